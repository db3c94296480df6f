"""Queries over the given tables, one for each family of operators, and their SQL.

Each entry of QUERIES takes (spark, sf_dir); ORACLE_SQL has DuckDB SQL for the same rows. Sums of prices are in whole
cents, so that they don't depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import kernels as K
from tallyforge.functions.decks import flips_of, rank_digits_of
from tallyforge.operators import exact, functional_graph, graphs, ranking, sampling, transfer, verify
from tallyforge.operators.loops import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


# Functional graphs -----------------------------------------------------------------------------------------------------


def customer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, nxt, n_nationkey): a customer's key squared plus one, modulo the number of customers; keys run from 0."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = customers.agg(F.count(F.lit(1)).alias("n"))
    return customers.crossJoin(n).select(F.col("c_custkey").alias("key"), K.quadratic(F.col("c_custkey"), 1, F.col("n")).alias("nxt"), "c_nationkey")  # n is one row


_ORBITS = """
    WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer),
    f AS (SELECT c_custkey AS k, (c_custkey * c_custkey + 1) % n AS y, c_nationkey FROM customer, n),
    o(s, x) AS (SELECT k, k FROM f UNION SELECT o.s, f.y FROM o JOIN f ON o.x = f.k),
    per AS (SELECT f.k FROM f JOIN o ON o.s = f.y AND o.x = f.k),
    st AS (SELECT o.s AS k, count(*) FILTER (WHERE per.k IS NULL) AS tail, count(per.k) AS len, min(per.k) AS cyc
           FROM o LEFT JOIN per ON per.k = o.x GROUP BY o.s)
"""


@query(
    _ORBITS
    + """
    , g AS (SELECT f.c_nationkey, st.*, tail = 0 AS periodic FROM st JOIN f USING (k)),
    m AS (SELECT c_nationkey, max(tail) AS max_tail FROM g GROUP BY 1)
    SELECT g.c_nationkey, count(*) AS nodes, CAST(sum(CAST(periodic AS BIGINT)) AS BIGINT) AS periodic, count(DISTINCT cyc) AS cycles, max(len) AS longest,
        CAST(sum(CASE WHEN periodic AND len = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fixed, max(tail) AS max_tail, CAST(sum(tail) AS BIGINT) AS sum_tail,
        count(*) FILTER (WHERE tail = m.max_tail) AS at_max_tail
    FROM g JOIN m USING (c_nationkey) GROUP BY 1"""
)
def functional_graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle and tail statistics of the customers' quadratic map, by nation."""
    graph = cut(customer_map(spark, sf_dir))
    stats = functional_graph.analyze(graph).join(graph.select("key", "c_nationkey"), "key")
    return functional_graph.report(stats, ["c_nationkey"])


@query(_ORBITS + "SELECT len AS cycle_len, count(DISTINCT cyc) AS cycles, count(*) AS nodes, CAST(sum(tail + len) AS BIGINT) AS sum_rho FROM st GROUP BY 1")
def cycle_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles by length, the keys that lead to them, and the sum of tail and cycle lengths."""
    stats = functional_graph.analyze(customer_map(spark, sf_dir))
    return stats.groupBy("cycle_len").agg(F.countDistinct("cycle").alias("cycles"), F.count(F.lit(1)).alias("nodes"), F.sum(F.col("tail") + F.col("cycle_len")).alias("sum_rho"))


@query(
    """WITH d AS (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, * FROM orders),
    n AS (SELECT a.o_orderkey AS k, coalesce(b.o_orderkey, a.o_orderkey) AS y FROM d a LEFT JOIN d b ON a.o_custkey = b.o_custkey AND b.i = a.i + 1)
    SELECT count(*) AS chains, CAST(max(c) - 1 AS BIGINT) AS longest_tail, CAST(sum(c * (c - 1) / 2) AS BIGINT) AS sum_tail FROM (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1)"""
)
def order_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that point to their customer's next one; a customer's last order is a fixed point."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    graph = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.coalesce(F.lead("o_orderkey").over(own), "o_orderkey").alias("nxt"))
    stats = functional_graph.analyze(graph)
    return stats.agg(F.countDistinct("cycle").alias("chains"), F.max("tail").alias("longest_tail"), F.sum("tail").alias("sum_tail"))


# Graphs ----------------------------------------------------------------------------------------------------------------

_TRADE = """
    t AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
    partner AS (SELECT a, b, n * count(*) OVER (PARTITION BY a) > sum(n) OVER (PARTITION BY a) AS major FROM t),
    e AS (SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst FROM partner WHERE major)
"""


def trade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): line items that customers of one nation have from suppliers of another."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("m"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    buyers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
    met = lines.join(orders, "l_orderkey").join(buyers, "c_custkey").join(sellers, "l_suppkey").where("src <> dst")
    return met.groupBy("src", "dst").agg(F.sum("m").alias("n"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Major partners: pairs of nations with more line items than the buying nation has with a partner on average."""
    counts = cut(trade_counts(spark, sf_dir))
    totals = counts.groupBy("src").agg(F.count(F.lit(1)).alias("partners"), F.sum("n").alias("total"))
    return cut(counts.join(totals, "src").where(F.col("n") * F.col("partners") > F.col("total")).select("src", "dst"))


def all_trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of nations that trade."""
    return cut(trade_counts(spark, sf_dir).select("src", "dst"))


@query(
    "WITH RECURSIVE "
    + _TRADE
    + """, p(first, head, mask, length) AS (
        SELECT DISTINCT src, src, CAST(1 AS BIGINT) << src, CAST(0 AS BIGINT) FROM e
        UNION ALL SELECT first, dst, mask | (CAST(1 AS BIGINT) << dst), length + 1 FROM p JOIN e ON src = head WHERE (mask >> dst) & 1 = 0 AND length < 4)
    SELECT length, count(*) AS paths, count(e.src) AS cyclic FROM p LEFT JOIN e ON e.src = p.head AND e.dst = p.first WHERE length > 0 GROUP BY 1"""
)
def simple_path_census(spark: SparkSession, sf_dir: str, edges_of=trade_edges) -> DataFrame:
    """Simple paths of up to four edges in the trade graph, and those that can close."""
    edges = edges_of(spark, sf_dir)
    found = graphs.simple_paths(edges, edges.select(F.col("src").alias("node")).distinct(), 4)
    return found.where("paths > 0")


@query(
    "WITH RECURSIVE "
    + _TRADE
    + """, p(first, head, mask, length) AS (
        SELECT DISTINCT src, src, CAST(1 AS BIGINT) << src, CAST(1 AS BIGINT) FROM e
        UNION ALL SELECT first, dst, mask | (CAST(1 AS BIGINT) << dst), length + 1 FROM p JOIN e ON src = head WHERE (mask >> dst) & 1 = 0 AND dst > first AND length < 5)
    SELECT length, count(*) AS cycles FROM p JOIN e ON e.src = p.head AND e.dst = p.first WHERE length > 1 GROUP BY 1"""
)
def directed_trade_cycles(spark: SparkSession, sf_dir: str, edges_of=trade_edges) -> DataFrame:
    """Directed cycles of two to five nations: a path that closes is found once from each of its nations."""
    edges = edges_of(spark, sf_dir)
    found = graphs.simple_paths(edges, edges.select(F.col("src").alias("node")).distinct(), 4)
    return found.where("cyclic > 0").select((F.col("length") + 1).alias("length"), (F.col("cyclic") / (F.col("length") + 1)).cast("long").alias("cycles"))


@query(
    "WITH RECURSIVE "
    + _TRADE
    + """, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(n, d) AS (SELECT min(src), CAST(0 AS BIGINT) FROM u UNION SELECT u.dst, d + 1 FROM w JOIN u ON u.src = w.n WHERE d < 24),
    o AS (SELECT n, row_number() OVER (ORDER BY d, n) AS pos FROM (SELECT n, min(d) AS d FROM w GROUP BY n)),
    s AS (SELECT least(a.pos, b.pos) AS a, greatest(a.pos, b.pos) AS b FROM (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM u) JOIN o a ON a.n = x JOIN o b ON b.n = y)
    SELECT CAST(max(c) AS BIGINT) AS width FROM (SELECT o.pos, count(*) AS c FROM o JOIN s ON s.a <= o.pos AND o.pos < s.b GROUP BY 1)"""
)
def breadth_first_cut_width(spark: SparkSession, sf_dir: str, edges_of=trade_edges) -> DataFrame:
    """How many edges of the trade graph span a gap at most, when nations are ordered breadth first from the least."""
    edges = edges_of(spark, sf_dir)
    root = edges.agg(F.coalesce(F.least(F.min("src"), F.min("dst")), F.lit(0)).alias("r")).first()["r"]
    return graphs.cut_width(edges, graphs.breadth_first(edges, root))


@query(
    """WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
    x AS (SELECT n, count(*) AS c FROM a GROUP BY 1), y AS (SELECT n, count(*) AS c FROM b GROUP BY 1)
    SELECT CAST(sum(x.c * y.c * gcd(x.n, y.n)) AS BIGINT) AS joint_cycles, CAST(max(lcm(x.n, y.n)) AS BIGINT) AS longest FROM x, y"""
)
def joint_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two histograms of numbers of orders as cycle lengths: cycles of the joint map, and the longest. Distinct numbers
    meet, which are few, never their rows."""
    orders = table(spark, sf_dir, "orders")
    one, two = (orders.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count(F.lit(1)).alias(c)).groupBy(c).agg(F.count(F.lit(1)).alias(f"c{c}")) for s, c in (("F", "x"), ("O", "y")))
    met = one.crossJoin(two).select((F.col("cx") * F.col("cy") * K.gcd(F.col("x"), F.col("y"))).alias("g"), K.lcm(F.col("x"), F.col("y")).alias("l"))
    return met.agg(F.sum("g").alias("joint_cycles"), F.max("l").alias("longest"))


@query(
    "WITH RECURSIVE "
    + _TRADE
    + """, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
    SELECT src, count(*) AS reached FROM r GROUP BY 1"""
)
def reachable_nations(spark: SparkSession, sf_dir: str, edges_of=trade_edges) -> DataFrame:
    return graphs.closure(edges_of(spark, sf_dir)).groupBy("src").agg(F.count(F.lit(1)).alias("reached"))


@query(
    "WITH RECURSIVE "
    + _TRADE
    + """, w(src, dst, d) AS (SELECT src, dst, CAST(1 AS BIGINT) FROM e UNION SELECT w.src, e.dst, d + 1 FROM w JOIN e ON w.dst = e.src WHERE d < 25),
    c AS (SELECT src, min(d) AS d FROM w WHERE src = dst GROUP BY 1)
    SELECT d AS girth, count(*) AS through FROM c WHERE d = (SELECT min(d) FROM c) GROUP BY 1"""
)
def shortest_trade_cycle(spark: SparkSession, sf_dir: str, edges_of=trade_edges) -> DataFrame:
    return graphs.girth(edges_of(spark, sf_dir))


@query(
    "WITH RECURSIVE "
    + _TRADE
    + """, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
    v AS (SELECT src AS n FROM e UNION SELECT dst FROM e),
    l AS (SELECT v.n, least(v.n, coalesce(min(a.dst), v.n)) AS comp FROM v LEFT JOIN (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src) a ON a.src = v.n GROUP BY v.n)
    SELECT comp AS component, count(*) AS size FROM l GROUP BY 1"""
)
def strong_components_of_trade(spark: SparkSession, sf_dir: str, edges_of=trade_edges) -> DataFrame:
    return graphs.strong_components(edges_of(spark, sf_dir)).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query(
    "WITH RECURSIVE "
    + _TRADE
    + """, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), v AS (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation),
    s(last, mask, size) AS (SELECT n, CAST(1 AS BIGINT) << n, CAST(1 AS BIGINT) FROM v
        UNION ALL SELECT v.n, mask | (CAST(1 AS BIGINT) << v.n), size + 1 FROM s JOIN v ON v.n > s.last WHERE size < 4 AND NOT EXISTS (SELECT 1 FROM u WHERE u.src = v.n AND (mask >> u.dst) & 1 = 1))
    SELECT size, count(*) AS sets FROM s GROUP BY 1"""
)
def independent_nations(spark: SparkSession, sf_dir: str, edges_of=trade_edges) -> DataFrame:
    """Sets of up to four nations without a trade edge among them, by size."""
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    return graphs.independent_sets(edges_of(spark, sf_dir), nodes, 4).where("sets > 0")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem),
    u AS (SELECT 2 * a AS s, 2 * b + 1 AS d FROM e UNION SELECT 2 * b + 1, 2 * a FROM e),
    r(s, d) AS (SELECT s, s FROM u UNION SELECT r.s, u.d FROM r JOIN u ON r.d = u.s)
    SELECT size, count(*) AS components FROM (SELECT c, count(*) AS size FROM (SELECT s, min(d) AS c FROM r GROUP BY s) GROUP BY c) GROUP BY size"""
)
def supplier_part_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of suppliers and parts that any line item links; by size."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    edges = lines.select((2 * F.col("l_suppkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst"))
    sizes = graphs.components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("components"))


@query(
    "WITH "
    + _TRADE
    + """, d AS (SELECT dst, count(*) AS degree FROM e GROUP BY 1) SELECT degree, count(*) AS nodes FROM d GROUP BY 1"""
)
def in_degree_histogram(spark: SparkSession, sf_dir: str, edges_of=trade_edges) -> DataFrame:
    edges = edges_of(spark, sf_dir)
    return graphs.degree_profile(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("WITH " + _TRADE + ", x AS (SELECT a.src, a.dst FROM e a LEFT JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE b.src IS NULL) SELECT 'one_way' AS fault, count(*) AS edges FROM x HAVING count(*) > 0")
def trade_graph_faults(spark: SparkSession, sf_dir: str, edges_of=trade_edges) -> DataFrame:
    """Edges that an undirected graph couldn't have."""
    found = graphs.validated(edges_of(spark, sf_dir), 25)
    return found.groupBy("fault").agg(F.count(F.lit(1)).alias("edges"))


def over_all_trade(f) -> None:
    """Register ``f`` over all pairs of nations too, as NAME_of_all_pairs; its SQL is that of ``f`` without the choice of partners."""
    name = f"{f.__name__}_of_all_pairs"
    QUERIES[name] = partial(f, edges_of=all_trade_edges)
    ORACLE_SQL[name] = ORACLE_SQL[f.__name__].replace(" WHERE major", "")


for _f in (simple_path_census, directed_trade_cycles, breadth_first_cut_width, reachable_nations, shortest_trade_cycle, strong_components_of_trade, independent_nations, in_degree_histogram, trade_graph_faults):
    over_all_trade(_f)


# Tournaments -----------------------------------------------------------------------------------------------------------

_BEATS = """
    m AS (SELECT p_brand AS i, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS t, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    r AS (SELECT a.i AS a, b.i AS b, CAST(sign(sum(sign(a.x - b.x))) AS BIGINT) AS rel FROM m a JOIN m b ON a.t = b.t AND a.i < b.i GROUP BY 1, 2),
    w AS (SELECT a AS w, b AS l FROM r WHERE rel = 1 UNION ALL SELECT b, a FROM r WHERE rel = -1)
"""


def brand_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, rel): which of two brands has the greater monthly revenue more often."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", cents("l_extendedprice").alias("x"))
    months = lines.join(parts, "l_partkey").groupBy("p_brand", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("t")).agg(F.sum("x").alias("x"))
    return cut(graphs.tournament(months, "p_brand", "t", "x"))


@query(
    "WITH "
    + _BEATS
    + """, o AS (SELECT w, count(*) AS n FROM w GROUP BY 1)
    SELECT (SELECT count(DISTINCT i) FROM m) AS items, (SELECT count(*) FROM r WHERE rel = 0) AS ties, (SELECT max(n) FROM o) AS max_out,
        (SELECT count(*) FROM o WHERE n = (SELECT max(n) FROM o)) AS at_max,
        (SELECT CAST(count(*) / 3 AS BIGINT) FROM w a JOIN w b ON a.l = b.w JOIN w c ON b.l = c.w AND c.l = a.w) AS cyc3,
        (SELECT count(*) FROM w a JOIN w b ON a.l = b.w JOIN w c ON c.w = a.w AND c.l = b.l) AS trans3"""
)
def brand_tournament_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.invariants(brand_tournament(spark, sf_dir))


@query(
    "WITH RECURSIVE "
    + _BEATS
    + """, reach(s, d) AS (SELECT w, l FROM w UNION SELECT reach.s, w.l FROM reach JOIN w ON reach.d = w.w),
    c AS (SELECT i, least(i, coalesce(min(x.d), i)) AS comp FROM (SELECT DISTINCT w AS i FROM w UNION SELECT l FROM w) v LEFT JOIN (SELECT a.s, a.d FROM reach a JOIN reach b ON a.s = b.d AND a.d = b.s) x ON x.s = v.i GROUP BY i)
    SELECT comp AS component, count(*) AS size FROM c GROUP BY 1"""
)
def brand_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = brand_tournament(spark, sf_dir)
    wins = relation.where("rel = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")).union(relation.where("rel = -1").select("b", "a"))
    return graphs.strong_components(wins).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query(
    "WITH "
    + _BEATS
    + """, two_way AS (SELECT a, b, rel FROM r UNION ALL SELECT b, a, -rel FROM r)
    SELECT count(*) AS pairs, count(*) FILTER (WHERE x.rel + y.rel <> 0) AS broken FROM two_way x JOIN two_way y ON x.a = y.b AND x.b = y.a"""
)
def tournament_antisymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation turned round must be its negative."""
    one = brand_tournament(spark, sf_dir)
    both = one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b"), -F.col("rel")))
    turned = both.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("rel").alias("other"))
    return both.join(turned, ["a", "b"]).agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("rel") + F.col("other") != 0).cast("long")).alias("broken"))


# Transfer and dynamic programs -----------------------------------------------------------------------------------------

_BIGRAMS = """
    l AS (SELECT event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events),
    g AS (SELECT a AS i, b AS j, count(*) AS v FROM l WHERE a IS NOT NULL GROUP BY 1, 2)
"""


def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, v): how often an event type follows another for a user."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select(F.lag("event_type").over(own).alias("i"), F.col("event_type").alias("j"))
    return pairs.where("i IS NOT NULL").groupBy("i", "j").agg(F.count(F.lit(1)).alias("v"))


@query("WITH " + _BIGRAMS + "SELECT a.i, b.j, CAST(sum(a.v * b.v) % 1000003 AS BIGINT) AS v FROM g a JOIN g b ON a.j = b.i GROUP BY 1, 2")
def event_matrix_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = cut(bigrams(spark, sf_dir))
    return transfer.multiply(one, one, 1_000_003)


@query(
    "WITH "
    + _BIGRAMS
    + """, one AS (SELECT j AS s, CAST(sum(v) AS HUGEINT) AS c FROM g GROUP BY 1), two AS (SELECT j AS s, sum(c * v) AS c FROM one JOIN g ON i = s GROUP BY 1),
    three AS (SELECT j AS s, sum(c * v) AS c FROM two JOIN g ON i = s GROUP BY 1)
    SELECT s AS state, CAST(c % 1000000007 AS BIGINT) AS cnt FROM three"""
)
def event_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted walks of three steps over event types, by their last one."""
    moves = cut(bigrams(spark, sf_dir).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("w")))
    start = moves.groupBy(F.col("src").alias("state")).agg(F.lit(1).alias("cnt"))
    return transfer.iterate(start, moves, 3, 1_000_000_007).select("state", F.col("cnt").cast("long").alias("cnt"))


@query(
    """WITH k AS (SELECT o_custkey, bit_or(CAST(1 AS BIGINT) << CAST(month(o_orderdate) - 1 AS BIGINT)) AS x FROM orders GROUP BY 1),
    s AS (SELECT x, (SELECT bit_or(((CAST(30 AS BIGINT) >> (4 * ((x >> ((i + 1) % 12)) & 1) + 2 * ((x >> i) & 1) + ((x >> ((i + 11) % 12)) & 1))) & 1) << i) FROM range(12) r(i)) AS y FROM (SELECT DISTINCT x FROM k))
    SELECT count(*) AS states, count(DISTINCT y) AS images FROM s"""
)
def automaton_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' ordering months as rings of 12 cells; how many states, and how many after one step of rule 30."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.month("o_orderdate") - 1)
    states = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bit_or(one).alias("x")).select("x").distinct()
    return states.agg(F.count(F.lit(1)).alias("states"), F.countDistinct(K.automaton_step(30, 12, F.col("x"))).alias("images"))


@query(
    """WITH p AS (SELECT l_orderkey AS k, list_reverse_sort(list(CAST(l_quantity AS BIGINT))) AS q FROM lineitem GROUP BY 1),
    a AS (SELECT k, list_reverse_sort(list_filter(list_append(list_transform(q, lambda x: x - 1), CAST(len(q) AS BIGINT)), lambda x: x > 0)) AS q FROM p),
    b AS (SELECT k, list_reverse_sort(list_filter(list_append(list_transform(q, lambda x: x - 1), CAST(len(q) AS BIGINT)), lambda x: x > 0)) AS q FROM a),
    c AS (SELECT k, list_reverse_sort(list_filter(list_append(list_transform(q, lambda x: x - 1), CAST(len(q) AS BIGINT)), lambda x: x > 0)) AS q FROM b)
    SELECT CAST(len(q) AS BIGINT) AS piles, count(*) AS orders, CAST(sum(q[1]) AS BIGINT) AS sum_largest, count(DISTINCT array_to_string(q, ',')) AS states FROM c GROUP BY 1"""
)
def solitaire_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' quantities as piles, after three moves that take one from each pile to a new one."""
    piles = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("long")), asc=False).alias("q"))
    for _ in range(3):
        piles = piles.select("l_orderkey", K.solitaire(F.col("q")).alias("q"))
    return piles.groupBy(F.size("q").cast("long").alias("piles")).agg(F.count(F.lit(1)).alias("orders"), F.sum(F.get("q", F.lit(0))).alias("sum_largest"), F.countDistinct("q").alias("states"))


# Permutations and words ------------------------------------------------------------------------------------------------

_DECKS = """
    i AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS pos,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS val, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    d AS (SELECT k, list(val ORDER BY pos) AS p, min(n) AS n FROM i GROUP BY 1)
"""


def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, p): an order's items by line number as a permutation of their price ranks."""
    tie = ["l_partkey", "l_suppkey"]
    by_line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", *tie, "l_extendedprice", "l_shipdate", "l_quantity")
    by_price = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber", *tie, "l_shipdate", "l_quantity")
    ranked = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(by_line).alias("pos"), F.row_number().over(by_price).alias("val"))
    found = ranked.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", "val"))).alias("l"))
    return found.select(F.col("l_orderkey").alias("k"), F.transform("l", lambda x: x["val"]).alias("p"))


@query(
    "WITH RECURSIVE "
    + _DECKS
    + """, g(k, p, n, t) AS (SELECT k, p, n, CAST(0 AS BIGINT) FROM d UNION ALL SELECT k, list_concat(list_reverse(p[1:p[1]]), p[p[1]+1:]), n, t + 1 FROM g WHERE p[1] <> 1),
    f AS (SELECT k, n, max(t) AS t FROM g GROUP BY 1, 2), m AS (SELECT n, max(t) AS most FROM f GROUP BY 1)
    SELECT f.n AS size, count(*) AS decks, CAST(sum(t) AS BIGINT) AS flips, max(t) AS most, count(*) FILTER (WHERE t = most) AS at_most FROM f JOIN m USING (n) GROUP BY 1"""
)
def topswops_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flips until the cheapest item is on top: totals and worst cases by deck size. Each distinct deck is played once,
    with as many flips as it needs."""
    flips = decks(spark, sf_dir).groupBy("p").agg(F.count(F.lit(1)).alias("times")).select(F.size("p").cast("long").alias("size"), flips_of("p").alias("t"), "times")
    by_count = flips.groupBy("size", "t").agg(F.sum("times").alias("n"))
    return by_count.groupBy("size").agg(F.sum("n").alias("decks"), F.sum(F.col("n") * F.col("t")).alias("flips"), F.max("t").alias("most"), F.max_by("n", "t").alias("at_most"))


@query(
    "WITH "
    + _DECKS
    + """, u AS (SELECT k, n, unnest(p) AS v, generate_subscripts(p, 1) AS i FROM d),
    c AS (SELECT a.k, a.n, a.i, count(b.v) AS s FROM u a LEFT JOIN u b ON a.k = b.k AND b.i > a.i AND b.v < a.v GROUP BY 1, 2, 3)
    SELECT n AS size, digits, count(*) AS decks FROM (SELECT k, n, list(s ORDER BY i) AS digits FROM c GROUP BY 1, 2) GROUP BY 1, 2"""
)
def permutation_rank_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their rank among the permutations of their size, as digits in the factorial base: beyond 20 items ranks
    don't fit into 64 bits."""
    counted = decks(spark, sf_dir).groupBy("p").agg(F.count(F.lit(1)).alias("decks"))
    return counted.select(F.size("p").cast("long").alias("size"), rank_digits_of("p").alias("digits"), "decks")


@query("WITH " + _DECKS + ", u AS (SELECT k, n, unnest(p) AS v, generate_subscripts(p, 1) AS i FROM d) SELECT n AS size, count(*) AS decks, CAST(sum(CAST(f = 0 AS BIGINT)) AS BIGINT) AS gardens FROM (SELECT k, n, count(*) FILTER (WHERE i > 1 AND v = i) AS f FROM u GROUP BY 1, 2) GROUP BY 1")
def decks_without_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = decks(spark, sf_dir).select(F.size("p").cast("long").alias("size"), K.no_fixed_point_after_first(F.col("p")).alias("garden"))
    return flagged.groupBy("size").agg(F.count(F.lit(1)).alias("decks"), F.sum(F.col("garden").cast("long")).alias("gardens"))


_WORDS = """
    s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, left(event_type, 1) AS c FROM events),
    w AS (SELECT DISTINCT a.c || b.c || d.c AS w FROM s a JOIN s b ON a.user_id = b.user_id AND b.i = a.i + 1 JOIN s d ON a.user_id = d.user_id AND d.i = a.i + 2)
"""


def event_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(w): distinct words of three successive events' first letters; at most the cube of the number of types."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    letter = F.left("event_type", F.lit(1))
    triples = table(spark, sf_dir, "events").select(F.lag(letter, 2).over(own).alias("a"), F.lag(letter).over(own).alias("b"), letter.alias("c"))
    return triples.where("a IS NOT NULL").select(F.concat("a", "b", "c").alias("w")).distinct()


def _corr_sql(a: str, b: str) -> str:
    return "(" + " + ".join(f"CASE WHEN right({a}, {j}) = left({b}, {j}) THEN {5 ** (j - 1)} ELSE 0 END" for j in (1, 2, 3)) + ")"


@query(
    "WITH "
    + _WORDS
    + f""", p AS (SELECT a.w AS a, b.w AS b, CAST({_corr_sql("b.w", "b.w")} - {_corr_sql("b.w", "a.w")} AS BIGINT) AS x, CAST({_corr_sql("a.w", "a.w")} - {_corr_sql("a.w", "b.w")} AS BIGINT) AS y FROM w a JOIN w b ON a.w < b.w)
    SELECT CAST(sign(x - y) AS BIGINT) AS rel, count(*) AS pairs, count(DISTINCT (x // greatest(gcd(x, x + y), 1)) || '/' || ((x + y) // greatest(gcd(x, x + y), 1))) AS chances FROM p GROUP BY 1"""
)
def word_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two event words would come up first on a die of five sides; distinct chances as fractions."""
    words = cut(event_words(spark, sf_dir))
    pairs = words.select(F.col("w").alias("a")).join(words.select(F.col("w").alias("b")), F.col("a") < F.col("b"))  # words are few, whatever the table's size
    odds = pairs.select(K.odds(F.col("a"), F.col("b"), 3, 5).alias("o")).select("o.num", "o.den")
    g = F.greatest(K.gcd(F.col("num"), F.col("den")), F.lit(1))
    fraction = F.concat_ws("/", (F.col("num") / g).cast("long").cast("string"), (F.col("den") / g).cast("long").cast("string"))
    rel = F.signum(2 * F.col("num") - F.col("den")).cast("long").alias("rel")
    return odds.select(rel, fraction.alias("f")).groupBy("rel").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("f").alias("chances"))


# Exact aggregates ------------------------------------------------------------------------------------------------------

_STREAK = """
    l AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events),
    h AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view' AND nxt IS NOT NULL) AS o, count(*) FILTER (WHERE event_type = 'view' AND nxt = 'view') AS h FROM l GROUP BY 1)
"""


@query(
    "WITH "
    + _STREAK
    + """, r AS (SELECT count(*) AS n, list_reduce(list(DISTINCT o), lambda a, b: lcm(a, b)) AS c FROM h WHERE o > 0),
    s AS (SELECT CAST(sum(h * (r.c // o)) AS BIGINT) AS top, any_value(r.n) AS n, any_value(r.c) AS c FROM h, r WHERE o > 0)
    SELECT CAST(n AS BIGINT) AS n, CAST(top // gcd(top, n * c) AS BIGINT) AS num, CAST(n * c // gcd(top, n * c) AS BIGINT) AS den FROM s"""
)
def streak_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact mean over users of the share of views that a view follows."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select("user_id", "event_type", F.lead("event_type").over(own).alias("nxt"))
    view, seen = F.col("event_type") == "view", F.col("nxt").isNotNull()
    shares = pairs.groupBy("user_id").agg(F.count_if(view & seen).alias("o"), F.count_if(view & (F.col("nxt") == "view")).alias("h"))
    return exact.rational_mean(shares, [], "h", "o")


@query("WITH " + _STREAK + "SELECT o, h, count(*) AS users FROM h GROUP BY 1, 2")
def streak_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select("user_id", "event_type", F.lead("event_type").over(own).alias("nxt"))
    view, seen = F.col("event_type") == "view", F.col("nxt").isNotNull()
    return pairs.groupBy("user_id").agg(F.count_if(view & seen).alias("o"), F.count_if(view & (F.col("nxt") == "view")).alias("h")).groupBy("o", "h").agg(F.count(F.lit(1)).alias("users"))


@query(
    """WITH m AS (SELECT o_orderpriority || o_orderstatus AS k, bit_xor(CAST(1 AS BIGINT) << (CAST(substr(p_brand, 7) AS BIGINT) - 1)) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1),
    i AS (SELECT m, row_number() OVER (ORDER BY k) - 1 AS i FROM m), n AS (SELECT count(*) AS n FROM i),
    z AS (SELECT s, bit_xor(CASE WHEN (s >> i) & 1 = 1 THEN m ELSE 0 END) AS x FROM range(32768) r(s), i WHERE s < (CAST(1 AS BIGINT) << (SELECT n FROM n)) GROUP BY s)
    SELECT n AS rows, CAST(n - round(log2((SELECT count(*) FROM z WHERE x = 0))) AS BIGINT) AS rank FROM n"""
)
def parity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank over GF(2) of the parities of line items by order priority and status, and brand."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat("o_orderpriority", "o_orderstatus").alias("k"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), K.place_in_mask(F.substring("p_brand", 7, 9).cast("int") - 1).cast("int").alias("b"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey").join(parts, "l_partkey")
    masks = lines.groupBy("k").agg(F.bit_xor(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("m"))
    return exact.gf2_rank(masks, [], "k", "m")


@query("SELECT l_returnflag, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS signed_cents, CAST(sum(l_linenumber * CAST(l_quantity AS BIGINT)) AS BIGINT) AS weighted FROM lineitem GROUP BY 1")
def signed_and_weighted_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag").agg(exact.signed_sum(cents("l_extendedprice"), F.col("l_linenumber")).alias("signed_cents"), F.sum(F.col("l_linenumber") * F.col("l_quantity").cast("long")).alias("weighted"))


@query(
    """WITH c AS (SELECT o_custkey, list(DISTINCT n) AS ns, CAST(count(*) AS BIGINT) AS orders FROM (SELECT o_custkey, l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1)
    SELECT CAST(list_reduce(ns, lambda a, b: lcm(a, b)) AS BIGINT) AS period, count(*) AS customers FROM c GROUP BY 1"""
)
def order_size_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least common multiple of a customer's order sizes, as a histogram."""
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    own = sizes.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").groupBy("o_custkey").agg(F.collect_set("n").alias("ns"))
    return own.select(K.lcm_of(F.col("ns")).alias("period")).groupBy("period").agg(F.count(F.lit(1)).alias("customers"))


@query(
    """WITH RECURSIVE q AS (SELECT l_orderkey, list(CAST(l_quantity AS BIGINT) ORDER BY l_quantity) AS q FROM lineitem GROUP BY 1)
    SELECT list_reduce(list_prepend(CAST(1 AS BIGINT), q), lambda a, b: (a * b) % 10007) % 10 AS digit, count(*) AS orders FROM q GROUP BY 1"""
)
def quantity_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of an order's quantities modulo 10007, by last digit."""
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("long")).alias("q"))
    return orders.select((K.product_of(F.col("q"), 10007) % 10).alias("digit")).groupBy("digit").agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT s_nationkey, bit_or(CAST(1 AS BIGINT) << (l_linenumber - 1)) AS any_line, bit_xor(CAST(l_partkey AS BIGINT)) AS xor_parts, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def bit_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber").join(sellers, "l_suppkey")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("l_linenumber") - 1)
    return lines.groupBy("s_nationkey").agg(F.bit_or(one).alias("any_line"), F.bit_xor("l_partkey").alias("xor_parts"), F.countDistinct("l_partkey").alias("parts"))


@query(
    """WITH g AS (SELECT DISTINCT l_orderkey, l_linenumber - 1 AS v FROM lineitem), c AS (SELECT l_orderkey FROM g GROUP BY 1),
    m AS (SELECT c.l_orderkey, min(r.i) AS mex FROM c, range(20) r(i) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.l_orderkey = c.l_orderkey AND g.v = r.i) GROUP BY 1)
    SELECT mex, count(*) AS orders FROM m GROUP BY 1"""
)
def missing_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least line number, from 0, that an order lacks."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber") - 1).alias("s"))
    return sets.select(K.mex(F.col("s")).alias("mex")).groupBy("mex").agg(F.count(F.lit(1)).alias("orders"))


@query(
    """WITH h AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
    SELECT CASE WHEN n % 2 = 1 THEN 1 ELSE 0 END AS parity, n, count(*) AS customers FROM h GROUP BY 1, 2"""
)
def game_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' numbers of orders as heaps from which 1 or 3 may be taken: a heap's value is its parity, and comes
    from the recursion here."""
    heaps = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("customers"))
    # the last three values are enough for the next one
    value = F.aggregate(
        F.sequence(F.lit(1), F.col("n")),
        F.expr("array(-1, -1, 0)"),
        lambda g, i: F.concat(F.slice(g, 2, 2), F.array(K.mex(F.filter(F.array(F.get(g, F.lit(2)), F.get(g, F.lit(0))), lambda x: x >= 0)).cast("int"))),
        lambda g: F.element_at(g, -1),
    )
    return heaps.select(value.cast("int").alias("parity"), "n", "customers")


# Windows, ranks and sets -----------------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT c_nationkey, o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    d AS (SELECT c_nationkey, day, CAST(sum(x) AS BIGINT) AS x FROM (SELECT c_nationkey, a AS day, 1 AS x FROM s UNION ALL SELECT c_nationkey, b, -1 FROM s) GROUP BY 1, 2)
    SELECT c_nationkey, CAST(max(w) AS BIGINT) AS width FROM (SELECT c_nationkey, sum(x) OVER (PARTITION BY c_nationkey ORDER BY day ROWS UNBOUNDED PRECEDING) AS w FROM d) GROUP BY 1"""
)
def cut_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most customers of a nation between first and last order at a time; days are summed before the running sum."""
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    spans = table(spark, sf_dir, "orders").join(buyers, "o_custkey").groupBy("c_nationkey", "o_custkey").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    ends = spans.select("c_nationkey", F.explode(F.array(F.struct(F.col("a").alias("day"), F.lit(1).alias("x")), F.struct(F.col("b").alias("day"), F.lit(-1).alias("x")))).alias("e")).select("c_nationkey", "e.*")
    days = ends.groupBy("c_nationkey", "day").agg(F.sum("x").alias("x"))
    own = Window.partitionBy("c_nationkey").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("c_nationkey", F.sum("x").over(own).alias("w")).groupBy("c_nationkey").agg(F.max("w").alias("width"))


@query(
    """WITH m AS (SELECT c_nationkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS t, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    l AS (SELECT *, lag(n) OVER (PARTITION BY c_nationkey ORDER BY t) AS before FROM m)
    SELECT c_nationkey, count(*) FILTER (WHERE n > before) AS rises, count(*) FILTER (WHERE n < before) AS falls, CAST(max(n * 1000 // before) AS BIGINT) AS best_growth FROM l GROUP BY 1"""
)
def monthly_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with more and with fewer orders than the one before, and the best ratio in thousandths."""
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    months = table(spark, sf_dir, "orders").join(buyers, "o_custkey").groupBy("c_nationkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    stepped = verify.steps(months, ["c_nationkey"], "t", "n")
    return stepped.groupBy("c_nationkey").agg(F.count_if(F.col("n") > F.col("before")).alias("rises"), F.count_if(F.col("n") < F.col("before")).alias("falls"), F.max(F.floor(F.col("n") * 1000 / F.col("before"))).alias("best_growth"))


@query("SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS k FROM part")
def price_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's price rank within its brand."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return ranking.ranks(parts, ["p_brand"], ["p_retailprice", "p_partkey"]).select("p_brand", "p_partkey", "k")


@query(
    """WITH n AS (SELECT c_nationkey, o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), m AS (SELECT c_nationkey, max(n) AS most FROM n GROUP BY 1)
    SELECT n.c_nationkey, most, count(*) AS customers, min(o_custkey) AS first FROM n JOIN m ON n.c_nationkey = m.c_nationkey AND n.n = m.most GROUP BY 1, 2"""
)
def top_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest number of orders of a customer in each nation, and who has it. Two aggregations, no sort."""
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).join(buyers, "o_custkey")
    by_count = counts.groupBy("c_nationkey", "n").agg(F.count(F.lit(1)).alias("customers"), F.min("o_custkey").alias("first"))
    top = by_count.groupBy("c_nationkey").agg(F.max(F.struct("n", "customers", "first")).alias("t"))
    return top.select("c_nationkey", F.col("t.n").alias("most"), "t.customers", "t.first")


@query(
    """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997)
    SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS in_both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS left_out"""
)
def customer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of two years: union, intersection and difference, by one aggregation of flags."""
    year = F.year("o_orderdate")
    flags = table(spark, sf_dir, "orders").where(year.isin(1996, 1997)).groupBy("o_custkey").agg(F.max((year == 1996).cast("int")).alias("a"), F.max((year == 1997).cast("int")).alias("b"))
    return flags.agg(F.count(F.lit(1)).alias("either"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("in_both"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("left_out"))


@query(
    """WITH g AS (SELECT CAST(c_nationkey AS BIGINT) + 1 AS m, year(o_orderdate) - 1994 AS n, count(*) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT CAST((m + n - 2) * (m + n - 1) // 2 + n AS BIGINT) AS idx, v FROM g"""
)
def antidiagonal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by nation and year, read by antidiagonals."""
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey").cast("long") + 1).alias("m"))
    counts = table(spark, sf_dir, "orders").join(buyers, "o_custkey").groupBy("m", (F.year("o_orderdate") - 1994).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("v"))
    return verify.antidiagonal(counts, "m", "n").select("idx", "v")


# Verification ----------------------------------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT l_orderkey AS k, count(*) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, CAST(max(l_linenumber) AS BIGINT) AS v FROM lineitem WHERE l_quantity >= 3 GROUP BY 1)
    SELECT CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'missing' WHEN a.v = b.v THEN 'match' ELSE 'mismatch' END AS status, count(*) AS orders FROM a FULL JOIN b ON a.k = b.k GROUP BY 1"""
)
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order against its greatest line number, as two results that ought to agree."""
    lines = table(spark, sf_dir, "lineitem")
    computed = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("val"))
    golden = lines.where("l_quantity >= 3").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linenumber").cast("long").alias("val"))
    return verify.reconcile(computed, golden, ["k"]).groupBy("status").agg(F.count(F.lit(1)).alias("orders"))


@query(
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)
    SELECT o_orderstatus, count(*) AS jobs, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS weight FROM f WHERE r = 1 GROUP BY 1"""
)
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's first order wins; the rest of the log is dropped."""
    log = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", cents("o_totalprice").alias("w"))
    first = verify.first_wins(log, "o_custkey", ["o_orderdate", "o_orderkey"])
    return first.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("jobs"), F.sum("w").alias("weight"))


@query("SELECT c_nationkey, count(*) AS missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def missing_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of status P, by nation."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return customers.join(done, "k", "left_anti").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("missing"))


@query(
    """WITH s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS t FROM events GROUP BY 1), p AS (SELECT user_id, t[1:3] AS h FROM s), k AS (SELECT DISTINCT h FROM p WHERE user_id % 3 = 0 AND len(h) = 3)
    SELECT h[1] AS first_type, count(*) AS unseen FROM p WHERE user_id % 3 <> 0 AND h NOT IN (SELECT h FROM k) GROUP BY 1"""
)
def unseen_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose first three events are no catalogued user's; every third user is the catalogue."""
    events = ranking.ranks(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).where("k <= 3")
    first = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("k", "event_type"))).alias("l"))  # three at most
    sequences = cut(first.select("user_id", F.transform("l", lambda x: x["event_type"]).alias("terms")))
    unseen = verify.unseen_prefixes(sequences.where("user_id % 3 <> 0"), sequences.where("user_id % 3 = 0"), "terms", 3)
    return unseen.groupBy(F.get("terms", F.lit(0)).alias("first_type")).agg(F.count(F.lit(1)).alias("unseen"))


@query(
    """WITH q AS (SELECT l_orderkey, array_to_string(list_sort(list(CAST(l_quantity AS BIGINT))), ',') AS key, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT n AS items, count(DISTINCT key) AS keys, count(*) AS orders FROM q GROUP BY 1"""
)
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' quantities as sorted keys: how many are distinct, by number of items."""
    keys = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("long"))).alias("key"))
    return keys.groupBy(F.size("key").cast("long").alias("items")).agg(F.countDistinct("key").alias("keys"), F.count(F.lit(1)).alias("orders"))


@query(
    """WITH h AS (SELECT l_returnflag, CASE WHEN CAST('0x' || left(md5(CAST(l_orderkey AS VARCHAR)), 1) AS INTEGER) < 4 THEN 1 ELSE 0 END AS s FROM lineitem)
    SELECT l_returnflag, count(*) AS exact, CAST(sum(s) AS BIGINT) AS sampled, CAST(sum(s) * 4 AS BIGINT) AS estimate FROM h GROUP BY 1"""
)
def sampled_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items counted in full and estimated from a quarter of the orders, chosen by hash."""
    chosen = sampling.hash_share(F.col("l_orderkey"), 4)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("exact"), F.count_if(chosen).alias("sampled"), (F.count_if(chosen) * 4).alias("estimate"))


@query(
    """SELECT CAST(p_size AS BIGINT) AS n, count(*) AS parts, CAST((SELECT count(*) FROM range(1, 51) r(i) WHERE i <= p_size AND gcd(i, p_size) = 1) AS BIGINT) AS totient,
        CAST(p_size > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 50) r(i) WHERE i < p_size AND p_size % i = 0) AS BOOLEAN) AS prime FROM part GROUP BY p_size"""
)
def size_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes with their totient and whether they are prime."""
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("parts"))
    return sizes.select("n", "parts", K.totient(F.col("n")).alias("totient"), K.is_prime(F.col("n")).alias("prime"))
