"""More queries over the given tables: structure of relations, parameter sweeps, estimates, file round trips. They are
registered with those of queries.py."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import kernels as K
from tallyforge.operators import exact, functional_graph, graphs, verify
from tallyforge.operators.loops import cut, shared_folder
from tallyforge.plans.queries import _BEATS, _ORBITS, _TRADE, brand_tournament, customer_map, query, table, trade_edges
from tallyforge.sources import readers, writers

# Relations -------------------------------------------------------------------------------------------------------------


@query(
    "WITH "
    + _BEATS
    + """, v AS (SELECT DISTINCT i FROM m), o AS (SELECT v.i, count(w.l) AS d FROM v LEFT JOIN w ON w.w = v.i GROUP BY 1),
    two AS (SELECT w AS s, l AS d FROM w UNION SELECT a.w, b.l FROM w a JOIN w b ON a.l = b.w WHERE a.w <> b.l),
    k AS (SELECT s FROM two GROUP BY 1 HAVING count(*) = (SELECT count(*) - 1 FROM v)),
    x AS (SELECT row_number() OVER (ORDER BY d, i) AS r, d FROM o), c AS (SELECT r, sum(d) OVER (ORDER BY r) - r * (r - 1) // 2 AS slack FROM x)
    SELECT (SELECT count(*) FROM v) AS items, (SELECT min(d) FROM o) AS least_wins, (SELECT max(d) FROM o) AS most_wins, (SELECT min(d) = max(d) FROM o) AS regular,
        (SELECT count(DISTINCT d) = count(*) FROM o) AS transitive, (SELECT count(*) FROM k) AS kings, (SELECT count(*) FROM c WHERE slack = 0) AS blocks"""
)
def tournament_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of tournament the brands' monthly revenues make: whether it is regular or transitive, how many kings
    (who beat every other in one step or two) it has, and how many prefixes of the score sequence win no game outside."""
    relation = brand_tournament(spark, sf_dir)
    return graphs.structure_report(relation)


@query(
    "WITH RECURSIVE "
    + _TRADE
    + """, w(first, head, path, d) AS (SELECT src, dst, [src, dst], CAST(1 AS BIGINT) FROM e UNION ALL SELECT first, dst, list_append(path, dst), d + 1 FROM w JOIN e ON src = head
        WHERE d < 3 AND head <> first AND (dst = first OR NOT list_contains(path, dst))),
    c AS (SELECT path, d FROM w WHERE head = first)
    SELECT d AS girth, array_to_string(min(path), '-') AS witness FROM c WHERE d = (SELECT min(d) FROM c) GROUP BY 1"""
)
def trade_girth_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest directed cycle among major partners, and the first such cycle; the search ends at its length."""
    return graphs.girth_witness(trade_edges(spark, sf_dir))


@query(
    "WITH RECURSIVE "
    + _TRADE
    + """, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), v AS (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation),
    s(last, mask, size) AS (SELECT n, CAST(1 AS BIGINT) << n, CAST(1 AS BIGINT) FROM v
        UNION ALL SELECT v.n, mask | (CAST(1 AS BIGINT) << v.n), size + 1 FROM s JOIN v ON v.n > s.last WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.src = v.n AND (mask >> u.dst) & 1 = 1))
    SELECT size AS largest, count(*) AS sets FROM s WHERE size = (SELECT max(size) FROM s) GROUP BY 1"""
)
def largest_independent_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most nations without a major partner among them, and how many such sets there are."""
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    return graphs.largest_independent_sets(trade_edges(spark, sf_dir), nodes)


_CLASS = "CASE event_type WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END"
_PRODUCT = " | ".join(f"(((({{a}} >> {3 * i + k}) & 1) & (({{b}} >> {3 * k + j}) & 1)) << {3 * i + j})" for i in range(3) for j in range(3) for k in range(3))


def _each(values: list) -> Column:
    """A row for each of a few values."""
    return F.explode(F.array(*[F.lit(v) for v in values]))


def _boolean_product(a: Column, b: Column) -> Column:
    """The product of two boolean matrices of 3 x 3, as masks of 9 bits."""
    terms = [F.shiftleft(K.bit(a, F.lit(3 * i + k)).bitwiseAND(K.bit(b, F.lit(3 * k + j))).cast("long"), 3 * i + j) for i in range(3) for j in range(3) for k in range(3)]
    return reduce(Column.bitwiseOR, terms)


@query(
    f"""WITH RECURSIVE l AS (SELECT user_id, CAST({_CLASS} AS BIGINT) AS b, lag(CAST({_CLASS} AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events),
    g AS (SELECT DISTINCT m FROM (SELECT user_id, bit_or(CAST(1 AS BIGINT) << (3 * a + b)) AS m FROM l WHERE a IS NOT NULL GROUP BY 1)),
    r(m) AS (SELECT m FROM g UNION SELECT {_PRODUCT.format(a="r.m", b="g.m")} FROM r, g)
    SELECT (SELECT count(*) FROM g) AS generators, count(*) AS elements, count(*) FILTER (WHERE {_PRODUCT.format(a="m", b="m")} = m) AS idempotents, bit_and(m) AS shared FROM r"""
)
def transition_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' successions of views, purchases and other events as boolean matrices: how many products of them there are.
    There are 512 matrices at most, whatever the number of users."""
    kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    from pyspark.sql import Window

    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select("user_id", F.lag(kind).over(own).alias("a"), kind.alias("b")).where("a IS NOT NULL")
    masks = pairs.groupBy("user_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("a") * 3 + F.col("b"))).alias("m"))
    generators = cut(masks.select("m").distinct())
    each = _each([r["m"] for r in generators.limit(512).collect()])  # all there can be
    elements = graphs.reachable_states(generators, lambda f: f.select("m", each.alias("g")).select(_boolean_product(F.col("m"), F.col("g")).alias("m")), ["m"])
    found = elements.agg(F.count(F.lit(1)).alias("elements"), F.count_if(_boolean_product(F.col("m"), F.col("m")) == F.col("m")).alias("idempotents"), F.bit_and("m").alias("shared"))
    return generators.agg(F.count(F.lit(1)).alias("generators")).crossJoin(found)  # one row each


# Parity ----------------------------------------------------------------------------------------------------------------


@query(
    """WITH m AS (SELECT o_orderpriority || o_orderstatus AS k, bit_xor(CAST(1 AS BIGINT) << (CAST(substr(p_brand, 7) AS BIGINT) - 1)) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1),
    i AS (SELECT m, row_number() OVER (ORDER BY k) - 1 AS i FROM m), n AS (SELECT count(*) AS n FROM i),
    z AS (SELECT s, bit_xor(CASE WHEN (s >> i) & 1 = 1 THEN m ELSE 0 END) AS x FROM range(32768) r(s), i WHERE s < (CAST(1 AS BIGINT) << (SELECT n FROM n)) GROUP BY s),
    t AS (SELECT bit_xor(m) AS t FROM i)
    SELECT n AS rows, CAST(round(log2((SELECT count(*) FROM z WHERE x = 0))) AS BIGINT) AS nullity, (SELECT CAST(min(bit_count(s)) AS BIGINT) FROM z, t WHERE x = t) AS fewest_rows FROM n"""
)
def parity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of order priorities and statuses whose line items' parities by brand cancel out: the dimension of their space,
    and the fewest rows that together have the parities of all of them."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat("o_orderpriority", "o_orderstatus").alias("k"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), K.place_in_mask(F.substring("p_brand", 7, 9).cast("int") - 1).cast("int").alias("b"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey").join(parts, "l_partkey")
    masks = cut(lines.groupBy("k").agg(F.bit_xor(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("m")))
    target = masks.agg(F.bit_xor("m").alias("t")).first()["t"] or 0
    return exact.gf2_kernel(masks, "k", "m", target)


# Functional graphs -----------------------------------------------------------------------------------------------------

_SWEEP = """
    q AS (SELECT CAST(p_size AS BIGINT) AS n, CAST(l_linenumber AS BIGINT) AS c, count(*) AS times FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    f AS (SELECT n, c, x, (x * x + c) % n AS y FROM (SELECT n, c, unnest(range(n)) AS x FROM q)),
    o(n, c, s, x) AS (SELECT n, c, x, x FROM f UNION SELECT o.n, o.c, o.s, f.y FROM o JOIN f ON o.n = f.n AND o.c = f.c AND o.x = f.x),
    per AS (SELECT f.n, f.c, f.x FROM f JOIN o ON o.n = f.n AND o.c = f.c AND o.s = f.y AND o.x = f.x),
    st AS (SELECT o.n, o.c, o.s, count(*) AS rho, min(per.x) AS cyc, count(per.x) AS len FROM o LEFT JOIN per ON per.n = o.n AND per.c = o.c AND per.x = o.x GROUP BY 1, 2, 3)
"""


@query(
    "WITH RECURSIVE "
    + _SWEEP
    + """, g AS (SELECT n, c, count(DISTINCT cyc) AS cycles, sum(rho) AS rho, count(DISTINCT CASE WHEN len = 1 THEN cyc END) AS fixed FROM st GROUP BY 1, 2)
    SELECT n, count(*) AS graphs, CAST(sum(times) AS BIGINT) AS lines, CAST(sum(cycles) AS BIGINT) AS cycles, CAST(sum(rho) AS BIGINT) AS sum_rho, CAST(sum(rho * times) AS BIGINT) AS weighted_rho, CAST(sum(fixed) AS BIGINT) AS fixed,
        count(*) FILTER (WHERE fixed > 0) AS with_fixed FROM g JOIN q USING (n, c) GROUP BY 1"""
)
def quadratic_parameter_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps x * x + c modulo n for each part size n and line number c that meet: cycles, fixed points and lengths of all
    walks, summed over c and weighted by line items. All graphs advance together, keyed by (n, c, x)."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("n"))
    times = cut(table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_linenumber").cast("long").alias("c")).join(sizes, "l_partkey").groupBy("n", "c").agg(F.count(F.lit(1)).alias("times")))
    return functional_graph.parameter_sums(times)


@query(
    _ORBITS
    + """SELECT CAST((SELECT n FROM n) AS BIGINT) AS keys, CAST(round(1000 * sum(tail + len) / (count(*) * sqrt(pi() * count(*) / 2))) AS BIGINT) AS rho_permille,
        CAST(round(1000 * count(*) FILTER (WHERE tail = 0) / sqrt(pi() * count(*) / 2)) AS BIGINT) AS periodic_permille FROM st"""
)
def random_map_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' map against a random one, of which walks and periodic keys number sqrt(pi n / 2) on average."""
    stats = functional_graph.analyze(customer_map(spark, sf_dir))
    n = F.count(F.lit(1))
    expected = F.sqrt(F.lit(math.pi) * n / 2)
    return stats.agg(
        n.alias("keys"), F.round(1000 * F.sum(F.col("tail") + F.col("cycle_len")) / (n * expected)).cast("long").alias("rho_permille"),
        F.round(1000 * F.count_if("periodic") / expected).cast("long").alias("periodic_permille"),
    )


# Numbers and words -----------------------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT CAST(p_size AS BIGINT) AS p, count(*) AS parts FROM part GROUP BY 1),
    o AS (SELECT * FROM s WHERE p > 2 AND NOT EXISTS (SELECT 1 FROM range(2, 50) r(i) WHERE i < p AND p % i = 0))
    SELECT p, parts, list_reduce(list_prepend(CAST(4 AS HUGEINT), list_transform(range(p - 2), lambda i: CAST(i AS HUGEINT))), lambda a, b: (a * a - 2) % (CAST(pow(2, p) AS HUGEINT) - 1)) = 0 AS mersenne FROM o"""
)
def mersenne_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes that are odd primes p, and whether 2**p - 1 is prime too."""
    sizes = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("p")).agg(F.count(F.lit(1)).alias("parts"))
    return sizes.where((F.col("p") > 2) & K.is_prime(F.col("p"))).select("p", "parts", K.lucas_lehmer(F.col("p")).alias("mersenne"))


@query(
    """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, left(event_type, 1) AS c FROM events),
    w AS (SELECT a.c || b.c || d.c AS w, count(*) AS n FROM s a JOIN s b ON a.user_id = b.user_id AND b.i = a.i + 1 JOIN s d ON a.user_id = d.user_id AND d.i = a.i + 2 GROUP BY 1),
    l AS (SELECT DISTINCT c FROM s), q AS (SELECT a.c || b.c || d.c AS w FROM l a, l b, l d)
    SELECT q.w, coalesce(n, 0) AS times FROM q LEFT JOIN w USING (w)"""
)
def event_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of three letters over the event types' first letters, and how often users have them in succession."""
    from pyspark.sql import Window

    own, letter = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.left("event_type", F.lit(1))
    events = table(spark, sf_dir, "events")
    triples = events.select(F.lag(letter, 2).over(own).alias("a"), F.lag(letter).over(own).alias("b"), letter.alias("c"))
    counts = triples.where("a IS NOT NULL").groupBy(F.concat("a", "b", "c").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    letters = cut(events.select(letter.alias("w")).distinct())
    words, few = letters, sorted(r["w"] for r in letters.collect())  # first letters of a few types
    for _ in range(2 if few else 0):
        words = words.select("w", _each(few).alias("c")).select(F.concat("w", "c").alias("w"))
    return words.join(counts, "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("times"))


@query(
    """WITH RECURSIVE f AS (SELECT user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY min(ts), event_type) AS r FROM events GROUP BY 1, 2),
    u AS (SELECT string_agg(t, '>' ORDER BY r) AS o, count(*) AS k FROM f GROUP BY user_id), types AS (SELECT DISTINCT event_type AS t FROM events),
    p(o, used, k) AS (SELECT t, [t], CAST(1 AS BIGINT) FROM types UNION ALL SELECT o || '>' || t, list_append(used, t), k + 1 FROM p, types WHERE NOT list_contains(used, t)),
    a AS (SELECT o FROM p WHERE k = (SELECT count(*) FROM types))
    SELECT a.o, count(u.o) AS users FROM a LEFT JOIN u ON u.o = a.o GROUP BY 1"""
)
def first_event_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the event types, and how many users met the types first in that order. Of equal first times the
    type that sorts first counts as earlier."""
    events = table(spark, sf_dir, "events")
    firsts = events.groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"))
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_type"))), lambda x: x["event_type"]), ">")  # one entry for each type
    users = firsts.groupBy("user_id").agg(order.alias("o")).groupBy("o").agg(F.count(F.lit(1)).alias("users"))
    types = cut(events.select(F.col("event_type").alias("t")).distinct())
    orders, few = types.select(F.array("t").alias("used")), sorted(r["t"] for r in types.collect())  # a few types
    for _ in few[1:]:
        orders = orders.select("used", _each(few).alias("t")).where(~F.array_contains("used", F.col("t"))).select(F.concat("used", F.array("t")).alias("used"))
    return orders.select(F.array_join("used", ">").alias("o")).join(users, "o", "left").select("o", F.coalesce("users", F.lit(0)).alias("users"))


# Estimates -------------------------------------------------------------------------------------------------------------


@query(
    "WITH RECURSIVE "
    + _TRADE
    + """, adj AS (SELECT src, list(dst ORDER BY dst) AS a FROM e GROUP BY 1),
    d(id, head, mask, weight, length) AS (SELECT CAST(c_custkey AS BIGINT), CAST(c_nationkey AS BIGINT), CAST(1 AS BIGINT) << c_nationkey, CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM customer
        UNION ALL SELECT id, w[k + 1], mask | (CAST(1 AS BIGINT) << w[k + 1]), weight * len(w), length + 1
            FROM (SELECT *, CAST('0x' || left(md5(id || '/' || length), 6) AS BIGINT) % len(w) AS k FROM (SELECT d.*, list_filter(a, lambda x: (mask >> x) & 1 = 0) AS w FROM d JOIN adj ON src = head WHERE length < 4) WHERE len(w) > 0))
    SELECT length, count(*) AS alive, CAST(sum(weight) AS BIGINT) AS weight, CAST(sum(weight * weight) AS BIGINT) AS squares FROM d WHERE length > 0 GROUP BY 1"""
)
def path_count_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knuth's estimate of the number of simple paths among major partners: each customer dives from their nation, and a
    dive's weight is the product of the choices it had. All dives advance together, by joins with the neighbours."""
    starts = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("head"))
    return graphs.dive_estimate(trade_edges(spark, sf_dir), starts, 4)


@query(
    """WITH s AS (SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1),
    v AS (SELECT *, s / n AS mean, sqrt((q - s * (s / n)) / (n - 1) / n) AS se FROM s WHERE n > 1)
    SELECT l_returnflag, n, CAST(round(1000 * mean) AS BIGINT) AS mean_thousandths, CAST(round(1000 * (mean - 1.96 * se)) AS BIGINT) AS low, CAST(round(1000 * (mean + 1.96 * se)) AS BIGINT) AS high FROM v"""
)
def quantity_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantities and their 95 % intervals, in thousandths; whole sums first, so the order of rows plays no part."""
    q = F.col("l_quantity").cast("long")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(q).alias("s"), F.sum(q * q).alias("q")).where("n > 1")
    mean = F.col("s") / F.col("n")
    found = sums.select("l_returnflag", "n", mean.alias("mean"), F.sqrt((F.col("q") - F.col("s") * mean) / (F.col("n") - 1) / F.col("n")).alias("se"))
    in_thousandths = lambda x: F.round(1000 * x).cast("long")
    return found.select("l_returnflag", "n", in_thousandths(F.col("mean")).alias("mean_thousandths"), in_thousandths(F.col("mean") - 1.96 * F.col("se")).alias("low"), in_thousandths(F.col("mean") + 1.96 * F.col("se")).alias("high"))


# Sweeps ----------------------------------------------------------------------------------------------------------------

_MONTHS = "m AS (SELECT c_nationkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS t, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def nation_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_nationkey, t, n): orders of a nation's customers by month."""
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return orders.join(buyers, "o_custkey").groupBy("c_nationkey", "t").agg(F.sum("n").alias("n"))


@query(
    f"""WITH {_MONTHS}, b AS (SELECT c_nationkey, count(*) AS k, sum(n) AS s FROM m GROUP BY 1),
    x AS (SELECT c_nationkey, max(t) FILTER (WHERE n * k < s) AS last_below, max(t) AS last FROM m JOIN b USING (c_nationkey) GROUP BY 1)
    SELECT x.c_nationkey, min(m.t) AS onset, count(m.t) AS months FROM x LEFT JOIN m ON m.c_nationkey = x.c_nationkey AND m.t > coalesce(x.last_below, 0) GROUP BY 1"""
)
def order_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first month from which on a nation's orders are never below its average, if there is one."""
    months = cut(nation_months(spark, sf_dir))
    totals = months.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    marked = months.join(totals, "c_nationkey").withColumn("holds", F.col("n") * F.col("k") >= F.col("s"))
    return verify.onset(marked, ["c_nationkey"], "t", "holds").withColumnRenamed("rows", "months")


@query(
    f"""WITH {_MONTHS}, l AS (SELECT c_nationkey, t // 12 AS y, n, lag(n) OVER (PARTITION BY c_nationkey ORDER BY t) AS b FROM m),
    c AS (SELECT c_nationkey, y, count(*) FILTER (WHERE n > b) AS up, count(*) FILTER (WHERE n < b) AS down FROM l GROUP BY 1, 2)
    SELECT up, down, CASE WHEN up > down THEN 'rising' WHEN up < down THEN 'falling' ELSE 'level' END AS phase, count(*) AS nation_years, min(c_nationkey) AS first FROM c GROUP BY 1, 2"""
)
def growth_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A census of nations' years by months that rose and fell: the phase of each point, and how many years are there."""
    stepped = verify.steps(nation_months(spark, sf_dir), ["c_nationkey"], "t", "n").withColumn("y", F.floor(F.col("t") / 12))
    years = stepped.groupBy("c_nationkey", "y").agg(F.count_if(F.col("n") > F.col("before")).alias("up"), F.count_if(F.col("n") < F.col("before")).alias("down"))
    phase = F.when(F.col("up") > F.col("down"), "rising").when(F.col("up") < F.col("down"), "falling").otherwise("level")
    return years.groupBy("up", "down").agg(F.count(F.lit(1)).alias("nation_years"), F.min("c_nationkey").alias("first")).withColumn("phase", phase)


@query("SELECT n_name, count(*) AS buyers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) GROUP BY 1")
def buyers_who_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a returned line item, by nation: two semi joins."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    buyers = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_semi").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("buyers"))
    return buyers.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("n_name", "buyers")


# Files -----------------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    shared_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4().hex}"


@query(
    f"""WITH {_MONTHS}, r AS (SELECT c_nationkey, n, row_number() OVER (PARTITION BY c_nationkey ORDER BY t) AS i FROM m)
    SELECT CAST(c_nationkey AS BIGINT) AS seq, count(*) AS terms, CAST(sum(i * n) AS BIGINT) AS weighted, CAST(0 AS BIGINT) AS repeated FROM r GROUP BY 1"""
)
def sequence_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly orders of each nation written as sequence files, and read again."""
    from pyspark.sql import Window

    months = nation_months(spark, sf_dir)
    terms = months.select(F.col("c_nationkey").alias("seq"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("t")).alias("idx"), F.col("n").alias("val"))
    path = _folder(spark)
    writers.sequence_files(terms, path)
    read = readers.sequence_folder(spark, path)
    twice = readers.duplicated_terms(read).count()
    return read.groupBy(F.col("file").cast("long").alias("seq")).agg(F.count(F.lit(1)).alias("terms"), F.sum(F.col("idx") * F.col("val")).cast("long").alias("weighted"), F.lit(twice).cast("long").alias("repeated"))


@query("WITH " + _TRADE + "SELECT 'adjacency' AS form, count(*) AS edges, CAST(sum(25 * src + dst) AS BIGINT) AS checksum FROM e UNION ALL SELECT 'edge list', count(*), CAST(sum(25 * src + dst) AS BIGINT) FROM e")
def graph_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of major partners written as an adjacency list and as an edge list, and read again."""
    edges, path = trade_edges(spark, sf_dir), _folder(spark)
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    lines = nodes.join(writers.adjacency(edges), "src", "left").orderBy("src").select(F.coalesce("line", F.lit("")).alias("line"))
    lines.coalesce(1).write.text(f"{path}/adjacency")  # 25 lines
    listed = edges.agg(F.count(F.lit(1)).alias("m"), F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("l"))  # 600 pairs at most
    listed = listed.select(F.explode(F.concat(F.array(F.concat_ws(" ", F.lit("25"), F.col("m").cast("string"))), F.transform("l", lambda x: F.concat_ws(" ", x["src"].cast("string"), x["dst"].cast("string"))))))
    listed.coalesce(1).write.text(f"{path}/list")
    read = {"adjacency": readers.adjacency_file(spark, f"{path}/adjacency"), "edge list": readers.edge_list_file(spark, f"{path}/list")}
    return reduce(DataFrame.union, [df.agg(F.count(F.lit(1)).alias("edges"), F.sum(25 * F.col("src") + F.col("dst")).alias("checksum")).select(F.lit(form).alias("form"), "edges", "checksum") for form, df in read.items()])


@query("WITH d AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT n % 5 AS job, count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS checksum FROM d GROUP BY 1")
def job_results_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dealt to jobs by their number of orders; each job's rows are written twice, as if it had run again, and
    count once."""
    counts, path = cut(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))), _folder(spark)
    for job in (0, 1, 2, 3, 4, 0, 3):
        own = counts.where(F.col("n") % 5 == job)
        if not own.isEmpty():
            writers.job_result(own, path, job)
    return spark.read.parquet(path).groupBy(F.col("job").cast("long").alias("job")).agg(F.count(F.lit(1)).alias("rows"), F.sum("o_custkey").alias("checksum"))


@query(
    "WITH a AS (SELECT l_orderkey AS k FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k FROM orders) SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS in_both, count(*) FILTER (WHERE b.k IS NULL) AS only_lines, count(*) FILTER (WHERE a.k IS NULL) AS only_orders, count(*) = count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS equal FROM a FULL JOIN b ON a.k = b.k"
)
def order_keys_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether line items and orders have the same set of orders, by one aggregation of both."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    return verify.set_comparison(lines, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "k").select("in_both", F.col("only_a").alias("only_lines"), F.col("only_b").alias("only_orders"), "equal")
