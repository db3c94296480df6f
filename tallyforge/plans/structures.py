"""Queries over the given tables about boards, prefixes, symmetry and closed forms. They are registered with those of
queries.py."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import boards, graphs
from tallyforge.operators.loops import cut
from tallyforge.plans.queries import _BEATS, _TRADE, brand_tournament, query, table, trade_edges
from tallyforge.plans.reports import _MONTHS, _folder, nation_months
from tallyforge.sources import writers

# Boards ----------------------------------------------------------------------------------------------------------------

_GLUED = "(VALUES ('plane', 0, 0), ('cylinder', 1, 0), ('torus', 1, 1), ('mobius', -1, 0), ('klein', -1, 1), ('klein_rows', 1, -1), ('projective', -1, -1)) s(surface, across, along)"


@query(
    f"""WITH z(n) AS (VALUES (3), (4)), cell AS (SELECT n, r, c FROM z, range(4) a(r), range(4) b(c) WHERE r < n AND c < n), o(dr, dc) AS (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)),
    b AS (SELECT surface, n, r * n + c AS cell, CASE WHEN c + dc NOT BETWEEN 0 AND n - 1 THEN CASE WHEN across <> 0 THEN CASE across WHEN -1 THEN n - 1 - r ELSE r END * n + (c + dc + n) % n END
        WHEN r + dr NOT BETWEEN 0 AND n - 1 THEN CASE WHEN along <> 0 THEN (r + dr + n) % n * n + CASE along WHEN -1 THEN n - 1 - c ELSE c END END ELSE (r + dr) * n + c + dc END AS t FROM {_GLUED}, cell, o),
    m AS (SELECT surface, n, cell, bit_or(CAST(1 AS BIGINT) << t) AS m FROM b WHERE t IS NOT NULL GROUP BY 1, 2, 3),
    x AS (SELECT surface, n, k, bit_xor(CASE WHEN (k >> cell) & 1 = 1 THEN m ELSE 0 END) AS x FROM m, range(65536) u(k) WHERE k < CAST(1 AS BIGINT) << (n * n) GROUP BY 1, 2, 3),
    p AS (SELECT s_nationkey AS key, n, bit_xor(CAST(1 AS BIGINT) << (n * (l_partkey % n) + l_quantity::BIGINT % n)) AS lit FROM lineitem JOIN supplier ON l_suppkey = s_suppkey, z GROUP BY 1, 2),
    i AS (SELECT DISTINCT surface, n, x FROM x), k AS (SELECT surface, n, CAST(round(log2(count(*))) AS BIGINT) AS nullity FROM x WHERE x = 0 GROUP BY 1, 2)
    SELECT k.surface, CAST(k.n AS BIGINT) AS n, nullity, count(*) AS patterns, count(i.x) AS solvable FROM k JOIN p ON p.n = k.n LEFT JOIN i ON i.surface = k.surface AND i.n = k.n AND i.x = lit GROUP BY 1, 2, 3"""
)
def lights_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of 3 x 3 and 4 x 4 lights on each surface. A nation's pattern is the parity of its suppliers' line items by
    the remainders of part and quantity; pressing a cell flips it and its neighbours. How many patterns can be put out."""
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("key"))
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("long").alias("q")).join(sellers, "l_suppkey")
    sizes = lines.select("*", F.explode(F.array(F.lit(3).cast("long"), F.lit(4).cast("long"))).alias("n"))
    cell = F.col("n") * (F.col("l_partkey") % F.col("n")) + F.col("q") % F.col("n")
    return boards.lights(cut(sizes.groupBy("key", "n").agg(F.bit_xor(F.call_function("shiftleft", F.lit(1).cast("long"), cell.cast("int"))).alias("lit"))))


_SQUARES = "c AS (SELECT DISTINCT p_type, p_size - 1 AS x, CAST(substr(p_brand, 7) AS BIGINT) - 1 AS y FROM part), b AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM c)"


@query(
    f"""WITH {_SQUARES}, s(surface, across, along) AS (VALUES ('plane', 0, 0), ('cylinder', 1, 0), ('torus', 1, 1), ('mobius', -1, 0), ('klein', -1, 1)),
    v AS (SELECT DISTINCT p_type, surface, CASE WHEN across <> 0 AND x + i = w THEN 0 ELSE x + i END AS x, CASE WHEN along <> 0 AND (CASE WHEN across = -1 AND x + i = w THEN h - y - j ELSE y + j END) = h THEN 0
        WHEN across = -1 AND x + i = w THEN h - y - j ELSE y + j END AS y FROM c, b, s, range(2) d(i), range(2) e(j)),
    up AS (SELECT DISTINCT p_type, surface, CASE WHEN across <> 0 AND x + i = w THEN 0 ELSE x + i END AS x, CASE WHEN across = -1 AND x + i = w THEN h - 1 - y ELSE y END AS y FROM c, b, s, range(2) d(i)),
    flat AS (SELECT DISTINCT p_type, surface, x, CASE WHEN along <> 0 AND y + j = h THEN 0 ELSE y + j END AS y FROM c, b, s, range(2) e(j)),
    n AS (SELECT p_type, surface, 0 AS faces, 0 AS edges, count(*) AS vertices FROM v GROUP BY 1, 2 UNION ALL SELECT p_type, surface, 0, count(*), 0 FROM up GROUP BY 1, 2
        UNION ALL SELECT p_type, surface, 0, count(*), 0 FROM flat GROUP BY 1, 2 UNION ALL SELECT p_type, surface, count(*), 0, 0 FROM c, s GROUP BY 1, 2)
    SELECT p_type, surface, CAST(sum(faces) AS BIGINT) AS faces, CAST(sum(edges) AS BIGINT) AS edges, CAST(sum(vertices) AS BIGINT) AS vertices, CAST(sum(vertices) - sum(edges) + sum(faces) AS BIGINT) AS chi FROM n GROUP BY 1, 2"""
)
def euler_of_part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and brands of a type's parts as unit squares of a box with glued sides: faces, edges, vertices and the Euler
    characteristic of their union."""
    cells = table(spark, sf_dir, "part").select("p_type", (F.col("p_size") - 1).cast("long").alias("x"), (F.substring("p_brand", 7, 9).cast("long") - 1).alias("y")).distinct()
    box = cells.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return boards.euler_characteristics(cut(cells.crossJoin(box)), ["p_type"])  # box is one row


@query(
    f"""WITH {_SQUARES}, a AS (SELECT p_type, count(*) AS n FROM c GROUP BY 1),
    q AS (SELECT c.p_type, count(*) AS hits FROM c JOIN c d ON c.p_type = d.p_type AND (c.x, c.y) < (d.x, d.y) AND (c.x = d.x OR c.y = d.y OR abs(c.x - d.x) = abs(c.y - d.y)) GROUP BY 1)
    SELECT p_type, n AS cells, coalesce(hits, 0) AS attacking, CAST(n * (n - 1) / 2 AS BIGINT) - coalesce(hits, 0) AS peaceful FROM a LEFT JOIN q USING (p_type)"""
)
def attacking_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and brands of a type's parts as queens on a board: pairs that attack each other, and independent pairs."""
    cells = table(spark, sf_dir, "part").select("p_type", F.col("p_size").cast("long").alias("x"), F.substring("p_brand", 7, 9).cast("long").alias("y"))
    return boards.attacking_pairs(cells, ["p_type"])


# Graphs ----------------------------------------------------------------------------------------------------------------


@query("WITH " + _BEATS + "SELECT (SELECT count(*) // 3 FROM w a JOIN w b ON a.l = b.w JOIN w c ON b.l = c.w AND c.l = a.w) AS cyc3, (SELECT count(*) FROM w a JOIN w b ON a.l = b.w JOIN w c ON c.w = a.w AND c.l = b.l) AS trans3")
def brand_triads_by_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cyclic and transitive triads of the brands' tournament by common bits of masks."""
    number = lambda c: F.substring(c, 7, 9).cast("long")
    relation = cut(brand_tournament(spark, sf_dir))
    wins = relation.where("rel = 1").select(number("a").alias("w"), number("b").alias("l")).union(relation.where("rel = -1").select(number("b"), number("a")))
    return graphs.bitset_triads(wins)


_MUTUAL = _TRADE + ", u AS (SELECT a.src, a.dst FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src)"


def mutual_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations that are each other's major partners, both ways round."""
    edges = trade_edges(spark, sf_dir)
    return cut(edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]))


@query(
    "WITH "
    + _MUTUAL
    + """, p AS (SELECT [a.src, a.dst, b.dst, c.dst] AS q FROM u a JOIN u b ON a.dst = b.src AND b.dst <> a.src JOIN u c ON b.dst = c.src AND c.dst <> a.src AND c.dst <> a.dst),
    x AS (SELECT least(q, list_reverse(q)) AS job, q, (SELECT count(*) FROM u WHERE u.src = q[4] AND NOT list_contains(q, u.dst)) AS ahead FROM p)
    SELECT job[1] AS first, count(DISTINCT job) AS jobs, count(*) AS paths, CAST(sum(ahead) AS BIGINT) AS ahead FROM x GROUP BY 1"""
)
def trade_path_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths of three edges among mutual partners: those not greater than their reverse, what they stand for, and
    how many paths of four edges go on from them."""
    return graphs.prefix_jobs(mutual_partners(spark, sf_dir), 3)


@query(
    "WITH RECURSIVE "
    + _MUTUAL
    + """, p AS (SELECT [a.src, a.dst, b.dst] AS q, a.src AS first, b.dst AS head FROM u a JOIN u b ON a.dst = b.src AND b.dst <> a.src),
    v AS (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation), o AS (SELECT q, first, head, n FROM p, v WHERE NOT list_contains(q, n)),
    open AS (SELECT q, n FROM o UNION SELECT q, first FROM p UNION SELECT q, head FROM p),
    g AS (SELECT o.q, o.n, count(open.n) AS d FROM o LEFT JOIN u ON u.src = o.n LEFT JOIN open ON open.q = o.q AND open.n = u.dst GROUP BY 1, 2),
    bad AS (SELECT DISTINCT q FROM g WHERE d < 2),
    r(q, n) AS (SELECT q, head FROM p UNION SELECT r.q, u.dst FROM r JOIN u ON u.src = r.n JOIN open ON open.q = r.q AND open.n = u.dst),
    j AS (SELECT q FROM (SELECT q, count(*) AS c FROM r GROUP BY 1) JOIN (SELECT q, count(*) AS c2 FROM open GROUP BY 1) USING (q) WHERE c = c2)
    SELECT first, count(*) AS prefixes, count(*) FILTER (WHERE bad.q IS NULL) AS by_degree, count(j.q) AS connected, count(*) FILTER (WHERE bad.q IS NULL AND j.q IS NOT NULL) AS viable
    FROM p LEFT JOIN bad ON bad.q = p.q LEFT JOIN j ON j.q = p.q GROUP BY 1"""
)
def viable_trade_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths of two edges among mutual partners, and how many pass the degree and the connectivity test for the
    beginning of a tour of all nations."""
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    return graphs.viable_prefixes(mutual_partners(spark, sf_dir), nodes, 2)


@query("WITH e AS (SELECT DISTINCT s_nationkey, l_suppkey, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) SELECT s_nationkey, count(*) AS edges, CAST(sum(CAST('0x' || left(md5(l_suppkey || '-' || l_partkey), 10) AS BIGINT)) AS BIGINT) AS structure FROM e GROUP BY 1")
def structure_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each nation's graph of suppliers and parts that doesn't depend on the order of its edges: the sum of the
    edges' own hashes, so that partial sums meet."""
    edges = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    own = F.conv(F.left(F.md5(F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).cast("binary")), F.lit(10)), 16, 10).cast("long")
    return edges.join(sellers, "l_suppkey").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("edges"), F.sum(own).alias("structure"))


# Symmetry and closed forms ---------------------------------------------------------------------------------------------


@query(
    f"""WITH {_MONTHS}, y AS (SELECT c_nationkey, t, (t - 1) // 12 AS y, n, avg(n) OVER (PARTITION BY c_nationkey, (t - 1) // 12) AS mean, count(*) OVER (PARTITION BY c_nationkey, (t - 1) // 12) AS k FROM m),
    w AS (SELECT c_nationkey, y, string_agg(CASE WHEN n > mean THEN 'u' ELSE 'd' END, '' ORDER BY t) AS w FROM y WHERE k = 12 GROUP BY 1, 2),
    g AS (SELECT c_nationkey, y, substr(w || w, CAST(i + 1 AS BIGINT), 12) AS x FROM w, range(12) r(i) UNION SELECT c_nationkey, y, substr(reverse(w) || reverse(w), CAST(i + 1 AS BIGINT), 12) FROM w, range(12) r(i)),
    c AS (SELECT c_nationkey, y, min(x) AS necklace, count(*) AS orbit FROM g GROUP BY 1, 2)
    SELECT necklace, orbit, count(*) AS nation_years FROM c GROUP BY 1, 2"""
)
def year_necklaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's full year as twelve letters, for months above the year's mean or not: the least image of the word under
    rotations and reflections, its number of images, and how many nations' years have it."""
    months = nation_months(spark, sf_dir).withColumn("y", F.floor((F.col("t") - 1) / 12))
    years = months.groupBy("c_nationkey", "y").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"), F.array_sort(F.collect_list(F.struct("t", "n"))).alias("l")).where("k = 12")  # 12 months
    words = years.select(F.array_join(F.transform("l", lambda x: F.when(x["n"] * 12 > F.col("s"), "u").otherwise("d")), "").alias("w"))
    turned = lambda w: [F.concat(F.substring(w, i + 1, 12), F.substring(w, 1, i)) for i in range(12)]
    images = words.select(F.array_distinct(F.array(*turned(F.col("w")), *turned(F.reverse("w")))).alias("g"))
    return images.groupBy(F.array_min("g").alias("necklace"), F.size("g").cast("long").alias("orbit")).agg(F.count(F.lit(1)).alias("nation_years"))


@query(
    """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT i * (i + 1) // 2 AS n, i FROM range(1, 100000) r(i) WHERE i * (i + 1) // 2 <= (SELECT max(n) FROM n))
    SELECT i AS steps, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders FROM n JOIN t USING (n) GROUP BY 1"""
)
def staircase_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose number of orders is triangular, so that solitaire with as many cards has a fixed point: the
    staircase's steps by closed form."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).withColumn("i", F.floor((F.sqrt(8 * F.col("n") + 1) - 1) / 2))
    return counts.where(F.col("i") * (F.col("i") + 1) / 2 == F.col("n")).groupBy(F.col("i").alias("steps")).agg(F.count(F.lit(1)).alias("customers"), F.sum("n").alias("orders"))


@query(
    """WITH s AS (SELECT n, count(*) AS decks FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1),
    t AS (SELECT n, decks, sum((CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * (n - k) / CAST(n AS DOUBLE) / factorial(CAST(k AS INTEGER))) AS share FROM s, range(20) r(k) WHERE k < n GROUP BY 1, 2)
    SELECT n AS size, decks, CAST(round(1000000 * share) AS BIGINT) AS gardens_per_million FROM t"""
)
def expected_gardens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many in a million decks of each size that occurs have no predecessor, by inclusion and exclusion over the items
    in their own place: the sum over k of (-1)**k (n - k) / (n k!), whose terms past the 19th are below 1e-17."""
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("decks"))
    n = F.col("size").cast("double")
    term = lambda k: F.when(F.col("size") > k, (1 if k % 2 == 0 else -1) * (n - k) / n / F.factorial(F.lit(k))).otherwise(F.lit(0.0))
    return sizes.select("size", "decks", F.round(1000000 * reduce(Column.__add__, [term(k) for k in range(20)])).cast("long").alias("gardens_per_million"))


@query(
    """WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS a, count(*) FILTER (WHERE event_type = 'purchase') AS c FROM events GROUP BY 1)
    SELECT a * n > c * (n - a) AS ahead, c * n > a * (n - c) AS behind, count(*) AS users, CAST(sum(n) AS BIGINT) AS events FROM u GROUP BY 1, 2"""
)
def survival_of_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by whether their share a of views survives that of purchases, a > c (1 - a), and the other way round; in whole
    numbers, so that ties are told exactly."""
    n, a, c = F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "purchase").alias("c")
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(n, a, c)
    return users.groupBy(F.expr("a * n > c * (n - a)").alias("ahead"), F.expr("c * n > a * (n - c)").alias("behind")).agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("events"))


# Files -----------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(n AS VARCHAR) AS step, count(*) AS rows, CAST(max(k) AS BIGINT) AS greatest FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) WHERE n <= 3 GROUP BY 1 UNION ALL SELECT 'more', count(*), CAST(max(k) AS BIGINT) FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) WHERE n > 3 HAVING count(*) > 0")
def stats_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one, two, three and more items: a line of measures for each step in a CSV folder, one written twice."""
    orders, path = cut(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))), _folder(spark)
    measures = {"rows": F.count(F.lit(1)), "greatest": F.max("k")}
    for step, rows in {"1": "n = 1", "2": "n = 2", "3": "n = 3", "more": "n > 3"}.items():
        for _ in range(2 if step == "2" else 1):
            writers.stats_csv(orders.where(rows), path, step, measures)
    return spark.read.option("header", True).schema("step string, rows long, greatest long").csv(path).where("rows > 0").select("step", "rows", "greatest")
