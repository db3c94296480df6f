"""Queries of wide matrices over GF(2) and of searches in graphs over the given tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import binary, cycles, sieve, symmetry, transfer
from tallyforge.operators.loops import cut
from tallyforge.plans.queries import _BEATS, _TRADE, brand_tournament, query, table, trade_edges
from tallyforge.plans.structures import _MUTUAL, mutual_partners

# Kernels ---------------------------------------------------------------------------------------------------------------


@query(
    """WITH RECURSIVE o AS (SELECT o_custkey AS c, CAST(substr(p_brand, 7) AS BIGINT) - 1 AS b, count(*) % 2 AS odd FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    m AS (SELECT CAST(c_custkey AS BIGINT) AS c, coalesce(bit_xor(CASE WHEN odd = 1 THEN CAST(1 AS BIGINT) << b ELSE 0 END), 0) AS m FROM customer LEFT JOIN o ON c = c_custkey GROUP BY 1),
    s(k, used, c, m, bit, lead) AS (
        SELECT 0, CAST(0 AS BIGINT), c, CAST(m AS BIGINT), CAST(0 AS BIGINT), CAST(-1 AS BIGINT) FROM m
        UNION ALL
        SELECT k + 1, used | bit, c, CASE WHEN m & bit <> 0 THEN xor(m, top & ~bit) ELSE m END, bit, first
        FROM (SELECT *, x & (-x) AS bit FROM (SELECT *, top & ~used AS x FROM (
            SELECT k, used, c, m, min(c) FILTER (WHERE m & ~used <> 0) OVER () AS first, arg_min(m, c) FILTER (WHERE m & ~used <> 0) OVER () AS top FROM s))) WHERE first IS NOT NULL),
    l AS (SELECT c, m FROM s WHERE k = (SELECT max(k) FROM s)), p AS (SELECT DISTINCT bit, lead FROM s WHERE k > 0),
    f AS (SELECT c, m FROM l WHERE c NOT IN (SELECT lead FROM p))
    SELECT v AS custkey, string_agg(CAST(c AS VARCHAR), '-' ORDER BY c) AS members, count(*) AS size, true AS cancels
    FROM (SELECT c AS v, c FROM f UNION ALL SELECT c, lead FROM f JOIN p ON f.m & p.bit <> 0) GROUP BY 1"""
)
def parity_kernel_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A basis of the sets of customers who together have an even number of line items of every brand: one row a vector, with
    its members (as many as brands, and one, at most), and whether a join with the line items' parities confirms it."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("col"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring("p_brand", 7, 9).cast("long").alias("row"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders, "l_orderkey").join(parts, "l_partkey")
    odd = lines.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("row", "col")
    ones = cut(odd)
    basis = cut(binary.kernel_basis(ones, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("col"))))
    members = basis.groupBy("vector").agg(F.array_join(F.array_sort(F.collect_list("col")).cast("array<string>"), "-").alias("members"))
    return members.hint("merge").join(binary.cancelling(ones, basis), "vector").select(F.col("vector").alias("custkey"), "members", "size", "cancels")


# Cycles ----------------------------------------------------------------------------------------------------------------


@query(
    "WITH RECURSIVE "
    + _BEATS
    + """, e AS (SELECT w, l FROM w UNION ALL SELECT a, b FROM r WHERE rel = 0),
    reach(s, d) AS (SELECT w, l FROM e UNION SELECT reach.s, e.l FROM reach JOIN e ON reach.d = e.w),
    c AS (SELECT a.s, count(*) AS size FROM reach a JOIN reach b ON a.s = b.d AND a.d = b.s GROUP BY 1)
    SELECT CAST(k AS INTEGER) AS length, true AS verified FROM (SELECT max(size) AS n FROM c) x, range(3, n + 1) y(k)"""
)
def brand_cycle_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of cycles of brands of which each beats the next (of a tie, the first by name wins), and whether the edges confirm
    a witness. The SQL has Moon's theorem: a strong tournament has cycles of all lengths from three to its size."""
    number = lambda c: F.substring(c, 7, 9).cast("long") - 1
    relation = brand_tournament(spark, sf_dir)
    edges = cut(relation.where("rel >= 0").select(number("a").alias("src"), number("b").alias("dst")).union(relation.where("rel = -1").select(number("b"), number("a"))))
    return cycles.checked(edges, cycles.cycle_lengths(edges, 3)).select("length", "verified")


@query(
    "WITH "
    + _TRADE
    + """, two AS (SELECT a.src AS p, a.dst AS q, b.dst AS r FROM e a JOIN e b ON a.dst = b.src),
    three AS (SELECT two.*, e.dst AS s FROM two JOIN e ON r = src WHERE two.p <> r AND s <> q)
    SELECT 2 AS length, true AS verified WHERE EXISTS (SELECT 1 FROM two WHERE p = r)
    UNION ALL SELECT 3, true WHERE EXISTS (SELECT 1 FROM three WHERE s = p)
    UNION ALL SELECT 4, true WHERE EXISTS (SELECT 1 FROM three JOIN e ON src = s AND dst = p WHERE s <> p)
    UNION ALL SELECT 5, true WHERE EXISTS (SELECT 1 FROM three JOIN two x ON x.p = three.s AND x.r = three.p WHERE three.s <> three.p AND x.q NOT IN (three.p, three.q, three.r, three.s))"""
)
def trade_coded_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of two to five major partners by colour coding, confirmed by the edges; lengths without one have no row."""
    edges = trade_edges(spark, sf_dir)
    return cycles.checked(edges, reduce(DataFrame.union, [cycles.coded_cycle(edges, k) for k in (2, 3, 4, 5)])).select("length", "verified")


@query(
    "WITH RECURSIVE "
    + _TRADE
    + """, reach(s, d) AS (SELECT src, dst FROM e UNION SELECT reach.s, e.dst FROM reach JOIN e ON reach.d = e.src),
    i AS (SELECT src, dst FROM e JOIN reach ON d = src AND s = dst),
    p(first, head, mask) AS (SELECT DISTINCT src, src, CAST(1 AS BIGINT) << src FROM i
        UNION SELECT first, i.dst, mask | (CAST(1 AS BIGINT) << i.dst) FROM p JOIN i ON i.src = p.head WHERE i.dst > first AND (mask >> i.dst) & 1 = 0)
    SELECT DISTINCT CAST(bit_count(mask) AS INTEGER) AS length, true AS verified FROM p JOIN i ON i.src = p.head AND i.dst = p.first"""
)
def trade_cycle_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of all simple cycles of major partners, and whether the edges confirm a witness of each."""
    edges = trade_edges(spark, sf_dir)
    return cycles.checked(edges, cycles.cycle_lengths(edges)).select("length", "verified")


# Symmetry --------------------------------------------------------------------------------------------------------------


@query(
    "WITH RECURSIVE "
    + _MUTUAL
    + """, c0 AS (SELECT src AS v, CAST(count(*) AS VARCHAR) AS c FROM u GROUP BY 1),
    c1 AS (SELECT src AS v, any_value(a.c) || '(' || string_agg(b.c, ',' ORDER BY b.c) || ')' AS c FROM u JOIN c0 a ON a.v = src JOIN c0 b ON b.v = dst GROUP BY 1),
    c2 AS (SELECT src AS v, any_value(a.c) || '(' || string_agg(b.c, ',' ORDER BY b.c) || ')' AS c FROM u JOIN c1 a ON a.v = src JOIN c1 b ON b.v = dst GROUP BY 1),
    o AS (SELECT v, c, row_number() OVER (ORDER BY v) AS k FROM c2), n AS (SELECT max(k) AS n FROM o),
    near AS (SELECT x.k, list(y.k) AS ks, list(y.v) AS vs, any_value(x.v) AS v, any_value(x.c) AS c FROM u JOIN o x ON x.v = src JOIN o y ON y.v = dst GROUP BY 1),
    p(k, images) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
        UNION ALL
        SELECT a.k, list_append(images, b.v) FROM p JOIN near a ON a.k = p.k + 1 JOIN near b ON a.c = b.c AND NOT list_contains(images, b.v)
        WHERE len(list_filter(range(1, a.k), lambda j: list_contains(a.ks, j) <> list_contains(b.vs, images[j]))) = 0),
    f AS (SELECT images FROM p, n WHERE k = n)
    SELECT o.v AS nation, min(images[o.k]) AS orbit, CAST(count(*) AS VARCHAR) AS automorphisms FROM f, o GROUP BY 1"""
)
def mutual_partner_orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that symmetries of the graph of mutual partners exchange, each with the least of them, and how many symmetries
    there are."""
    edges = mutual_partners(spark, sf_dir)
    found, order = symmetry.orbits(edges, edges.select(F.col("src").alias("node")))
    return found.select(F.col("node").alias("nation"), "orbit", F.lit(str(order)).alias("automorphisms"))


# Sums over subsets -----------------------------------------------------------------------------------------------------


@query(
    """WITH m AS (SELECT o_custkey, bit_or(1 << (CAST(month(o_orderdate) AS INTEGER) - 1)) AS months FROM orders GROUP BY 1),
    c AS (SELECT CAST(months AS BIGINT) AS months, count(*) AS customers FROM m GROUP BY 1)
    SELECT a.months, a.customers, CAST(sum(b.customers) AS BIGINT) AS within FROM c a JOIN c b ON b.months & ~a.months = 0 GROUP BY 1, 2"""
)
def customers_within_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of months in which some customer's orders lie (bit 0 is January), how many customers have exactly these, and how many
    have no order in any other month."""
    month = F.call_function("shiftleft", F.lit(1).cast("long"), F.month("o_orderdate") - 1)
    sets = table(spark, sf_dir, "orders").where("o_custkey IS NOT NULL AND o_orderdate IS NOT NULL").groupBy("o_custkey").agg(F.bit_or(month).alias("months"))
    counts = cut(sets.groupBy("months").agg(F.count(F.lit(1)).alias("customers")))
    sums = transfer.subset_sums(counts.select(F.col("months").alias("mask"), F.col("customers").alias("cnt")), 12)
    return counts.join(sums.withColumnRenamed("mask", "months"), "months").select("months", "customers", F.col("cnt").cast("long").alias("within"))


# Numbers ---------------------------------------------------------------------------------------------------------------


@query(
    """WITH RECURSIVE t AS (SELECT n, count(*) AS customers FROM (SELECT o_custkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY 1),
    p(n, k, x) AS (SELECT n, CAST(1 AS BIGINT), 2 % n FROM t WHERE n % 2 = 1 AND n > 1 UNION ALL SELECT n, k + 1, x * 2 % n FROM p WHERE x <> 1)
    SELECT n AS total, customers, max(k) AS period FROM p JOIN t USING (n) GROUP BY 1, 2"""
)
def quantity_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd total quantities of customers, how many customers have each, and the period of the binary fraction one over it."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q")).join(orders, "l_orderkey")
    totals = cut(lines.groupBy("o_custkey").agg(F.sum("q").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("customers")))
    return sieve.multiplicative_orders(totals.select("n"), 2).join(totals, "n").select(F.col("n").alias("total"), "customers", F.col("ord").alias("period"))
