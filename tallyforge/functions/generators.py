"""Base relations that are generated: partitions, permutations, masks, words, lattices, boards and graphs.

They are ranges and joins of ranges, so that Spark deals them out; nothing is enumerated on the driver.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import kernels as K


def partitions(spark: SparkSession, n: int) -> DataFrame:
    """(p: array<long>) all descending partitions of n; a part is added to every partial partition at a time."""
    now = spark.createDataFrame([([], n, n)], "p array<long>, left long, most long")
    done = now.where("left = 0").select("p")
    for _ in range(n):
        parts = F.sequence(F.lit(1).cast("long"), F.least("left", "most"))
        now = now.where("left > 0").select("p", "left", F.explode(parts).alias("x")).select(F.concat("p", F.array("x")).alias("p"), (F.col("left") - F.col("x")).alias("left"), F.col("x").alias("most"))
        done = done.union(now.where("left = 0").select("p"))
    return done


def permutations(spark: SparkSession, n: int) -> DataFrame:
    """(rank, p: array<int>) by unranking a range."""
    return spark.range(factorial(n)).select(F.col("id").alias("rank"), K.permutation_of_rank(F.col("id"), n).alias("p"))


def masks(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1 << n).withColumnRenamed("id", "mask")


def words(spark: SparkSession, k: int, q: int) -> DataFrame:
    """(id, word): words of k digits below q (at most 36), in order."""
    return spark.range(q**k).select("id", F.lpad(F.lower(F.conv(F.col("id").cast("string"), 10, q)) if q > 1 else F.lit("0"), k, "0").alias("word"))


def histories(spark: SparkSession, longest: int, q: int) -> DataFrame:
    """(word): all words shorter than ``longest``, the empty one included."""
    out = spark.range(1).select(F.lit("").alias("word"))
    for k in range(1, longest):
        out = out.union(words(spark, k, q).select("word"))
    return out


def line_states(spark: SparkSession, n: int, cyclic: bool) -> DataFrame:
    """(mask): no two neighbouring bits; around the end as well if cyclic."""
    found = masks(spark, n).where("mask & shiftright(mask, 1) = 0")
    return found.where(f"NOT (mask & 1 = 1 AND shiftright(mask, {n - 1}) & 1 = 1)") if cyclic and n > 1 else found


def transition_rules(spark: SparkSession, n: int) -> DataFrame:
    """(rule): nonempty sets of disjoint exchanges of neighbours; bit i exchanges places i + 1 and i + 2."""
    return masks(spark, n - 1).where("mask > 0 AND mask & shiftright(mask, 1) = 0").withColumnRenamed("mask", "rule")


def apply_rule(p, rule):
    """The permutation with the exchanges of a rule made."""
    n = F.size(p)
    at = lambda i: F.when((i <= n - 1) & (K.bit(rule, i - 1) == 1), i + 1).when((i > 1) & (K.bit(rule, F.greatest(i - 2, F.lit(0))) == 1), i - 1).otherwise(i)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(p, at(i)))


def permutation_graph(spark: SparkSession, n: int) -> DataFrame:
    """(src, dst): ranks of permutations that a rule takes to each other."""
    rules = F.array(*[F.lit(m).cast("long") for m in range(1, 1 << (n - 1)) if m & (m >> 1) == 0])
    moved = permutations(spark, n).select(F.col("rank").alias("src"), "p", F.explode(rules).alias("rule"))
    return moved.select("src", K.permutation_rank(apply_rule(F.col("p"), F.col("rule"))).alias("dst"))


def conjugate_by_reversal(p):
    """The automorphism of permutation_graph() that reverses places and names."""
    n = F.size(p)
    return F.transform(F.reverse(p), lambda v: n + 1 - v)


def lattice(spark: SparkSession, total: int) -> DataFrame:
    """(a, b, c): positive numbers of a given sum."""
    first = spark.range(1, total - 1).withColumnRenamed("id", "a")
    return first.select("a", F.explode(F.sequence(F.lit(1).cast("long"), total - 1 - F.col("a"))).alias("b")).select("a", "b", (total - F.col("a") - F.col("b")).alias("c"))


def leaper_vectors(spark: SparkSession, a: int, b: int) -> DataFrame:
    signed = [(sa * x, sb * y) for x, y in ((a, b), (b, a)) for sa in (1, -1) for sb in (1, -1)]
    return spark.createDataFrame(sorted(set(signed)), "dr int, dc int")


def cells(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))


def family(spark: SparkSession, name: str, n: int) -> DataFrame:
    """(u, v) with u < v of a family of graphs: path, cycle, ladder, prism, wheel, fan, gear, helm, friendship,
    book_tri, book_quad."""
    i = F.col("i").cast("long")
    nxt, inner = (i + 1) % n, i < n - 1
    hub = lambda at: F.lit(at).cast("long")
    shapes = {
        "path": [(i, i + 1, inner)],
        "cycle": [(i, nxt, True)],
        "ladder": [(i, i + 1, inner), (n + i, n + i + 1, inner), (i, n + i, True)],
        "prism": [(i, nxt, True), (n + i, n + nxt, True), (i, n + i, True)],
        "wheel": [(i, nxt, True), (i, hub(n), True)],
        "fan": [(i, i + 1, inner), (i, hub(n), True)],
        "gear": [(2 * i, 2 * i + 1, True), (2 * i + 1, (2 * i + 2) % (2 * n), True), (2 * i, hub(2 * n), True)],
        "helm": [(i, nxt, True), (i, n + i, True), (i, hub(2 * n), True)],
        "friendship": [(2 * i, 2 * i + 1, True), (2 * i, hub(2 * n), True), (2 * i + 1, hub(2 * n), True)],
        "book_tri": [(i, hub(n), True), (i, hub(n + 1), True), (hub(n), hub(n + 1), i == 0)],
        "book_quad": [(2 * i, 2 * i + 1, True), (2 * i, hub(2 * n), True), (2 * i + 1, hub(2 * n + 1), True), (hub(2 * n), hub(2 * n + 1), i == 0)],
    }[name]
    base = spark.range(n).withColumnRenamed("id", "i")
    ends = F.array(*[F.when(cond if not isinstance(cond, bool) else F.lit(cond), F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))) for a, b, cond in shapes])
    return base.select(F.explode(F.filter(ends, lambda e: e.isNotNull())).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def random_graph(spark: SparkSession, vertices: int, per_thousand: int, seed: int) -> DataFrame:
    """(u, v) with u < v: each pair with a chance, by a seeded hash."""
    pairs = spark.range(vertices).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(vertices - 1).cast("long"))).alias("v")).where("u < v")
    return pairs.where(F.pmod(F.xxhash64("u", "v", F.lit(seed)), F.lit(1000)) < per_thousand)
