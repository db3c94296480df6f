"""Reconciling results: golden tables, coverage, first-wins logs, catalogues, monotony."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(computed: DataFrame, golden: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    """(keys.., computed, golden, status): match, mismatch, missing (only golden) or new (only computed)."""
    a = computed.select(*keys, F.col(value).alias("computed"), F.lit(1).alias("in_a"))
    b = golden.select(*keys, F.col(value).alias("golden"), F.lit(1).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "new").when(F.col("in_a").isNull(), "missing").when(F.col("computed").eqNullSafe(F.col("golden")), "match").otherwise("mismatch")
    return a.join(b, keys, "full_outer").select(*keys, "computed", "golden", status.alias("status"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, each as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def first_wins(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key. Minima of row structs are aggregated before the shuffle; no window over a hot key."""
    rest = [c for c in log.columns if c not in (key, *order)]
    first = log.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("row"))
    return first.select(key, "row.*").select(*log.columns)


def missing(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(seen.select(*keys), keys, "left_anti")


def unseen_prefixes(sequences: DataFrame, catalogue: DataFrame, terms: str, length: int) -> DataFrame:
    """Sequences whose first terms no catalogued sequence starts with; catalogue has the same column."""
    head = F.slice(terms, 1, length)
    known = catalogue.select(head.alias("__head__")).where(F.size("__head__") == length).distinct()
    return sequences.withColumn("__head__", head).join(known, "__head__", "left_anti").drop("__head__")


def steps(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """``df`` with the value before it in its group's order: for monotony and growth."""
    return df.withColumn("before", F.lag(value).over(Window.partitionBy(*by).orderBy(order)))


def antidiagonal(df: DataFrame, m: str, n: str) -> DataFrame:
    """``df`` with idx, its place when (m, n), from 1, are read by antidiagonals: a formula, so nothing is sorted."""
    d = F.col(m) + F.col(n) - 2
    return df.withColumn("idx", (d * (d + 1) / 2).cast("long") + F.col(n))


def appended(old: DataFrame, new: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    """Old rows and those of ``new`` with keys beyond; raises if they differ where both have a value."""
    if not reconcile(new, old, keys, value).where("status = 'mismatch'").isEmpty():
        raise ValueError("the tables differ where they overlap")
    return old.select(*keys, value).union(new.select(*keys, value).join(old.select(*keys), keys, "left_anti"))


def onset(df: DataFrame, by: list[str], order: str, holds: str) -> DataFrame:
    """(by.., onset, rows): the first place in ``order`` from which on ``holds`` is true to the end, null if it isn't at
    the end, and how many rows are from there. Two aggregations, no sort."""
    last = df.groupBy(*by).agg(F.max(F.when(~F.col(holds), F.col(order))).alias("__last__"))
    after = F.col("__last__").isNull() | (F.col(order) > F.col("__last__"))
    return df.join(last, by).groupBy(*by).agg(F.min(F.when(after, F.col(order))).alias("onset"), F.count_if(after).alias("rows"))


def set_comparison(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(in_both, only_a, only_b, equal) of two sets of keys: one aggregation of flags, no join."""
    marked = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(key, F.lit(0), F.lit(1)))
    flags = marked.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counted = flags.agg(F.count_if(F.expr("a = 1 AND b = 1")).alias("in_both"), F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"))
    return counted.withColumn("equal", F.col("only_a") + F.col("only_b") == 0)
