"""Exact aggregates: rationals, least common multiples, GF(2) rank, Grundy values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import kernels as K
from tallyforge.operators import residues


def rational_mean(df: DataFrame, by: list[str], num: str, den: str) -> DataFrame:
    """(by.., n, num, den): the mean of num / den over rows with den > 0, in lowest terms, by residues: no denominators meet.
    A numerator or denominator beyond 64 bits raises an error here; residues.fraction_means() gives it as a string."""
    return residues.fraction_means(df, by, num, den).select(*by, "n", F.col("num").cast("long").alias("num"), F.col("den").cast("long").alias("den"))


def signed_sum(value: Column, power: Column) -> Column:
    """Sum of (-1)**power * value."""
    return F.sum(F.when(power % 2 == 0, value).otherwise(-value))


def gf2_rank(df: DataFrame, by: list[str], row: str, mask: str) -> DataFrame:
    """(by.., rows, rank) over GF(2) of each group's 64-bit rows. A group keeps one row of each leading bit, so a task
    holds 64 numbers at most, however many rows there are: partitions are reduced first, then their bases meet."""
    reduced = df.select(*by, F.col(mask).cast("long").alias("m"))

    def reduce_group(pdf: pd.DataFrame) -> pd.DataFrame:
        basis: dict[int, int] = {}
        for m in pdf["m"]:
            m = int(m) & (2**64 - 1)
            while m and (lead := m.bit_length()) in basis:
                m ^= basis[lead]
            if m:
                basis[m.bit_length()] = m
        out = pd.DataFrame({"m": [x - 2**64 if x >= 2**63 else x for x in basis.values()]}, dtype="int64")
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "m"]]

    shape = df.select(*by, F.col(mask).cast("long").alias("m")).schema
    parts = reduced.withColumn("__p__", F.spark_partition_id())
    local = parts.groupBy(*by, "__p__").applyInPandas(lambda pdf: reduce_group(pdf), shape)
    whole = local.groupBy(*by).applyInPandas(reduce_group, shape)
    ranks = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("rank"))
    counts = df.groupBy(*by).agg(F.countDistinct(row).alias("rows"))
    joined = counts.join(ranks, by, "left") if by else counts.crossJoin(ranks)
    return joined.select(*by, "rows", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"))


def grundy(heaps: DataFrame, largest: int, coprime: bool) -> DataFrame:
    """(n, g) Grundy values of the game that takes d of n chips when gcd(d, n) = 1 (or > 1), joined to heaps (n).

    The recursion runs in n, so it is one short table, made once; the heaps are joined to it."""
    from math import gcd

    values = [0]
    for n in range(1, largest + 1):
        seen = {values[n - d] for d in range(1, n + 1) if (gcd(d, n) == 1) == coprime}
        values.append(next(g for g in range(len(seen) + 1) if g not in seen))
    table = heaps.sparkSession.createDataFrame(list(enumerate(values)), "n long, g long")
    return heaps.join(table, "n")


def factor_walk(numbers: DataFrame, column: str, c: int = 1) -> DataFrame:
    """``numbers`` with a factor found by Floyd's cycle search on x*x + c, null if the walk closes without one. A small
    helper per number; the rows are dealt out by Spark."""
    from math import gcd

    @F.udf("long")
    def factor(n):
        if n is None or n < 4:
            return None
        if n % 2 == 0:
            return 2
        slow = fast = 2
        while True:
            slow, fast = (slow * slow + c) % n, ((fast * fast + c) ** 2 + c) % n
            d = gcd(abs(slow - fast), n)
            if d == n:
                return None
            if d > 1:
                return d

    return numbers.withColumn("factor", factor(F.col(column).cast("long")))


def gf2_kernel(df: DataFrame, row: str, mask: str, target: int) -> DataFrame:
    """(rows, nullity, fewest_rows): the dimension of the sets of rows that cancel out over GF(2), and how many rows at
    least add up to ``target`` (null if none do). At most 62 rows, of 64 bits; solutions are 2**nullity, and weighed by
    Spark."""
    masks = [r[mask] for r in df.select(row, mask).orderBy(row).limit(63).collect()]
    if len(masks) > 62:
        raise ValueError("more than 62 rows")
    basis: list[tuple[int, int]] = []  # a reduced row and the rows that make it

    def reduced(value: int, made_of: int) -> tuple[int, int]:
        for v, m in basis:
            if value ^ v < value:
                value, made_of = value ^ v, made_of ^ m
        return value, made_of

    kernel = []
    for i, value in enumerate(masks):
        value, made_of = reduced(value & (2**64 - 1), 1 << i)
        if value:
            basis.append((value, made_of))
            basis.sort(reverse=True)
        else:
            kernel.append(made_of)
    left, one = reduced(target & (2**64 - 1), 0)
    chosen = F.lit(one).cast("long")
    for i, k in enumerate(kernel):
        chosen = chosen.bitwiseXOR(F.when(K.bit(F.col("id"), F.lit(i)) == 1, F.lit(k).cast("long")).otherwise(F.lit(0).cast("long")))
    sizes = df.sparkSession.range(2 ** len(kernel) if not left else 0).agg(F.min(F.bit_count(chosen)).cast("long").alias("fewest_rows"))
    return sizes.select(F.lit(len(masks)).cast("long").alias("rows"), F.lit(len(kernel)).cast("long").alias("nullity"), "fewest_rows")
