"""Arithmetic from a segmented sieve: least prime factors, factor sets and multiplicative orders of many numbers at once."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import kernels as K
from tallyforge.operators.loops import written

SEGMENT = 1 << 18
LARGEST = 2**31 - 1


def _small_primes(upto: int) -> np.ndarray:
    """Primes up to the root of LARGEST at most."""
    prime = np.ones(upto + 1, dtype=bool)
    prime[:2] = False
    for p in range(2, isqrt(upto) + 1):
        if prime[p]:
            prime[p * p :: p] = False
    return np.flatnonzero(prime)


def least_factors(spark: SparkSession, upto: int) -> DataFrame:
    """(n, p) with the least prime factor of each n from 2 to ``upto``, below 2**31. A segment of numbers is one row of a range,
    sieved apart from the others by the primes up to the root of ``upto``, of which there are 4,792 at most."""
    if upto > LARGEST:
        raise ValueError("numbers must be below 2**31")
    primes = _small_primes(isqrt(max(upto, 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low in pdf["id"].tolist():
                n = np.arange(low, min(low + SEGMENT, upto + 1), dtype=np.int64)
                least = n.copy()
                for p in primes[::-1].tolist():  # the least one comes last
                    least[-low % p :: p] = np.where(n[-low % p :: p] == p, least[-low % p :: p], p)
                yield pd.DataFrame({"n": n, "p": least})[n >= 2]

    segments = -(-(upto + 1) // SEGMENT) if upto >= 2 else 0
    return spark.range(0, segments * SEGMENT, SEGMENT, max(1, min(segments, 10_000))).mapInPandas(run, "n long, p long")


def factors(numbers: DataFrame, least: DataFrame) -> DataFrame:
    """(n, p, e): prime powers of the numbers (n) by a table of least factors (n, p) that holds them. A round divides all
    numbers by their least factor, 30 rounds at most. Numbers below 2, nulls and repeated ones have no rows of their own."""
    least = least.select(F.col("n").alias("left"), "p")
    now = written(numbers.where("n >= 2").select(F.col("n").cast("long").alias("n")).distinct().withColumn("left", F.col("n")))
    found = None
    while not now.isEmpty():
        step = written(now.join(least, "left").select("n", "p", (F.col("left") / F.col("p")).cast("long").alias("left")))
        found = step.select("n", "p") if found is None else found.union(step.select("n", "p"))
        now = step.where("left > 1").select("n", "left")
    if found is None:
        return numbers.sparkSession.createDataFrame([], "n long, p long, e long")
    return found.groupBy("n", "p").agg(F.count(F.lit(1)).alias("e"))


def multiplicative_orders(numbers: DataFrame, base: int) -> DataFrame:
    """(n, ord): the least k > 0 with base**k = 1 modulo n, for each different n from 2 to 2**31 - 1 that has no factor in
    common with ``base``; other numbers have no row, greater ones raise an error. Totients come from the factors of n, and every
    prime of a totient is divided out as often as the power stays 1."""
    spark = numbers.sparkSession
    fits = F.when(F.col("n") <= LARGEST, F.col("n").cast("long")).otherwise(F.raise_error(F.lit("numbers must be below 2**31")).cast("long"))
    numbers = written(numbers.where("n >= 2").select(fits.alias("n")).distinct())
    least = written(least_factors(spark, numbers.agg(F.max("n").alias("n")).first()["n"] or 0))
    own = written(factors(numbers, least))
    shared = own.where(F.lit(base) % F.col("p") == 0).select("n").distinct()
    parts = own.join(shared, "n", "left_anti").groupBy("n").agg(F.collect_list(F.struct("p", "e")).alias("parts"))  # 9 primes at most
    times = F.aggregate("parts", F.lit(1).cast("long"), lambda a, x: F.aggregate(F.sequence(F.lit(1).cast("long"), x["e"]), a * (x["p"] - 1), lambda b, i: F.when(i > 1, b * x["p"]).otherwise(b)))
    totients = written(parts.select("n", times.alias("t")))
    primes = factors(totients.select(F.col("t").alias("n")), least).groupBy(F.col("n").alias("t")).agg(F.collect_list(F.struct("p", "e")).alias("parts"))
    met = totients.join(primes, "t", "left")
    n = F.col("n")

    def divided(order, x):
        return F.aggregate(F.sequence(F.lit(1).cast("long"), x["e"]), order, lambda o, _: F.when((o % x["p"] == 0) & (K.power_mod(F.lit(base), (o / x["p"]).cast("long"), n) == 1), (o / x["p"]).cast("long")).otherwise(o))

    return met.select("n", F.when(F.col("parts").isNull(), F.col("t")).otherwise(F.aggregate("parts", F.col("t"), divided)).alias("ord"))
