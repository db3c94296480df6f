"""Exact arithmetic beyond 64 bits: numbers are kept as residues modulo several primes below 2**31.

Residues add and multiply in 64-bit columns, so sums are Spark's partial sums and elimination is joins. How many primes are
needed follows from a bound of the result's size, which one aggregate gives. A result is put together once, from as many
residues as there are primes: by Chinese remainders, and as a fraction by rational reconstruction, which is unique while
numerator and denominator are below the root of half the primes' product.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, gcd, isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import kernels as K
from tallyforge.operators.loops import cut


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all numbers below 2**31."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_for(bits: float) -> list[int]:
    """The greatest primes below 2**31, as many as have a product above 2**bits; each is above 2**30."""
    out, product, n = [], 1, 2**31 - 1
    while product <= 1 << ceil(bits):
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def inverse(value: Column, prime: Column) -> Column:
    """By Fermat; for values that the prime doesn't divide."""
    return K.power_mod(F.pmod(value, prime), prime - 2, prime)


def fraction_of(residues: list[tuple[int, int]]) -> tuple[int, int]:
    """(numerator, denominator > 0) in lowest terms of a fraction from (prime, residue)."""
    whole, x = 1, 0
    for p, r in residues:
        x += whole * ((r - x) * pow(whole, -1, p) % p)
        whole *= p
    bound = isqrt((whole - 1) // 2)
    a, b, s, t = whole, x % whole, 0, 1
    while b > bound:
        q = a // b
        a, b, s, t = b, a - q * b, t, s - q * t
    if not t or abs(t) > bound or gcd(b, t) != 1:
        raise ArithmeticError("the primes are too few for this fraction")
    return (b, t) if t > 0 else (-b, -t)


def restored(df: DataFrame, keys: list[str], over: str | None = None) -> DataFrame:
    """(keys.., num, den: decimal strings) from rows (keys.., __p, __r): the fraction with these residues, divided by the whole
    number in column ``over`` if one is named. A group has a row for each prime."""
    extra = [F.max(over).cast("string").alias("over")] if over else [F.lit("1").alias("over")]
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__p", "__r"))).alias("residues"), *extra)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for residues, divisor in zip(pdf["residues"], pdf["over"], strict=True):
                n, d = fraction_of([(int(x["__p"]), int(x["__r"])) for x in residues])
                d *= int(divisor)
                g = gcd(n, d)
                found.append((str(n // g), str(d // g)))
            yield pdf[keys].assign(num=[f[0] for f in found], den=[f[1] for f in found])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return grouped.mapInPandas(run, f"{kept}{', ' if kept else ''}num string, den string")


def _each_prime(df: DataFrame, primes: list[int]) -> DataFrame:
    """Every row once for each prime __p: tens of them, by the bound."""
    return df.withColumn("__p", F.explode(F.array(*[F.lit(p).cast("long") for p in primes])))


def fraction_sums(df: DataFrame, by: list[str], num: str, den: str) -> DataFrame:
    """(by.., n, num, den): the sum of num / den over rows with 0 < den < 2**30, in lowest terms, as decimal strings; n is the
    number of these rows. Greater denominators raise an error; null numbers and denominators, and others, are left out.

    Rows of one denominator are summed first. The least common multiple of denominators has at most as many bits as they
    have together, or as that of all numbers up to the greatest, below 1.5 bits for each."""
    rows = df.where((F.col(den) > 0) & F.col(num).isNotNull()).select(*by, F.col(num).cast("decimal(38,0)").alias("s"), F.when(F.col(den) < 2**30, F.col(den).cast("long")).otherwise(F.raise_error(F.lit("denominators must be below 2**30")).cast("long")).alias("d"))
    sums = cut(rows.groupBy(*by, "d").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.count(F.lit(1)).alias("c")))
    sizes = sums.groupBy(*by).agg(F.least(F.sum(F.log2("d")), 1.5 * F.max("d")).alias("lcm_bits"), F.log2(F.sum(F.abs(F.col("s").cast("double"))) + 1).alias("top_bits"))
    most = sizes.agg(F.coalesce(F.max(F.col("lcm_bits") + F.col("top_bits")), F.lit(0.0)).alias("bits")).first()["bits"]
    dealt = _each_prime(sums, primes_for(2 * most + 3))
    r = F.pmod(F.col("s"), F.col("__p").cast("decimal(38,0)")).cast("long") * inverse(F.col("d"), F.col("__p")) % F.col("__p")
    summed = dealt.groupBy(*by, "__p").agg(F.sum(r).alias("__r"), F.sum("c").alias("n")).withColumn("__r", F.col("__r") % F.col("__p"))
    return restored(summed, [*by, "n"])


def fraction_means(df: DataFrame, by: list[str], num: str, den: str) -> DataFrame:
    """(by.., n, num, den): as fraction_sums(), for the mean."""
    sums = fraction_sums(df, by, num, den)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for n, top, bottom in zip(pdf["n"], map(int, pdf["num"]), map(int, pdf["den"]), strict=True):
                g = gcd(top, bottom * int(n))
                found.append((str(top // g), str(bottom * int(n) // g)))
            yield pdf.assign(num=[f[0] for f in found], den=[f[1] for f in found])

    return sums.mapInPandas(run, sums.schema)


def solve(systems: DataFrame, by: list[str]) -> DataFrame:
    """(by.., unknown, num, den): exact solutions of regular linear systems (by.., row, coefs): coefs are the n coefficients
    of the unknowns 0 .. n-1 and the right side, whole numbers below 2**31 in size, and each system has n rows. A singular
    system has no solution rows.

    All systems are eliminated together, each in several prime fields, one pivot a round: its row goes by a join to the other
    rows of its system and field. Cramer's determinants are below the product of the rows' lengths (Hadamard), which gives the
    number of primes; two more make up for primes that divide a determinant, and fewer than needed raise an error."""
    lengths = F.aggregate("__a", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = cut(systems.select(*by, F.col("row").cast("long").alias("__row"), F.transform("coefs", lambda x: x.cast("long")).alias("__a")))
    sizes = rows.groupBy(*by).agg(F.sum(F.log2(lengths + 1) / 2).alias("bits"))
    shape = sizes.agg(F.coalesce(F.max("bits"), F.lit(0.0)).alias("bits")).first()
    rounds = rows.agg(F.coalesce(F.max(F.size("__a") - 1), F.lit(0)).alias("n")).first()["n"]
    needed = primes_for(2 * shape["bits"] + 3)
    primes = primes_for(sum(p.bit_length() for p in needed) + 62)
    field, p = [*by, "__p"], F.col("__p")  # names that no key of a system has
    now = _each_prime(rows, primes).select(*field, "__row", (F.size("__a") - 1).alias("__n"), F.transform("__a", lambda x: F.pmod(x, p)).alias("__a"), F.lit(-1).alias("__pivot"))
    for c in range(rounds):
        head = F.element_at("__a", c + 1)
        open_rows = now.where((F.col("__n") > c) & (F.col("__pivot") < 0)).where(head != 0)
        chosen = open_rows.groupBy(*field).agg(F.min_by(F.struct("__row", "__a"), "__row").alias("__top"))
        scale = inverse(F.element_at(F.col("__top.__a"), c + 1), p)
        chosen = chosen.select(*field, F.col("__top.__row").alias("__top_row"), scale.alias("__scale"), F.col("__top.__a").alias("__top"))
        chosen = chosen.select(*field, "__top_row", F.transform("__top", lambda x: x * F.col("__scale") % p).alias("__top"))
        met = now.where(F.col("__n") > c).join(chosen, field)  # a field in which the system is singular ends here
        left = F.zip_with("__a", "__top", lambda x, y: F.pmod(x - F.element_at(F.col("__a"), c + 1) * y % p, p))
        own = F.col("__row") == F.col("__top_row")
        moved = met.select(*field, "__row", "__n", F.when(own, F.col("__top")).otherwise(left).alias("__a"), F.when(own, F.lit(c)).otherwise(F.col("__pivot")).alias("__pivot"))
        now = cut(moved.union(now.where(F.col("__n") <= c)))
    values = now.where("__pivot >= 0").select(*by, F.col("__pivot").cast("long").alias("unknown"), "__p", F.element_at("__a", -1).alias("__r"))
    enough = values.groupBy(*by, "unknown").agg(F.count(F.lit(1)).alias("__fields"))
    checked = values.join(enough, [*by, "unknown"]).withColumn("__r", F.when(F.col("__fields") >= len(needed), F.col("__r")).otherwise(F.raise_error(F.lit("too many primes divide a determinant")).cast("long")))
    return restored(checked, [*by, "unknown"])
