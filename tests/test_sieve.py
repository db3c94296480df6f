"""Sieve, factor sets and orders against plain Python."""

from math import gcd

import pytest

from tallyforge.operators import sieve


def least(n):
    return next((d for d in range(2, int(n**0.5) + 1) if n % d == 0), n)


@pytest.mark.parametrize("segment", [64, 1 << 18])
@pytest.mark.parametrize("upto", [0, 2, 63, 64, 1000])
def test_least_factors(spark, monkeypatch, segment, upto):
    monkeypatch.setattr(sieve, "SEGMENT", segment)
    assert sorted(map(tuple, sieve.least_factors(spark, upto).collect())) == [(n, least(n)) for n in range(2, upto + 1)]


def test_factors(spark):
    numbers = spark.createDataFrame([(n,) for n in [1, 0, None, 2, 12, 12, 97, 64, 900]], "n long")
    got = sieve.factors(numbers, sieve.least_factors(spark, 1000))
    assert sorted(map(tuple, got.collect())) == [(2, 2, 1), (12, 2, 2), (12, 3, 1), (64, 2, 6), (97, 97, 1), (900, 2, 2), (900, 3, 2), (900, 5, 2)]


@pytest.mark.parametrize("base", [2, 10])
def test_orders(spark, base):
    want = {n: next(k for k in range(1, n + 1) if pow(base, k, n) == 1) for n in range(2, 200) if gcd(n, base) == 1}
    got = sieve.multiplicative_orders(spark.range(200).withColumnRenamed("id", "n"), base)
    assert {r["n"]: r["ord"] for r in got.collect()} == want


def test_no_numbers_and_too_large(spark):
    assert sieve.multiplicative_orders(spark.createDataFrame([(None,), (1,)], "n long"), 2).count() == 0
    with pytest.raises(Exception, match="below 2"):
        sieve.multiplicative_orders(spark.createDataFrame([(2**31,)], "n long"), 2)
