"""Residue arithmetic, linear systems and races against Python's fractions."""

import itertools
import random
from fractions import Fraction
from math import lcm, log2

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import kernels as K
from tallyforge.operators import exact, functional_graph, graphs, races, residues, sampling


def test_primes_and_fractions():
    primes = residues.primes_for(500)
    assert primes[0] == 2**31 - 1 and sorted(set(primes), reverse=True) == primes and sum(map(log2, primes)) > 500
    assert all(all(p % d for d in range(3, 2000, 2)) for p in primes)
    for f in (Fraction(0), Fraction(-7, 3), Fraction(10**40 + 1, 10**35 + 3), Fraction(1, 2**200)):
        assert Fraction(*residues.fraction_of([(p, f.numerator * pow(f.denominator, -1, p) % p) for p in primes])) == f


def test_fraction_means_beyond_64_bits(spark):
    rng = random.Random(1)
    rows = [("a", rng.randrange(-(10**18), 10**18), d) for d in range(1, 61) for _ in range(3)] + [("b", 1, d) for d in range(1, 301)] + [("c", 0, 7), ("c", None, 7), ("c", 5, 0), ("c", 5, None), (None, 3, 2), ("d", 10**18, 1)] + [("d", 10**18, 1)] * 30
    df = spark.createDataFrame(rows, "g string, h long, o long")
    got = {r["g"]: (r["n"], Fraction(int(r["num"]), int(r["den"]))) for r in residues.fraction_means(df, ["g"], "h", "o").collect()}
    for g in ("a", "b", "c", "d", None):
        kept = [Fraction(h, o) for k, h, o in rows if k == g and h is not None and o]
        assert got[g] == (len(kept), sum(kept) / len(kept))
    assert got.keys() == {"a", "b", "c", "d", None} and lcm(*range(1, 61)) > 2**64
    whole = residues.fraction_sums(df, [], "h", "o").first()
    assert Fraction(int(whole["num"]), int(whole["den"])) == sum(Fraction(h, o) for _, h, o in rows if h is not None and o)
    assert residues.fraction_means(df.limit(0), ["g"], "h", "o").count() == 0
    with pytest.raises(Exception, match="below 2"):
        residues.fraction_sums(spark.createDataFrame([(1, 2**30)], "h long, o long"), [], "h", "o").collect()
    assert exact.rational_mean(df.where("g = 'c'"), ["g"], "h", "o").first().asDict() == {"g": "c", "n": 1, "num": 0, "den": 1}


def solved(rows):
    """Gauss by fractions; None if singular."""
    m = [[Fraction(x) for x in r] for r in rows]
    n = len(m)
    for c in range(n):
        pivot = next((r for r in range(c, n) if m[r][c]), None)
        if pivot is None:
            return None
        m[c], m[pivot] = m[pivot], m[c]
        m[c] = [x / m[c][c] for x in m[c]]
        m = [m[r] if r == c else [x - m[r][c] * y for x, y in zip(m[r], m[c], strict=True)] for r in range(n)]
    return [r[-1] for r in m]


def test_linear_systems(spark):
    """Systems of several sizes at once, with large numbers, zero pivots, and a singular one among them."""
    rng = random.Random(2)
    systems = {}
    for s in range(12):
        n, size = rng.randrange(1, 7), rng.choice([2, 10, 2**30])
        systems[s] = [[rng.randrange(-size, size + 1) for _ in range(n + 1)] for _ in range(n)]
    systems[20] = [[1, 2, 3], [2, 4, 6]]
    systems[21] = [[0, 1, 5], [1, 0, 7]]
    systems[22] = [[2**31 - 1, 0, 1], [0, 2**31 - 1, 2]]  # the first prime divides the determinant
    df = spark.createDataFrame([(s, k, r) for s, rows in systems.items() for k, r in enumerate(rows)], "s long, row long, coefs array<long>")
    got = {}
    for r in residues.solve(df, ["s"]).collect():
        got.setdefault(r["s"], {})[r["unknown"]] = Fraction(int(r["num"]), int(r["den"]))
    for s, rows in systems.items():
        wanted = solved(rows)
        assert got.get(s) == (wanted and dict(enumerate(wanted))), s
    assert 20 not in got


def test_chance_by_formula_equals_linear_equations(spark):
    words = ["".join(w) for w in itertools.product("01", repeat=3)]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words if a != b], "a string, b string")
    found = {(r["a"], r["b"]): Fraction(int(r["num"]), int(r["den"])) for r in races.race(pairs, {"0": 1, "1": 1}).collect()}
    for r in pairs.select("a", "b", K.odds(F.col("a"), F.col("b"), 3, 2).alias("o")).collect():
        assert Fraction(r["o"]["num"], r["o"]["den"]) == found[r["a"], r["b"]]
    assert found["100", "000"] == Fraction(7, 8) and len(found) == 56


def test_weighted_races_of_words_of_any_length(spark):
    weights = {"x": 3, "y": 1, "z": 2}
    words = ["xy", "zzx", "yxyx", "xxxz", "yzy"]
    pairs = [(a, b) for a in words for b in words if a != b and a not in b and b not in a]

    def chance(a, b):
        states = sorted({w[:i] for w in (a, b) for i in range(len(w))})
        rows = []
        for s in states:
            row = {t: Fraction(s == t) for t in states} | {None: Fraction(0)}
            for letter, weight in weights.items():
                t = s + letter
                if t.endswith(a):
                    row[None] += Fraction(weight, 6)
                elif not t.endswith(b):
                    row[next(t[i:] for i in range(len(t) + 1) if t[i:] in states)] -= Fraction(weight, 6)
            rows.append([*(row[t] for t in states), row[None]])
        return solved(rows)[0]

    got = {(r["a"], r["b"]): Fraction(int(r["num"]), int(r["den"])) for r in races.race(spark.createDataFrame(pairs, "a string, b string"), weights).collect()}
    assert got == {p: chance(*p) for p in pairs}


# Bounds of masks -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("node", [63, 64, 130, -1])
def test_nodes_beyond_a_mask_raise_an_error(spark, node):
    """They had wrapped round to other nodes' places."""
    edges = spark.createDataFrame([(0, node), (node, 0), (1, 0), (0, 1)], "src long, dst long")
    nodes = spark.createDataFrame([(0,), (1,), (node,)], "node long")
    starts = spark.createDataFrame([(1, 0)], "id long, head long")
    for made in (
        lambda: graphs.simple_paths(edges, nodes, 2).collect(), lambda: graphs.independent_sets(edges, nodes, 2).collect(), lambda: graphs.largest_independent_sets(edges, nodes).collect(),
        lambda: graphs.dive_estimate(edges, starts, 2).collect(), lambda: graphs.neighbour_masks(edges).collect(), lambda: graphs.prefixes(edges, 1).collect(), lambda: graphs.viable_prefixes(edges, nodes, 1).collect(),
    ):
        with pytest.raises(Exception, match="masks have the places"):
            made()


def test_node_62_has_a_place(spark):
    edges = spark.createDataFrame([(61, 62), (62, 61), (62, 0), (0, 62)], "src long, dst long")
    found = {r["length"]: (r["paths"], r["cyclic"]) for r in graphs.simple_paths(edges, spark.createDataFrame([(61,)], "node long"), 2).collect()}
    assert found == {1: (1, 1), 2: (1, 0)}
    assert graphs.largest_independent_sets(edges, spark.createDataFrame([(0,), (61,), (62,)], "node long")).first()[:] == (2, 1)


def test_other_bounds_raise_errors(spark):
    p = spark.createDataFrame([(89,)], "p long")
    with pytest.raises(Exception, match="up to 61"):
        p.select(K.lucas_lehmer(F.col("p"))).collect()
    with pytest.raises(Exception, match="below 2"):
        functional_graph.parameter_sums(spark.createDataFrame([(2**20, 1, 1)], "n long, c long, times long")).collect()


# Bootstrap -------------------------------------------------------------------------------------------------------------


def test_bootstrap_interval(spark):
    """Its width is near that of the normal interval; nulls are left out; an empty group has no row."""
    rng = random.Random(4)
    values = [rng.randrange(100) for _ in range(4000)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 1, 7), ("c", 2, None), ("c", None, 5), (None, 3, 9)], "g string, id long, v long")
    rows = {r["g"]: r for r in sampling.poisson_bootstrap(df, ["g"], "id", "v", replicates=80).collect()}
    mean, se = sum(values) / 4000, (sum((v - sum(values) / 4000) ** 2 for v in values) / 4000 / 4000) ** 0.5
    a = rows["a"]
    assert a["n"] == 4000 and a["mean"] == int(mean * 1000) and a["low"] < a["mean"] < a["high"]
    assert 2.5 * se < (a["high"] - a["low"]) / 1000 < 5.5 * se and abs(a["middle"] - a["mean"]) < 4000 * se
    assert (rows["b"]["n"], rows["b"]["mean"], rows["b"]["middle"]) == (1, 7000, 7000) and rows.keys() == {"a", "b", None}
