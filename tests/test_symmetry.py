"""Orbits and orders of groups against all permutations."""

from itertools import permutations
from math import factorial
import random

import pytest

from tallyforge.operators import symmetry


def brute(nodes, edges):
    both = {frozenset(e) for e in edges}
    kept = [dict(zip(nodes, p, strict=True)) for p in permutations(nodes)]
    kept = [p for p in kept if {frozenset(p[v] for v in e) for e in both} == both]
    return {v: min(p[v] for p in kept) for v in nodes}, len(kept)


def run(spark, nodes, edges):
    found, order = symmetry.orbits(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(v,) for v in nodes], "node long"))
    return {r["node"]: r["orbit"] for r in found.collect()}, order


RNG = random.Random(2)
GRAPHS = {
    "ring": (range(6), [(i, (i + 1) % 6) for i in range(6)]),
    "two paths and two edges": (range(1, 8), [(1, 2), (2, 3), (4, 5), (6, 7)]),
    "star with a tail": (range(7), [(0, i) for i in range(1, 6)] + [(5, 6)]),
    "no edges": (range(4), []),
    "random": (range(7), [(a, b) for a in range(7) for b in range(a) if RNG.random() < 0.4]),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_orbits(spark, name):
    nodes, edges = GRAPHS[name]
    assert run(spark, list(nodes), edges) == brute(list(nodes), edges)


def test_large_groups_are_not_listed(spark):
    nodes = list(range(20))
    assert run(spark, nodes, [(a, b) for a in nodes for b in range(a)]) == (dict.fromkeys(nodes, 0), factorial(20))


def test_odd_graphs(spark):
    assert run(spark, [], []) == ({}, 1)
    assert run(spark, [3, 3, 4], [(3, 3), (3, None), (3, 4), (4, 3)]) == ({3: 3, 4: 3}, 2)
    with pytest.raises(Exception, match="0 to 62"):
        run(spark, [0, 63], [(0, 63)])
