"""Cycle lengths and witnesses against enumeration."""

import random

import pytest

from tallyforge.operators import cycles


def lengths(edges):
    """Lengths of all simple directed cycles."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    found = set()

    def walk(first, path):
        for b in near.get(path[-1], ()):
            if b == first and len(path) > 1:
                found.add(len(path))
            elif b > first and b not in path:
                walk(first, [*path, b])

    for a in near:
        walk(a, [a])
    return found


def graph(spark, edges):
    return spark.createDataFrame(list(edges), "src long, dst long")


GRAPHS = {
    "none": [],
    "loops": [(1, 1), (2, 2), (1, 2), (1, None)],
    "path": [(i, i + 1) for i in range(6)],
    "two cycles": [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 6), (6, 3), (2, 3), (2, 3)],
    "bipartite": [(a, b) for a in range(4) for b in range(4, 8)] + [(b, a) for a in range(4) for b in range(4, 8) if (a + b) % 3],
    "highest node": [(60, 61), (61, 62), (62, 60)],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("sample", [3, 20_000])
def test_lengths_of_graphs(spark, name, sample):
    edges = GRAPHS[name]
    got = cycles.cycle_lengths(graph(spark, edges), sample=sample)
    assert {r["length"] for r in got.collect()} == lengths([e for e in edges if None not in e and e[0] != e[1]])
    assert all(r["verified"] for r in cycles.checked(graph(spark, edges), got).collect())


def test_lengths_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(a, b) for a in range(9) for b in range(9) if a != b and rng.random() < 0.25]
    got = cycles.cycle_lengths(graph(spark, edges), sample=5)
    assert {r["length"] for r in got.collect()} == lengths(edges)


def test_a_node_beyond_the_mask_is_an_error(spark):
    with pytest.raises(Exception, match="0 to 62"):
        cycles.cycle_lengths(graph(spark, [(0, 63), (63, 0)]))


def test_coded_cycles(spark):
    far = 10**12
    edges = [(far + a, far + b) for a, b in GRAPHS["two cycles"]]
    for length in (3, 4, 5):
        got = cycles.coded_cycle(graph(spark, edges), length)
        rows = cycles.checked(graph(spark, edges), got).collect()
        assert [r["verified"] for r in rows] == ([True] if length < 5 else [])
    with pytest.raises(ValueError, match="2 to 20"):
        cycles.coded_cycle(graph(spark, edges), 1)


def test_a_false_witness_is_not_verified(spark):
    edges = graph(spark, [(0, 1), (1, 2), (2, 0)])
    claims = spark.createDataFrame([(3, [0, 1, 2]), (3, [0, 2, 1]), (3, [0, 1, 0]), (2, [0, 1, 2])], "length int, witness array<long>")
    assert {(r["length"], tuple(r["witness"])): r["verified"] for r in cycles.checked(edges, claims).collect()} == {(3, (0, 1, 2)): True, (3, (0, 2, 1)): False, (3, (0, 1, 0)): False, (2, (0, 1, 2)): False}
