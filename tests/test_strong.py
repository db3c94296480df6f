"""Strong components against Kosaraju's two walks."""

import random

import pytest

from tallyforge.operators import ranking, strong


def kosaraju(edges):
    nodes = {v for e in edges for v in e}
    out, into = ({v: set() for v in nodes} for _ in range(2))
    for a, b in edges:
        out[a].add(b)
        into[b].add(a)

    def walk(start, ways, seen):
        order, stack = [], [(start, iter(ways[start]))]
        seen.add(start)
        while stack:
            v, rest = stack[-1]
            nxt = next((w for w in rest if w not in seen), None)
            if nxt is None:
                order.append(v)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(ways[nxt])))
        return order

    seen, order = set(), []
    for v in sorted(nodes):
        if v not in seen:
            order += walk(v, out, seen)
    seen, component = set(), {}
    for v in reversed(order):
        if v not in seen:
            found = walk(v, into, seen)
            component |= dict.fromkeys(found, min(found))
    return component


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


@pytest.mark.parametrize("worth", [strong.WORTH, 2.0])
def test_random_graphs(spark, monkeypatch, worth):
    """Many small graphs at once, with and without contraction; loops, repeated edges and null ends."""
    monkeypatch.setattr(strong, "WORTH", worth)
    rng = random.Random(9)
    edges = []
    for g in range(150):
        n = rng.randrange(2, 9)
        edges += [(g * 100 + rng.randrange(n), g * 100 + rng.randrange(n)) for _ in range(rng.randrange(1, 14))]
    found = strong.strong_components(frame(spark, [*edges, edges[0], (None, 3), (500_000, 500_000)]))
    assert dict(found.collect()) == kosaraju([*edges, (500_000, 500_000)])


def test_a_long_chain_and_a_cycle(spark):
    """A chain of 100,000 nodes, and a cycle of 1,000 with a tail in and one out."""
    n = 100_000
    chain = spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst")
    assert strong.strong_components(chain).where("node = component").count() == n
    ring = [(200_000 + i, 200_000 + (i + 1) % 1000) for i in range(1000)] + [(300_000, 200_005), (200_009, 300_001)]
    sizes = strong.strong_components(frame(spark, ring)).groupBy("component").count()
    assert {tuple(r) for r in sizes.collect()} == {(200_000, 1000), (300_000, 1), (300_001, 1)}


def test_condensation(spark):
    edges = frame(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 3), (1, 3)])
    rows = strong.condensation(edges, strong.strong_components(edges)).collect()
    assert {tuple(r) for r in rows} == {(1, 2, 0, 1), (3, 2, 2, 0), (5, 1, 0, 1)}


def test_no_edges(spark):
    assert strong.strong_components(frame(spark, [])).count() == 0


# Ranks -----------------------------------------------------------------------------------------------------------------


def test_ranks_of_a_hot_group_and_of_nulls(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id long")
    found = {r["id"]: r["k"] for r in ranking.ranks(df, ["g"], ["v", "id"]).collect()}
    assert len(found) == len(rows)
    for g in ("hot", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [found[r[2]] for r in own] == list(range(1, len(own) + 1))
    whole = ranking.ranks(df, ["g"], ["v", "id"]).groupBy("g").count()
    assert whole.count() == 3 and ranking.ranks(df.limit(0), ["g"], ["v"]).count() == 0
