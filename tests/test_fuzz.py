"""Random small graphs: different operators, and different numbers of partitions, must agree."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import generators as G
from tallyforge.operators import frontier, graphs, verify


def grid(rows, cols):
    edges = []
    for r in range(rows):
        for c in range(cols):
            v = r * cols + c
            edges += [(v, v + 1)] * (c + 1 < cols) + [(v, v + cols)] * (r + 1 < rows)
    return edges


@pytest.mark.parametrize(("edges", "n", "cycles"), [([(a, b) for a in range(5) for b in range(a + 1, 5)], 5, 12), (grid(4, 4), 16, 6), ([(0, 1), (1, 2)], 3, 0)])
def test_hamiltonian_cycles_edge_by_edge(spark, edges, n, cycles):
    assert frontier.hamiltonian_cycles(spark, edges, n) == cycles


@pytest.mark.parametrize("seed", [1, 2])
def test_two_ways_of_counting_cycles(spark, seed):
    edges = sorted((r["u"], r["v"]) for r in G.random_graph(spark, 7, 650, seed).collect())
    brute = sum(all(tuple(sorted(p)) in edges for p in zip((0, *q), (*q, 0), strict=True)) for q in itertools.permutations(range(1, 7))) // 2
    names = list(range(7))
    random.Random(seed).shuffle(names)
    renamed = [(names[a], names[b]) for a, b in edges]
    both = spark.createDataFrame(renamed + [(b, a) for a, b in renamed], "src long, dst long")
    assert graphs.hamiltonian_cycles(both, 7) == brute
    assert frontier.hamiltonian_cycles(spark, edges, 7) == brute


def test_partitions_do_not_matter(spark):
    edges = G.random_graph(spark, 12, 200, 5).select(F.col("u").alias("src"), F.col("v").alias("dst"))
    start = edges.select(F.col("src").alias("node")).distinct()
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, graphs.simple_paths(edges, start, 3).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    assert verify.same_rows(edges, edges.repartition(5))
