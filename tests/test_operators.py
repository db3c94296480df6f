"""Operators against known values and small brute-force versions."""

import itertools
from fractions import Fraction
from math import factorial, gcd

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import generators as G
from tallyforge.functions import kernels as K
from tallyforge.operators import exact, functional_graph, graphs, sampling, search, transfer, verify


def test_generators(spark):
    assert G.partitions(spark, 10).count() == 42
    perms = [tuple(r["p"]) for r in G.permutations(spark, 4).orderBy("rank").collect()]
    assert perms == list(itertools.permutations(range(1, 5)))
    assert [r["word"] for r in G.words(spark, 2, 3).orderBy("id").collect()] == ["".join(w) for w in itertools.product("012", repeat=2)]
    assert G.histories(spark, 3, 2).count() == 1 + 2 + 4
    fib = [1, 1, 2, 3, 5, 8, 13]
    assert G.transition_rules(spark, 5).count() == fib[5] - 1
    assert G.line_states(spark, 5, False).count() == 13 and G.line_states(spark, 5, True).count() == 11
    assert G.lattice(spark, 6).count() == 10
    assert G.leaper_vectors(spark, 1, 2).count() == 8 and G.leaper_vectors(spark, 1, 1).count() == 4
    assert G.permutation_graph(spark, 4).count() == 24 * 4
    sizes = {"path": 4, "cycle": 5, "ladder": 13, "prism": 15, "wheel": 10, "fan": 9, "gear": 15, "helm": 15, "friendship": 15, "book_tri": 11, "book_quad": 16}
    assert {name: G.family(spark, name, 5).count() for name in sizes} == sizes


def test_reversal_is_an_automorphism(spark):
    ranks = G.permutations(spark, 4).select("rank", K.permutation_rank(G.conjugate_by_reversal(F.col("p"))).alias("image"))
    edges = G.permutation_graph(spark, 4)
    a, b = ranks.toDF("src", "a"), ranks.toDF("dst", "b")
    moved = edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    assert verify.same_rows(moved, edges)


def test_kernels(spark):
    row = spark.range(1).select(
        K.gcd(F.lit(84), F.lit(-36)).alias("g"), K.lcm_of(F.array(*[F.lit(i) for i in range(1, 11)])).alias("l"), K.power_mod(F.lit(3), F.lit(200), F.lit(1009)).alias("p"),
        K.mex(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("m"), K.composition_count(F.array(F.lit(2), F.lit(1), F.lit(1))).alias("c"), K.reverse_bits(F.lit(6), 5).alias("r"),
        K.solitaire(F.array(*[F.lit(x).cast("long") for x in (3, 2, 1)])).alias("s"), K.automaton_step(30, 5, F.lit(4).cast("long")).alias("a"),
    ).first()
    step = sum(((30 >> (4 * (4 >> ((i + 1) % 5) & 1) + 2 * (4 >> i & 1) + (4 >> ((i - 1) % 5) & 1))) & 1) << i for i in range(5))
    assert tuple(row) == (12, 2520, pow(3, 200, 1009), 2, 3, 12, [3, 2, 1], step)
    primes = [r["id"] for r in spark.range(60).where(K.is_prime(F.col("id"))).collect()]
    assert primes == [p for p in range(2, 60) if all(p % d for d in range(2, p))]


def test_topswops_of_seven(spark):
    row = G.permutations(spark, 7).select(K.flips_to_top(F.col("p"), 16).alias("t")).agg(F.sum("t").alias("s"), F.max("t").alias("m")).first()
    assert tuple(row) == (18508, 16)


def walk_stats(f):
    out = {}
    for x in f:
        seen = [x]
        while f[seen[-1]] not in seen:
            seen.append(f[seen[-1]])
        at = seen.index(f[seen[-1]])
        out[x] = (at, min(seen[at:]), len(seen) - at, seen[at])
    return out


@pytest.mark.parametrize("n", [1, 30, 97])
def test_functional_graph(spark, n):
    f = {x: (x * x + 1) % n for x in range(n)}
    df = spark.range(n).select(F.col("id").alias("key"), K.quadratic(F.col("id"), 1, F.lit(n)).alias("nxt"))
    got = {r["key"]: r for r in functional_graph.analyze(df).collect()}
    for x, (tail, low, length, entry) in walk_stats(f).items():
        r = got[x]
        assert (r["tail"], r["cycle"], r["cycle_len"], r["entry"], r["periodic"]) == (tail, low, length, entry, tail == 0)


def test_solitaire_settles_on_partitions(spark):
    df = G.partitions(spark, 6).select(F.col("p").alias("key"), K.solitaire(F.col("p")).alias("nxt"))
    row = functional_graph.report(functional_graph.analyze(df).withColumn("g", F.lit(1)), ["g"]).first()
    assert (row["nodes"], row["periodic"], row["cycles"], row["fixed"]) == (11, 1, 1, 1)


def test_chip_firing_terminals(spark):
    states = transfer.chip_states(spark, 5)
    assert (transfer.terminal(states).count(), states.count()) == (12, 56)


def test_tilings_kings_and_orphans(spark):
    assert transfer.domino_tilings(spark, 4, 4) == 36
    assert transfer.domino_tilings(spark, 3, 3) == 0
    assert transfer.tiling_counts(spark, 4, 4) == [1, 1, 5, 11, 36]
    assert transfer.fault_free_tilings(spark, 5, 6) == 6
    assert transfer.king_placements(spark, 3, False) == 35
    image = {sum(((30 >> (4 * (x >> ((i + 1) % 6) & 1) + 2 * (x >> i & 1) + (x >> ((i - 1) % 6) & 1))) & 1) << i for i in range(6)) for x in range(64)}
    assert transfer.orphans(spark, 30, 6).first()["orphans"] == 64 - len(image)
    wanted = spark.range(64).withColumnRenamed("id", "y")
    assert transfer.predecessors(spark, 30, 6, wanted).where("witness IS NULL").count() == 64 - len(image)
    assert transfer.symbol_matrices(spark, 30).groupBy("symbol").count().count() == 2


def test_paths_cycles_and_sets_on_small_graphs(spark):
    edges = spark.createDataFrame([(a, b) for a in range(5) for b in range(5) if a != b], "src long, dst long")
    got = {r["length"]: (r["paths"], r["cyclic"]) for r in graphs.simple_paths(edges, spark.range(1).toDF("node"), 4).collect()}
    assert got == {1: (4, 4), 2: (12, 12), 3: (24, 24), 4: (24, 24)}
    assert graphs.hamiltonian_cycles(edges, 5) == factorial(4) // 2
    ring = spark.createDataFrame([(i, (i + d) % 6) for i in range(6) for d in (1, 5)], "src long, dst long")
    assert {r["size"]: r["sets"] for r in graphs.independent_sets(ring, spark.range(6).toDF("node"), 3).collect()} == {1: 6, 2: 9, 3: 2}
    assert graphs.girth(ring).first()["girth"] == 2


def test_breadth_first_order_and_its_width(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)], "src long, dst long")
    order = graphs.breadth_first(ring, 0)
    assert dict(order.collect()) == {0: 0, 1: 1, 5: 2, 2: 3, 4: 4, 3: 5}
    assert graphs.cut_width(ring, order).first()["width"] == 2


def test_strong_components_and_plain_ones(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src long, dst long")
    assert dict(graphs.strong_components(edges).collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert dict(graphs.components(edges).collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}
    assert {r["fault"] for r in graphs.validated(edges.union(spark.createDataFrame([(9, 9), (1, 2)], edges.schema)), 8).collect()} == {"range", "loop", "repeat", "one_way"}


def test_exact_aggregates(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (0, 5), (7, 0)], "h int, o int")
    row = exact.rational_mean(df, [], "h", "o").first()
    assert (row["n"], Fraction(row["num"], row["den"])) == (3, Fraction(5, 18))
    masks = spark.createDataFrame([("a", 0b110), ("b", 0b011), ("c", 0b101), ("d", 0), ("e", -1)], "row string, m long")
    got = exact.gf2_rank(masks, [], "row", "m").first()
    assert (got["rows"], got["rank"]) == (5, 3)
    assert exact.grundy(spark.range(1, 10).withColumnRenamed("id", "n"), 9, True).count() == 9
    rows = exact.factor_walk(spark.createDataFrame([(8051,), (13,), (4,)], "n long"), "n").collect()
    assert 1 < gcd(rows[0]["factor"], 8051) < 8051 and rows[1]["factor"] is None and rows[2]["factor"] == 2


def brute_graceful(edges):
    vertices = sorted({v for e in edges for v in e})
    return sum(len({abs(p[vertices.index(a)] - p[vertices.index(b)]) for a, b in edges}) == len(edges) for p in itertools.permutations(range(len(edges) + 1), len(vertices)))


@pytest.mark.parametrize("name", ["path", "fan"])
def test_graceful_labelings(spark, name):
    edges = [(r["u"], r["v"]) for r in G.family(spark, name, 4).collect()]
    assert search.graceful_labelings(spark, edges) == brute_graceful(edges)


def test_automorphisms_and_attacks(spark):
    ring = spark.createDataFrame([(i, (i + d) % 4) for i in range(4) for d in (1, 3)], "src long, dst long")
    assert search.automorphisms(ring, 4).count() == 8
    king = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    assert search.attacks(spark, "plane", 3, king, False).count() == 40
    assert search.attacks(spark, "torus", 4, king, False).count() == 16 * 8
    rook = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    assert search.attacks(spark, "plane", 3, rook, True).count() == 9 * 4


def test_sampling_is_near_the_exact_count(spark):
    k5 = [[b for b in range(5) if b != a] for a in range(5)]
    for biased in (False, True):
        row = sampling.estimate(sampling.hamiltonian_dives(spark, k5, 400, biased=biased), "weight").first()
        assert abs(row["mean"] - 12) <= 5 * row["se"] + 1e-9
    row = sampling.estimate(sampling.race_dives(spark, "100", "000", 2, 1500), "weight").first()
    assert abs(row["mean"] - 7 / 8) <= 5 * row["se"]


def test_verification(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "idx long, val long")
    b = spark.createDataFrame([(2, 6), (3, 8), (4, 9)], "idx long, val long")
    assert dict(verify.reconcile(a, b, ["idx"]).select("idx", "status").collect()) == {1: "new", 2: "match", 3: "mismatch", 4: "missing"}
    with pytest.raises(ValueError):
        verify.appended(a, b, ["idx"])
    assert verify.appended(a, b.where("idx <> 3"), ["idx"]).count() == 4
    order = verify.antidiagonal(spark.createDataFrame([(1, 1), (2, 1), (1, 2), (3, 1)], "m long, n long"), "m", "n")
    assert [tuple(r) for r in order.orderBy("idx").collect()] == [(1, 1, 1), (2, 1, 2), (1, 2, 3), (3, 1, 4)]
    assert not verify.reconcile(a.withColumn("val", F.col("val") + (F.col("idx") == 2).cast("int")), a, ["idx"]).where("status <> 'match'").isEmpty()


def test_matrix_powers(spark):
    m = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 1)], "i int, j int, v long")
    now = m
    for _ in range(4):
        now = transfer.multiply(now, m)
    assert {(r["i"], r["j"]): int(r["v"]) for r in now.collect()} == {(0, 0): 8, (0, 1): 5, (1, 0): 5, (1, 1): 3}
