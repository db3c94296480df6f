"""Boards, prefixes and writers against plain Python; counts that relabelling must keep, and checks that must fail."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.kernels import SURFACES
from tallyforge.operators import boards, graphs, verify
from tallyforge.sources import writers


def neighbours(surface, n, r, c):
    across, along = SURFACES[surface]
    found = {(r, c)}
    for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        x, y = r + a, c + b
        if not 0 <= y < n:
            if not across:
                continue
            x, y = (n - 1 - x if across < 0 else x), y % n
        if not 0 <= x < n:
            if not along:
                continue
            x, y = x % n, (n - 1 - y if along < 0 else y)
        found.add((x, y))
    return sum(1 << (n * x + y) for x, y in found)


def test_lights_by_brute_force(spark):
    rng = random.Random(3)
    patterns = [(k, 3, rng.randrange(512)) for k in range(12)] + [(k, 2, k) for k in range(16)]
    rows = [*patterns, patterns[0], (None, 3, 5), (99, None, 1)]
    found = {(r["surface"], r["n"]): (r["nullity"], r["patterns"], r["solvable"]) for r in boards.lights(spark.createDataFrame(rows, "key long, n long, lit long")).collect()}
    for surface, n in itertools.product(SURFACES, (2, 3)):
        images = [0]
        for r, c in itertools.product(range(n), repeat=2):
            images += [x ^ neighbours(surface, n, r, c) for x in images]
        lit = [m for _, size, m in patterns if size == n]
        assert found[surface, n] == ((2 ** (n * n) // len(set(images))).bit_length() - 1, len(lit), sum(m in set(images) for m in lit)), (surface, n)


def test_euler_characteristics_of_known_surfaces(spark):
    whole = [("all", x, y, 4, 3) for x in range(4) for y in range(3)]
    ring = [("ring", x, y, 4, 3) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    found = {(r["k"], r["surface"]): r["chi"] for r in boards.euler_characteristics(spark.createDataFrame(whole + ring + ring[:2], "k string, x long, y long, w long, h long"), ["k"]).collect()}
    assert {s: found["all", s] for s in ("plane", "cylinder", "torus", "mobius", "klein")} == {"plane": 1, "cylinder": 0, "torus": 0, "mobius": 0, "klein": 0}
    assert found["ring", "plane"] == 0
    assert boards.euler_characteristics(spark.createDataFrame([], "x long, y long, w long, h long"), []).where("faces > 0").isEmpty()


def test_attacking_pairs_of_all_cells(spark):
    n = 5
    cells = list(itertools.product(range(n), repeat=2))
    pairs = sum(a[0] == b[0] or a[1] == b[1] or abs(a[0] - b[0]) == abs(a[1] - b[1]) for a, b in itertools.combinations(cells, 2))
    row = boards.attacking_pairs(spark.createDataFrame(cells + cells[:3], "x long, y long"), []).first()
    assert (row["cells"], row["attacking"], row["peaceful"]) == (25, pairs, 300 - pairs)


def symmetric(spark, pairs):
    return spark.createDataFrame(sorted({(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}), "src long, dst long")


#: a sparse graph on 9 nodes with a bridge, so that both tests reject prefixes
PAIRS = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3), (3, 4), (4, 5), (5, 6), (6, 4), (6, 7), (5, 7), (8, 0), (8, 1)]


def viable_by_hand(pairs, nodes):
    near = {v: {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v} for v in nodes}
    counts = {}
    for p in itertools.permutations(nodes, 3):
        if p[1] not in near[p[0]] or p[2] not in near[p[1]]:
            continue
        off = set(nodes) - set(p)
        open_nodes = off | {p[0], p[2]}
        degree = all(len(near[v] & open_nodes) >= 2 for v in off)
        seen, todo = {p[2]}, [p[2]]
        while todo:
            new = (near[todo.pop()] & open_nodes) - seen
            seen |= new
            todo += new
        joined = seen == open_nodes
        row = counts.setdefault(p[0], [0, 0, 0, 0])
        for i, hit in enumerate((True, degree, joined, degree and joined)):
            row[i] += hit
    return counts


def test_viable_prefixes(spark):
    nodes = spark.range(9).withColumnRenamed("id", "node")
    found = {r["first"]: [r["prefixes"], r["by_degree"], r["connected"], r["viable"]] for r in graphs.viable_prefixes(symmetric(spark, PAIRS), nodes, 2).collect()}
    by_hand = viable_by_hand(PAIRS, range(9))
    assert found == by_hand
    total = [sum(c) for c in zip(*by_hand.values(), strict=True)]
    assert total[0] > total[1] > total[3] and total[0] > total[2] > total[3]
    assert graphs.viable_prefixes(symmetric(spark, PAIRS), nodes.limit(0), 2).isEmpty()


def paths_by_hand(pairs, length):
    edges = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    return sum(len(set(p)) == length + 1 and all(e in edges for e in itertools.pairwise(p)) for p in itertools.product(range(9), repeat=length + 1))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_counts_survive_relabelling(spark, seed):
    """Jobs, paths and paths ahead don't depend on the numbers of the nodes."""
    to = list(range(9)) if not seed else random.Random(seed).sample(range(50), 9)
    row = graphs.prefix_jobs(symmetric(spark, [(to[a], to[b]) for a, b in PAIRS]), 2).agg(F.sum("jobs"), F.sum("paths"), F.sum("ahead")).first()
    two = paths_by_hand(PAIRS, 2)
    assert tuple(row) == (two // 2, two, paths_by_hand(PAIRS, 3))


def test_bitset_triads_beyond_one_mask(spark):
    rng = random.Random(9)
    names = rng.sample(range(300), 20)
    wins = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in itertools.combinations(names, 2)]
    beats = set(wins)
    cyclic = sum({(a, b), (b, c), (c, a)} <= beats or {(b, a), (c, b), (a, c)} <= beats for a, b, c in itertools.combinations(names, 3))
    row = graphs.bitset_triads(spark.createDataFrame(wins + wins[:5], "w long, l long")).first()
    assert tuple(row) == (cyclic, 20 * 19 * 18 // 6 - cyclic)
    assert tuple(graphs.bitset_triads(spark.createDataFrame([], "w long, l long")).first()) == (0, 0)


@pytest.mark.parametrize("at", [0, 7, 19])
def test_a_changed_term_is_found(spark, at):
    golden = spark.range(20).select(F.col("id").alias("idx"), (F.col("id") * F.col("id")).alias("val"))
    changed = golden.withColumn("val", F.when(F.col("idx") == at, F.col("val") + 1).otherwise(F.col("val")))
    assert verify.reconcile(golden, golden, ["idx"]).where("status <> 'match'").isEmpty()
    assert [r["idx"] for r in verify.reconcile(changed, golden, ["idx"]).where("status = 'mismatch'").collect()] == [at]


def test_absence_needs_a_control_that_is_found(spark):
    """Factorials are in the catalogue and must be found by both windows before another sequence counts as absent."""
    known = spark.createDataFrame([([1, 1, 2, 6, 24, 120],), ([1, 2, 6, 24, 120],), ([1, 3, 5, 7, 9],)], "terms array<long>")
    asked = spark.createDataFrame([("control", [1, 1, 2, 6, 24]), ("control later", [1, 2, 6, 24]), ("new", [4, 4, 2, 9])], "name string, terms array<long>")
    assert [r["name"] for r in verify.unseen_prefixes(asked, known, "terms", 4).collect()] == ["new"]


def test_guarded_may_read_what_it_replaces(spark, tmp_path):
    path = f"{tmp_path}/t"
    writers.guarded(spark.range(5), path)
    writers.guarded(spark.read.parquet(path).union(spark.range(5, 7)), path)
    assert spark.read.parquet(path).count() == 7
    with pytest.raises(ValueError, match="7 rows"):
        writers.guarded(spark.range(3), path)
    assert spark.read.parquet(path).count() == 7 and not (tmp_path / "t.next").exists()


def test_level_and_stats_run_twice(spark, tmp_path):
    for _ in range(2):
        writers.level(spark.range(4), f"{tmp_path}/levels", 2)
        writers.stats_csv(spark.range(4), f"{tmp_path}/stats", "two", {"rows": F.count(F.lit(1))})
    assert [(r["level"], r["states"]) for r in spark.read.parquet(f"{tmp_path}/levels/manifest").collect()] == [(2, 4)]
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/stats").select("step", "rows").collect()] == [("two", "4")]
