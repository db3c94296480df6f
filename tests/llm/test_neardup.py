import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import neardup
from tallyforge.llm.components import connected_components


def brute(rows, width, percent=80):
    """component of each id, and set sizes, by comparing all pairs."""
    sets = collections.defaultdict(set)
    for i, t in rows:
        words = (t or "").encode().lower().split()
        sets[i] |= {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = [None, "", " \n", "a b", "A  b", "a b c", "x"]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(20, 120))]
        out.append(" ".join(base))
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            out.append((" " if rng.random() < 0.5 else "\n").join(copy))
    return list(enumerate(out, 10))


@pytest.mark.parametrize("block", [512, 4])
def test_components_equal_brute_force(spark, block):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Component_id", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, width=4, block=block).collect()}
    assert got == brute(rows, 4)


def test_repeated_rows_and_drop(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, None), (None, "q r s t u v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = neardup.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, "a b c d e f"), (3, None), (None, "q r s t u v w")], key=str)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_similar_pairs_counts_exactly():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(20)]
    got = {tuple(p) for p in neardup.similar_pairs(sets, sets, 60)}
    assert got == {(i, j) for i in range(20) for j in range(20) if 100 * len(set(sets[i]) & set(sets[j])) >= 60 * len(set(sets[i]) | set(sets[j]))}


def test_connected_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (9, 8), (8, 9)]
    got = dict(connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    assert {got[i] for i in range(100, 141)} == {100}
    assert {got[i] for i in range(200, 260)} | {got[7]} == {7}
    assert got[9] == got[8] == 8


def test_null_id_inside_a_group_of_copies(spark):
    """Copies stay linked with each other and with near copies; the null id's row has no component, and stays."""
    words = [f"w{i}" for i in range(100)]
    copy, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(None, copy), (1, copy), (2, copy), (3, near), (None, near), (4, "q r s t u v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (None, None), (None, None)]
    assert sorted(map(tuple, neardup.drop_near_duplicates(df).collect()), key=str) == sorted([rows[0], rows[1], rows[4], rows[5]], key=str)


def test_null_ids_are_kept_by_the_query(spark, tmp_path):
    spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.op3_minhash(spark, str(tmp_path)).collect()}
    assert got == {(None, None, True), (1, 1, True), (2, 1, False)}


def test_signatures_filter_unrelated_long_texts():
    """20 unrelated texts of 3000 shingles, one of which has a copy with a tenth replaced: these two alone are left."""
    rng = np.random.default_rng(4)
    minhash = neardup.MinHash()
    sets = [rng.integers(0, 2**64, 3000, np.uint64) for _ in range(20)]
    sets.append(np.concatenate([sets[3][:2700], rng.integers(0, 2**64, 300, np.uint64)]))
    rows = [(0, node, neardup.signature_of(minhash.of(s))) for node, s in enumerate(sets)]
    assert [node for _, node in neardup._resembling(rows, None)] == [3, 20]


def test_large_group_of_which_little_resembles(spark):
    """A band that all members share: 40 unrelated sets among which are three pairs, in blocks of 4 (so those left apart
    fill many blocks, and a second band parts them)."""
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([*common, *(f"x{n}" for n in rng.integers(0, 10**9, 40))])) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end") for i in (5, 17, 39)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, width=4, block=4).collect()}
    assert got == brute(rows, 4)
    assert {got[i][1] for i in (105, 117, 139)} == {5, 17, 39}


def test_pair_with_one_common_band_in_a_large_group(spark):
    """Two sets of similarity 0.8 whose only common band is also that of twelve sets like nobody, in blocks of 4: neither
    is in the other's block, and no second band joins them."""
    hashes, minhash = neardup.WordHashes(), neardup.MinHash()
    bands = lambda t: minhash.of(neardup.shingles(t, 4, hashes)).reshape(neardup.BANDS, neardup.ROWS)
    core = " ".join(f"w53482x{i}" for i in range(11))
    pair = [f"{core} left", f"{core} right"]
    (band,) = np.flatnonzero((bands(pair[0]) == bands(pair[1])).all(axis=1))
    more = (f"{core} " + " ".join(f"y{k}z{i}" for i in range(5)) for k in range(10_000))
    others = [t for t in more if (bands(t)[band] == bands(pair[0])[band]).all()][:12]
    assert len(others) == 12
    rows = [*enumerate(others), (100, pair[0]), (102, pair[1])]  # the blocks go by a hash of the id
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, width=4, block=4).collect()}
    assert got == brute(rows, 4)
    assert got[102][1] == 100


@pytest.mark.parametrize("few_ends", [False, True])
def test_large_groups_split_by_shingles_or_not(spark, monkeypatch, few_ends):
    """Common beginnings and various ends, in blocks of 4. Where many sets have the same rare shingles, splitting by them
    saves nothing, and blocks of the group itself meet."""
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(60)]
    ends = [" ".join(f"x{n}" for n in rng.integers(0, 8, 12)) for _ in range(8)]
    rows = []
    for i in range(48):
        own = " ".join(ends[n] for n in rng.permutation(8)[:4]) if few_ends else " ".join(f"x{n}" for n in rng.integers(0, 10**9, 24))
        rows.append((i, " ".join(common) + " " + own))
    rows += [(100 + i, rows[i][1] + " end") for i in (3, 21)]
    seen, rows_of = [], neardup._rows
    monkeypatch.setattr(neardup, "_rows", lambda uneven: seen.append(rows_of(uneven)) or seen[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, width=4, block=4).collect()}
    assert got == brute(rows, 4)
    assert (seen[0] > seen[1]) == few_ends


def test_similar_sets_share_a_rare_shingle():
    """In any order of shingles, two sets that are similar enough share one of those chosen from each."""
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(3000):
        counts = rng.integers(0, 4, neardup.CELLS).astype(np.int32)
        percent = int(rng.integers(1, 101))
        both, a, b = (rng.integers(0, 2**64, int(rng.integers(0, 9)), np.uint64) for _ in range(3))
        a, b = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        shared = len(np.intersect1d(a, b))
        if shared and 100 * shared >= percent * len(np.union1d(a, b)):
            met += 1
            assert len(np.intersect1d(neardup.rarest(a, counts, percent), neardup.rarest(b, counts, percent)))
    assert met > 500


def test_groups_of_rows_of_one_id_with_different_texts(spark):
    """Two long texts of id 1: two texts of id 2 are like one of them, two of id 3 like the other. All bands give a
    group of 1, 2, 2 or one of 1, 3, 3, which aren't the same."""
    words = {k: [f"{k}{i}" for i in range(4000)] for k in "ab"}
    rows = [(1, " ".join(words["a"])), (1, " ".join(words["b"]))]
    rows += [(i, " ".join([*words[k], end])) for i, k in ((2, "a"), (3, "b")) for end in ("this", "that")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1)}
