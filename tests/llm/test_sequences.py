"""Periodic runs, byte-level BPE and the prefix trie, against brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import bytebpe, periodic, prefixtrie, registry

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "\x00", "é ü 😀", "a" * 30_000, "word " * 5_000, " x y", "ﬁ ǅ İ   \n ", "one two " * 700 + "three", "<|endoftext|> it's"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Periodic runs ---------------------------------------------------------------------------------------------------------


def brute_runs(w, least=12):
    out, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and j > i:
                out.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j + 1
    return sorted((i, length, q) for (i, length), q in out.items())


def fibonacci(n):
    a, b = [b"a"], [b"b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(60):
        batch = []
        for _ in range(rng.randrange(1, 6)):
            n, k = rng.randrange(90), rng.choice([1, 2, 3, 5])
            w = [bytes([97 + rng.randrange(k)]) for _ in range(n)]
            if n and rng.random() < 0.4:
                p, a = rng.randrange(1, 12), rng.randrange(n)
                w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
            batch.append(fibonacci(n) if rng.random() < 0.1 else w)
        got = [[tuple(r) for r in rows.tolist()] for rows in periodic.runs_of(batch, least)]
        assert got == [brute_runs(w, least) for w in batch]


def test_lyndon_array_is_the_longest_lyndon_word_at_each_place():
    rng = random.Random(3)
    lyndon = lambda w: all(w < w[i:] for i in range(1, len(w)))
    for _ in range(100):
        w = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 25))]
        wanted = [max(k for k in range(1, len(w) - i + 1) if lyndon(w[i : i + k])) for i in range(len(w))]
        assert periodic.lyndon_array([*w, 0, *w, 0], 4) == [*wanted, 0, *wanted, 0]


def test_long_texts_take_time_in_proportion():
    assert len(periodic.runs_of([fibonacci(100_000)])[0]) > 10_000
    assert periodic.runs_of([[b"%d" % (i % 7) for i in range(100_000)]])[0].tolist() == [[0, 100_000, 7]]


def brute_digest(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(told), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_query_equals_brute_force(spark, tmp_path):
    """Odd texts under ids of both kinds, a null id, repeated rows; and documents of up to 400 words of the given table."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in given.where(F.length("text") < 2500).select("doc_id", "text").collect()]
    short = [t if t is None or len(t) < 4000 else t[:1500] for t in ODD]
    rows += [(1000 + 50 * k + j, t) for k, t in enumerate(short) for j in range(25)] + [(None, ODD[10][:2000]), (None, None), (5, "a b " * 9), (5, "a b " * 9)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, period int").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    got = [tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in found.collect()]
    wanted = [brute_digest(*r) for r in rows]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert sum(r[1] > 0 for r in wanted) > 20


def test_runs_operator_keeps_columns_and_collapses(spark):
    df = spark.createDataFrame([(1, "x " * 20 + "end", "mine", 3), (2, None, "b", 4), (3, "a  b", "c", 5)], "id int, text string, runs string, extra int")
    found = {r["id"]: r for r in periodic.find_runs(df).collect()}
    assert [tuple(x) for x in found[1]["runs"]] == [(0, 20, 1)] and found[2]["runs"] == [] and found[3]["extra"] == 5
    left = {r["id"]: r["text"] for r in periodic.collapse_runs(df).collect()}
    assert left == {1: "x end", 2: None, 3: "a  b"}
    assert periodic.digest_runs(df.limit(0)).count() == 0


# Byte-level BPE --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bytebpe.Codec.of(*bytebpe.default_vocabulary())


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=bytebpe.default_vocabulary()[1], mergeable_ranks=codec.ranks, special_tokens={})


def test_every_token_encodes_to_itself(codec):
    """What the proof of stable neighbours needs."""
    assert all(codec.merged(b) == [i] for b, i in codec.ranks.items())


def test_encoding_equals_the_library(codec, library):
    rng = random.Random(4)
    for _ in range(1500):
        letters = rng.choice(["ab", "aA1 ,.", "x", "the cat's\n ", "é日本😀 ", "=-", "0123456789"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(300)))
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_joining_at_any_cut_gives_the_whole(codec):
    rng = random.Random(5)
    for _ in range(1500):
        piece = bytes(rng.choice(rng.choice([b"thenaig", b"a", b"ab", bytes(range(256))])) for _ in range(rng.randrange(80)))
        a, b = sorted(rng.randrange(len(piece) + 1) for _ in range(2))
        parts = [codec.merged(p) for p in (piece[:a], piece[a:b], piece[b:])]
        whole = codec.merged(piece)
        assert codec.joined(codec.joined(parts[0], parts[1]), parts[2]) == whole == codec.joined(parts[0], codec.joined(parts[1], parts[2]))


def test_small_caches_change_nothing(codec, monkeypatch):
    monkeypatch.setattr(bytebpe, "MOST_KEPT", 3)
    small = bytebpe.Codec(codec.ranks, bytebpe.default_vocabulary()[1])
    text = " ".join(f"word{i % 17} Wörter{i % 5}" for i in range(300))
    assert small.encode(text) == codec.encode(text)


def test_bpe_query_equals_the_library(spark, library, tmp_path):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = given + [(10_000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (10_005, ODD[5])]
    spark.createDataFrame([(*r, b"mine") for r in rows], "doc_id long, text string, ids binary").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["op12_byte_bpe"](spark, str(tmp_path))
    got = sorted((tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in found.collect()), key=str)
    ids = [library.encode_ordinary(t or "") for _, t in rows]
    assert got == sorted(((d, len(i), sha(" ".join(map(str, i))), sha(t or "")) for (d, t), i in zip(rows, ids, strict=True)), key=str)


# Prefix trie -----------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    rebuilt, members = {}, collections.defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children, leaves, saved = (collections.Counter() for _ in range(3))
    children.update(u[:-1] for u in members if u)
    for u, m in members.items():
        for d in range(len(u) + 1):
            saved[u[:d]] += (len(m) - 1) * len(u[-1][1].encode()) if u else 0
            leaves[u[:d]] += not children[u]
    ends = {u: sha(",".join(map(str, sorted(c for c in m if rebuilt[c] == u)))) for u, m in members.items()}
    return sorted(((min(m), len(u), min(members[u[:-1]]) if u else None, len(m), children[u], leaves[u], saved[u], ends[u]) for u, m in members.items()), key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, depth int").write.parquet(f"{tmp_path}/conversations.parquet")
    found = registry.QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str)


def test_trie_equals_brute_force(spark, tmp_path):
    """Nulls in each column, ties, negative ids, a group of copies over all shards, a long conversation, turnless ones."""
    rng = random.Random(6)
    rows = []
    for c in range(-12, 300):
        if c % 5 == 0 and rng.random() < 0.3:
            continue  # an absent head
        for t in range(rng.randrange(1, 14)):
            rows.append((c, rng.choice([t, t, t, 0, None]), rng.choice(["user", None]), rng.choice(["a", "b", "ü", "", None])))
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1400) for t in range(12)]
    rows += [(2000, t, "user", f"long {t}") for t in range(150)] + [(2001, t, "user", f"long {t}") for t in range(120)]
    rows += [(None, 0, "user", "no id"), rows[0], rows[0]]
    assert trie_of(spark, tmp_path, rows) == brute_trie(rows)


def test_trie_of_no_conversations(spark, tmp_path):
    assert trie_of(spark, tmp_path, []) == []


def test_trie_of_one_conversation(spark, tmp_path):
    rows = [(7, 0, None, None)]
    assert trie_of(spark, tmp_path, rows) == brute_trie(rows)


def test_shards_and_skeleton(spark):
    """Splitters are cut short, their nodes shared, and every number of shards gives the same nodes."""
    step = lambda *ks: b"".join(bytes([k]) * 16 for k in ks)
    sample = sorted([(step(1, 2, 3, 4), 1), (step(1, 2, 9, 9), 2), (step(1, 2, 9, 9), 3), (step(5, 5, 5), 4)])
    skeleton = prefixtrie.Skeleton.of(sample, 4)
    assert skeleton.splitters == [(step(1, 2, 9), -(1 << 63)), (step(1, 2, 9, 9), 3), (step(5), -(1 << 63))]
    assert skeleton.numbers == [[0, 1, 2, 3], [0, 1, 2, 3, 4], [0, 5]] and skeleton.parents == [-1, 0, 1, 2, 3, 0]
    paths = spark.createDataFrame([(c, step(*p), [10 * k for k in p]) for c, p in enumerate([(1,), (1, 2), (1, 2), (), (1, 3, 3), (2, 2)] * 40)], "conv_id long, path binary, sizes array<long>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for shards in (1, 3, 20):
        spark.conf.set("spark.sql.shuffle.partitions", shards)
        results.append(sorted(map(str, prefixtrie.prefix_trie(paths).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2] and len(results[0]) == 7


