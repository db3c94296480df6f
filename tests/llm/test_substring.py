import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import substring


def brute(texts, window):
    docs = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[k : k + window]) for w in docs for k in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abc") + str(rng.randrange(50))
    passages = [[word() for _ in range(rng.randint(30, 60))] for _ in range(4)]
    out = [None, "", " ", "one two", " ".join(["z"] * 90), " ".join(["x", "y"] * 40)]
    for _ in range(25):
        words = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        out.append(rng.choice([" ", "\n", " \t"]).join(words))
    return out + [out[10], out[10], out[11] + " "]


def test_cover_is_a_difference_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


@pytest.mark.parametrize(("seed", "window"), [(1, 35), (2, 35), (3, 24)])
def test_equals_brute_force(spark, seed, window):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"key": F.lit(1), "N_words": F.lit("clash")})
    got = {r["doc_id"]: r for r in substring.remove_repeats(df, window=window).collect()}
    assert len(got) == len(texts)
    for i, expected in enumerate(brute(texts, window)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"], got[i]["kept_text"]) == expected


def test_small_gathers_give_the_same(spark, monkeypatch):
    texts = corpus(4)
    gatherer = substring.Gatherer(3)
    gatherer.add(b"k" * 16, *substring._anchors(35)()(texts[-1]), False)
    assert len(list(gatherer.packed())) <= 3


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
