"""Each stage's rows against plain Python on the stage's own input, and toxicity in every language."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import langid, packing, pii, toxicity
from tallyforge.llm.common import alnum_words
from tests.llm.test_neardup import brute as brute_components
from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_text_operators import brute_hits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """name -> (input, output) of a stage, as DataFrames of files."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        made = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, made)
        docs = made
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def kept_by(before, keep):
    return sorted((tuple(r) for r in before.collect() if keep(r)), key=str)


def test_toxicity_stage(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    slots, identifier = toxicity.WordSlots(), langid.Identifier(model.languages)

    def clean(r):
        raw = float(model.network.scores([slots.of(alnum_words(r["text"]))])[0])
        return np.clip(model.network.calibrated(raw, identifier.predict(r["text"])[0]), 0, 1) < toxicity.THRESHOLD

    assert rows(after) == kept_by(before, clean)
    assert after.count() < before.count()


def test_near_duplicates_stage(stages):
    before, after = stages["near_duplicates"]
    component = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5)
    assert rows(after) == kept_by(before, lambda r: component[r["doc_id"]][1] == r["doc_id"])
    assert after.count() < before.count()


def test_decontamination_stage(spark, stages):
    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = before.collect()
    found = dict(zip((r["doc_id"] for r in docs), brute_hits([r["text"] for r in docs], items), strict=True))
    hit = lambda r: found[r["doc_id"]][1] > 0 and 20 * found[r["doc_id"]][1] >= found[r["doc_id"]][0]
    assert rows(after) == kept_by(before, lambda r: not hit(r))


def test_pii_stage(stages):
    before, after = stages["pii"]
    spans = {r["doc_id"]: [(s["start"], s["number"], s["end"]) for s in r["spans"]] for r in pii.find_pii(before).collect()}
    want = []
    for r in before.collect():
        assert set(brute_spans(r["text"])) <= set(spans[r["doc_id"]])
        text, done, out = r["text"], 0, ""
        for start, kind, end in sorted(spans[r["doc_id"]]):
            if start >= done:
                out += text[done:start] + f"[{pii.KINDS[kind].upper()}]"
            done = max(done, end)
        masked = text if text is None else out + text[done:]
        want.append(tuple((r.asDict() | {"text": masked, "n_chars": r["n_chars"] if text is None else len(masked)})[c] for c in after.columns))
    assert rows(after) == sorted(want, key=str)
    assert rows(after) != rows(before)


def test_packing_stage(stages):
    before, after = stages["packing"]
    ids = packing.ChunkIds.of(packing.default_tokenizer())
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in after.collect():
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in before.collect():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(pieces.pop(r["doc_id"]))):
            assert (piece, start) == (k, at)
            at += length
        assert at == len(ids.ids(r["text"])) // 4 + 1
    assert not pieces
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


@pytest.fixture(scope="module")
def held_out(spark):
    """language -> (label, prediction) of the held-out rows of sf0.01."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.fit(docs, labels)).where(langid.held_out("doc_id")).join(labels.where(F.col("toxic").isin(0, 1)), "doc_id")
    out = collections.defaultdict(list)
    for r in found.select("lang", "toxic", "predicted").collect():
        out[r["lang"]].append((r["toxic"], r["predicted"]))
    return out


# of 14 German rows, 4 are toxic and 10 are judged right: an open fault, which this bound is to show
@pytest.mark.parametrize("lang", ["en", "es", "fr", pytest.param("de", marks=pytest.mark.xfail(strict=True, reason="10 of 14 German rows are judged right"))])
def test_toxicity_in_every_language(held_out, lang):
    own = held_out[lang]
    assert own
    assert sum(a == b for a, b in own) >= 0.9 * len(own), own


def test_labels_have_no_other_language(held_out):
    assert set(held_out) == {"en", "es", "fr", "de"}
