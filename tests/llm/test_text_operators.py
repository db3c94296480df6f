"""Operators that look at each text, or each conversation, against brute-force versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import chat, decontaminate, langid, packing, quality, secrets, toxicity
from tallyforge.llm.common import rolling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "\x00", "é ü 😀", "a" * 50_000, "word " * 20_000, " x y", "ﬁ ǅ İ"]


def frame(spark, texts, **extra):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def test_rolling_hashes_tell_windows_apart():
    words = np.random.default_rng(0).integers(0, 4, 400).astype(np.uint64)
    for width in (1, 2, 3, 7, 13, 35):
        windows = [tuple(words[i : i + width]) for i in range(400 - width + 1)]
        assert len(set(rolling(words, width).tolist())) == len(set(windows))


# Decontamination -------------------------------------------------------------------------------------------------------


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_hits(texts, items):
    out = []
    for text in texts:
        words, hit, found = words_of(text), set(), set()
        for item, t in items:
            w = words_of(t)
            k = min(13, len(w))
            for j in range(len(w) - k + 1 if k else 0):
                for i in range(len(words) - k + 1):
                    if words[i : i + k] == w[j : j + k]:
                        hit |= set(range(i, i + k))
                        found.add(str(item))
        out.append((len(words), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_hits_equal_brute_force(spark, limit):
    rng = random.Random(5)
    word = lambda: rng.choice(["Ab", "c", "ü", "d1", "E"])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 13, 20])))) for i in range(12)] + [(12, None), (13, "- -"), (3, "c, c; c")]
    texts = [*ODD[:6], *[rng.choice(["", "x y z "]) + (rng.choice(items)[1] or "") + " " + " ".join(word() for _ in range(40)) for _ in range(20)]]
    texts.append(texts[-1])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(decontaminate.find_hits(frame(spark, texts, N_hit="clash"), bench, max_broadcast_bytes=limit).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in got] == brute_hits(texts, items)


def test_decontaminate_documents_and_spans(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    texts = [f"{passage.upper()}!", "clean text", f"Start. {passage}; " + "end " * 400, None]
    df = frame(spark, texts, n_words=1)
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == [1, 2, 3]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, bench, remove="spans").collect()}
    assert cut == {0: "!", 1: "clean text", 2: "Start. ; " + "end " * 400, 3: None}


# Packing ---------------------------------------------------------------------------------------------------------------


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = [*ODD, "It's <|endoftext|> A.B, c. d.", "<|ENDOFTEXT|>. X", "don't. we'll, I'VE; x,y. 3.14, é. ", *[" ".join(rng.choice(["Hello,", "naïve", "World.", "x", "42"]) for _ in range(rng.randint(0, 3000))) for _ in range(30)]]
    packed = packing.pack(frame(spark, texts, length="clash", Sequence_ID="clash"), path, keep_ids=True)
    rows = packed.collect()
    docs = collections.defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(docs[i], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), 2048))
        raw = [np.array(ids[k : k + 2048], "<u4").tobytes() for k in range(0, len(ids), 2048)]
        assert [bytes(r["ids"]) for r in pieces] == raw
        assert [r["ids_crc32"] for r in pieces] == [zlib.crc32(b) for b in raw]
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 2048) + 2
    assert packing.sequences(packed).agg(F.sum("n_tokens")).first()[0] == total


@pytest.mark.parametrize("setting", [(1 / 2, 64), (1 / 3, 16), (1 / 4, 64)])
def test_plan_places_every_length_once(setting):
    rng = np.random.default_rng(1)
    lengths = np.concatenate([rng.integers(1, 2049, 4000), np.full(500, 700), np.full(300, 2048)])
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan = packing.Plan(histogram, 2048, *setting)
    seen, used = collections.Counter(), collections.defaultdict(list)
    for length, first, end, sequence, each, offset in plan.rows:
        seen[length] += end - first
        for k in range(end - first):
            used[sequence + k // each].append((offset + k % each * length, length))
    assert seen == histogram
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) <= plan.sequences <= 1.06 * lengths.sum() / 2048 + 1


# Secrets ---------------------------------------------------------------------------------------------------------------

BASE = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def checked_token(body):
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[d] + digits
    return "ghp_" + body + digits.rjust(6, "0")


def test_secrets(spark):
    good = checked_token("a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5")
    texts = [
        *ODD, "é token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" x", "PASSWORD:abc password=abcdef", "secret: token: abcdefg", "token=token=abcdef", "ſecret=abcdef toKen=abcdef", "AKIAAKIA" + "B" * 16 + " akia" + "1" * 20,
        "f" * 23 + "g" + "f" * 24 + "F" + "0" * 70, f"{good} {good[:-1]}x", "api_key='a.b/c+d' apikey = \"zzzzzz", "secret=" * 2000, "😀AKIA" + "Z9" * 10 + "ü" + "ab" * 15,
    ]
    got = {r["doc_id"]: r["secrets"] for r in secrets.find_secrets(frame(spark, texts, Secrets=1)).collect()}
    for i, t in enumerate(texts):
        expected = {(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, t or "", re.A) if ok(m)}
        assert {(s["kind"], s["start"], s["end"]) for s in got[i] if s["kind"] in BASE} == expected, t
        assert [s["start"] for s in got[i]] == sorted(s["start"] for s in got[i])
    hub = [texts[len(ODD) + 7][s["start"] : s["end"]] for s in got[len(ODD) + 7] if s["kind"] == "hub_token"]
    assert hub == [good]
    redacted = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(frame(spark, texts)).collect()}
    assert redacted[len(ODD)] == 'é [SECRET]" x'


# Quality ---------------------------------------------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n")]
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), base


def test_quality_measures(spark):
    prose = "The first line tells a story of some length.\nAnother one goes on with it, at leisure.\n"
    texts = [*ODD[:6], *ODD[8:], "a b c d e a b c d e", prose, prose * 2, prose + "All rights reserved.", "Home | About | Contact | Help | More | Shop | News\n" * 3 + "Only one line of prose is here.", "x# y$ z% a& b* c< d> e| f# g$ h% i&", "THIS!! IS!! SHOUTED!! TEN!! TIMES!! OVER!! AND!! OVER!! AGAIN!! NOW!!", "\n".join(["same line here"] * 3 + ["  "] * 3)]
    rows = {r["doc_id"]: r for r in quality.assess(frame(spark, texts, kept="clash")).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(t), t
        assert not (r["base_failed"] and r["kept"])
    n = len(ODD[:6]) + len(ODD[8:])
    assert [rows[n + k]["kept"] for k in (1, 3, 4, 5, 6)] == [True, True, False, False, False]
    clean = {r["doc_id"]: r["text"] for r in quality.keep_clean(frame(spark, texts)).collect()}
    assert clean[n + 3] == prose.rstrip("\n")


# Chat ------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "", None, "é😀\n\n a", "<|endoftext|>", "x" * 45_000, "\\n", "<" * 50 + "|"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb", "<|im_start|>"]), rng.choice(hard)) for c in range(12) for t in range(rng.randint(1, 6))]
    rows += [(3, 0, "user", "tie"), (3, 0, "assistant", "tie"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    vocabulary = chat.default_vocabulary()
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(df, vocabulary), vocabulary).collect()}
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert got.keys() == groups.keys()
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    codec = chat.Codec.of(*vocabulary)
    for text in hard:
        ids, _, _ = codec.turn("user", text)
        assert codec.formatted(ids).count("<|im_end|>") == 1
    assert chat.format_chats(df.where("false"), vocabulary).count() == 0


# Models ----------------------------------------------------------------------------------------------------------------


def test_language_words_then_shorter_grams(spark):
    model = langid.LanguageModel([("en", "the cat sat on the mat"), ("de", "der hund und die katze")])
    identifier = langid.Identifier(model)
    assert identifier.predict("the mat")[0] == "en" and identifier.predict("und der")[0] == "de"
    assert identifier.predict("hundert katzen")[0] == "de"  # unseen words back off
    for text in (None, "", "123 --", "²½"):
        assert identifier.predict(text) == ("und", 0.0)
    assert langid.Identifier(langid.LanguageModel([])).predict("abc") == ("und", 0.0)
    small = langid.Identifier(model, most=2)
    assert [small.predict("the cat sat on")[0] for _ in range(3)] == ["en"] * 3


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = langid.identify(docs, langid.fit(docs)).where(langid.held_out("doc_id"))
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()
    empty = docs.where("false")
    assert langid.identify(empty, langid.fit(empty)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).where(langid.held_out("doc_id") & (F.col("lang") == "en")).join(labels, "doc_id")
    rows = [(r["toxic"], r["predicted"]) for r in found.collect()]
    assert sum(a == b for a, b in rows) >= 0.9 * len(rows)
    odd = toxicity.score(frame(spark, ODD, Score="clash"), model).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in odd)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_network_gives_one_score_however_texts_are_cut(monkeypatch):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 1 << toxicity.BITS, (n, 3)) for n in (0, 1, 5, 300, 40)] * 4
    labels = np.array([0, 0, 1, 1, 0] * 4)
    net = toxicity.train(docs, labels)
    whole = net.scores(docs)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(net.scores(docs), whole, atol=1e-5)


def test_toxicity_without_labels(spark):
    docs = frame(spark, ["a b", None])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()] == [0, 0]


# Sizes and odd rows ----------------------------------------------------------------------------------------------------


def test_web_tokens_in_a_long_run():
    """Each "eyJ" of a run was scanned to the run's end; a megabyte takes a second now, and a real token is still found."""
    import time

    began = time.time()
    assert secrets.Scanner().spans("eyJ" * 350_000) == []
    assert time.time() - began < 20
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abcdefghijk"
    assert ("web_token", 3, 3 + len(token)) in secrets.Scanner().spans(f"x: {token} " + "eyJ" * 1000)


def letters(n):
    return "".join(chr(97 + int(d)) for d in str(n))


def test_four_hundred_languages(spark):
    """Each of them is learned and predicted, from words of its own."""
    rows = [(i, " ".join(f"x{letters(i % 400)}{w}" for w in ("na", "to", "ri")), f"l{i % 400}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 400
    found = langid.identify(docs, model)
    assert found.where("lang = lang_pred").count() == 4000
    part = langid.sample_of(docs, "lang", "doc_id", 1500, most_rows=1200)
    assert part.select("lang").distinct().count() > 300 and 900 < part.count() < 1500


def backed_off(rows, word, longest=5):
    """Log frequencies of a word by dictionaries."""
    counts = {lang: [collections.Counter() for _ in range(longest + 1)] for lang, _ in rows}
    grams = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)] if n else [w]
    for lang, text in rows:
        for w in text.split():
            for n in range(longest + 1):
                counts[lang][n].update(grams(w, n))
    for n in [0, *range(longest, 0, -1)]:
        entries = set().union(*(c[n] for c in counts.values()))
        known = [g for g in grams(word, n) if g in entries]
        if known:
            total = {k: sum(c[n].values()) + len(entries) / 2 for k, c in counts.items()}
            return [sum(np.log((counts[k][n][g] + 0.5) / total[k]) for g in known) / len(known) for k in sorted(counts)]
    return [0.0] * len(counts)


def test_word_scores_equal_dictionaries():
    rng = random.Random(4)
    word = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6)))
    rows = [(lang, " ".join(word(a) for _ in range(60))) for lang, a in (("a", "abc"), ("b", "bcd"), ("c", "xyza"))]
    words = [word("abcdxyzq") for _ in range(200)] + ["qqq", "a"]
    assert np.allclose(langid.LanguageModel(rows).word_scores(words), [backed_off(rows, w) for w in words])


def test_network_equals_a_plain_convolution():
    """Every window of every width, one after another, in float64."""
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 1 << toxicity.BITS, (n, 3)) for n in (0, 1, 2, 7, 30)] * 4
    net = toxicity.train(docs, np.array([0, 1, 0, 1, 0] * 4))
    for d, got in zip(docs, net.scores(docs), strict=True):
        x = [np.concatenate([t[i] for t, i in zip(net.tables, row, strict=True)]).astype(float) for row in d]
        x += [np.zeros(sum(t.shape[1] for t in net.tables))] * max(toxicity.WIDTHS)
        pooled = []
        for w, kernel, bias in zip(toxicity.WIDTHS, net.kernels, net.biases, strict=True):
            windows = [sum(x[i + j] @ kernel[j].astype(float) for j in range(w)) for i in range(len(d) + 1)]
            pooled.append(np.max(windows, axis=0) + bias)
        logit = np.maximum(np.concatenate(pooled), 0) @ net.out + net.constant
        assert abs(got - 1 / (1 + np.exp(-logit))) < 1e-4


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_windows_of_a_null_item_hit_words(spark, limit):
    passage = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(None, passage), (2, "w1 w2")], "item_id long, text string")
    r = decontaminate.find_hits(frame(spark, [passage]), bench, max_broadcast_bytes=limit).first()
    assert (r["n_words"], r["n_hit"], r["items"]) == (15, 15, ["2"])
    empty = frame(spark, ["x"]).where("false")
    assert decontaminate.find_hits(empty, bench, max_broadcast_bytes=limit).count() == 0


def test_empty_tables_repeated_rows_and_clashing_columns(spark):
    path = packing.default_tokenizer()
    empty = frame(spark, ["x"]).where("false")
    model = langid.LanguageModel([("en", "the cat"), ("de", "der hund")])
    assert packing.pack(empty, path).count() == 0
    assert secrets.find_secrets(empty).count() == quality.assess(empty).count() == 0
    twice = spark.createDataFrame([(1, "the cat " * 30_000)] * 2, "doc_id long, text string").withColumns({"Score": F.lit("a"), "Lang_Pred": F.lit("b")})
    found = langid.identify(twice, model).collect()
    assert [(r["lang_pred"], r["doc_id"]) for r in found] == [("en", 1)] * 2
    assert [c.lower() for c in langid.identify(twice, model).columns].count("score") == 1
    long = [r.asDict() for r in quality.assess(twice).collect()]
    assert long[0] == long[1] and (long[0]["n_words"], long[0]["n_repeat_words"]) == (60_000, 60_000)
    chats = spark.createDataFrame([(1, 0, "user", "hi", "x")], "conv_id long, turn long, role string, text string, ids string").withColumn("N_turns", F.lit(1))
    vocabulary = chat.default_vocabulary()
    assert chat.digest(chat.format_chats(chats, vocabulary), vocabulary).first()["n_turns"] == 1
