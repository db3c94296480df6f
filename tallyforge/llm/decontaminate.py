"""Benchmark decontamination by a broadcast set of normalised benchmark n-grams.

Words: A-Z lower-cased, runs of ASCII letters, digits and characters beyond ASCII. A window is 13 consecutive words
of a benchmark item; an item of fewer words (but not none) is one window. A document word inside any occurrence of a
window is hit; a document is contaminated if it has hits that make up at least a twentieth of its words.

Defined results: null or empty texts have no words, no hits and are kept; null or empty items give no windows; rows of
one item_id count as one item; windows of a null item_id hit words, but name no item; repeated document rows give
repeated result rows; very long texts are scanned whole; an empty table gives an empty result; extra columns stay, and
give way to an output of the same name (decontaminate() keeps all).
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import alnum_words, as_table, quoted, rolling, table, with_outputs

WINDOW = 13
#: The set is broadcast only if the benchmark has at most so many bytes of text; beyond, windows are joined. A window takes
#: some 400 bytes of a Python worker, and there is about one for 6 bytes of text: 4 MB of text are some 300 MB there.
MAX_BROADCAST_BYTES = 4 << 20


class WindowSet:
    """Windows of the benchmark by their words' ids in its vocabulary."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[int, dict[bytes, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = alnum_words(text)
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint32)
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                self.items[size][ids[i : i + size].tobytes()].add(item)
        self.items = {k: dict(v) for k, v in self.items.items()}
        self.hashes = {k: np.unique(_row_hashes(v, k)) for k, v in self.items.items()}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Whether each word is hit, and the items with occurring windows."""
        n = len(words)
        hit, found = np.zeros(n, bool), set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint32, n)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, known in self.items.items():
            if n < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            hashes = rolling(ids, size)[at]
            sorted_hashes = self.hashes[size]
            near = sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)] == hashes
            for i in at[near]:
                if items := known.get(ids[i : i + size].tobytes()):
                    hit[i : i + size] = True
                    found |= items
        return hit, found


def _row_hashes(windows: dict[bytes, set], size: int) -> np.ndarray:
    """The rolling hash of each window of ``size`` ids by itself."""
    return np.array([rolling(np.frombuffer(w, np.uint32), size)[0] for w in windows], np.uint64)


def _intervals(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


FOUND = "n_words long, n_hit long, hits array<struct<start: long, end: long>>, items array<string>"


def find_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, drop: tuple[str, ...] = ()
) -> DataFrame:
    """``docs``, but for the columns in ``drop``, with n_words, n_hit, hits (word intervals) and items (ids of items with
    occurring windows, as sorted strings)."""
    items = benchmark.select(F.col(quoted(item_id)).cast("string").alias("item"), F.col(quoted(item_text)).cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if size > max_broadcast_bytes:
        return _joined_hits(docs, items, text, window, drop)
    known = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])

    def make():
        windows = WindowSet(known.value, window)

        def work(texts):
            out = ([], [], [], [])
            for t in texts:
                words = alnum_words(t)
                hit, found = windows.scan(words)
                n_hit = int(hit.sum())
                for column, value in zip(out, (len(words), n_hit, _intervals(hit) if n_hit else [], sorted(found - {None})), strict=True):
                    column.append(value)
            return out

        return work

    return with_outputs(docs, text, make, FOUND, drop)


def _joined_hits(docs: DataFrame, items: DataFrame, text: str, window: int, drop: tuple[str, ...]) -> DataFrame:
    """The same for a benchmark of any size: windows of distinct texts are joined by a 128-bit digest."""
    spans = "array<struct<size: int, start: int, digest: binary>>"

    def windows_of(sizes: list[int] | None):
        def make():
            def work(texts):
                out = []
                for t in texts:
                    words, rows = alnum_words(t), []
                    for k in sizes if sizes is not None else [min(window, len(words))]:
                        for i in range(len(words) - k + 1 if k else 0):
                            rows.append({"size": k, "start": i, "digest": hashlib.md5(b" ".join(words[i : i + k])).digest()})
                    out.append(rows)
                return ([len(alnum_words(t)) for t in texts], out)

            return work

        return make

    fields = f"n_words long, windows {spans}"
    bench = with_outputs(items, "text", windows_of(None), fields).select("item", F.explode("windows").alias("w")).select("item", "w.size", "w.digest").distinct()
    bench = as_table(bench, "bench")
    sizes = [r["size"] for r in bench.select("size").distinct().collect()]  # at most `window` numbers
    keyed = docs.withColumn("__key__", F.md5(F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).cast("binary")))
    texts = keyed.select("__key__", F.col(quoted(text)).cast("string").alias("__t__")).dropDuplicates(["__key__"])
    made = with_outputs(texts, "__t__", windows_of(sizes), fields, drop=("__t__",))
    rows = made.select("__key__", F.explode("windows").alias("w")).select("__key__", "w.size", "w.start", "w.digest")
    near = rows.join(bench, ["size", "digest"])
    places = near.groupBy("__key__").agg(F.collect_set(F.struct("start", "size")).alias("places"), F.array_sort(F.collect_set("item")).alias("items"))
    counts = made.select("__key__", "n_words")

    def merge(places):
        hit = np.zeros(max((p["start"] + p["size"] for p in places), default=0), bool)
        for p in places:
            hit[p["start"] : p["start"] + p["size"]] = True
        return _intervals(hit)

    merged = F.udf(merge, "array<struct<start: long, end: long>>")
    hits = counts.join(places, "__key__", "left").select(
        "__key__", "n_words", merged(F.coalesce("places", F.expr("cast(array() as array<struct<start: int, size: int>>)"))).alias("hits"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")
    )
    hits = hits.withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]))
    kept = [c for c in docs.columns if c.lower() not in {"n_words", "n_hit", "hits", "items"} | {d.lower() for d in drop}]
    return keyed.select(*[F.col(quoted(c)) for c in kept], "__key__").join(hits, "__key__").select(*[F.col(quoted(c)) for c in kept], "n_words", "n_hit", "hits", "items")


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents (remove="documents"), or with the hit words cut out of their texts
    (remove="spans"); clean documents stay as they are. The columns are those of ``docs``."""
    renamed = docs.select(*[F.col(quoted(c)).alias(f"__{i}__") for i, c in enumerate(docs.columns)])  # no clash with the outputs
    at = f"__{docs.columns.index(text)}__"
    found = find_hits(renamed, benchmark, text=at, **options)
    if remove == "documents":
        found = found.where(f"NOT ({CONTAMINATED})")
    else:
        cut = F.udf(_without, "string")
        found = found.withColumn(at, F.when(F.size("hits") > 0, cut(at, "hits")).otherwise(F.col(at)))
    return found.select(*[F.col(f"__{i}__").alias(c) for i, c in enumerate(docs.columns)])


def _without(text, hits):
    """The text without the hit words, as character runs from the first hit word's start to the last one's end."""
    if not hits:  # Spark evaluates this for every row
        return text
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for h in hits:
        out.append(text[at : places[h["start"]][0]])
        at = places[h["end"] - 1][1]
    return "".join([*out, text[at:]])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), drop=("text",))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), F.expr(f"{CONTAMINATED}").alias("contaminated")
    )
