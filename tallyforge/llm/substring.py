"""Substring deduplication by difference-cover anchors.

Removes each word covered by a window of WINDOW words whose sequence starts anywhere else as well. COVER is a
difference cover modulo PERIOD: for any two places there is an offset below PERIOD at which both are congruent to
members of COVER. Anchors, hashes of ANCHOR = WINDOW - PERIOD + 1 words, are taken at these positions alone; two equal
windows therefore share an anchor at one offset. Only windows around shared anchors are hashed whole, by 128 bits, and
matched to extend the anchors to exact duplicates.

Texts that are copies of each other are first brought together by a digest, so hot groups of copies are aggregated
before the shuffle. Anchors and windows are sent as packed arrays, dealt by their hash; a task sends each hash once,
whatever its number of occurrences, so that a passage of very many documents stays a short group.

Defined results: a null or empty text has no words; a text of fewer words than the window keeps all; repeated rows are
copies, so all their words are covered if they have a window; all copies of a passage are removed; an empty table gives
an empty result; extra columns stay, and give way to an output of the same name.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.llm.common import WordHashes, plain_words, quoted, rolling, table

WINDOW = 35
#: A perfect difference set: every difference modulo PERIOD is one of two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Entries that a task gathers before it sends them, and bytes of text for each bucket of hashes.
MOST_GATHERED, BYTES_A_BUCKET, LEAST_BUCKETS = 4_000_000, 32 << 20, 64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SENT = "bucket int, payload binary"
MARKS = "key binary, places binary"


class Gatherer:
    """Collects (hash, second hash, document, place) and packs them by bucket, each hash once."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.keys, self.parts, self.size = [], [], 0

    def add(self, key: bytes, first: np.ndarray, second: np.ndarray, places: np.ndarray, many: bool) -> None:
        if len(first):
            self.parts.append((first, second, np.full(len(first), len(self.keys), np.uint32), places.astype(np.uint32), np.full(len(first), many)))
            self.keys.append(key)
            self.size += len(first)

    def packed(self) -> Iterator[tuple[int, bytes]]:
        """Payloads: hashes that occur here once with their places, hashes known to occur again, and the places of
        hashes found twice in this task, which need no answer."""
        if not self.size:
            return
        first, second, doc, place, many = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((second, first))
        first, second, doc, place, many = first[order], second[order], doc[order], place[order], many[order]
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        group = np.cumsum(new) - 1
        count = np.bincount(group)
        again = (count > 1) | (np.bincount(group, weights=many) > 0)
        starts = np.flatnonzero(new)
        bucket = (first[starts] >> np.uint64(32)) % np.uint64(self.buckets)
        by_bucket = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by_bucket], np.arange(self.buckets + 1))
        here = np.flatnonzero((count > 1)[group])
        here = here[np.argsort(doc[here], kind="stable")]
        # answers that are known already travel with the bucket that their document's number falls in
        local = np.searchsorted(doc[here], np.linspace(0, len(self.keys), self.buckets + 1).astype(int))
        for b in range(self.buckets):
            own = by_bucket[edges[b] : edges[b + 1]]
            at, flags = starts[own], again[own]
            known = here[local[b] : local[b + 1]]
            if len(own) or len(known):
                once = at[~flags]
                yield b, self._pack(first[at], second[at], flags, doc[once], place[once], doc[known], place[known])
        self.clear()

    def _pack(self, first, second, flags, doc, place, known_doc, known_place) -> bytes:
        used, order = np.unique(np.concatenate([doc, known_doc]), return_inverse=True)
        keys = b"".join(self.keys[d] for d in used)
        short = len(used) < 1 << 16 and max(place.max(initial=0), known_place.max(initial=0)) < 1 << 16
        number = "<u2" if short else "<u4"
        second = second if second.any() else second[:0]
        parts = [first, second, np.packbits(flags), *(p.astype(number) for p in (order[: len(doc)], place, order[len(doc) :], known_place))]
        return struct.pack("<6I", int(short), len(used), len(first), len(second), len(doc), len(known_doc)) + keys + b"".join(p.tobytes() for p in parts)


def _unpack(payload: bytes) -> tuple:
    short, n_keys, n, n_second, once, known = struct.unpack_from("<6I", payload)
    at = 24
    keys, at = payload[at : at + 16 * n_keys], at + 16 * n_keys
    number, out = "<u2" if short else "<u4", []
    for kind, size in (("<u8", n), ("<u8", n_second), ("u1", -(-n // 8)), (number, once), (number, once), (number, known), (number, known)):
        out.append(np.frombuffer(payload, kind, size, at))
        at += out[-1].nbytes
    out[1] = out[1] if n_second else np.zeros(n, np.uint64)
    out[2] = np.unpackbits(out[2], count=n)
    return keys, *out


def _answer(payloads: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(key, places) of hashes that more than one payload has, and of those known before."""
    firsts, seconds, refs, docs, places, keys, base = [], [], [], [], [], [], 0
    known_docs, known_places = [], []
    total = 0
    for payload in payloads:
        raw, first, second, flags, doc, place, known_doc, known_place = _unpack(payload)
        ref = np.full(len(first), -1, np.int64)
        ref[flags == 0] = np.arange(len(doc)) + total
        total += len(doc)
        firsts.append(first)
        seconds.append(second)
        refs.append(ref)
        docs.append(doc.astype(np.int64) + base)
        places.append(place)
        known_docs.append(known_doc.astype(np.int64) + base)
        known_places.append(known_place)
        keys.append(raw)
        base += len(raw) // 16
    first, second, ref = np.concatenate(firsts), np.concatenate(seconds), np.concatenate(refs)
    order = np.lexsort((second, first))
    first, second, ref = first[order], second[order], ref[order]
    equal = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
    shared = np.append(equal, False) | np.append(False, equal)
    chosen = ref[shared & (ref >= 0)] if len(ref) else ref
    doc = np.concatenate([np.concatenate(docs)[chosen], *known_docs])
    place = np.concatenate([np.concatenate(places)[chosen], *known_places])
    if not len(doc):
        return
    order = np.argsort(doc, kind="stable")
    doc, place = doc[order], place[order].astype("<u4")
    raw = b"".join(keys)
    edges = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    for a, b in zip(edges, np.append(edges[1:], len(doc)), strict=True):
        yield raw[16 * doc[a] : 16 * doc[a] + 16], place[a:b].tobytes()


def _sent(rows: DataFrame, buckets: int, entries: Callable[[], Callable], final: bool) -> DataFrame:
    """entries()(text, marks) gives (first, second, places) of a text; the payloads, by bucket. Whatever a text with
    copies holds occurs again; that settles windows (final), while its anchors still need an answer."""
    arrow = to_arrow_schema(T._parse_datatype_string(SENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gatherer, of = Gatherer(buckets), entries()

        def sent():
            for b, payload in gatherer.packed():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([payload], pa.binary())], schema=arrow)

        for batch in batches:
            for i in range(batch.num_rows):
                key, text, copies, *marks = (c[i].as_py() for c in batch.columns)
                gatherer.add(key, *of(text, *marks), final and copies > 1)
                if gatherer.size > MOST_GATHERED:
                    yield from sent()
        yield from sent()

    return rows.mapInArrow(run, SENT)


def _answered(sent: DataFrame) -> DataFrame:
    """The answers to _sent(): a row for each key with all its places, joined to one string of bytes."""
    arrow = to_arrow_schema(T._parse_datatype_string(MARKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(payloads):
            rows = list(_answer(payloads))
            for at in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows[at : at + 5000], strict=True)], schema=arrow)

        now, payloads = None, []
        for batch in batches:
            for b, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != now and payloads:
                    yield from made(payloads)
                    payloads = []
                now = b
                payloads.append(payload)
        if payloads:
            yield from made(payloads)

    marks = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, MARKS)
    return marks.groupBy("key").agg(F.collect_list("places").alias("marks"))


def anchor_places(n_words: int, window: int = WINDOW) -> np.ndarray:
    last = n_words - (window - PERIOD + 1)
    if n_words < window:
        return np.empty(0, np.int64)
    starts = np.arange(0, last + 1, PERIOD)[:, None] + np.array(COVER)[None, :]
    return starts[starts <= last].ravel() if starts.size else np.empty(0, np.int64)


def _anchors(window: int):
    def make():
        hashes = WordHashes()
        none = np.empty(0, np.uint64)

        def of(text):
            words = plain_words(text)
            at = anchor_places(len(words), window)
            if not len(at):
                return none, none, at
            return rolling(hashes.of(words), window - PERIOD + 1, _BASES[0])[at], np.zeros(len(at), np.uint64), at

        return of

    return make


def covered(places: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Which of n positions are from ``before`` ahead of one of ``places`` to ``after`` - 1 behind it."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.clip(places - before, 0, n), 1)
    np.add.at(step, np.clip(places + after, 0, n), -1)
    return np.cumsum(step)[:n] > 0


def _joined(marks: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(marks or []), "<u4").astype(np.int64)


def _windows(window: int):
    def make():
        hashes = WordHashes()

        def of(text, marks):
            words = plain_words(text)
            n = len(words) - window + 1
            at = np.flatnonzero(covered(_joined(marks), PERIOD - 1, 1, max(n, 0)))
            h = hashes.of(words)
            return rolling(h, window, _BASES[0])[at], rolling(h, window, _BASES[1])[at], at

        return of

    return make


RESULT = "key binary, n_words long, n_removed long, kept_sha256 string"


def _kept(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                key, text, copies, marks = (c[i].as_py() for c in batch.columns)
                words = plain_words(text)
                if copies > 1 and len(words) >= window:
                    kept = []
                elif marks:
                    gone = covered(_joined(marks), 0, window, len(words))
                    kept = [words[j] for j in np.flatnonzero(~gone)]
                else:
                    kept = words
                body = b" ".join(kept)
                out.append((key, len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest()) + ((body.decode("utf-8", "surrogatepass"),) if keep_text else ()))
            types = [pa.binary(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * keep_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=["key", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text)

    return run


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and, with keep_text, kept_text (kept words joined by a space)."""
    if window <= PERIOD:
        raise ValueError(f"the window must be longer than {PERIOD} words")
    spark = docs.sparkSession
    body = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    # never null, so that no join adds a filter and the exchange of texts stays one and the same
    key = F.coalesce(F.unhex(F.md5(body.cast("binary"))), F.lit(b""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("n")).first()["n"]
    buckets = max(LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_A_BUCKET))
    # one exchange of texts: the plan has it three times, with the same columns, so Spark uses it again
    texts = docs.select(key.alias("key"), body.alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    shared = _answered(_sent(texts, buckets, _anchors(window), False))
    near = texts.join(shared, "key").select("key", "text", "copies", "marks")
    repeated = _answered(_sent(near, buckets, _windows(window), True))
    result = texts.join(repeated, "key", "left").select("key", "text", "copies", "marks").mapInArrow(_kept(window, keep_text), RESULT + ", kept_text string" * keep_text)
    outputs = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text
    kept = [c for c in docs.columns if c.lower() not in outputs]
    keyed = docs.select(*[F.col(quoted(c)) for c in kept], key.alias("__key__"))
    return keyed.join(result.withColumnRenamed("key", "__key__"), "__key__").select(*[F.col(quoted(c)) for c in kept], *outputs)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
