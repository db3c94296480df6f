"""Best-fit packing of tokenized documents by the linear grouping scheme.

A document is its token ids and an end id; documents over the capacity are cut into full pieces and a rest. Only the
histogram of piece lengths (at most one row for each length up to the capacity) decides the plan: large lengths, by
descending size, fall into groups of equal cardinality and are rounded up to their group's largest; configurations of
these few sizes are optimised by column generation; actual lengths take the rounded ones' places; what is left is
put in best-fit. The plan is a table of rank intervals, so each piece finds its place by its rank within its length.

Defined results: a null or empty text is one piece of the end id alone; repeated rows are separate documents; an empty
table gives an empty result; extra columns stay, and give way to an output of the same name.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.llm.common import ROWS_AT_ONCE, as_table, encoded, quoted, table

CAPACITY = 2048
#: Settings that are planned with, of which the one with the fewest sequences is taken: lengths over this share of the
#: capacity are large, and the large lengths are rounded in so many groups.
SETTINGS = ((1 / 2, 64), (1 / 3, 16), (1 / 4, 64))

_ENDED = re.compile(rb"(?<=[a-z0-9])([.,])(?=[\x20\n]|$)")


class ChunkIds(dict):
    """Ids of text between white space, as little-endian unsigned 32-bit bytes. The tokenizer drops white space and
    never merges across it, so that a text's ids are its chunks' ids one after the other; letters in A-Z are
    lower-cased and a single comma or stop after a letter is cut off first, which gives the same ids and fewer chunks."""

    MOST = 600_000
    _own: dict[str, ChunkIds] = {}

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    @classmethod
    def of(cls, path: str) -> ChunkIds:
        """One for each worker process, kept from task to task."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.MOST:
            short = {k: v for k, v in self.items() if len(k) <= 7}
            self.clear()
            if len(short) < self.MOST // 2:
                self.update(short)
        ids = self.tokenizer.encode(chunk.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids
        self[chunk] = made = np.array(ids, "<u4").tobytes()
        return made

    def ids(self, text: str | None) -> bytes:
        raw = encoded(text)
        if b"<|" not in raw:  # a special token's name stays as it is
            raw = _ENDED.sub(rb" \1 ", raw.lower())
        return b"".join(map(self.__getitem__, raw.split()))


def tokenize(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: the columns of ``docs`` but for the text, piece, start, length, ids_crc32 and, with
    keep_ids, ids (binary, little-endian unsigned 32-bit)."""
    fields = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    new = T._parse_datatype_string(fields)
    kept = [c for c in docs.columns if c != text and c.lower() not in {f.name for f in new}]
    schema = T.StructType([docs.schema[c] for c in kept] + list(new.fields))
    names, end = to_arrow_schema(schema).names, np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches):
        chunks = ChunkIds.of(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                rows, pieces, starts, lengths, sums, bodies = [], [], [], [], [], []
                for row, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    ids = chunks.ids(t) + end
                    for k, i in enumerate(range(0, len(ids), step)):
                        body = ids[i : i + step]
                        rows.append(row)
                        pieces.append(k)
                        starts.append(i // 4)
                        lengths.append(len(body) // 4)
                        sums.append(zlib.crc32(body))
                        if keep_ids:
                            bodies.append(body)
                made = [pa.array(pieces, pa.int32()), *(pa.array(c, pa.int64()) for c in (starts, lengths, sums))] + [pa.array(bodies, pa.binary())] * keep_ids
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns[:-1], *made], names=names)

    return docs.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(text)).cast("string").alias("__text__")).mapInArrow(run, schema)


# The plan, made from the histogram alone ---------------------------------------------------------------------------


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Column generation for the fractional bin packing of a few sizes: (copies of each size, times used)."""
    k = len(sizes)
    columns = [np.eye(k)[i] * (capacity // s) for i, s in enumerate(sizes)]
    basis, need = np.array(columns).T, np.array(demand, float)
    for _ in range(20 * k + 50):
        price = np.linalg.solve(basis.T, np.ones(k))
        column, worth = _knapsack(sizes, price, capacity)
        if worth <= 1 + 1e-9:
            break
        used, direction = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    used = np.linalg.solve(basis, need)
    return [(basis[:, i].round().astype(int), max(0.0, used[i])) for i in range(k)]


def _knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The copies of each size that are worth most within the capacity."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, s in enumerate(sizes):
        if price[i] <= 0:
            continue
        for _ in range(capacity // s):  # each pass adds at most one more copy
            other = best[:-s] + price[i]
            better = other > best[s:] + 1e-12
            if not better.any():
                break
            best[s:][better], took[s:][better] = other[better], i
    column, room = np.zeros(len(sizes)), capacity
    room = int(np.argmax(best))
    total = best[room]
    while room > 0 and took[room] >= 0:
        i = int(took[room])
        column[i] += 1
        room -= sizes[i]
    return column, float(min(total, column @ price))


class Plan:
    """Interval rows (length, first rank, end rank, first sequence, pieces of it in a sequence, offset)."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, large: float = SETTINGS[0][0], groups: int = SETTINGS[0][1]):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.ranks: dict[int, int] = defaultdict(int)
        self.left = dict(histogram)
        #: Sequences with so much room, as [first, end) intervals.
        self.room: dict[int, list[list[int]]] = defaultdict(list)
        self.rooms: list[int] = []
        if n := self.left.pop(capacity, 0):
            self._put(capacity, n, self._open(n), 1, 0)
        self._grouped(int(capacity * large), groups)
        self._best_fit()

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _put(self, length: int, n: int, first: int, each: int, offset: int) -> None:
        rank = self.ranks[length]
        self.rows.append((length, rank, rank + n, first, each, offset))
        self.ranks[length] = rank + n

    def _add_room(self, room: int, first: int, end: int) -> None:
        if room > 0 and end > first:
            if not self.room[room]:
                bisect.insort(self.rooms, room)
            self.room[room].append([first, end])

    def _grouped(self, small: int, groups: int) -> None:
        lengths = sorted((x for x in self.left if x > small and self.left[x]), reverse=True)
        total = sum(self.left[x] for x in lengths)
        if not total:
            return
        # groups of equal cardinality, each a list of [length, count] by descending length
        each, members, filled = -(-total // groups), [[]], 0
        for x in lengths:
            n = self.left[x]
            while n:
                take = min(n, each - filled)
                members[-1].append([x, take])
                n, filled = n - take, filled + take
                if filled == each:
                    members.append([])
                    filled = 0
        members = [m for m in members if m]
        merged: dict[int, list] = {}
        for m in members:  # groups that round to one size are one
            merged.setdefault(m[0][0], []).extend(m)
        sizes = list(merged)
        chosen = configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], self.capacity)
        for column, times in chosen:
            times = int(times + 1e-6)  # what the rounding leaves over goes to best-fit
            if not times:
                continue
            first = self._open(times)
            parts = [[first, first + times, 0]]  # sequences with one filling each
            for i in np.flatnonzero(column):
                for _ in range(column[i]):
                    parts = self._substitute(merged[sizes[i]], parts)
            for lo, hi, fill in parts:
                self._add_room(self.capacity - fill, lo, hi)

    def _substitute(self, members: list, parts: list) -> list:
        """One actual piece of the group for each sequence of ``parts``, while there are any."""
        out = []
        for lo, hi, fill in parts:
            while lo < hi and members:
                length, n = members[0]
                take = min(n, hi - lo)
                self._put(length, take, lo, 1, fill)
                self.left[length] -= take
                out.append([lo, lo + take, fill + length])
                lo += take
                members[0][1] -= take
                if not members[0][1]:
                    members.pop(0)
            if lo < hi:
                out.append([lo, hi, fill])
        return out

    def _best_fit(self) -> None:
        for length in sorted((x for x in self.left if self.left[x]), reverse=True):
            n = self.left[length]
            while n:
                at = bisect.bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    each = self.capacity // length
                    new = -(-n // each)
                    self._add_room(self.capacity, first := self._open(new), first + new)
                    continue
                room = self.rooms[at]
                lo, hi = self.room[room].pop()
                if not self.room[room]:
                    self.rooms.pop(at)
                each = min(n, room // length)
                bins = min(hi - lo, n // each)
                self._put(length, bins * each, lo, each, self.capacity - room)
                n -= bins * each
                self._add_room(room - each * length, lo, lo + bins)
                self._add_room(room, lo + bins, hi)
            self.left[length] = 0


PLACED = "sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False, settings: tuple[tuple[float, int], ...] = SETTINGS) -> DataFrame:
    """The pieces of tokenize() with sequence_id and offset. Offsets have no gaps within a sequence."""
    spark = docs.sparkSession
    pieces = as_table(tokenize(docs, tokenizer, text, capacity, end_id, keep_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = min((Plan(histogram, capacity, large, groups) for large, groups in settings), key=lambda p: p.sequences)
    # rank within a length: by a hash bucket first, so that no task holds a whole length
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(quoted(id_col), "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    dealt = pieces.withColumn("__bucket__", bucket)
    counts = dealt.groupBy("length", "__bucket__").agg(F.count(F.lit(1)).alias("__n__"))
    before = F.sum("__n__").over(Window.partitionBy("length").orderBy("__bucket__").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "__bucket__", F.coalesce(before, F.lit(0)).alias("__before__"))
    inner = F.row_number().over(Window.partitionBy("length", "__bucket__").orderBy(quoted(id_col), "piece", "ids_crc32"))
    ranked = dealt.withColumn("__inner__", inner).join(starts, ["length", "__bucket__"]).withColumn("__rank__", F.col("__before__") + F.col("__inner__") - 1)
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)
    known = spark.sparkContext.broadcast(rows)

    def place(batches):
        lengths, firsts, _, sequences, each, offsets = known.value.T
        keys = lengths * (1 << 50) + firsts
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank__"))
            at = np.searchsorted(keys, length * (1 << 50) + rank, "right") - 1
            k = rank - firsts[at]
            columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "__rank__"]
            made = [pa.array(sequences[at] + k // each[at]), pa.array(offsets[at] + k % each[at] * length)]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=out_names)

    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    schema = T.StructType([pieces.schema[c] for c in kept] + list(T._parse_datatype_string(PLACED).fields))
    out_names = to_arrow_schema(schema).names
    return ranked.select(*[F.col(quoted(c)) for c in kept], "__rank__").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences of pack(keep_ids=True): sequence_id, ids (binary), n_tokens; a group is at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    return joined.withColumn("n_tokens", F.expr("octet_length(ids) div 4"))


def default_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
