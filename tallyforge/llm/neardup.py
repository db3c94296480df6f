"""MinHash near-duplicates: universal hash minima, banding, signature verification, and connected components.

A document's set is its distinct word shingles (a text of fewer words is one shingle as a whole). Documents with one
and the same set are a class, by a 128-bit digest. Classes that share a band of their minima are a group; groups of the
same members count once. Large groups are dealt into blocks of about BLOCK members with their least member in each.
Signatures drop members of a block that resemble nobody there; what is left is verified on full sets. What a first round
leaves in different components of a large group meets again, block against block: by signatures, then on full sets.
Where that is many rows, the members are first grouped by their rarest shingles, of which two sets that are similar
enough always share one. So no pair of a group is left out, and no task holds more than two blocks. A task gives at most
one link for each member, never a group's pairs.

With BANDS bands of ROWS minima, two sets of similarity 0.8 share none with a chance of 3 in a million; that their
signatures agree in less than SIGNATURE_SHARE has the same chance, in groups of any size.

Defined results: a text without words, or null, has the empty set, and is linked with nothing; rows of one id are one
document; a row with a null id is linked with nothing, has a null component, and stays; identical texts are linked; an empty table gives an empty result;
extra columns stay, and give way to an output of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.llm.common import ROWS_AT_ONCE, WordHashes, as_table, drop_table, lowered_words, mixed, quoted, rolling, table, with_outputs
from tallyforge.llm.components import connected_components

BANDS, ROWS = 32, 5
BLOCK = 512
#: Signatures that agree in a smaller share are not verified: 4.7 standard deviations below 0.8.
SIGNATURE_SHARE = 0.65
#: Cells of the counts that put shingles in order: a table of this size at most goes through the driver.
CELLS = 2**18


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = lowered_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return np.unique(rolling(h, width)) if len(h) >= width else mixed(rolling(h, len(h)) + np.uint64(len(h)))


class MinHash:
    """Minima of BANDS * ROWS multiply-add functions modulo 2**32."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = BANDS * ROWS
        self.a, self.b = rng.integers(0, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n).astype(np.uint32)

    def of(self, shingle_hashes: np.ndarray) -> np.ndarray:
        x = (shingle_hashes >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 2**32 - 1, np.uint32)
        for at in range(0, len(x), 2048):
            out = np.minimum(out, (x[at : at + 2048, None] * self.a + self.b).min(axis=0))
        return out


def signature_of(minima: np.ndarray) -> bytes:
    """A byte of a hash of each minimum. The minima of large sets are small numbers, whose own top bytes are all 0."""
    return ((minima * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


SETS = "n_shingles long, set_key binary, signature binary, bands array<long>"


def shingle_sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """``docs`` without the text, with its set's size and digest, its signature (signature_of its minima) and a hash of
    each band."""

    def make():
        hashes, minhash = WordHashes(), MinHash()

        def one(t: str | None) -> tuple:
            s = shingles(t, width, hashes)
            if not len(s):
                return 0, None, None, None
            minima = minhash.of(s)
            bands = [xxhash.xxh3_64_intdigest(minima[k * ROWS : (k + 1) * ROWS].tobytes(), k) - 2**63 for k in range(BANDS)]
            return len(s), xxhash.xxh3_128_digest(s.tobytes()), signature_of(minima), bands

        return lambda texts: [list(c) for c in zip(*map(one, texts), strict=True)] if texts else [[], [], [], []]

    return with_outputs(docs, text, make, SETS, drop=(text,))


def grouped(df: DataFrame, keys: list[str], work: Callable[[list[tuple]], list[tuple]], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """work(rows of a group, setup()) for each group of ``keys``, streamed over partitions that are sorted by them.
    Groups must be of bounded size; rows are tuples of the other columns."""
    made = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(made)
    rest = [c for c in df.columns if c not in keys]
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = setup() if setup else None
        key, rows, out = None, [], []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != key:
                    if rows:
                        out += work(rows, own)
                    key, rows = row[:width], []
                    if len(out) >= 4096:
                        yield batch_of(out)
                        out = []
                rows.append(row[width:])
        if rows:
            out += work(rows, own)
        if out:
            yield batch_of(out)

    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, made)


def _resembling(rows: list[tuple], _) -> list[tuple]:
    """Members whose signature agrees enough with another's. rows: (group, node, signature)."""
    signatures = np.array([np.frombuffer(r[-1], np.uint8) for r in rows])
    near = np.zeros(len(rows), bool)
    for i in range(len(rows) - 1):
        agree = (signatures[i + 1 :] == signatures[i]).mean(axis=1) >= SIGNATURE_SHARE
        near[i + 1 :] |= agree
        near[i] |= agree.any()
    return [r[:-1] for r, keep in zip(rows, near, strict=True) if keep]


def _resembling_across(rows: list[tuple], _) -> list[tuple]:
    """Members whose signature agrees enough with one of the other side in another component. rows: (group, block,
    block, side, node, component, signature); sides 0 and 1, or all on side 0."""
    signatures = np.array([np.frombuffer(r[-1], np.uint8) for r in rows])
    component, side = np.array([r[5] for r in rows]), np.array([r[3] for r in rows])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(right):
        right = left
    near = np.zeros(len(rows), bool)
    for i in left.tolist():
        agree = ((signatures[right] == signatures[i]).mean(axis=1) >= SIGNATURE_SHARE) & (component[right] != component[i])
        near[right[agree]] = True
        near[i] |= agree.any()
    return [r[:-1] for r, keep in zip(rows, near, strict=True) if keep]


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """(i, j) where 100 * intersection >= percent * union, for sets of sorted distinct hashes: shared hashes are
    counted by products of 0/1 matrices, some columns at a time. ``right`` may be ``left`` itself."""
    sets = left if right is left else [*left, *right]
    sizes, n = np.array([len(s) for s in sets]), len(left)
    sizes_l, sizes_r = sizes[:n], sizes[len(sets) - len(right) :]
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    keep = np.bincount(column, minlength=len(values)) > 1  # a hash of one set alone is never shared
    place = np.cumsum(keep) - 1
    chosen = keep[column]
    row, column = row[chosen], place[column[chosen]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width, step = int(keep.sum()), max(256, 4_000_000 // len(sets))
    shared = np.zeros((n, len(right)), np.float64)
    for at in range(0, width, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        ones = np.zeros((len(sets), min(step, width - at)), np.float32)
        ones[row[lo:hi], column[lo:hi] - at] = 1
        shared += ones @ ones.T if right is left else ones[:n] @ ones[n:].T
    if right is left:
        np.fill_diagonal(shared, sizes)
    union = sizes_l[:, None] + sizes_r[None, :] - shared
    return np.argwhere((100 * shared >= percent * union) & (shared > 0))


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of pairs of numbers below n, those of a spanning forest: at most one for each number."""
    adjacent = np.zeros((n, n), bool)
    adjacent[pairs[:, 0], pairs[:, 1]] = adjacent[pairs[:, 1], pairs[:, 0]] = True
    unseen, out = np.ones(n, bool), []
    for first in np.unique(pairs).tolist():
        ahead = [first] if unseen[first] else []
        unseen[first] = False
        while ahead:
            i = ahead.pop()
            new = np.flatnonzero(adjacent[i] & unseen).tolist()
            unseen[new] = False
            out += [(i, j) for j in new]
            ahead += new
    return out


def _verified(width: int, percent: int):
    def work(rows: list[tuple], hashes: WordHashes) -> list[tuple]:
        """rows: (node, text) -> links"""
        sets = {(node, s.tobytes()): s for node, text in rows if len(s := shingles(text, width, hashes))}
        nodes, own = [k[0] for k in sets], list(sets.values())
        if len(set(nodes)) < 2:
            return []
        return [(nodes[i], nodes[j]) for i, j in _forest(similar_pairs(own, own, percent), len(own)) if nodes[i] != nodes[j]]

    return work


def _crossed(width: int, percent: int):
    def work(rows: list[tuple], hashes: WordHashes) -> list[tuple]:
        """rows: (side, node, component, text) -> links between components; sides 0 and 1, or all on side 0."""
        own = [(side, node, comp, s) for side, node, comp, text in rows if len(s := shingles(text, width, hashes))]
        left = [r for r in own if r[0] == 0]
        right = [r for r in own if r[0] == 1] or left
        if not left:
            return []
        sets = [r[3] for r in left]
        pairs = similar_pairs(sets, sets if right is left else [r[3] for r in right], percent)
        names, at = np.unique([r[2] for r in left] + [r[2] for r in right], return_inverse=True)
        met = np.stack([at[: len(left)][pairs[:, 0]], at[len(left) :][pairs[:, 1]]], axis=1)
        apart = met[:, 0] != met[:, 1]
        example = {tuple(sorted(m)): (left[i][1], right[j][1]) for m, (i, j) in zip(met[apart].tolist(), pairs[apart].tolist(), strict=True)}
        return [example[min(i, j), max(i, j)] for i, j in _forest(met[apart], len(names))]

    return work


LINK = "u long, v long"


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """A row for each of ``docs``: its id, n_shingles and component_id, the least id that links reach."""
    source = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    sets = as_table(shingle_sets(source, "text", width), "sets")
    full = sets.where("n_shingles > 0 AND id IS NOT NULL")
    classes = full.groupBy("set_key").agg(F.min(F.struct("id", "signature", "bands")).alias("first")).select("set_key", "first.*")
    classes = as_table(classes, "classes")
    banded = classes.select(F.explode("bands").alias("h"), F.col("id").alias("node"))
    groups = banded.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("leader"), _mark("node", 1), _mark("node", 2)).where("m > 1")
    groups = groups.groupBy("m", "f1", "f2", "leader").agg(F.min("h").alias("h")).select("h", "m", "leader")
    members = as_table(banded.join(groups, "h"), "members")
    many = members.where(F.col("m") > block)
    # a large group's members are dealt into blocks; its leader is in each of them
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.array(F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int"))
    placed = members.select("h", F.explode(F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), blocks - 1)).otherwise(own)).alias("b"), "node")
    signatures = classes.select(F.col("id").alias("node"), "signature")
    signed = placed.join(signatures, "node").select("h", "b", F.col("h").alias("g"), F.col("b").alias("c"), "node", "signature")
    dealt = as_table(grouped(signed, ["h", "b"], _resembling, "h long, b int, node long"), "dealt")
    nodes = dealt.select(F.col("node").alias("id")).union(many.select("node")).distinct()
    # rows of one id and text are one; the texts of candidates alone are needed, and written once for both rounds.
    # Candidates grow with the input, so the joins are shuffled at every size
    texts = source.join(nodes.hint("merge"), "id", "left_semi").groupBy("id", F.xxhash64("text").alias("t1"), F.crc32(F.col("text").cast("binary")).alias("t2")).agg(F.first("text").alias("text")).select(F.col("id").alias("node"), "text")
    texts = as_table(texts, "texts")
    links = grouped(dealt.hint("merge").join(texts, "node").select("h", "b", "node", "text"), ["h", "b"], _verified(width, percent), LINK, WordHashes)
    links = as_table(links, "verified")
    component = as_table(connected_components(links), "components")
    if many.limit(1).count():
        links = as_table(links.union(_left_apart(many, classes, component, texts, block, width, percent)), "verified")
        component = as_table(connected_components(links), "components")
    of_class = classes.select("set_key", F.col("id").alias("node")).join(component, "node", "left").select("set_key", F.coalesce("component", "node").alias("c"))
    found = sets.select("id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    return found.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"))


def _cells(shingle_hashes: np.ndarray) -> np.ndarray:
    return (shingle_hashes % np.uint64(CELLS)).astype(np.int64)


def rarest(shingle_hashes: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """So many of a set's shingles, in order of their cells' counts and then of the hashes, that two sets of similarity
    ``percent`` share one: of n shingles at least a = ceil(n * percent / 100) are common, and the first common one of
    that order has a - 1 others behind it in both sets."""
    n = len(shingle_hashes)
    first = n - (n * percent + 99) // 100 + 1
    return shingle_hashes[np.lexsort((shingle_hashes, counts[_cells(shingle_hashes)]))[:first]]


def _by_rarest(held: DataFrame, width: int, percent: int) -> DataFrame:
    """``held`` (node, c, text) by the rarest shingles of each text: (h, node, c). How rare they are is counted among
    ``held``, in CELLS cells; shingles that meet in a cell change the order, which any order may be, not what is found."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                cells, n = np.unique(_cells(shingles(text.as_py(), width, hashes)), return_counts=True)
                counts[cells] += n
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["cell", "n"])

    table_of = held.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[table_of.column("cell").to_numpy()] = table_of.column("n").to_numpy()
    known = held.sparkSession.sparkContext.broadcast(counts)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, names = WordHashes(), ["h", "node", "c"]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                chosen = [rarest(shingles(t, width, hashes), known.value, percent) for t in batch.column(2).to_pylist()]
                sizes = [len(c) for c in chosen]
                node, c = (np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(chosen).view(np.int64)), pa.array(node), pa.array(c)], names=names)

    return held.select("node", "c", "text").mapInArrow(part, "h long, node long, c long").distinct()


def _mark(node: str, seed: int) -> Column:
    """Sums of hashes of 36 bits: equal for groups of the same members, each as often (a row's id may have several sets,
    which would cancel out in an exclusive or)."""
    return F.sum(F.shiftright(F.xxhash64(node, F.lit(seed)), 28)).alias(f"f{seed}")


def _uneven(placed: DataFrame, block: int) -> DataFrame:
    """Groups of ``placed`` (h, node, c) with more than one component: their size, the largest component, and how many
    blocks those outside of it and those within fill. Groups of the same members count once."""
    counts = placed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), _mark("node", 1), _mark("node", 2))
    largest = counts.groupBy("h").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("m"), F.sum("f1").alias("f1"), F.sum("f2").alias("f2")).where("top.n < m")
    largest = largest.groupBy("m", "f1", "f2", "top").agg(F.min("h").alias("h"))
    return largest.select("h", "m", F.col("top.c").alias("top"), F.ceil((F.col("m") - F.col("top.n")) / block).cast("int").alias("outer"), F.ceil(F.col("top.n") / block).cast("int").alias("inner"))


def _rows(uneven: DataFrame) -> int:
    """How many rows the members of groups give, each to meet all blocks."""
    return uneven.agg(F.sum(F.col("m").cast("decimal(38,0)") * (F.col("outer") + F.col("inner")))).first()[0] or 0


def _left_apart(many: DataFrame, classes: DataFrame, component: DataFrame, texts: DataFrame, block: int, width: int, percent: int) -> DataFrame:
    """Links between members of large groups that are in different components so far. Members outside of a group's
    largest component meet each other and all of that component, in pairs of blocks: by their signatures first, then
    those that resemble in full. Where those outside fill more than one block, members are grouped by their rarest
    shingles instead if that gives fewer rows to compare; either way each similar pair meets."""
    placed = many.select("h", "node").join(component, "node", "left").select("h", "node", F.coalesce("component", "node").alias("c"))
    placed = as_table(placed, "placed")
    uneven = as_table(_uneven(placed, block), "uneven")
    wide = uneven.where("outer > 1")
    sided = placed.join(uneven, "h")
    if wide.limit(1).count():
        held = placed.join(wide.select("h"), "h", "left_semi").select("node", "c").distinct()
        held = as_table(held.hint("merge").join(texts, "node").select("node", "c", "text"), "held")
        parts = as_table(_by_rarest(held, width, percent), "parts")
        drop_table(held)
        uneven_parts = as_table(_uneven(parts, block), "uneven")
        if _rows(uneven_parts) < _rows(wide):
            sided = placed.join(uneven.where("outer = 1"), "h").union(parts.join(uneven_parts, "h"))
    # blocks 0 .. outer-1 hold those outside, outer .. outer+inner-1 the largest component
    own = F.when(F.col("c") == F.col("top"), F.col("outer") + F.pmod(F.xxhash64("node", F.lit(4)), F.col("inner"))).otherwise(F.pmod(F.xxhash64("node", F.lit(4)), F.col("outer"))).cast("int")
    others = F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1)
    dealt = sided.select("h", "node", "c", "outer", "inner", own.alias("own")).join(classes.select(F.col("id").alias("node"), "signature"), "node").withColumn("other", F.explode(others)).where("own < outer OR other < outer")
    keys = [F.least("own", "other"), F.greatest("own", "other")]
    dealt = dealt.select("h", keys[0].alias("b1"), keys[1].alias("b2"), F.col("h").alias("g"), keys[0].alias("c1"), keys[1].alias("c2"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "c", "signature")
    dealt = grouped(dealt, ["h", "b1", "b2"], _resembling_across, "h long, b1 int, b2 int, side int, node long, c long")
    return grouped(dealt.hint("merge").join(texts, "node").select("h", "b1", "b2", "side", "node", "c", "text"), ["h", "b1", "b2"], _crossed(width, percent), LINK, WordHashes)


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: the one that names it. The columns are those of ``docs``; of several rows of one
    id, one stays."""
    found = as_table(near_duplicates(docs, text, id_col, width, percent), "found")
    own = F.col(quoted(id_col))
    dropped = found.where(own != F.col("component_id")).select(own.alias("__other__")).distinct()
    # what is dropped grows with the input: shuffled at every size, like the joins of candidates
    kept = docs.join(dropped.hint("merge"), own.cast("long") == F.col("__other__"), "left_anti")
    again = found.where(own.isNotNull()).groupBy(own.alias("__other__")).count().where("count > 1").select("__other__")
    if not again.limit(1).count():
        return kept
    same = own.cast("long") == F.col("__other__")
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col]))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
