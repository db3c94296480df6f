"""The prefix trie of conversations, by a splitter skeleton.

A conversation's path is 16 bytes of SHA-256 for each of its turns (role and text), one after the other. Paths, with the
conversation's id after them, are dealt into shards by range: splitters come from a sample, and the trie of their paths, the
skeleton, is broadcast. A node has conversations in two shards only if a splitter's path goes through it: if x < s <= y, and
x and y begin with the node's path, so does s. So a shard, read in order, finishes all nodes beside the skeleton with a stack of
open nodes, and gives a partial aggregate for each skeleton node that it meets. Those are reduced by node, and then summed up
the skeleton. A group of any size is dealt over many shards, as ids tell equal paths apart.

What is on the driver: the sample (64 MB of paths in the mean at most, and a million paths), the skeleton made from it, and
one aggregate for each of its nodes. Splitter paths are cut to what tells them from the sampled path before.
A digest of ends streams over ids in order, within a shard or, for a skeleton node, over rows of 4096 ids.

Defined results: turns are ordered by number (null first), then role, then text; a null role or text is empty; repeated rows are
repeated turns; rows without a conv_id belong to no conversation and aren't read; a conversation without turns is a member of the
root; no conversations, no nodes; extra columns aren't read. A conversation's path is one row of 24 bytes for each turn.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.llm.common import as_table, drop_table, quoted, table

#: Bytes of a turn in a path.
STEP = 16
#: Sampled paths for each shard, and in all; bytes of them in all, in the mean.
SAMPLED, MOST_SAMPLED, SAMPLED_BYTES = 32, 1_000_000, 64_000_000
#: Ids of a row of a skeleton node's ends.
IDS_AT_ONCE = 4096
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: kind 0: a node; 1: a node below a skeleton node; 2: a skeleton node's partial aggregate; 3: some of its ends.
_PARTIAL = f"kind int, skeleton long, part long, {NODES}, size long, ends string"


def paths_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, path, sizes): a row for each conversation, with 16 bytes and the UTF-8 size of the text for each turn."""
    c = {k: F.col(quoted(v)) for k, v in (("conv", conv), ("turn", turn), ("role", role), ("text", text))}
    who, said = (F.coalesce(c[k].cast("string"), F.lit("")) for k in ("role", "text"))
    rows = turns.where(c["conv"].isNotNull()).select(c["conv"].cast("long").alias("conv_id"), c["turn"].alias("turn"), who.alias("role"), said.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    key = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256), 1, 2 * STEP)
    placed = rows.select("conv_id", F.row_number().over(order).alias("at"), key.alias("key"), F.octet_length("text").cast("long").alias("size"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "key", "size"))).alias("turns"))
    joined = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    return whole.select("conv_id", joined.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def regrafted(paths: DataFrame, head: Column, turns: Column) -> DataFrame:
    """Each conversation with the first ``turns`` turns of the conversation ``head`` (none if that is absent) in place of its
    own first ones."""
    own = paths.select("*", head.alias("__head__"), turns.cast("int").alias("__turns__"))
    most = own.agg(F.coalesce(F.max("__turns__"), F.lit(0)).alias("most")).first()["most"]
    heads = paths.select(F.col("conv_id").alias("__head__"), F.substring("path", 1, STEP * most).alias("__path__"), F.slice("sizes", 1, most).alias("__sizes__"))
    n = F.col("__turns__")
    path = F.concat(F.coalesce(F.substring(F.col("__path__"), F.lit(1), STEP * n), F.lit(b"")), F.substring(F.col("path"), STEP * n + 1, F.octet_length("path")))
    sizes = F.concat(F.coalesce(F.slice("__sizes__", F.lit(1), n), F.array().cast("array<long>")), F.slice("sizes", n + 1, F.greatest(F.size("sizes"), F.lit(0))))
    return own.join(heads, "__head__", "left").select("conv_id", path.alias("path"), sizes.alias("sizes"))


def _common(a: bytes, b: bytes) -> int:
    """Turns with which both paths begin."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        middle = (low + high + 1) // 2
        if a[STEP * low : STEP * middle] == b[STEP * low : STEP * middle]:
            low = middle
        else:
            high = middle - 1
    return low


@dataclass
class Skeleton:
    """Splitters in order, and of each the numbers of the nodes on its path, the root (0) first. ``parents`` and ``depths`` are by
    number; a node's number is greater than its parent's."""

    splitters: list[tuple[bytes, int]]
    numbers: list[list[int]]
    parents: list[int]
    depths: list[int]

    @classmethod
    def of(cls, sample: list[tuple[bytes, int]], shards: int) -> Skeleton:
        """Splitters from a sorted sample, at equal distances."""
        at = sorted({len(sample) * k // shards for k in range(1, shards)} - {0}) if len(sample) > 1 else []
        out = cls([], [], [-1], [0])
        for k in at:
            path, conv = sample[k]
            if (shared := _common(path, sample[k - 1][0])) * STEP < len(path) and path != sample[k - 1][0]:
                path, conv = path[: STEP * (shared + 1)], -(1 << 63)
            if out.splitters and (path, conv) <= out.splitters[-1]:
                continue
            nodes = out.numbers[-1][: _common(path, out.splitters[-1][0]) + 1] if out.splitters else [0]
            while len(nodes) <= len(path) // STEP:
                out.parents.append(nodes[-1])
                out.depths.append(len(nodes))
                nodes.append(len(out.parents) - 1)
            out.splitters.append((path, conv))
            out.numbers.append(nodes)
        return out


def _sampled(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Sorted paths and ids of a sample by a hash of the id."""
    total = paths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0)).alias("bytes")).first()
    share = min(1.0, min(SAMPLED * shards, MOST_SAMPLED) / max(1, total["n"]), SAMPLED_BYTES / max(1, total["bytes"]))
    chosen = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("path", "conv_id")
    return sorted((bytes(r["path"]), r["conv_id"]) for r in chosen.collect())


class _Node:
    """An open node: its aggregates so far, and the rows of closed children, which wait for its least member."""

    __slots__ = ("children", "convs", "ends", "leaves", "least", "number", "part", "saved", "size", "some", "waiting")

    def __init__(self, size: int, number: int):
        self.size, self.number = size, number  # number in the skeleton, or -1
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.some, self.part, self.waiting = None, [], 0, []


class _Rows:
    """Rows of _PARTIAL, and batches of them."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows = []
        return out


_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _shard(batches: Iterator[pa.RecordBatch], skeleton: Skeleton, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Nodes and partial aggregates of shards, of which the rows come in order of shard, path and id."""
    rows, stack, last, now, lower, upper = _Rows(schema), [], b"", None, None, None

    def flush(node: _Node) -> None:
        """Some of a skeleton node's ends."""
        if node.some:
            rows.rows.append((3, node.number, now * (1 << 32) + node.part, *[None] * 9, ",".join(map(str, node.some))))
            node.part, node.some = node.part + 1, []

    def close() -> None:
        node = stack.pop()
        if node.number >= 0:
            flush(node)
            rows.rows.append((2, node.number, now, node.least, len(stack), None, node.convs, node.children, node.leaves, node.saved, None, node.size, None))
            if stack:
                above = stack[-1]
                above.convs += node.convs
                above.least = node.least if above.least is None else min(above.least, node.least)
            return
        leaves, saved = node.leaves or 1, node.saved + (node.convs - 1) * node.size
        rows.rows += [(0, None, None, *w[:2], node.least, *w[2:], None, None) for w in node.waiting]
        made = (node.least, len(stack), node.convs, node.children, leaves, saved, node.ends.hexdigest() if node.ends else _NO_ENDS)
        above = stack[-1]  # the root is in the skeleton
        above.convs += node.convs
        above.least = node.least if above.least is None else min(above.least, node.least)
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        if above.number >= 0:
            rows.rows.append((1, above.number, None, *made[:2], None, *made[2:], None, None))
        else:
            above.waiting.append(made)

    for batch in batches:
        shards, paths, convs = (batch.column(k) for k in range(3))
        sizes = batch.column(3)
        for shard, path, conv, own in zip(shards.to_pylist(), paths.to_pylist(), convs.to_pylist(), sizes.to_pylist(), strict=True):
            if shard != now:
                while stack:
                    close()
                now, last = shard, b""
                lower = shard - 1 if shard else None
                upper = shard if shard < len(skeleton.splitters) else None
                stack.append(_Node(0, 0))
            shared = _common(path, last)
            while len(stack) > shared + 1:
                close()
            if len(stack) <= len(own):
                near = [(_common(path, skeleton.splitters[k][0]), skeleton.numbers[k]) for k in (lower, upper) if k is not None]
                for depth in range(len(stack), len(own) + 1):
                    stack.append(_Node(own[depth - 1], next((numbers[depth] for most, numbers in near if depth <= most), -1)))
            node = stack[-1]
            node.convs += 1
            node.least = conv if node.least is None else min(node.least, conv)
            if node.number >= 0:
                node.some.append(conv)
                if len(node.some) >= IDS_AT_ONCE:
                    flush(node)
            elif node.ends is None:
                node.ends = hashlib.sha256(b"%d" % conv)
            else:
                node.ends.update(b",%d" % conv)
            last = path
            if len(rows.rows) >= 4096:
                yield rows.batch()
    while stack:
        close()
    yield rows.batch()


def _dealt(paths: DataFrame, skeleton: Broadcast, shards: int) -> DataFrame:
    """Paths with their shard, each shard in order in a partition of its own."""
    schema = T._parse_datatype_string("shard int, path binary, conv_id long, sizes array<long>")
    arrow = to_arrow_schema(schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = skeleton.value.splitters
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            shard = pa.array([bisect_right(splitters, key) for key in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *batch.columns], names=arrow.names)

    dealt = paths.select("path", "conv_id", "sizes").mapInArrow(deal, schema)
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")


def _digests(ends: DataFrame) -> DataFrame:
    """(skeleton, ends_sha256) from rows of ends."""
    schema = T._parse_datatype_string("skeleton long, ends_sha256 string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for number, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number != now:
                    done += [(now, state.hexdigest())] if state else []
                    now, state = number, hashlib.sha256(some.encode())
                else:
                    state.update(b"," + some.encode())
        done += [(now, state.hexdigest())] if state else []
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return ends.repartition(F.col("skeleton")).sortWithinPartitions("skeleton", "part").select("skeleton", "ends").mapInArrow(run, schema)


def _reduced(skeleton: Skeleton, parts: list, ends: dict[int, str]) -> list[tuple]:
    """(number, columns of NODES) of the skeleton's nodes from their reduced aggregates; children come after parents."""
    of = {r["skeleton"]: r for r in parts}
    n = len(skeleton.parents)
    children, leaves, saved = np.zeros(n, object), np.zeros(n, object), np.zeros(n, object)
    for number in sorted(of, reverse=True):
        r = of[number]
        children[number] += r["n_children"]
        leaves[number] = leaves[number] + r["n_leaves"] or 1
        saved[number] += r["saved_tokens"] + (r["n_convs"] - 1) * r["size"]
        if (above := skeleton.parents[number]) >= 0:
            children[above] += 1
            leaves[above] += leaves[number]
            saved[above] += saved[number]
    least = lambda k: of[k]["conv_id"] if k >= 0 else None
    return [(k, of[k]["conv_id"], skeleton.depths[k], least(skeleton.parents[k]), of[k]["n_convs"], int(children[k]), int(leaves[k]), int(saved[k]), ends.get(k, _NO_ENDS)) for k in sorted(of)]


def prefix_trie(paths: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``paths`` (conv_id, path, sizes), as NODES says: its least member, depth, parent's
    least member, members, children, leaves and saved bytes of its subtree, digest of the ids that end there."""
    spark = paths.sparkSession
    kept = as_table(paths, "paths")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    skeleton = Skeleton.of(_sampled(kept, shards), shards)
    shared, schema = spark.sparkContext.broadcast(skeleton), T._parse_datatype_string(_PARTIAL)
    arrow = to_arrow_schema(schema)
    partial = as_table(_dealt(kept, shared, shards).mapInArrow(lambda batches: _shard(batches, shared.value, arrow), schema), "trie")
    drop_table(kept)
    met = partial.where("kind = 2").groupBy("skeleton")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = met.agg(F.min("conv_id").alias("conv_id"), *sums, F.max("size").alias("size")).collect()  # a row for each node of the skeleton
    ends = {r["skeleton"]: r["ends_sha256"] for r in _digests(partial.where("kind = 3")).collect()}  # likewise
    names = [f.name for f in T._parse_datatype_string(NODES)]
    top = spark.createDataFrame(_reduced(skeleton, parts, ends), f"skeleton long, {NODES}")
    inner = partial.where("kind = 0").select(*names)
    least = top.select("skeleton", F.col("conv_id").alias("__least__"))
    edge = partial.where("kind = 1").join(F.broadcast(least), "skeleton").withColumn("parent_conv_id", F.col("__least__")).select(*names)
    return inner.unionByName(edge).unionByName(top.select(*names))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    paths = as_table(paths_of(table(spark, sf_dir, "conversations")), "turns")
    nodes = prefix_trie(regrafted(paths, conv - conv % 5, F.crc32(conv.cast("string")) % 9))
    drop_table(paths)
    return nodes
