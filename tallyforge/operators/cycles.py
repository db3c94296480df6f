"""Which lengths the simple directed cycles of a graph have, with a witness each, and witnesses by colour coding.

States of both programs keep one path each, the least, so that a cycle can be read off; paths are never enumerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import kernels as K
from tallyforge.operators.loops import cut, written
from tallyforge.operators.strong import strong_components


def _one(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _closed(level: DataFrame, edges: DataFrame) -> DataFrame:
    """The least path of (path, first, head) whose head has an edge to its first node; one row, null if there is none."""
    back = edges.select(F.col("src").alias("head"), F.col("dst").alias("first"))
    return level.join(back, ["head", "first"]).agg(F.min("path").alias("path"))


def _by_subsets(edges: DataFrame, wanted: set[int], kept: int | None) -> dict[int, list[int]]:
    """A cycle of each length in ``wanted`` that states (set of nodes, last node) lead to, a level for each length; the first
    node is the least. With ``kept``, about as many states of a level go on, drawn by a hash; without it all do, and a
    length that isn't found has no cycle."""
    found: dict[int, list[int]] = {}
    level = cut(edges.select(F.col("src").alias("first")).distinct().select("first", F.col("first").alias("head"), _one(F.col("first")).alias("mask"), F.array("first").alias("path")))
    ways = edges.withColumnRenamed("src", "head")
    for length in range(2, max(wanted, default=0) + 1):
        grown = level.join(ways, "head").where((F.col("dst") > F.col("first")) & (K.bit(F.col("mask"), F.col("dst")) == 0))
        grown = grown.groupBy("first", F.col("dst").alias("head"), F.col("mask").bitwiseOR(_one(F.col("dst"))).alias("mask")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        level = cut(grown)
        states = level.count()
        if not states:
            break
        if length in wanted and (path := _closed(level, edges).first()["path"]):
            found[length] = path
        if kept and states > kept:
            level = level.where(F.pmod(F.xxhash64("mask", "head"), F.lit(states)) < kept)
        if wanted <= found.keys():
            break
    return found


def cycle_lengths(edges: DataFrame, least: int = 2, sample: int = 20_000) -> DataFrame:
    """(length, witness: array<long>): all lengths, from ``least`` on, of simple directed cycles in edges (src, dst) of nodes 0 to
    62, with one such cycle each, its least node first. Other nodes raise an error; loops, nulls and repeated edges don't
    count. A graph without cycles has no rows.

    A cycle stays within a strong component, so no length exceeds the largest one. A first pass lets a sample of states go on
    at each level and finds most lengths that there are. Only for lengths that it has not found does the whole program over
    subsets run, which settles them; it has as many states as sets of nodes that form a path, times their ends."""
    spark = edges.sparkSession
    edges = edges.where("src <> dst").select(*[K.place_in_mask(F.col(c)).alias(c) for c in ("src", "dst")]).distinct()
    edges = written(edges)
    part = strong_components(edges)
    here = part.select(F.col("node").alias("src"), F.col("component").alias("a"))
    there = part.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    inner = cut(edges.join(here, "src").join(there, "dst").where("a = b").select("src", "dst"))
    sizes = part.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    wanted = set(range(least, (sizes.first()["n"] or 0) + 1))
    found = _by_subsets(inner, wanted, sample) if wanted else {}
    if wanted - found.keys():
        found |= _by_subsets(inner, wanted - found.keys(), None)
    return spark.createDataFrame([(k, list(v)) for k, v in sorted(found.items())], "length int, witness array<long>")  # 62 at most


def coded_cycle(edges: DataFrame, length: int, batches: int = 4, colourings: int = 64) -> DataFrame:
    """(length, witness: array<long>): a simple directed cycle of this length (2 to 20), or no row if none was met. Nodes are any
    whole numbers, and graphs of any size: each of many random colourings gives every node one of ``length`` colours, and
    states (colouring, first node, set of colours, last node) keep one path. A given cycle has all colours, and is found,
    with a chance of length! / length**length for each colouring, so finding none is no proof. Colours come from a hash."""
    spark = edges.sparkSession
    if not 2 <= length <= 20:
        raise ValueError("lengths from 2 to 20")
    edges = written(edges.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct())
    colour = lambda node: F.pmod(F.xxhash64("colouring", node), F.lit(length)).cast("int")
    for batch in range(batches):
        numbers = F.sequence(F.lit(batch * colourings), F.lit((batch + 1) * colourings - 1))
        level = edges.select(F.col("src").alias("first")).distinct().withColumn("colouring", F.explode(numbers)).where(colour("first") == 0)
        level = level.select("colouring", "first", F.col("first").alias("head"), F.lit(1).cast("long").alias("mask"), F.array("first").alias("path"))
        for _ in range(length - 1):
            grown = level.join(edges.withColumnRenamed("src", "head"), "head").where(K.bit(F.col("mask"), colour("dst")) == 0)
            level = grown.groupBy("colouring", "first", F.col("dst").alias("head"), F.col("mask").bitwiseOR(_one(colour("dst"))).alias("mask")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
            level = written(level)
        path = _closed(level, edges).first()["path"]
        if path:
            return spark.createDataFrame([(length, list(path))], "length int, witness array<long>")
    return spark.createDataFrame([], "length int, witness array<long>")


def checked(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """(length, witness, verified): whether a witness has ``length`` different nodes, each with an edge to the next one and the
    last to the first; every step is joined to the edges."""
    around = F.transform(F.col("witness"), lambda x, i: F.struct(x.alias("src"), F.get("witness", (i + 1) % F.size("witness")).alias("dst")))
    steps = cycles.select("length", "witness", F.explode(around).alias("e")).select("length", "witness", "e.src", "e.dst")
    there = steps.join(edges.select("src", "dst").distinct(), ["src", "dst"]).groupBy("length", "witness").agg(F.count(F.lit(1)).alias("n"))
    distinct = F.size(F.array_distinct("witness")) == F.col("length")
    joined = cycles.join(there, ["length", "witness"], "left")
    return joined.select("length", "witness", (distinct & (F.size("witness") == F.col("length")) & (F.coalesce("n", F.lit(0)) == F.col("length"))).alias("verified"))
