"""Automorphisms of graphs: twins are merged, colours are refined, and only then are images tried, level by level.

Nodes are numbers from 0 to 62, as neighbourhoods are masks; others raise an error. Graphs are undirected: an edge counts both
ways, loops and nulls don't count.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import kernels as K
from tallyforge.operators.loops import cut, written


def _one(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _both_ways(edges: DataFrame) -> DataFrame:
    src, dst = (K.place_in_mask(F.col(c)) for c in ("src", "dst"))
    one = edges.where("src <> dst").select(src.alias("src"), dst.alias("dst"))
    return one.union(one.select("dst", "src")).distinct()


def refined(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(node, colour: long): colours (node, colour) split until all nodes of a colour have as many neighbours of each colour.
    Every round hashes a node's colour with its neighbours' colours and their counts; no node's neighbours are collected. Equal
    hashes of different colours could only leave a split undone, never part nodes that an automorphism exchanges."""
    now = written(colours.select("node", F.xxhash64("colour").alias("colour")))
    count = now.agg(F.countDistinct("colour").alias("n")).first()["n"]
    while True:
        seen = edges.join(now.withColumnRenamed("node", "dst"), "dst").groupBy("src", "colour").agg(F.count(F.lit(1)).alias("n"))
        around = seen.groupBy(F.col("src").alias("node")).agg(F.bit_xor(F.xxhash64("colour", "n")).alias("h"))
        new = written(now.join(around, "node", "left").select("node", F.xxhash64("colour", "h").alias("colour")))
        more = new.agg(F.countDistinct("colour").alias("n")).first()["n"]
        if more <= count:
            return now
        now, count = new, more


def without_twins(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(edges, colours, tops, order): the graph in which nodes of one colour and the same neighbours, or the same ones with
    themselves, are merged again and again. ``tops`` (node, top) says what each node went into: all nodes of one top can be
    exchanged. ``colours`` (node, colour) of those left say how they came about, and ``order`` is the number of ways to
    exchange nodes within them. Complete and bipartite complete graphs become one node or two."""
    now = cut(nodes.select(K.place_in_mask(F.col("node")).alias("node")).distinct().withColumn("colour", F.lit("")))
    tops = now.select("node", F.col("node").alias("top"))
    order, still = 1, 0
    while still < 2:
        for kind in ("open", "closed"):
            near = edges.groupBy(F.col("src").alias("node")).agg(F.bit_or(_one(F.col("dst"))).alias("mask"))
            masks = now.join(near, "node", "left").select("node", "colour", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
            if kind == "closed":
                masks = masks.withColumn("mask", F.col("mask").bitwiseOR(_one(F.col("node"))))
            groups = cut(masks.groupBy("colour", "mask").agg(F.min("node").alias("top"), F.count(F.lit(1)).alias("size"), F.collect_list("node").alias("members")))
            sizes = [r["size"] for r in groups.where("size > 1").select("size").collect()]  # 31 at most
            still = 0 if sizes else still + 1
            if not sizes:
                continue
            for size in sizes:
                order *= factorial(size)
            into = cut(groups.select(F.explode("members").alias("node"), "top"))
            now = cut(groups.select(F.col("top").alias("node"), F.when(F.col("size") > 1, F.concat("colour", F.lit(f"({kind} "), F.col("size").cast("string"), F.lit(")"))).otherwise(F.col("colour")).alias("colour")))
            tops = cut(tops.join(into.select(F.col("node").alias("top"), F.col("top").alias("next")), "top").select("node", F.col("next").alias("top")))
            edges = cut(edges.join(now.select(F.col("node").alias("src")), "src", "left_semi").join(now.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    return edges, now, tops, order


def colour_automorphisms(edges: DataFrame, colours: DataFrame) -> tuple[list[int], DataFrame]:
    """(moving, images): the nodes that could move, and a row (images: array<long>) of their images for each automorphism that
    keeps colours (node, colour) of a graph given both ways. Nodes alone in their refined colour stay, so a graph whose
    colours all differ has one row, of no images. Each level gives one node an image of its own colour by a join, and
    drops what breaks an edge to the nodes before."""
    fine = refined(edges, colours)
    near = edges.groupBy(F.col("src").alias("node")).agg(F.bit_or(_one(F.col("dst"))).alias("mask"))
    rows = cut(fine.join(near, "node", "left").select("node", "colour", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))
    known = [tuple(r) for r in rows.orderBy("node").collect()]  # 63 at most
    classes: dict[int, list[int]] = {}
    for node, colour, _ in known:
        classes.setdefault(colour, []).append(node)
    mask = {node: m for node, _, m in known}
    colour_of = {node: c for node, c, _ in known}
    left = {node for members in classes.values() if len(members) > 1 for node in members}
    moving: list[int] = []
    while left:  # next to those placed, of the smallest colour
        node = min(left, key=lambda v: (-sum(mask[v] >> u & 1 for u in moving), len(classes[colour_of[v]]), v))
        moving.append(node)
        left.remove(node)
    now = edges.sparkSession.range(1).select(F.array().cast("array<long>").alias("images"))
    for k, node in enumerate(moving):
        options = rows.where(F.col("colour") == colour_of[node]).select("colour", F.col("node").alias("image"), "mask")
        met = now.withColumn("colour", F.lit(colour_of[node]).cast("long")).join(options, "colour").where(~F.array_contains("images", F.col("image")))
        wanted = F.array(*[F.lit(mask[node] >> u & 1) for u in moving[:k]]) if k else None
        fits = F.forall(F.zip_with("images", wanted, lambda i, w: K.bit(F.col("mask"), i) == w), lambda x: x) if k else F.lit(True)
        now = cut(met.where(fits).select(F.concat("images", F.array("image")).alias("images")))
    return moving, now


def orbits(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """(node, orbit) with the least node of its orbit, and the number of automorphisms of the graph. Twins are merged first, so
    what they may be exchanged for is counted and not listed; the rest is listed, an array for each automorphism of what
    is left. A node without edges is one of ``nodes`` (node); no nodes have no orbits and one automorphism."""
    both = cut(_both_ways(edges))
    inner, colours, tops, order = without_twins(both, nodes)
    moving, images = colour_automorphisms(inner, colours)
    count = images.count()
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(v).cast("long") for v in moving]).alias("top"), F.col("images").alias("image"))) if moving else None
    if moving:
        least = images.select(pairs.alias("p")).groupBy(F.col("p.top").alias("top")).agg(F.min("p.image").alias("least"))
        tops = tops.join(least, "top", "left").select("node", F.coalesce("least", "top").alias("top"))
    lowest = tops.groupBy("top").agg(F.min("node").alias("orbit"))
    return tops.join(lowest, "top").select("node", "orbit"), order * count
