"""Constraint search by levels: partial solutions are rows, a level adds one choice, prunes are filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import kernels as K
from tallyforge.operators import symmetry
from tallyforge.operators.loops import cut, merged


def _one(i):
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def graceful_labelings(spark: SparkSession, edges: list[tuple[int, int]]) -> int:
    """Labelings of vertices by different numbers 0 .. m with all m edge differences different (m below 63).

    Vertices are taken most-connected first; states that agree in what later vertices see are merged."""
    m = len(edges)
    vertices = sorted({v for e in edges for v in e})
    near = {v: {a + b - v for a, b in edges if v in (a, b)} for v in vertices}
    order: list[int] = []
    while len(order) < len(vertices):
        order.append(max((v for v in vertices if v not in order), key=lambda v: (len(near[v] & set(order)), len(near[v]))))
    labels = F.sequence(F.lit(0).cast("long"), F.lit(m).cast("long"))
    now = spark.range(1).select(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("diffs"), F.array().cast("array<long>").alias("own"), F.lit(1).alias("cnt"))
    open_vertices: list[int] = []
    for k, v in enumerate(order):
        now = now.select("*", F.explode(labels).alias("x")).where(K.bit(F.col("used"), F.col("x")) == 0)
        for u in sorted(near[v] & set(order[:k]), key=order.index):
            d = F.abs(F.col("x") - F.get("own", open_vertices.index(u)))
            now = now.withColumn("d", d).where(K.bit(F.col("diffs"), F.col("d")) == 0).withColumn("diffs", F.col("diffs").bitwiseOR(_one(F.col("d")))).drop("d")
        still = [u for u in [*open_vertices, v] if near[u] - set(order[: k + 1])]
        own = F.array(*[F.col("x") if u == v else F.get("own", open_vertices.index(u)) for u in still]) if still else F.array().cast("array<long>")
        now = now.select(F.col("used").bitwiseOR(_one(F.col("x"))).alias("used"), "diffs", own.alias("own"), "cnt")
        now = cut(merged(now, ["used", "diffs", "own"]))
        open_vertices = still
    return int(now.agg(F.sum("cnt").alias("n")).first()["n"] or 0)


def automorphisms(edges: DataFrame, vertices: int) -> DataFrame:
    """(p: array<int>) of permutations of 1 .. vertices (63 at most) that keep a symmetric edge set (src, dst from 0). Images
    are tried within refined colours only; symmetry.orbits() counts them without a row for each."""
    table = cut(edges.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct())
    nodes = edges.sparkSession.range(vertices).select(F.col("id").alias("node"), F.lit(0).alias("colour"))
    moving, images = symmetry.colour_automorphisms(table, nodes)
    return images.select(F.array(*[((F.get("images", moving.index(v)) if v in moving else F.lit(v)) + 1).cast("int") for v in range(vertices)]).alias("p"))


def attacks(spark: SparkSession, surface: str, n: int, steps: list[tuple[int, int]], slide: bool) -> DataFrame:
    """(src, dst): cells of an n by n board that a piece attacks; a sliding piece goes on step by step, over the seams."""
    from tallyforge.functions.generators import cells

    moves = spark.createDataFrame(steps, "dr int, dc int")
    board = cells(spark, n, n).crossJoin(moves)  # as many rows as cells times steps
    now = board.select(F.col("r").alias("r0"), F.col("c").alias("c0"), "r", "c", "dr", "dc")
    size, out = F.lit(n), None
    for _ in range(2 * n if slide else 1):
        dr, dc = F.col("dr"), F.col("dc")
        folded = K.fold(surface, F.col("r") + dr, F.col("c") + dc, size, size)
        across, along = K.SURFACES[surface]
        turned_c = (F.col("c") + dc < 0) | (F.col("c") + dc >= n)
        turned_r = (F.col("r") + dr < 0) | (F.col("r") + dr >= n)
        new_dr = F.when(turned_c & F.lit(across == -1), -dr).otherwise(dr)
        new_dc = F.when(turned_r & F.lit(along == -1), -dc).otherwise(dc)
        now = cut(now.select("r0", "c0", folded.alias("at"), new_dr.alias("dr"), new_dc.alias("dc")).where("at IS NOT NULL").select("r0", "c0", "at.r", "at.c", "dr", "dc").distinct())
        step = now.select((F.col("r0") * n + F.col("c0")).cast("long").alias("src"), (F.col("r") * n + F.col("c")).cast("long").alias("dst"))
        out = step if out is None else out.union(step)
    return out.where("src <> dst").distinct()
