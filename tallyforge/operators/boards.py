"""Boards whose edges are glued to surfaces: neighbourhoods, lights, cell complexes and lines of attack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import kernels as K
from tallyforge.operators.exact import gf2_rank


def _one(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def closed_neighbourhoods(boards: DataFrame) -> DataFrame:
    """(surface, n, cell, mask) for boards (n) of n x n cells, n up to 7: the cell and those a unit move leads to, each
    once, as a mask. A null n has no cells; repeated rows count once."""
    cells = boards.select("n").distinct().where("n > 0").select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") * F.col("n") - 1)).alias("cell"))
    r, c, n = F.floor(F.col("cell") / F.col("n")), F.col("cell") % F.col("n"), F.col("n")
    place = lambda p: F.when(p.isNotNull(), _one(p["r"] * n + p["c"])).otherwise(F.lit(0).cast("long"))

    def on(surface: str) -> DataFrame:
        moves = [place(K.fold(surface, r + a, c + b, n, n)) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))]
        return cells.select(F.lit(surface).alias("surface"), "n", "cell", reduce(Column.bitwiseOR, moves, _one(F.col("cell"))).alias("mask"))

    return reduce(DataFrame.union, [on(surface) for surface in K.SURFACES])


def lights(patterns: DataFrame) -> DataFrame:
    """(surface, n, nullity, patterns, solvable) for patterns (key, n, lit) on n x n boards, n up to 7. Pressing a cell
    flips its closed neighbourhood; a pattern can be put out if it adds nothing to the rank of the neighbourhoods."""
    rows = closed_neighbourhoods(patterns)
    alone = gf2_rank(rows, ["surface", "n"], "cell", "mask").select("surface", "n", F.col("rank").alias("own"))
    keys = patterns.select("key", "n", "lit").where("key IS NOT NULL AND n > 0").distinct()
    met = rows.join(keys.select("key", "n"), "n").select("surface", "n", "key", "mask")
    surfaces = rows.select("surface", "n").distinct()
    added = met.union(keys.join(surfaces, "n").select("surface", "n", "key", "lit"))
    with_pattern = gf2_rank(added, ["surface", "n", "key"], "key", "mask").select("surface", "n", "rank")
    return with_pattern.join(alone, ["surface", "n"]).groupBy("surface", "n").agg(
        F.max(F.col("n") * F.col("n") - F.col("own")).cast("long").alias("nullity"), F.count(F.lit(1)).alias("patterns"), F.count_if(F.col("rank") == F.col("own")).alias("solvable")
    )


def euler_characteristics(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by.., surface, faces, edges, vertices, chi) of unit squares (by.., x, y, w, h) in a box of w x h whose sides are
    glued. In doubled coordinates a square is the point (2x+1, 2y+1) and its sides and corners are the points around it;
    glued points become one by taking the left or the top one, so distinct points count cells of each dimension."""
    cells = cells.select(*by, "x", "y", "w", "h").distinct()
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1, 2) for b in (0, 1, 2)])).alias("d")
    points = cells.select(*by, "x", "y", "w", "h", around).select(*by, (2 * F.col("x") + F.col("d.a")).alias("x"), (2 * F.col("y") + F.col("d.b")).alias("y"), "w", "h").distinct()

    def on(surface: str) -> DataFrame:
        across, along = K.SURFACES[surface]
        x, y, w, h = F.col("x"), F.col("y"), 2 * F.col("w"), 2 * F.col("h")
        right = (x == w) if across else F.lit(False)
        glued = points.select(*by, F.when(right, 0).otherwise(x).alias("x"), (F.when(right, h - y).otherwise(y) if across == -1 else y).alias("y"), "h")
        glued = glued.select(*by, "x", F.when((y == h) if along else F.lit(False), 0).otherwise(y).alias("y"))
        odd = F.col("x") % 2 + F.col("y") % 2
        counted = glued.select(*by, "x", "y").distinct().groupBy(*by).agg(*[F.count_if(odd == k).alias(name) for k, name in ((2, "faces"), (1, "edges"), (0, "vertices"))])
        return counted.select(*by, F.lit(surface).alias("surface"), "faces", "edges", "vertices", (F.col("vertices") - F.col("edges") + F.col("faces")).alias("chi"))

    return reduce(DataFrame.union, [on(s) for s in ("plane", "cylinder", "torus", "mobius", "klein")])


def attacking_pairs(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by.., cells, attacking, peaceful): pairs of distinct cells (by.., x, y) that queens on them attack, and the other
    pairs. Two cells share one line at most, so pairs are counted by line, without a join."""
    cells = cells.select(*by, "x", "y").distinct()
    kinds = {"row": F.col("x"), "column": F.col("y"), "diagonal": F.col("x") - F.col("y"), "antidiagonal": F.col("x") + F.col("y")}
    lines = cells.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("long").alias("at")) for k, v in kinds.items()])).alias("line"))
    pairs = lambda n: (n * (n - 1) / 2).cast("long")
    by_line = lines.groupBy(*by, "line").agg(F.count(F.lit(1)).alias("n"))
    found = by_line.groupBy(*by).agg(F.sum(F.when(F.col("line.kind") == "row", F.col("n")).otherwise(0)).alias("cells"), F.sum(pairs(F.col("n"))).alias("attacking"))
    return found.select(*by, "cells", "attacking", (pairs(F.col("cells")) - F.col("attacking")).alias("peaceful"))
