"""Hamiltonian cycles edge by edge: a state is the mate of every vertex, equal states are merged with their counts.

A vertex's mate is itself while it is untouched, the other end of its path while it is an end, and -1 once it is inside
one. An edge is left out or taken; after a vertex's last edge it must be inside. Unlike counting by visited sets this
needs no bit per vertex, and states only differ in the vertices that are both begun and unfinished, so an order of
edges with a small cut keeps them few.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.loops import cut, merged

#: Edges between cuts of the lineage.
STEPS = 4


def _taken(mates: Column, a: int, b: int) -> Column:
    """The mates once the edge is taken, with the two path ends joined; null if it can't be."""
    x, y = F.get(mates, F.lit(a)), F.get(mates, F.lit(b))

    def new(m: Column, v: Column) -> Column:
        return F.when(v == x, y).when(v == y, x).when(v.isin(a, b), -1).otherwise(m)

    return F.when((x != -1) & (y != -1) & (x != b), F.transform(mates, new))


def hamiltonian_cycles(spark: SparkSession, edges: list[tuple[int, int]], vertices: int) -> int:
    """Undirected Hamiltonian cycles of a simple graph on 0 .. vertices-1 (at least 3), its edges in the given order."""
    last = {v: max((i for i, e in enumerate(edges) if v in e), default=-1) for v in range(vertices)}
    if min(last.values()) < 0:
        return 0
    now = spark.range(1).select(F.sequence(F.lit(0), F.lit(vertices - 1)).alias("mates"), F.lit(1).cast("decimal(38,0)").alias("cnt"))
    total = 0
    for i, (a, b) in enumerate(edges):
        others_inside = F.forall(F.transform("mates", lambda m, v: (m == -1) | v.isin(a, b)), lambda ok: ok)
        if i >= vertices - 1:  # a cycle has as many edges as vertices
            closing = now.where((F.get("mates", F.lit(a)) == b) & others_inside)
            total += int(closing.agg(F.sum("cnt").alias("n")).first()["n"] or 0)
        now = now.select(F.explode(F.filter(F.array("mates", _taken(F.col("mates"), a, b)), lambda m: m.isNotNull())).alias("mates"), "cnt")
        for v in (a, b):
            if last[v] == i:
                now = now.where(F.get("mates", F.lit(v)) == -1)
        now = merged(now, ["mates"])
        if i % STEPS == STEPS - 1 or i >= vertices - 2:
            now = cut(now)
    return total
