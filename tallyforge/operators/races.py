"""Races of words: which of two comes up first in a row of random letters. The walk over the words' beginnings is a linear
system, one for each pair of words; an independent method to the closed form of kernels.odds()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.residues import solve


def _any_end(t: Column, states: Column) -> Column:
    """The place in ``states`` of the longest end of ``t`` that is one of them; the empty word always is."""
    ends = F.transform(F.sequence(F.lit(1), F.length(t) + 1), lambda i: F.substring(t, i, F.length(t)))
    return (F.array_position(states, F.get(F.filter(ends, lambda x: F.array_contains(states, x)), 0)) - 1).cast("int")


def race_systems(pairs: DataFrame, weights: dict[str, int]) -> DataFrame:
    """(a, b, row, coefs) for ``pairs`` (a, b) of different words, neither within the other, over the letters in ``weights``,
    which come up with chances in proportion: the equations of the chance that a comes first, from each beginning of a or b
    that isn't a whole word. The first unknown is the empty beginning."""
    beginnings = lambda w: F.transform(F.sequence(F.lit(0), F.length(w) - 1), lambda i: F.substring(w, F.lit(1), i))
    states = pairs.select("a", "b").distinct().withColumn("states", F.array_distinct(F.concat(beginnings(F.col("a")), beginnings(F.col("b")))))
    rows = states.select("a", "b", "states", F.posexplode("states").alias("row", "state"))
    moves = []
    for letter, weight in weights.items():
        t = F.concat("state", F.lit(letter))
        to = F.when(F.endswith(t, F.col("a")), F.size("states")).when(~F.endswith(t, F.col("b")), _any_end(t, F.col("states")))
        moves.append(F.struct(to.alias("to"), F.lit(weight).cast("long").alias("weight")))
    moved = rows.withColumn("moves", F.array(*moves))
    whole = sum(weights.values())

    def coefficient(j: Column) -> Column:
        gone = F.aggregate(F.filter("moves", lambda m: m["to"] == j), F.lit(0).cast("long"), lambda x, m: x + m["weight"])
        return F.when(j == F.size("states"), gone).otherwise(F.when(j == F.col("row"), F.lit(whole).cast("long")).otherwise(F.lit(0).cast("long")) - gone)

    return moved.select("a", "b", F.col("row").cast("long").alias("row"), F.transform(F.sequence(F.lit(0), F.size("states")), coefficient).alias("coefs"))


def race(pairs: DataFrame, weights: dict[str, int]) -> DataFrame:
    """(a, b, num, den): the exact chance that a comes up before b, in lowest terms, as decimal strings."""
    return solve(race_systems(pairs, weights), ["a", "b"]).where("unknown = 0").select("a", "b", "num", "den")
