"""Matrices over GF(2) of any width: reduced row echelon form, rank, and bases of the kernel as rows.

A matrix is a table (row, col) of its ones. Inside, 63 columns are one word of bits, so a row of any width is as many rows
(row, word, bits) as it has words with a one in them. Elimination goes word by word from the left. The words of one panel are
reduced apart in each partition and merged as a tree; the at most 63 rows that remain are all that the driver sees. They go
back as a small table, and each other row takes the sum of those that clear its panel: a join for a whole panel, not for each
pivot. There are as many rounds as words in which a pivot lies, at most rank and at most width / 63.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.loops import written

WORD = 63  # bits of a word; the sign stays free
_SPREAD = 16  # parts into which a pivot row's words are dealt when they are sent to the rows that take them


def _independent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows (row, bits), those that are no sum of earlier ones: 63 at most."""
    basis: dict[int, int] = {}
    kept: list[tuple[int, int]] = []
    for pdf in batches:
        for row, bits in zip(pdf["row"].tolist(), pdf["bits"].tolist(), strict=True):
            left = bits
            while left and (low := left & -left) in basis:
                left ^= basis[low]
            if left:
                basis[left & -left] = left
                kept.append((row, bits))
                if len(kept) == WORD:
                    break
        if len(kept) == WORD:
            break
    yield pd.DataFrame(kept, columns=["row", "bits"]).astype("int64")


def _panel(chosen: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(lead, bits, made_of) of the reduced rows that independent rows (row, bits) span: made_of has bit i for chosen[i]."""
    reduced: list[tuple[int, int]] = []
    for i, (_, bits) in enumerate(chosen):
        made = 1 << i
        for b, m in reduced:
            if bits & (b & -b):
                bits, made = bits ^ b, made ^ m
        low = bits & -bits
        reduced = [(b ^ bits, m ^ made) if b & low else (b, m) for b, m in reduced] + [(bits, made)]
    return sorted((b & -b, b, m) for b, m in reduced)


def _merged(rows: DataFrame) -> list[tuple[int, int]]:
    """Independent rows of all of (row, bits), in order of row: partitions apart, then in 64 tasks, then in one, of 64 times 63
    rows at most."""
    parts = rows.mapInPandas(_independent, "row long, bits long")
    for tasks in (64, 1):
        parts = parts.repartition(tasks).mapInPandas(_independent, "row long, bits long")
    return sorted((r["row"], r["bits"]) for r in parts.collect())


def _places(ones: DataFrame) -> DataFrame:
    """(row, col) of the ones without a null; a negative column raises an error."""
    col = F.when(F.col("col") >= 0, F.col("col").cast("long")).otherwise(F.raise_error(F.lit("columns are numbered from 0")).cast("long"))
    return ones.where("row IS NOT NULL AND col IS NOT NULL").select(F.col("row").cast("long").alias("row"), col.alias("col"))


def packed(ones: DataFrame) -> DataFrame:
    """(row, word, bits) of the ones (row, col) of a matrix; columns are whole numbers from 0. A one that comes an even number
    of times cancels out, and nulls are left out. A negative column raises an error."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("col") % WORD).cast("int"))
    return _places(ones).select("row", F.floor(F.col("col") / WORD).alias("word"), bit.alias("bits")).groupBy("row", "word").agg(F.bit_xor("bits").alias("bits")).where("bits <> 0")


def unpacked(words: DataFrame) -> DataFrame:
    """(.., col) for each bit of rows (.., word, bits)."""
    others = [c for c in words.columns if c not in ("word", "bits")]
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("bits", i) == 1)
    return words.select(*others, F.explode(F.transform(places, lambda i: i + F.col("word") * WORD)).alias("col"))


def row_echelon(ones: DataFrame) -> DataFrame:
    """(pivot, word, bits): the reduced row echelon form of a matrix (row, col), rows named by the column of their first one. It
    depends on the columns' order and not on the rows'. An empty matrix, or one of zeros, has no rows."""
    spark = ones.sparkSession
    now = written(packed(ones).withColumn("pivot", F.lit(None).cast("long")))
    while True:
        word = now.where("pivot IS NULL").agg(F.min("word").alias("w")).first()["w"]
        if word is None:
            return now.drop("row")
        panel = now.where(F.col("word") == word)
        chosen = _merged(panel.where("pivot IS NULL").select("row", "bits"))
        reduced = _panel(chosen)
        # the i-th chosen row turns into the i-th reduced one; what a row takes is a set of chosen rows
        own = {chosen[i][0]: made ^ (1 << i) for i, (_, _, made) in enumerate(reduced)}
        leads = [F.when(F.getbit("bits", F.lit(lead.bit_length() - 1)) == 1, F.lit(made)).otherwise(F.lit(0)).cast("long") for lead, _, made in reduced]
        cleared = leads[0]
        for taken in leads[1:]:
            cleared = cleared.bitwiseXOR(taken)
        names = spark.createDataFrame([(row, i, own[row], word * WORD + reduced[i][0].bit_length() - 1) for i, (row, _) in enumerate(chosen)], "row long, slot int, own long, lead long")
        takes = panel.join(F.broadcast(names.select("row", "own")), "row", "left").select("row", F.coalesce("own", cleared).alias("mask"))  # 63 rows at most
        slots = F.filter(F.sequence(F.lit(0), F.lit(len(chosen) - 1)), lambda i: F.getbit("mask", i) == 1)
        dealt = F.array(*[F.lit(i) for i in range(_SPREAD)])
        takes = takes.where("mask <> 0").select("row", F.explode(slots).alias("slot")).withColumn("part", F.explode(dealt))
        source = now.join(F.broadcast(names.select("row", "slot")), "row").select("slot", (F.col("word") % _SPREAD).cast("int").alias("part"), "word", "bits")
        changes = takes.join(source, ["slot", "part"]).select("row", "word", "bits")
        summed = now.select("row", "word", "bits").union(changes).groupBy("row", "word").agg(F.bit_xor("bits").alias("bits")).where("bits <> 0")
        known = now.where("pivot IS NOT NULL").select("row", "pivot").distinct().union(names.select("row", F.col("lead").alias("pivot")))
        now = written(summed.join(known, "row", "left").select("row", "word", "bits", "pivot"))


def kernel_basis(ones: DataFrame, columns: DataFrame) -> DataFrame:
    """(vector, col): a basis of the sets of ``columns`` (col) that add up to zero in every row of the matrix (row, col). Each
    vector is named by its one column that is no pivot, so there are as many as columns less the rank. All columns of the matrix
    must be among ``columns``; a column of zeros is a vector of its own."""
    reduced = written(row_echelon(ones))
    free = columns.where("col IS NOT NULL").select(F.col("col").cast("long").alias("col")).distinct().join(reduced.select(F.col("pivot").alias("col")).distinct(), "col", "left_anti")
    members = unpacked(reduced).where("col <> pivot").select(F.col("col").alias("vector"), F.col("pivot").alias("col"))
    return members.union(free.select(F.col("col").alias("vector"), "col"))


def cancelling(ones: DataFrame, vectors: DataFrame) -> DataFrame:
    """(vector, size, cancels): whether the columns of each vector (vector, col) add up to zero in every row of the matrix. 64 rows,
    named by any whole numbers, are one word of a column, and a vector's sum is taken word by word. Spark takes vectors unpacked
    from bits for far fewer than they are, and would broadcast them; so the join is one of sorted rows."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("row").bitwiseAND(63).cast("int"))
    columns = _places(ones).select("col", F.shiftright("row", 6).alias("word"), bit.alias("bits")).groupBy("col", "word").agg(F.bit_xor("bits").alias("bits")).where("bits <> 0")
    sizes = vectors.groupBy("vector").agg(F.count(F.lit(1)).alias("size"))
    sums = vectors.join(columns.hint("merge"), "col").groupBy("vector", "word").agg(F.bit_xor("bits").alias("bits"))
    odd = sums.where("bits <> 0").select("vector").distinct()
    return sizes.join(odd.withColumn("odd", F.lit(True)), "vector", "left").select("vector", "size", F.col("odd").isNull().alias("cancels"))


def asymmetric(ones: DataFrame) -> DataFrame:
    """(row, col): ones of a square matrix without a one in the mirrored place; none if the matrix is symmetric."""
    ones = unpacked(packed(ones))
    return ones.join(ones.select(F.col("col").alias("row"), F.col("row").alias("col")), ["row", "col"], "left_anti")
