"""Ranks within groups of any size: a group is dealt over shards by range, so that no task holds one whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.loops import written


def ranks(df: DataFrame, by: list[str], order: list[str], name: str = "k") -> DataFrame:
    """``df`` with the rank of each row, from 1, among those of its group by ``order`` (nulls first; ties: any order).

    Rows are dealt by range of group and order, and written with their shard. A rank is the number of the group's rows in the
    shards before, of which there are as many as groups and shards together at most, and the rank within the shard. Null keys
    are a group."""
    dealt = written(df.repartitionByRange(*by, *order).withColumn("__shard", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "__shard").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"__key{i}") for i, c in enumerate(by)]
    starts = counts.select(*keys, F.col("__shard").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = dealt.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__shard").orderBy(*order)))
    met = F.col("__shard") == F.col("__of")
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"__key{i}"))
    return within.join(starts, met).select(*df.columns, (F.col("__before") + F.col("__r")).alias(name))
