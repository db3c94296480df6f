"""Streams: a job log that grows, first line of an id wins; and running counts of states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def job_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """(id, weight, body) of ``J id weight body;`` lines as files arrive; later lines of an id are dropped. The state
    holds one row for each id, which is what first-wins over an endless log needs."""
    form = r"^J ([0-9]+) ([0-9]+) (.+;)$"
    lines = spark.readStream.text(path).where(F.col("value").rlike(form))
    rows = lines.select(F.regexp_extract("value", form, 1).cast("long").alias("id"), F.regexp_extract("value", form, 2).cast("long").alias("weight"), F.regexp_extract("value", form, 3).alias("body"))
    return rows.dropDuplicates(["id"])


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str, lateness: str) -> DataFrame:
    """Counts by window and group; a window is given once the watermark has passed it."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
