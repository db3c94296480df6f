"""What iterative operators share: cutting lineage in the shared folder, and merging states."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> None:
    """Set a checkpoint folder if the session's cluster names none (in tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(found)


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from files in the shared folder; what made them is run once, and forgotten."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As cut(), by a Parquet table in the same folder, whose size Spark then knows. A checkpoint keeps the estimate of its plan,
    and that of a join is its sides' product: in loops that join a table with itself it has twice as many digits each round."""
    spark = df.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(states: DataFrame, keys: list[str], count: str = "cnt") -> DataFrame:
    """States that are equal become one, with the sum of their counts; partial sums before the shuffle. The type has
    38 digits, and a greater sum raises an error."""
    return states.groupBy(*keys).agg(F.sum(F.col(count).cast("decimal(38,0)")).cast("decimal(38,0)").alias(count))
