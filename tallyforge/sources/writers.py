"""Writers: sequence files, guarded overwrites, per-level tables, adjacency lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sequence_files(terms: DataFrame, path: str) -> None:
    """One folder of ``index value`` lines for each seq of (seq, idx, val), in order."""
    lines = terms.select("seq", "idx", F.concat_ws(" ", F.col("idx").cast("string"), F.col("val").cast("string")).alias("value"))
    lines.repartition("seq").sortWithinPartitions("seq", "idx").select("seq", "value").write.partitionBy("seq").text(path)


def guarded(new: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write, unless the table that is there has more rows. The rows go to a folder beside it, which then takes its
    place, so ``new`` may read the table and a job that fails leaves it as it was."""
    spark = new.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    folder, aside = make(path), make(f"{path}.next")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    new.write.mode("overwrite").format(fmt).save(f"{path}.next")
    if files.exists(folder):
        if (old := spark.read.format(fmt).load(path).count()) > (now := spark.read.format(fmt).load(f"{path}.next").count()):
            files.delete(aside, True)
            raise ValueError(f"{path} has {old} rows; {now} would replace them")
        files.delete(folder, True)
    files.rename(aside, folder)


def json_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def job_result(df: DataFrame, path: str, job: int) -> None:
    """A job's rows in a folder of its own: a job that runs again replaces its rows, and nobody else's."""
    df.write.mode("overwrite").parquet(f"{path}/job={job}")


def level(df: DataFrame, path: str, k: int) -> dict:
    """A level's rows and, once they are there, its manifest row, which a rerun replaces; observed on the way, so rows are
    read once."""
    from pyspark.sql import Observation

    seen = Observation("level")
    df.observe(seen, F.count(F.lit(1)).alias("states")).write.mode("overwrite").parquet(f"{path}/level={k}")
    row = {"level": k, "states": seen.get["states"]}
    df.sparkSession.createDataFrame([row], "level long, states long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/of={k}")
    return row


def stats_csv(df: DataFrame, path: str, step: str, measures: dict) -> None:
    """A line with the measures (name to aggregate) of this step's rows in a CSV folder; a step that runs again replaces
    its line."""
    row = df.agg(*[m.alias(name) for name, m in measures.items()]).select(F.lit(step).alias("step"), *measures)
    row.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/of={step}")


def table_tsv(df: DataFrame, rows: list[str], column: str, value: str, path: str) -> None:
    """A line for each group of rows with its values listed by ``column``."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(column, value))), lambda x: x[value].cast("string"))
    df.groupBy(*rows).agg(F.array_join(listed, ",").alias("terms")).orderBy(*rows).write.mode("overwrite").csv(path, sep="\t")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, line): neighbours from 1, ascending."""
    return edges.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_set("dst")), lambda x: (x + 1).cast("string")), " ").alias("line")).orderBy("src")
