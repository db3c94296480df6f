"""Readers of sequence, graph, log and catalogue files; all by Spark's own sources, so any file system works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sequence_file(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file, idx, val) of lines ``index value``; comments and blank lines are left out. Values have up to 38 digits.
    Strict: a malformed line raises an error, else it is left out."""
    return _terms(spark.read.text(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)), strict)


def sequence_folder(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file, idx, val) of a folder of sequences as sequence_files() writes them; file is the sequence's name."""
    return _terms(spark.read.text(path).withColumn("file", F.col("seq").cast("string")), strict)


def _terms(named: DataFrame, strict: bool) -> DataFrame:
    lines = named.select("file", F.trim("value").alias("line")).where("line <> '' AND NOT line LIKE '#%'")
    good = F.col("line").rlike(r"^-?[0-9]+\s+-?[0-9]{1,38}$")
    if strict:
        lines = lines.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a term: "), "line")).cast("boolean")))
    parts = F.split("line", r"\s+")
    return lines.where(good).select("file", parts[0].cast("long").alias("idx"), parts[1].cast("decimal(38,0)").alias("val"))


def duplicated_terms(terms: DataFrame) -> DataFrame:
    return terms.groupBy("file", "idx").count().where("count > 1")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(row, value) of one file, by its lines' order: a file is read as one split, line numbers come from its text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("row", "value"))


def adjacency_file(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst), from 0: line i lists the neighbours of vertex i, from 1."""
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    return _numbered(spark, path).select(F.col("row").cast("long").alias("src"), F.explode(parts).alias("dst")).select("src", (F.col("dst").cast("long") - 1).alias("dst"))


def graph_file(spark: SparkSession, path: str) -> tuple[int, int, DataFrame]:
    """Vertices, start and (src, dst) of a header ``n s`` and a line ``degree neighbours..`` for each vertex; raises if
    an edge is out of range, a loop, repeated, or one-way."""
    from tallyforge.operators.graphs import validated

    lines = _numbered(spark, path).select("row", F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != ""), lambda x: x.cast("long")).alias("v"))
    n, start = lines.where("row = 0").first()["v"][:2]
    edges = lines.where("row > 0").select((F.col("row") - 1).cast("long").alias("src"), F.explode(F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0)))).alias("dst"))
    if faults := validated(edges, n).limit(5).collect():
        raise ValueError(f"not a simple undirected graph: {faults}")
    return n, start, edges


def edge_list_file(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a header ``v m`` and m lines ``a b``."""
    parts = F.split(F.trim("value"), r"\s+")
    return _numbered(spark, path).where("row > 0 AND trim(value) <> ''").select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))


def job_log(spark: SparkSession, path: str, header: str) -> DataFrame:
    """(id, weight, body) of ``J id weight body`` lines; the header must match; broken lines are left out, and the first
    line of an id counts."""
    from tallyforge.operators.verify import first_wins

    lines = _numbered(spark, path)
    if lines.where(F.col("value") == header).isEmpty():
        raise ValueError("the log is of another job")
    form = r"^J ([0-9]+) ([0-9]+) (.+;)$"
    rows = lines.where(F.col("value").rlike(form)).select("row", *[F.regexp_extract("value", form, i).alias(c) for i, c in ((1, "id"), (2, "weight"), (3, "body"))])
    return first_wins(rows.select(F.col("id").cast("long").alias("id"), "row", F.col("weight").cast("long").alias("weight"), "body"), "id", ["row"]).drop("row")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(idx, val) of a catalogue record: a JSON array whose first entry has its terms, comma-joined, in ``data``."""
    return spark.read.json(path, multiLine=True).select(F.posexplode(F.split("data", ",")).alias("idx", "v")).select(F.col("idx").cast("long"), F.col("v").cast("decimal(38,0)").alias("val"))


def run_output(spark: SparkSession, path: str) -> DataFrame:
    """(length, path, cyclic, noncappable) of result rows; comments are left out."""
    p = F.split(F.trim("value"), r"\s+")
    names = ("length", "path", "cyclic", "noncappable")
    return spark.read.text(path).where("trim(value) <> '' AND NOT value LIKE '#%'").select(*[p[i].cast("decimal(38,0)" if i else "long").alias(c) for i, c in enumerate(names)])


def level_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, comment="#")


def drift_table(values: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    """Recorded values with a status column; raises if a key has two different values."""
    if not values.groupBy(*keys).agg(F.countDistinct(value).alias("n")).where("n > 1").isEmpty():
        raise ValueError("a recorded value is given twice, differently")
    return values.select(*keys, value).distinct().withColumn("status", F.lit("drift"))
