"""Readers, writers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import readers, writers
from tallyforge.streaming import logs


def put(path, text):
    path.write_text(text)
    return str(path)


def test_sequence_files(spark, tmp_path):
    path = put(tmp_path / "b1.txt", "# a comment\n1 10\n\n2 -99999999999999999999999999999999999999\n")
    rows = readers.sequence_file(spark, path).orderBy("idx").collect()
    assert [(r["file"], r["idx"], int(r["val"])) for r in rows] == [("b1.txt", 1, 10), ("b1.txt", 2, -(10**38 - 1))]
    bad = put(tmp_path / "b2.txt", "1 10\nx y\n1 10\n")
    with pytest.raises(Exception, match="not a term"):
        readers.sequence_file(spark, bad).collect()
    assert readers.duplicated_terms(readers.sequence_file(spark, bad, strict=False)).count() == 1


def test_graph_files(spark, tmp_path):
    path = put(tmp_path / "a.dat", "2 3\n1 3\n1 2\n")
    edges = readers.adjacency_file(spark, path)
    assert {tuple(r) for r in edges.collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert [r["line"] for r in writers.adjacency(edges).collect()] == ["2 3", "1 3", "1 2"]
    n, start, good = readers.graph_file(spark, put(tmp_path / "g", "3 1\n2 1 2\n2 0 2\n2 0 1\n"))
    assert (n, start, good.count()) == (3, 1, 6)
    with pytest.raises(ValueError):
        readers.graph_file(spark, put(tmp_path / "g2", "2 0\n1 1\n0\n"))
    assert readers.edge_list_file(spark, put(tmp_path / "e", "3 2\n0 1\n1 2\n")).count() == 2


def test_logs_and_catalogues(spark, tmp_path):
    log = put(tmp_path / "log", "H job\nJ 1 2 5,6;\nJ 1 9 7,7;\nJ 2 1 broken\nJ 3 1 1,1;\n")
    assert {tuple(r) for r in readers.job_log(spark, log, "H job").collect()} == {(1, 2, "5,6;"), (3, 1, "1,1;")}
    with pytest.raises(ValueError):
        readers.job_log(spark, log, "H other")
    record = put(tmp_path / "c.json", json.dumps([{"data": "1,2,4"}]))
    assert [int(r["val"]) for r in readers.catalogue(spark, record).orderBy("idx").collect()] == [1, 2, 4]
    assert readers.run_output(spark, put(tmp_path / "o", "# h\n1 2 3 4\n")).first()["cyclic"] == 3
    assert readers.level_csv(spark, put(tmp_path / "l.csv", "level,states\n1,5\n")).first()["states"] == 5
    values = spark.createDataFrame([(1, 2), (1, 2)], "idx long, val long")
    assert readers.drift_table(values, ["idx"]).count() == 1
    with pytest.raises(ValueError):
        readers.drift_table(values.union(spark.createDataFrame([(1, 3)], values.schema)), ["idx"])


def test_writers(spark, tmp_path):
    terms = spark.createDataFrame([("a", 2, 20), ("a", 1, 10), ("b", 1, 5)], "seq string, idx long, val long")
    writers.sequence_files(terms, str(tmp_path / "s"))
    back = readers.sequence_file(spark, str(tmp_path / "s" / "seq=a"))
    assert [(r["idx"], int(r["val"])) for r in back.orderBy("idx").collect()] == [(1, 10), (2, 20)]
    guarded = str(tmp_path / "g")
    writers.guarded(terms, guarded)
    with pytest.raises(ValueError):
        writers.guarded(terms.limit(1), guarded)
    for job in (1, 2, 1):
        writers.job_result(terms, str(tmp_path / "j"), job)
    assert spark.read.parquet(str(tmp_path / "j")).count() == 6
    assert writers.level(terms, str(tmp_path / "v"), 3) == {"level": 3, "states": 3}
    writers.table_tsv(terms, ["seq"], "idx", "val", str(tmp_path / "t"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "t"), sep="\t").collect()} == {("a", "10,20"), ("b", "5")}
    writers.json_dataset(terms, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "1", "J 1 2 a;\nJ 1 3 b;\nJ 2 1 c;\nx\n")
    query = logs.job_log_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["id"] for r in spark.table("jobs").collect()) == [1, 2]
    events = spark.range(10).select(F.timestamp_seconds("id").alias("ts"), (F.col("id") % 2).alias("k"))
    assert {r["n"] for r in logs.windowed_counts(events, "ts", ["k"], "10 seconds", "1 second").collect()} == {5}
