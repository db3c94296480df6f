"""Registered queries against their SQL, on the given tables and on odd ones."""

import decimal

import duckdb
import pytest

from tallyforge.llm import registry

SF = "/root/testdata/sf0.001"
LINES = [
    "| Home | About | Contact |", "Home > Shop > Sale", "All rights reserved (c) 2020", "READ THIS NOW IMMEDIATELY FRIENDS", "##### $$$$ ****", "Menu", "Done.", "",
    " \t ", "An ordinary sentence of several words, which ends well.", "one two three four five one two three four five one two three four five", "naïve café – “quoted”", "日本語の文。", "ordinary line without an end but with many words in it",
]
TEXTS = [
    None, "", "   \n\t ", "Menu", "word " * 9, "word " * 10, "\n".join(LINES), "\n".join(LINES + LINES), "\n".join(LINES[9:] * 2), "a b c d e f g h i j k\r\nMenu\r\nMenu\x0bthing",
    "\n".join(f"Sentence number {i} is different from the others, says {i * i}." for i in range(4000)), "x" * 200_000, "one two three four five six " * 3000,
]


def rows_of(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder != SF else ''}')")
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    plain = lambda v: int(v) if isinstance(v, decimal.Decimal) else v
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=str)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str), wanted


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got, wanted = rows_of(spark, SF, name)
    assert got == wanted and got


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([*enumerate(TEXTS), (6, TEXTS[6]), (None, TEXTS[7])], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("a", "one two three four five one two three four five one two three"), ("b", "Menu"), ("c", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "ok")], "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op6_quality_rules", "op7_decontaminate"])
def test_odd_texts(spark, odd, name):
    """Null, empty, very long and repeated texts, a null id, menus, notices and letters beyond ASCII."""
    got, wanted = rows_of(spark, odd, name)
    assert got == wanted and len(got) == len(TEXTS) + 2
