"""Each query over the given tables against its SQL."""

import decimal

import duckdb
import pytest

from tallyforge.plans import queries as plans
from tallyforge.plans import algebra, reports, searches, structures  # noqa: F401  they register their queries with those of plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return int(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    rows = found.fetchall()
    assert got == sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in rows), key=str)


def test_entry_module_has_these_queries():
    import __spark_entry__

    assert plans.QUERIES.keys() <= __spark_entry__.queries().keys()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
