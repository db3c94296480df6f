"""Queries over all of their input against plain Python: nothing is thinned out."""

import collections
import itertools
import random

import duckdb
import pytest

from tallyforge.plans import queries as plans
from tallyforge.plans import searches

SF = "/root/testdata/sf0.001"


def rows(sql):
    return duckdb.sql(sql.format(**{t: f"'{SF}/{t}.parquet'" for t in ("lineitem", "orders", "customer", "supplier", "part")})).fetchall()


def trade():
    sql = "SELECT DISTINCT c_nationkey, s_nationkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey"
    return set(rows(sql))


def got(spark, name):
    return sorted(map(tuple, plans.QUERIES[name](spark, SF).collect()))


def test_trade_queries_have_all_pairs(spark):
    edges = trade()
    degrees = collections.Counter(collections.Counter(b for _, b in edges).values())
    assert got(spark, "in_degree_histogram_of_all_pairs") == sorted(degrees.items())
    assert got(spark, "trade_graph_faults_of_all_pairs") == [("one_way", sum((b, a) not in edges for a, b in edges))]
    paths = [p for p in itertools.product(range(25), repeat=3) if len(set(p)) == 3 and {p[:2], p[1:]} <= edges]
    assert (2, len(paths), sum((p[2], p[0]) in edges for p in paths)) in got(spark, "simple_path_census_of_all_pairs")


def test_price_ranks_have_every_part(spark):
    found = got(spark, "price_ranks")
    by_brand = collections.defaultdict(list)
    for brand, price, part in rows("SELECT p_brand, p_retailprice, p_partkey FROM {part}"):
        by_brand[brand].append((price, part))
    assert found == sorted((b, part, k) for b, own in by_brand.items() for k, (_, part) in enumerate(sorted(own), 1))


def flips_by_hand(p):
    t = 0
    while p[0] != 1:
        p, t = p[: p[0]][::-1] + p[p[0] :], t + 1
    return t


def test_decks_of_any_size(spark, tmp_path):
    """Orders of 1 to 40 items and one of 3000, which is most of the table."""
    rng = random.Random(5)
    lines, decks = [], {}
    for key, n in enumerate([*range(1, 41), 3000]):
        p = decks[key] = rng.sample(range(1, n + 1), n)
        lines += [(key, pos, 0, 0, float(v), "1996-01-01", 1.0) for pos, v in enumerate(p, 1)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate string, l_quantity double"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: plans.QUERIES[name](spark, str(tmp_path)).collect()
    flips = {len(p): flips_by_hand(p) for p in decks.values()}
    assert {r["size"]: (r["decks"], r["flips"], r["most"], r["at_most"]) for r in run("topswops_of_orders")} == {n: (1, t, t, 1) for n, t in flips.items()}
    digits = {len(p): [sum(w < v for w in p[i:]) for i, v in enumerate(p)] for p in decks.values()}
    assert {r["size"]: r["digits"] for r in run("permutation_rank_histogram")} == digits
    gardens = {len(p): int(all(v != i for i, v in enumerate(p, 1) if i > 1)) for p in decks.values()}
    assert {r["size"]: r["gardens"] for r in run("decks_without_predecessor")} == gardens


def union_find_sizes(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(("s", a))] = root(("p", b))
    return sorted(collections.Counter(collections.Counter(root(x) for x in list(parent)).values()).items())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_all_line_items(spark, tmp_path, seed):
    """Sparse links, repeated rows, one hot supplier, and no returned or undiscounted row."""
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(90)) for _ in range(70)] + [(7, 100 + rng.randrange(200)) for _ in range(400)]
    lines = [(a, b, "N", 0.05, 30.0) for a, b in links + links[:20]]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_returnflag string, l_discount double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = plans.QUERIES["supplier_part_components"](spark, str(tmp_path))
    assert sorted((r["size"], r["components"]) for r in found.collect()) == union_find_sizes(links)


def test_kernel_basis_of_many_customers(spark, tmp_path):
    """Half a million members of vectors, with 8 MB at most to broadcast."""
    n, rng = 40_000, random.Random(3)
    put = lambda name, found, schema: spark.createDataFrame(found, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("customer", [(c,) for c in range(n)], "c_custkey long")
    put("orders", [(c + 7, c) for c in range(n - 100)], "o_orderkey long, o_custkey long")
    put("part", [(p, f"Brand#{p % 25 + 1}") for p in range(50)], "p_partkey long, p_brand string")
    put("lineitem", [(c + 7, rng.randrange(50)) for c in range(n) for _ in range(25)], "l_orderkey long, l_partkey long")
    limits = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.maxBroadcastTableSize": "8m"}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        found = sorted(map(tuple, searches.parity_kernel_basis(spark, str(tmp_path)).select("custkey", "members", "size", "cancels").collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    con = duckdb.connect()
    for t in ("customer", "orders", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert found == sorted(con.execute(f"SELECT custkey, members, size, cancels FROM ({plans.ORACLE_SQL['parity_kernel_basis']})").fetchall())
    assert len(found) == n - 25 and sum(size for _, _, size, _ in found) > 400_000
