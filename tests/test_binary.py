"""Wide matrices over GF(2) against elimination in plain Python."""

import random

import pytest

from tallyforge.operators import binary


def reduced(rows):
    """Reduced rows, by their least column, of rows as sets of columns."""
    done = {}
    for row in rows:
        row = set(row)
        for p in sorted(done):
            if p in row:
                row ^= done[p]
        if row:
            p = min(row)
            done = {q: r ^ row if p in r else r for q, r in done.items()} | {p: row}
    return done


def table(spark, rows):
    return spark.createDataFrame([(i, c) for i, row in enumerate(rows) for c in row], "row long, col long")


@pytest.mark.parametrize(("height", "width", "share"), [(6, 5, 0.5), (40, 200, 0.4), (150, 130, 0.5), (90, 64, 0.1)])
def test_echelon_form_and_kernel(spark, height, width, share):
    rng = random.Random(height)
    rows = [{c for c in range(width) if rng.random() < share} for _ in range(height)]
    rows += rows[:3]  # repeated rows add nothing
    want = reduced(rows)
    ones = table(spark, rows)
    got = {}
    for r in binary.unpacked(binary.row_echelon(ones)).collect():
        got.setdefault(r["pivot"], set()).add(r["col"])
    assert got == want
    columns = spark.range(width).withColumnRenamed("id", "col")
    basis = binary.kernel_basis(ones, columns)
    vectors = {}
    for r in basis.collect():
        vectors.setdefault(r["vector"], set()).add(r["col"])
    assert vectors == {f: {f} | {p for p, r in want.items() if f in r} for f in range(width) if f not in want}
    assert all(r["cancels"] and r["size"] == len(vectors[r["vector"]]) for r in binary.cancelling(ones, basis).collect())


def test_odd_matrices(spark):
    none = spark.createDataFrame([], "row long, col long")
    assert binary.row_echelon(none).count() == 0
    columns = spark.range(3).withColumnRenamed("id", "col")
    assert sorted(map(tuple, binary.kernel_basis(none, columns).collect())) == [(0, 0), (1, 1), (2, 2)]
    twice = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (None, 1), (2, None)], "row long, col long")
    assert [tuple(r) for r in binary.unpacked(binary.row_echelon(twice)).collect()] == [(2, 2)]
    assert [r["cancels"] for r in binary.cancelling(twice, spark.createDataFrame([(0, 2)], "vector long, col long")).collect()] == [False]
    with pytest.raises(Exception, match="numbered from 0"):
        binary.row_echelon(spark.createDataFrame([(1, -1)], "row long, col long"))


def test_cancelling_with_rows_of_any_names(spark):
    rng = random.Random(11)
    names = [0, 31, 62, 63, 64, 127, 128, -1, -63, -64, -65, 2**53, 2**53 + 1, 2**63 - 1, -(2**63)]
    ones = [(name, c) for name in names for c in range(40) if rng.random() < 0.1]
    ones += ones[:5] * 2 + [(None, 1), (3, None)]  # thrice is once
    columns = {c: {row for row, col in ones if col == c and row is not None} for c in range(40)}
    vectors = [(v, c) for v in range(200) for c in rng.sample(range(40), rng.randint(1, 3))]
    vectors += [(200, 5), (200, 5), (201, 6), (201, 6), (201, 6), (202, 99)]
    want = {}
    for v, c in vectors:
        size, left = want.get(v, (0, set()))
        want[v] = (size + 1, left ^ columns.get(c, set()))
    found = binary.cancelling(spark.createDataFrame(ones, "row long, col long"), spark.createDataFrame(vectors, "vector long, col long"))
    assert {r["vector"]: (r["size"], r["cancels"]) for r in found.collect()} == {v: (size, not left) for v, (size, left) in want.items()}
    assert 3 <= sum(not left for _, left in want.values()) <= 150


def test_asymmetric_places(spark):
    ones = spark.createDataFrame([(0, 1), (1, 0), (2, 2), (2, 0), (70, 3), (3, 70)], "row long, col long")
    assert [tuple(r) for r in binary.asymmetric(ones).collect()] == [(2, 0)]
