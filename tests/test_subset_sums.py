"""Sums over subsets, and kings by them, against plain Python."""

import random

import pytest

from tallyforge.operators import transfer


def kings(n, cyclic):
    """Placements line by line."""
    lines = [m for m in range(1 << n) if not m & m >> 1 and not (cyclic and n > 1 and m & 1 and m >> (n - 1))]

    def touched(m):
        around = ((m & 1) << (n - 1)) | (m >> (n - 1)) if cyclic and n > 1 else 0
        return m | m << 1 | m >> 1 | around

    count = dict.fromkeys(lines, 1)
    for _ in range(n - 1):
        count = {b: sum(c for a, c in count.items() if not touched(a) & b) for b in lines}
    return sum(count.values())


@pytest.mark.parametrize("bits", [0, 3, 4, 10])
def test_sums_over_subsets(spark, bits):
    rng = random.Random(bits)
    counts = [(rng.randrange(1 << bits), rng.randrange(10**12)) for _ in range(12)]
    want = {m: sum(c for t, c in counts if t & ~m == 0) for m in range(1 << bits) if any(t & ~m == 0 for t, _ in counts)}
    got = transfer.subset_sums(spark.createDataFrame(counts, "mask long, cnt long"), bits)
    assert {r["mask"]: int(r["cnt"]) for r in got.collect()} == want


def test_no_counts_and_too_many_bits(spark):
    none = spark.createDataFrame([], "mask long, cnt long")
    assert transfer.subset_sums(none, 5).count() == 0
    with pytest.raises(ValueError, match="62"):
        transfer.subset_sums(none, 63)


@pytest.mark.parametrize(("n", "cyclic", "modulus"), [(1, True, None), (2, True, None), (4, False, None), (6, True, None), (7, False, 1009)])
def test_kings(spark, n, cyclic, modulus):
    want = kings(n, cyclic)
    assert transfer.king_placements(spark, n, cyclic, modulus) == (want % modulus if modulus else want)
