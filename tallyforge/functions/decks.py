"""Decks (arrays of 1..n) of any length, in Python: an order that holds a large share of all rows is one deck. A deck is
one row, of at most 2**31 items; its flips are counted until 1 is on top, without a bound."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import functions as F
from pyspark.sql import types as T


def flips(p: list[int]) -> int:
    """Flips until the first item is 1; Conway's game ends for every deck."""
    p, t = list(p), 0
    while (head := p[0]) != 1:
        p[:head] = p[head - 1 :: -1]
        t += 1
    return t


def rank_digits(p: list[int]) -> list[int]:
    """The lexicographic rank in the factorial base, greatest weight first: how many later items are smaller."""
    seen, out = [], []
    for v in reversed(p):
        at = bisect_left(seen, v)
        seen.insert(at, v)
        out.append(at)
    return out[::-1]


flips_of = F.udf(flips, T.LongType(), useArrow=True)
rank_digits_of = F.udf(rank_digits, T.ArrayType(T.IntegerType()), useArrow=True)
