"""Periodic runs of words in each text, by Baier grouping.

A run is a stretch of words with smallest period q and at least two periods that no neighbouring word extends. Every run
holds a Lyndon word of its period, under some order of the words or its reverse, which is the longest Lyndon word that
begins at its place. Phase one of Baier's suffix sorter groups suffixes by just these longest Lyndon words: groups are taken
from the highest down, and a group's context goes to the end of the contexts of the nearest lower suffixes before it. So it
gives the Lyndon array without the sorted suffixes, once for the order and once for its reverse. Each Lyndon word is a
candidate root: common extensions (LCE) of its place and the place one period on give the run.

Only words that lie in a window of half the least length which occurs twice in the text can be in a run of that length: a
run of period q is its first and its last ``length - q`` words, which are equal, and at least half of it. Other words are left
out before the grouping. This loses nothing, and stretches of repeated windows are searched whole.

LCE are exact: blocks of 1, 2, 4, .. words are numbered by sorting (no hashes), and an LCE is put together from the largest
blocks down. Everything is linear in the words but for sorting; a batch holds 256 texts at most, and a text of n words in
repeated windows takes about 4 * n * log2(n) bytes and Python lists of 8 n numbers.

Defined results: a null or empty text has no words and no runs; repeated rows are judged apart; words are compared as bytes;
an empty table gives an empty result; extra columns stay, and one that is named like an output gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import mixed, plain_words, rolling, table, with_outputs

#: Least number of words of a run.
LEAST = 12
RUNS = "runs array<struct<start: long, length: long, period: long>>"
DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lyndon_array(codes: list[int], size: int) -> list[int]:
    """The length of the longest Lyndon word at each place of ``codes``, numbers below ``size``; 0 ends a string, so no word
    goes over it, and gets length 0 itself.

    Places that aren't in a group above the current one form a chain. A place's context reaches to the next in the chain,
    so what is taken out is added to the one before: the one in front of a group's place is the nearest lower place.
    """
    n = len(codes)
    members: list[list[int]] = [[] for _ in range(size)]
    for i, c in enumerate(codes):
        members[c].append(i)
    group, lengths = list(codes), [0] * n
    below, above = list(range(-1, size - 1)), list(range(1, size + 1))
    before, after = [*range(-1, n - 1), n - 1], [*range(1, n + 1), n]
    now = size - 1
    while now > 0:
        fronts: dict[tuple[int, int], list[int]] = {}
        front, copies = -1, 0
        for s in [*(m for m in members[now] if group[m] == now), n]:
            here = before[s] if s < n else n
            if here != front:
                if front >= 0 and group[front]:  # what goes before a string's beginning is its neighbour's end
                    fronts.setdefault((copies, group[front]), []).append(front)
                front, copies = here, 0
            if s < n:
                copies += 1
                nxt = after[s]
                lengths[s] = nxt - s
                after[here] = nxt
                before[nxt] = here
        for copies, low in sorted(fronts, reverse=True):  # more copies make a context greater: the last group is the lowest
            moved, new, high = fronts[copies, low], len(members), above[low]
            members.append(moved)
            below.append(low)
            above.append(high)
            above[low] = new
            if high < len(below):
                below[high] = new
            for m in moved:
                group[m] = new
        now = below[now]
    return lengths


def _blocks(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """levels[k][i]: a number for the block of 2**k items at i, equal for equal blocks only."""
    levels = [codes.astype(np.int32)]
    while 2 << (len(levels) - 1) <= longest:
        last, half = levels[-1], 1 << (len(levels) - 1)
        pairs = last[: len(last) - half].astype(np.int64) << 32 | last[half:]
        values, numbers = np.unique(pairs, return_inverse=True)
        if len(values) == len(pairs):
            break
        levels.append(numbers.astype(np.int32))
    return levels


def _forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Items that are equal from i and from j on; i < j."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at = np.flatnonzero(j + out < len(levels[k]))
        same = levels[k][i[at] + out[at]] == levels[k][j[at] + out[at]]
        out[at[same]] += 1 << k
    return out


def _backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Items that are equal before i and before j; i < j."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at = np.flatnonzero(i - out >= 1 << k)
        a, b = i[at] - out[at] - (1 << k), j[at] - out[at] - (1 << k)
        fits = b < len(levels[k])
        same = np.zeros(len(at), bool)
        same[fits] = levels[k][a[fits]] == levels[k][b[fits]]
        out[at[same]] += 1 << k
    return out


def _stretches(codes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of windows of ``width`` items that occur twice in one text. Windows are told apart by a
    hash; a clash makes a stretch longer at most."""
    n = len(codes)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    whole = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    with np.errstate(over="ignore"):
        keys = mixed(rolling(mixed(codes.astype(np.uint64) + np.uint64(1)), width)[whole] + mixed(owner[whole].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    again = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][again]] = twice[order[:-1][again]] = True
    at = whole[twice]
    edges = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + width, minlength=n + 1)[: n + 1]
    covered = np.cumsum(edges)[:n] > 0
    changed = np.flatnonzero(np.diff(owner)) + 1
    starts = np.union1d(np.flatnonzero(covered & ~np.r_[False, covered[:-1]]), changed[covered[changed]])
    stops = np.union1d(np.flatnonzero(covered & ~np.r_[covered[1:], False]) + 1, changed[covered[changed - 1]])
    return starts, stops


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """For each list of words its runs of at least ``least`` words, as rows (start, length, period) by start, then period."""
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for words in texts for w in words), np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
    first = np.r_[0, np.cumsum([len(words) for words in texts])]
    none = [np.empty((0, 3), np.int64)] * len(texts)
    starts, stops = _stretches(codes, owner, max(1, (least + 1) // 2))
    wide = stops - starts >= least
    starts, stops = starts[wide], stops[wide]
    if not len(starts):
        return none
    # stretches one after the other, an end mark after each
    sizes = stops - starts + 1
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    place = np.arange(sizes.sum()) - np.repeat(begins - starts, sizes)  # in codes; of an end mark: one beyond the stretch
    ends = begins + sizes - 1
    values, letters = np.unique(np.delete(codes[np.minimum(place, len(codes) - 1)], ends), return_inverse=True)
    inside = np.ones(len(place), bool)
    inside[ends] = False
    letter = np.zeros(len(place), np.int64)
    letter[inside] = letters + 1
    unique_ends = letter.copy()
    unique_ends[ends] = len(values) + 1 + np.arange(len(ends))
    levels = _blocks(unique_ends, int(sizes.max()))
    reverse = np.where(letter > 0, len(values) + 1 - letter, 0)
    found = []
    for order in (letter, reverse):
        period = np.array(lyndon_array(order.tolist(), len(values) + 1), np.int64)
        i = np.flatnonzero(inside)
        i = i[inside[np.minimum(i + period[i], len(place) - 1)]]  # the word after a root is no end
        j = i + period[i]
        start = i - _backward(levels, i, j)
        length = j + _forward(levels, i, j) - start
        long = length >= np.maximum(least, 2 * period[i])
        found.append(np.stack([place[start[long]], length[long], period[i[long]]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    at = owner[rows[:, 0]]
    rows[:, 0] -= first[at]
    return np.split(rows, np.searchsorted(at, np.arange(1, len(texts))))


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """The columns of ``docs`` and ``runs``: start, length and period in words of each run, by start, then period."""

    def make() -> Callable[[list], list]:
        def work(texts: list) -> list:
            found = runs_of([plain_words(t) for t in texts], least)
            return [[[dict(zip(("start", "length", "period"), r, strict=True)) for r in rows.tolist()] for rows in found]]

        return work

    return with_outputs(docs, text, make, RUNS)


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs.tolist():
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with each run cut down to its first period; words are then joined by one space. A text without a run stays
    as it is, null too."""

    def make() -> Callable[[list], list]:
        def work(texts: list) -> list:
            words = [plain_words(t) for t in texts]
            found = runs_of(words, least)
            return [[t if not len(r) else b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for t, w, r in zip(texts, words, found, strict=True)]]

        return work

    return with_outputs(docs, text, make, "collapsed_text string").withColumn(text, F.col("collapsed_text")).drop("collapsed_text")


def digest_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """The columns of ``docs`` but the text, the number of runs, the longest one (ties: the first, then the shorter period;
    null without a run), and digests of all runs and of the collapsed text."""

    def make() -> Callable[[list], list]:
        def work(texts: list) -> list:
            columns: list[list] = [[] for _ in range(7)]
            words = [plain_words(t) for t in texts]
            for own, rows in zip(words, runs_of(words, least), strict=True):
                best = max(rows.tolist(), key=lambda r: (r[1], -r[0], -r[2]), default=None)
                told = "".join(f"{s},{n},{p}\n" for s, n, p in rows.tolist()).encode()
                left = collapsed(own, rows) if best else own
                row = [len(rows), *(best or [None] * 3), best and 1000 * best[1] // best[2], hashlib.sha256(told).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()]
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            return columns

        return work

    return with_outputs(docs, text, make, DIGEST, drop=(text,))


def _with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text; of one id in ten, by its checksum, with a repeated stretch in place of its end."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def periodic(parts: Column) -> Column:
        w, a = parts["w"], parts["a"]
        n = F.size(w)
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8)).cast("int")
        return F.when(n == 0, text).otherwise(F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " "))

    split = F.struct(words.alias("w"), (g % F.greatest(F.size(words), F.lit(1))).cast("int").alias("a"))
    return F.when(h % 10 == 0, F.get(F.transform(F.array(split), periodic), 0)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    return digest_runs(texts)
