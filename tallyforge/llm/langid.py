"""Language identification by words first: known words score by their log frequency in each language; an unseen word
backs off to its longest character n-grams that are known, from five characters down to one.

The model is fitted on a bounded sample: at most about DOCS_PER_LANGUAGE rows of each label and MOST_ROWS in all, chosen
by a hash of the id, and never rows of the held-out quarter (crc32 of the id as text, modulo 4, is 2). With more labels
than MOST_ROWS / DOCS_PER_LANGUAGE each gets an equal, smaller part; none is left out. Tables keep the commonest entries of
each language, as many as MOST_CELLS allows but LEAST_ENTRIES at least; words without an entry back off. Every text is
scored whole.

Defined results: a null text, or one without any letter, is ``und`` with score 0; rows without a label or text are not
learned from; without any rows to learn from, every text is ``und``; ties go to the label that sorts first; repeated
rows are scored each by itself; extra columns stay, and give way to an output of the same name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import as_table, quoted, table, with_outputs

#: Bounds of the sample and of the model.
DOCS_PER_LANGUAGE = 1500
MOST_ROWS = 100_000
#: Counts of so many labels at most are broadcast; more are joined by a shuffle.
MOST_LABELS_BROADCAST = 100_000
WORDS_PER_LANGUAGE = 60_000
GRAMS_PER_LANGUAGE = 20_000
LONGEST_GRAM = 5
#: Numbers that a table, or the cache of word scores, has at most (but LEAST_ENTRIES for each language): with more than
#: MOST_CELLS / WORDS_PER_LANGUAGE languages, tables keep fewer of the commonest entries of each.
MOST_CELLS = 8_000_000
LEAST_ENTRIES = 50
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: str) -> Column:
    """Whether a row's labels are never learned from, by its id; null for a null id, which the queries give as false."""
    return F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")) % 4 == 2


@dataclass
class Table:
    """Entries with their log frequencies, add-half smoothed: ``base`` holds those of an entry that a language lacks, and
    ``deltas[k]`` for k from starts[e] to starts[e + 1] what entry e has more in language ``langs[k]``. So a table is as
    large as its counts, however many languages there are."""

    entries: dict[str, int]
    starts: np.ndarray
    langs: np.ndarray
    deltas: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, counts: list[Counter]) -> Table:
        entries = {e: i for i, e in enumerate(sorted(set().union(*counts)))}
        sizes = [len(c) for c in counts]
        owner = np.fromiter((entries[e] for c in counts for e in c), np.int64, sum(sizes))
        times = np.fromiter((n for c in counts for n in c.values()), np.float64, sum(sizes))
        langs = np.repeat(np.arange(len(counts)), sizes)
        order = np.argsort(owner, kind="stable")
        totals = np.bincount(langs, times, len(counts)) + 0.5 * len(entries)
        starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(entries)))]).astype(np.int64)
        return cls(entries, starts, langs[order].astype(np.int32), np.log(times[order] + 0.5) - np.log(0.5), np.log(0.5 / totals) if entries else np.zeros(len(counts)))

    def means(self, found: list[list[int]]) -> np.ndarray:
        """The mean of the log frequencies of each list of entries, which have one at least."""
        sizes = np.array([len(f) for f in found])
        at = np.fromiter((e for f in found for e in f), np.int64, sizes.sum())
        n = self.starts[at + 1] - self.starts[at]
        places = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        row = np.repeat(np.repeat(np.arange(len(found)), sizes), n)
        width = len(self.base)
        more = np.bincount(row * width + self.langs[places], self.deltas[places], len(found) * width).reshape(len(found), width)
        return self.base + more / sizes[:, None]


class LanguageModel:
    """Counts of words and n-grams by language."""

    def __init__(self, rows: list[tuple[str, str]], longest: int = LONGEST_GRAM):
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in rows:
            words[lang].update(_WORD.findall(text.lower()))
        self.languages, self.longest = sorted(words), longest
        most = max(LEAST_ENTRIES, MOST_CELLS // max(1, len(words)))
        self.tables: dict[int, Table] = {0: Table.of([Counter(dict(words[k].most_common(min(WORDS_PER_LANGUAGE, most)))) for k in self.languages])}
        for n in range(1, longest + 1):
            grams: list[Counter] = []
            for lang in self.languages:
                found: Counter = Counter()
                for word, times in words[lang].items():
                    for g in self._grams(word, n):
                        found[g] += times
                grams.append(Counter(dict(found.most_common(min(GRAMS_PER_LANGUAGE, most)))))
            self.tables[n] = Table.of(grams)

    @staticmethod
    def _grams(word: str, n: int) -> list[str]:
        padded = f" {word} "
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own if it is known, else the mean of its longest known n-grams, else zeros."""
        out = np.zeros((len(words), len(self.languages)))
        left = range(len(words))
        for n in [0, *range(self.longest, 0, -1)]:
            table = self.tables[n]
            found, who, unseen = [], [], []
            for i in left:
                rows = [r for g in (self._grams(words[i], n) if n else (words[i],)) if (r := table.entries.get(g)) is not None]
                if rows:
                    found.append(rows)
                    who.append(i)
                else:
                    unseen.append(i)
            if who:
                out[who] = table.means(found)
            left = unseen
        return out


class Identifier:
    """Scores texts; remembers the scores of up to ``most`` words."""

    def __init__(self, model: LanguageModel, most: int = 100_000):
        self.model, self.most = model, min(most, MOST_CELLS // max(1, len(model.languages)))
        self.index: dict[str, int] = {}
        self.scores = np.empty((1024, len(model.languages)))

    def _learn(self, words: set[str]) -> None:
        if len(self.index) + len(words) > max(self.most, len(words)):
            self.index.clear()
        at = len(self.index)
        if at + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores[:at], np.empty((at + 2 * len(words), self.scores.shape[1]))])
        new = list(words)
        self.index.update(zip(new, range(at, at + len(new)), strict=True))
        self.scores[at : at + len(new)] = self.model.word_scores(new)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text else []
        if not self.model.languages or not (any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)):
            return UNDETERMINED, 0.0
        distinct = set(words)
        if new := distinct.difference(self.index):
            self._learn(new if len(self.index) + len(new) <= self.most else distinct)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        total = self.scores[at].sum(axis=0)
        mean = total / len(words) * min(len(words), 40)  # words are not independent
        best = int(np.argmax(total))
        return self.model.languages[best], float(1 / np.exp(mean - mean[best]).sum())


def sample_of(docs: DataFrame, label: str, id_col: str, most: int, most_rows: int = MOST_ROWS) -> DataFrame:
    """At most about ``most`` rows of each label and ``most_rows`` in all, chosen by a hash of the id; a label of fewer
    rows than its part is taken whole. Counts of labels are joined, so there may be any number of them."""
    own = F.col(quoted(label))
    counts = as_table(docs.groupBy(own.alias("__of__")).agg(F.count(F.lit(1)).alias("__n__")), "labels")
    labels = counts.count()
    part = min(float(most), most_rows / max(1, labels))
    shares = counts.select("__of__", (F.lit(part) / F.col("__n__")).alias("__share__"))
    dealt = F.pmod(F.xxhash64(F.col(quoted(id_col)).cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    joined = docs.join(F.broadcast(shares) if labels <= MOST_LABELS_BROADCAST else shares, own == F.col("__of__"))
    return joined.where(dealt < F.col("__share__")).select(*[F.col(quoted(c)) for c in docs.columns])


def fit(docs: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE) -> LanguageModel:
    rows = docs.where(F.col(quoted(label)).isNotNull() & F.col(quoted(text)).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False)))
    rows = rows.select(F.col(quoted(label)).cast("string").alias("label"), F.col(quoted(text)).cast("string").alias("text"), F.col(quoted(id_col)).cast("string").alias("id"))
    chosen = sample_of(rows, "label", "id", docs_per_language)
    return LanguageModel([(r["label"], r["text"]) for r in chosen.select("label", "text").orderBy("label", "id").collect()])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs``, but for the columns in ``drop``, with lang_pred and score."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        identifier = Identifier(known.value)
        return lambda texts: [list(c) for c in zip(*map(identifier.predict, texts), strict=True)] if texts else [[], []]

    return with_outputs(docs, text, make, "lang_pred string, score double", drop)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out")), fit(docs), drop=("text",))
    return found.select("doc_id", "held_out", "lang_pred", "score")
