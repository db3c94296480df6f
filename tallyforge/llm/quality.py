"""Line-first quality rules: lines that fail are removed, documents that lose too much text are rejected.

A line fails as navigation (menu separators, or a few words without closing punctuation), as symbols, as shouting, as
boilerplate (licence, copyright and cookie notices), or as a repeat of an earlier line. A document is rejected if the
lines that failed hold more than half of its words, or if its whole text fails the base rules: fewer than 10 words, or
over a fifth of its words in five-word windows found twice or more.

Defined results: a null or empty text has no words and fails the base rules; a text of white space likewise; repeated
rows are judged each by itself; an empty table gives an empty result; extra columns stay, and give way to an output of
the same name.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import WordHashes, encoded, quoted, rolling, table, with_outputs

SYMBOLS = b"#*$%&|<>"
#: A document that loses more than this share of its words is rejected.
MOST_LOST = 0.5
_BOILERPLATE = re.compile(
    rb"(?i)all rights reserved|licensed under|released under the|this work is licensed|\(c\) ?[0-9]{4}|\xc2\xa9|copyright|terms of (use|service)|privacy policy|accept (all )?cookies|uses cookies|subscribe to our|click here|share this"
)
_LOG_IN, _SIGN_UP = re.compile(rb"(?i)log ?in\b"), re.compile(rb"(?i)\bsign ?up")
_CLOSED = re.compile(rb"[.!?:;,\"')\]]$|\xe2\x80[\xa6\x9c\x9d\x99]$|\xc2\xbb$|\xe3\x80\x82$")


def _notice(line: bytes) -> bool:
    """Boilerplate, or a sign-up somewhere after the first log-in: looked for apart, so that a line takes time in proportion."""
    if _BOILERPLATE.search(line):
        return True
    first = _LOG_IN.search(line)
    return bool(first and _SIGN_UP.search(line, first.end()))


def line_fault(line: bytes, words: list[bytes]) -> str | None:
    """The first rule that a line of at least one word fails."""
    chars = sum(map(len, words))
    if 12 * (chars - len(b"".join(words).translate(None, SYMBOLS))) > chars:
        return "symbols"
    if words.count(b"|") >= 2 or line.count(b" > ") + line.count(b" \xc2\xbb ") >= 2:
        return "navigation"
    if len(words) <= 2 and not _CLOSED.search(words[-1]):
        return "navigation"
    upper, lower = len(re.findall(rb"[A-Z]", line)), len(re.findall(rb"[a-z]", line))
    if upper > 4 * lower and upper >= 12 and (2 * line.count(b"!") >= len(words) or len(words) >= 4):
        return "shouting"
    if len(words) <= 30 and _notice(line):
        return "boilerplate"
    return None


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost_words long, line_faults map<string,long>, clean_text string, base_failed boolean, kept boolean"


def assess(docs: DataFrame, text: str = "text", most_lost: float = MOST_LOST, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs``, but for the columns in ``drop``, with the measures of the whole text, the text without its failing lines, and the verdict."""

    def make():
        hashes = WordHashes()

        def one(t: str | None) -> tuple:
            raw = encoded(t)
            words = raw.split()
            n, chars = len(words), sum(map(len, words))
            repeats = 0
            if n >= 6:
                _, which, counts = np.unique(rolling(hashes.of(words), 5), return_inverse=True, return_counts=True)
                step = np.zeros(n + 1, np.int64)
                twice = np.flatnonzero(counts[which] > 1)
                np.add.at(step, twice, 1)
                np.add.at(step, twice + 5, -1)
                repeats = int((np.cumsum(step)[:n] > 0).sum())
            seen, faults, kept, lost, again = set(), Counter(), [], 0, 0
            for line in raw.split(b"\n"):
                own = line.split()
                if not own:
                    kept.append(line)
                    continue
                fault = line_fault(line, own)
                if line in seen:
                    again += 1
                    fault = fault or "repeat"
                seen.add(line)
                if fault:
                    faults[fault] += 1
                    lost += len(own)
                else:
                    kept.append(line)
            base = n < 10 or 100 * repeats > 20 * n
            clean = b"\n".join(kept).decode("utf-8", "surrogatepass")
            return n, len(t or "") - len(raw) + chars, len(raw) - len(raw.translate(None, SYMBOLS)), again, repeats, lost, list(faults.items()), clean, base, not base and lost <= most_lost * n

        return lambda texts: [list(c) for c in zip(*map(one, texts), strict=True)] if texts else [[] for _ in range(10)]

    return with_outputs(docs, text, make, MEASURES, drop)


def keep_clean(docs: DataFrame, text: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """Documents that pass, with their failing lines removed; the columns are those of ``docs``."""
    renamed = docs.select(*[F.col(quoted(c)).alias(f"__{i}__") for i, c in enumerate(docs.columns)])
    at = docs.columns.index(text)
    found = assess(renamed, f"__{at}__", most_lost).where("kept")
    return found.select(*[(F.col("clean_text") if i == at else F.col(f"__{i}__")).alias(c) for i, c in enumerate(docs.columns)])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assess(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept")
