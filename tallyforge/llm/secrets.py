"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions at its hits, then checksum validation.

The text is scanned once as ASCII-lower-cased bytes by an automaton of all kinds' keywords; an expression is tried only
where one of its keywords begins. Runs of 24 or more hex digits have no keyword; their prefilter is a byte translation
that leaves such runs as one needle. Kinds with an embedded checksum or structure (CRC-32 in base 62, base64 JSON
headers, key blocks) are kept only if it holds.

Defined results: a null or empty text has no secrets; spans are code points, end exclusive, by start, then kind as
listed; repeated rows are scanned each by itself; an empty table gives an empty result; extra columns stay, and give
way to an output of the same name.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import encoded, quoted, table, with_outputs

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _crc62(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of the secret's body in base 62."""
    body, check = match[2], match[3].decode()
    value, digits = zlib.crc32(body), ""
    while value:
        value, d = divmod(value, 62)
        digits = _BASE62[d] + digits
    return digits.rjust(6, "0") == check


def _json_header(match: re.Match) -> bool:
    """The part before the first stop is a base64 JSON object that names an algorithm. One that is nested too deeply to be read
    is none."""
    head = match[0].split(b".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, RecursionError):
        return False


def _mixed(match: re.Match) -> bool:
    """Letters and digits both, not one character over and over."""
    body = match[0]
    return bool(re.search(rb"[0-9]", body) and re.search(rb"[A-Za-z]", body)) and len(set(body)) >= 8


def _always(match: re.Match) -> bool:
    return True


#: kind, keywords (lower case), expression anchored at a keyword's start, check of the match, whether it is a base kind.
RULES: list[tuple[str, tuple[str, ...], bytes, Callable[[re.Match], bool], bool]] = [
    ("assign", ("password", "passwd", "secret", "token", "api_key", "apikey"), rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6, True),
    ("access", ("akia",), rb"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20, True),
    ("access_temp", ("asia",), rb"(?<![A-Za-z0-9])ASIA[A-Z0-9]{16}(?![A-Za-z0-9])", _mixed, False),
    ("hub_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), rb"(ghp_|gho_|ghu_|ghs_|ghr_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", _crc62, False),
    ("chat_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), rb"xox[abprs]-[0-9A-Za-z-]{10,}", _mixed, False),
    ("pay_key", ("sk_live_", "rk_live_"), rb"[sr]k_live_[0-9A-Za-z]{16,}", _mixed, False),
    ("map_key", ("aiza",), rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])", _mixed, False),
    ("lab_token", ("glpat-",), rb"glpat-[0-9A-Za-z_-]{20,}", _mixed, False),
    ("web_token", ("eyj",), rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", _json_header, False),
    ("bearer", ("bearer ",), rb"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*", _mixed, False),
    ("url_login", ("://",), rb"://[^\s/:@\"'<>]{1,64}:[^\s/@\"'<>]{3,128}@[A-Za-z0-9.-]+", _always, False),
    ("private_key", ("-----begin ",), rb"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END ([A-Z]+ )*PRIVATE KEY-----)?", _always, False),
]
#: Kinds in the order that ties are listed in.
KINDS = ["assign", "access", "hex", *(r[0] for r in RULES if not r[4])]
_HEX = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_NEEDLE = b"h" * 24
_TEXT_OUT = "secrets array<struct<kind: string, start: long, end: long>>"


class Scanner:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.rules = [(kind, re.compile(pattern), check) for kind, _, pattern, check, _ in RULES]
        words: dict[str, list[int]] = {}
        for i, (_, keywords, *_) in enumerate(RULES):
            for word in keywords:
                words.setdefault(word, []).append(i)
        for word, rules in words.items():
            self.automaton.add_word(word, (len(word), tuple(rules)))
        self.automaton.make_automaton()

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then kind."""
        raw = encoded(text)
        found = []
        hits = sorted((end - size + 1, i) for end, (size, rules) in self.automaton.iter(raw.lower().decode("latin-1")) for i in rules)
        free = [0] * len(self.rules)  # where the last match of each kind ended
        for start, i in hits:
            kind, pattern, check = self.rules[i]
            if start >= free[i] and (m := pattern.match(raw, start)):
                free[i] = m.end()
                if check(m):
                    found.append((kind, start, m.end()))
        runs = raw.translate(_HEX)
        at = runs.find(_NEEDLE)
        while at >= 0:
            end = runs.find(b" ", at)
            end = len(runs) if end < 0 else end
            found.append(("hex", at, end))
            at = runs.find(_NEEDLE, end)
        if found and len(raw) != len(text):
            points = [0, 0]  # bytes, code points so far

            def point(byte: int) -> int:
                points[1] += len(raw[points[0] : byte].decode("utf-8", "surrogatepass"))
                points[0] = byte
                return points[1]

            place = {b: point(b) for b in sorted({b for _, *ends in found for b in ends})}
            found = [(k, place[a], place[b]) for k, a, b in found]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs``, but for the columns in ``drop``, with secrets: an array of (kind, start, end)."""

    def make():
        scanner = Scanner()
        return lambda texts: [[[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(t)] for t in texts]]

    return with_outputs(docs, text, make, _TEXT_OUT, drop)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with overlapping secrets joined and replaced by ``mark``; the columns are those of ``docs``."""
    renamed = docs.select(*[F.col(quoted(c)).alias(f"__{i}__") for i, c in enumerate(docs.columns)])
    at = f"__{docs.columns.index(text)}__"

    def replaced(t, secrets):
        if not secrets:  # Spark evaluates this for every row
            return t
        out, done = [], 0
        for s in secrets:
            if s["end"] <= done:
                continue
            if s["start"] >= done:
                out += [t[done : s["start"]], mark]
            done = s["end"]
        return "".join([*out, t[done:]])

    cut = F.udf(replaced, "string")
    found = find_secrets(renamed, at).withColumn(at, F.when(F.size("secrets") > 0, cut(at, "secrets")).otherwise(F.col(at)))
    return found.select(*[F.col(f"__{i}__").alias(c) for i, c in enumerate(docs.columns)])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
    listed = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
