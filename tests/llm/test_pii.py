import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            checks = {
                "email": lambda m, d: True,
                "ip": lambda m, d: all(int(x) <= 255 for x in m.split(".")),
                "card": lambda m, d: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda m, d: 10 <= len(d) <= 15,
            }
            if checks[kind](m[0], digits):
                out.append((m.start(), k, m.end()))
    return sorted(out)


CARD = "4539578763621486"
TEXTS = [
    None, "", " ", "é a.b@c.de_x@y.zz, ü@", "a@b.c@d.e f@g", "x" * 300 + "@" + "y" * 300 + ".com", "a@b.c " * 400, "1.2.3.4.5.6.7.8", "1.2.3.400 10.0.0.1.",
    "0255.1.1.1 00000000000000000255.3.4.5 99999999999999999999.1.1.1", f"{CARD} {CARD}", f"card {CARD}.", f"x {CARD[:4]}-{CARD[4:8]}-{CARD[8:12]}-{CARD[12:]} y", "9" * 5000, "1 " * 3000,
    "+1 (826) 555-4081 190.137.223.204", "+1 ( ( (", "+12345678901234567890", "😀 +1 (017) 555-7713 😀 me@x.org 😀", "a\x00b@c.d\x00", "tel. 555-123-4567, ssn 123-45-6789, iban GB82 WEST 1234 5698 7654 32",
    "write to jane (at) example (dot) com", "order 555-123-4567 version 1.2.3.4 and 12-34-5678",
]


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])], "id long, text string")
    rows = pii.candidates(df).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert sorted((b["start"], b["kind"], b["end"]) for b in r["base"]) == brute(r["text"]), r["text"]


def test_spans_keep_base_and_add_wide_formats(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    rows = {r["id"]: r for r in pii.find_pii(df.withColumn("Base", F.lit(1))).collect()}
    for i, t in enumerate(TEXTS):
        spans = [(s["start"], s["number"], s["end"]) for s in rows[i]["spans"]]
        assert spans == sorted(spans)
        assert set(brute(t)) <= set(spans)
    found = lambda i: {(s["kind"], TEXTS[i][s["start"] : s["end"]]) for s in rows[i]["spans"]}
    assert {("card", CARD)} == found(10)
    assert {("phone", "555-123-4567"), ("ssn", "123-45-6789"), ("iban", "GB82 WEST 1234 5698 7654 32")} == found(20)
    assert {("email", "jane (at) example (dot) com")} == found(21)
    assert "555-123-4567" not in {x for _, x in found(22)}


def test_redact_keeps_columns_and_the_rest_of_the_text(spark):
    df = spark.createDataFrame([(1, f"é {CARD} ü", 5), (2, None, 6), (3, "clean", 7)], "spans long, text string, base long")
    rows = {r["spans"]: r for r in pii.redact(df).collect()}
    assert rows[1].asDict() == {"spans": 1, "text": "é [CARD] ü", "base": 5}
    assert rows[2]["text"] is None
    assert rows[3]["text"] == "clean"


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "id long, text string")).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_digest(spark, sf):
    got = {r["doc_id"]: r for r in pii.op1_pii(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        spans = brute(r["text"])
        text = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in spans)
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [got[r["doc_id"]][f"n_{k}"] for k in PATTERNS] == [sum(s[1] == i for s in spans) for i in range(4)]


class ByCode:
    """Scores that a code gives in percent."""

    thresholds = [0.1] * len(pii.KINDS)

    def score(self, code):
        return code / 100


def greedy(base, proposed):
    """Best score first, then the first, the longest and the kind; each that touches nothing before it."""
    touches = lambda a, b: a[1] < b[2] and b[1] < a[2]
    kept = []
    for c in sorted((c for c in proposed if c[3] >= 10), key=lambda c: (-c[3], c[1], -c[2], c[0])):
        if not any(touches(c, o) for o in [*base, *kept]):
            kept.append(c)
    return sorted((s, k, e) for k, s, e, *_ in [*base, *kept])


def test_a_suppressed_span_suppresses_nothing(spark):
    chain = [(4, 0, 10, 90), (4, 8, 20, 80), (4, 18, 30, 70), (5, 28, 40, 60)]
    rng = random.Random(2)
    rows = [(0, [], chain), (1, [], []), (2, [(0, 5, 9)], chain)]
    for i in range(3, 60):
        made = [(rng.randrange(6), s, s + rng.randint(1, 12), rng.randrange(100)) for s in (rng.randrange(60) for _ in range(rng.randint(0, 25)))]
        held = [(k, s + 7 * k, s + 7 * k + 4) for k, s in ((rng.randrange(4), rng.randrange(40)) for _ in range(rng.randint(0, 2)))]
        rows.append((i, held, list(set(made))))
    df = spark.createDataFrame(rows, "id long, base array<struct<kind: int, start: int, end: int>>, proposed array<struct<kind: int, start: int, end: int, code: int>>")
    got = {r["id"]: [(s["start"], s["number"], s["end"]) for s in r["spans"]] for r in pii.select_spans(df, ByCode()).collect()}
    assert got[0] == [(0, 4, 10), (18, 4, 30)]
    assert got == {i: greedy(base, proposed) for i, base, proposed in rows}


def test_texts_of_many_matches(spark):
    """20,000 addresses, and a chain of thousands of candidates that overlap, in one text each."""
    many = " ".join(f"10.{i % 256}.{i // 256}.7" for i in range(20_000))
    chain = "1234 5678 " * 1500
    rows = {r["id"]: r for r in pii.find_pii(spark.createDataFrame([(1, many), (2, chain)], "id long, text string")).collect()}
    ips = [(s["start"], s["end"]) for s in rows[1]["spans"] if s["kind"] == "ip"]
    assert ips == [m.span() for m in re.finditer(PATTERNS["ip"], many)]
    spans = [(s["start"], s["end"]) for s in rows[2]["spans"]]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_thresholds_come_from_rows_held_back():
    """A vector that is positive where the trees are fitted and negative where it is held back is not selected."""
    sizes = [1]
    for n in reversed(pii.CARDINALITY[1:]):
        sizes.insert(0, sizes[0] * n)
    code = sum(f * s for f, s in zip((3, 10, 1, 1, 0, 2, 1, 1), sizes, strict=True))
    agreed, contrary = pii.Trees([code], [400], [400], ([code], [90], [90])), pii.Trees([code], [400], [400], ([code], [0], [90]))
    prob = agreed.probabilities(pii._vectors([code]))[0]
    assert agreed.thresholds[3] <= prob
    assert contrary.thresholds[3] > prob
