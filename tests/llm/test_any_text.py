"""Registered queries on texts that are built to be slow or to break a parser, and against brute-force versions."""

import base64
import hashlib
import re
import time

from tallyforge.llm import quality, registry, secrets
from tests.llm.test_text_operators import BASE, ODD

SF = "/root/testdata/sf0.001"
NESTED = "eyJ" + base64.urlsafe_b64encode(b'"a":' + b"[" * 200_000).decode().rstrip("=") + ".eyJzdWIiOiIxMjM0In0.abcdefghijk"


def test_a_deeply_nested_header_is_no_token():
    began = time.time()
    head = base64.urlsafe_b64encode(b'{"a":' + b"[" * 200_000).decode().rstrip("=")
    assert head.startswith("eyJ")
    found = secrets.Scanner().spans(f"{head}.eyJzdWIiOiIxMjM0In0.abcdefghijk and token=abcdef123")
    assert [k for k, *_ in found] == ["assign"] and time.time() - began < 5
    objects = base64.urlsafe_b64encode(b'{"alg":' * 50_000).decode().rstrip("=")
    assert secrets.Scanner().spans(f"{objects}.eyJzdWIiOiIxMjM0In0.abcdefghijk") == []


def test_a_line_of_many_log_ins():
    """The rule scanned to the line's end from each of them."""
    line = b"login." * 170_000
    began = time.time()
    assert quality.line_fault(line, line.split()) is None
    assert quality.line_fault(line + b"sign up.", (line + b"sign up.").split()) == "boilerplate"
    assert time.time() - began < 5
    for text, fault in ((b"Log in here or Sign Up.", True), (b"sign up or log in now.", False), (b"Sign up, login, signup now.", True), (b"login signups it.", True), (b"login resign up it.", False), (b"loginsign up to it.", False)):
        assert (quality.line_fault(text, text.split()) == "boilerplate") is fault is bool(re.search(rb"(?i)log ?in\b.*\bsign ?up", text)), text


def test_secrets_query_equals_brute_force(spark, tmp_path):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = given + [(5000 + k, t) for k, t in enumerate(ODD)] + [(None, "token=abcdef1"), (1, "secret: é12345678"), (1, "secret: é12345678"), (6000, "é api_key = 'ab-cd.ef' AKIA" + "Z" * 16 + " " + "0f" * 12), (6001, NESTED)]
    spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, secrets string").write.parquet(f"{tmp_path}/documents.parquet")

    def wanted(doc, text):
        found = [(m.start(), list(BASE).index(k), k, m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "", re.A) if ok(m)]
        spans = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
        return (doc, *(sum(f[2] == k for f in found) for k in BASE), hashlib.sha256(spans.encode()).hexdigest())

    got = registry.QUERIES["op5_secret_scan"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) for r in got), key=str) == sorted((wanted(*r) for r in rows), key=str)
    for r in got:
        kept = [s for s in r["spans"].split(",") if s.split(":")[0] in BASE]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r["base_sha256"]


def test_a_null_id_is_not_held_out(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(60).union(spark.createDataFrame([(None, "some text", None), (None, None, None)], "doc_id long, text string, lang string")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.QUERIES["op10_language_id"](spark, str(tmp_path)).collect()
    assert len(rows) == 62 and [r["held_out"] for r in rows if r["doc_id"] is None] == [False, False]
    assert {r["held_out"] for r in rows} == {True, False}
