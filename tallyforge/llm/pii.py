"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base expressions and wider, overlapping generators propose spans; each candidate has small integer features of its
format (kind, digits, separators, checksum or range validity, a leading plus) and context (key words before it, the
characters around it). Feature vectors are few, so the corpus is reduced to their counts, over all rows; boosted trees
are fitted to these counts, and their scores of all feature vectors are a constant array. A candidate counts as positive in training if a base
match holds it or a key word of its kind stands before it; SEEDS add formats that base matches cannot confirm. For each
kind the lowest threshold with enough precision, on rows held back for this, selects what is added. Base spans always
stay. Spans are placed, compared and chosen while they are read by start, so that a text of many matches takes time in
proportion to them.

Defined results: a null text is empty and has no spans; spans are code points, end exclusive, by start, then kind in
the order of KINDS; of overlapping added spans the best score wins, and none overlaps a base span; repeated rows are
searched each by itself; an empty table gives an empty result; extra columns stay, and give way to an output of the
same name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import as_table, quoted, table

KINDS = ["email", "ip", "card", "phone", "ssn", "iban"]
BASE_KINDS = 4
#: A match begins where a run begins or the match before ended; possessive, so that long runs take linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?|\x20(?:at|AT)\x20|\x20?@\x20?)", r"(?:\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)"
GENERATORS = [
    ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\x20?[.,]\x20?[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]{2,7}(?![0-9])"),
    ("card", r"(?<![0-9])3[0-9]{3}[\x20.-]?[0-9]{6}[\x20.-]?[0-9]{4,5}(?![0-9])"),
    ("phone", r"(?<![0-9+.])(?:\+|00)?(?:[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9]|[.-][0-9])"),
    ("phone", r"(?<![0-9])(?:\+|00)[1-9][0-9]{9,13}(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
]
FOR = {
    "email": "mail|contact|write to|reach|correo|courriel|schreib",
    "ip": r"\bip\b|address|host|server|addr",
    "card": "card|visa|master|amex|credit|debit|carte|tarjeta|karte|payment",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|dial|llam|appel|anruf",
    "ssn": "ssn|social|tax id|identif",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
AGAINST = r"version|order|invoice|isbn|issn|release|build|serial|ticket|section|chapter|doi|part no|\bv$"
FEATURES = ["kind", "digits", "separator", "valid", "plus", "context", "before", "after"]
CARDINALITY = [6, 22, 5, 2, 2, 3, 3, 3]
#: Feature vectors (as FEATURES), label and weight of formats that no base match confirms. Fixed values.
SEEDS = [
    ((0, 0, 4, 1, 0, 1, 0, 0), 1, 8), ((0, 0, 4, 1, 0, 1, 0, 1), 1, 8), ((0, 2, 4, 1, 0, 1, 0, 0), 1, 8), ((0, 0, 4, 0, 0, 1, 0, 0), 0, 8),
    ((1, 8, 3, 1, 0, 1, 0, 0), 1, 4), ((1, 8, 3, 0, 0, 1, 0, 0), 0, 8), ((1, 4, 3, 1, 0, 0, 0, 0), 0, 8), ((1, 8, 4, 1, 0, 1, 0, 0), 0, 4),
    ((2, 16, 0, 1, 0, 1, 0, 0), 1, 8), ((2, 16, 1, 1, 0, 1, 0, 0), 1, 8), ((2, 16, 2, 1, 0, 1, 0, 0), 1, 8), ((2, 15, 1, 1, 0, 1, 0, 0), 1, 8), ((2, 16, 3, 1, 0, 1, 0, 0), 1, 4),
    ((2, 16, 0, 0, 0, 1, 0, 0), 0, 8), ((2, 16, 1, 0, 0, 1, 0, 0), 0, 8), ((2, 16, 2, 0, 0, 1, 0, 0), 0, 8), ((2, 15, 0, 0, 0, 1, 0, 0), 0, 8), ((2, 16, 0, 1, 0, 0, 0, 0), 0, 4),
    ((3, 10, 4, 1, 0, 1, 0, 0), 1, 8), ((3, 10, 2, 1, 0, 1, 0, 0), 1, 8), ((3, 10, 1, 1, 0, 2, 0, 0), 1, 8), ((3, 10, 3, 1, 0, 1, 0, 0), 1, 4), ((3, 11, 4, 1, 0, 1, 0, 0), 1, 8), ((3, 12, 0, 1, 1, 1, 0, 0), 1, 8),
    ((3, 9, 1, 0, 0, 1, 0, 0), 0, 8), ((3, 8, 2, 0, 0, 1, 0, 0), 0, 8), ((3, 10, 1, 1, 0, 0, 0, 0), 0, 8), ((3, 10, 2, 1, 0, 0, 0, 0), 0, 8), ((3, 10, 1, 1, 0, 1, 0, 0), 0, 4),
    ((4, 9, 2, 1, 0, 1, 0, 0), 1, 8), ((4, 9, 2, 1, 0, 2, 0, 0), 1, 8), ((4, 9, 2, 0, 0, 1, 0, 0), 0, 8), ((4, 9, 2, 1, 0, 0, 0, 0), 0, 8),
    ((5, 20, 0, 1, 0, 1, 0, 0), 1, 8), ((5, 20, 1, 1, 0, 1, 0, 0), 1, 8), ((5, 14, 1, 1, 0, 1, 0, 0), 1, 8), ((5, 20, 0, 0, 0, 1, 0, 0), 0, 8), ((5, 16, 1, 0, 0, 1, 0, 0), 0, 8),
]
ROUNDS, DEPTH, RATE, PRECISION = 40, 3, 0.3, 0.9


BLOCK = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with ``value`` evaluated once for each row, however often the body has it."""
    return F.transform(F.array(value), body)[0]


def _blocks(xs: Column) -> Column:
    """``xs``, which must be bound, in pieces of BLOCK entries."""
    return F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array(xs))


def _scan(xs: Column, state: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state, x) for each entry, an array of ``kind``, where step(state, x) is the next entry's state. Entries are
    appended by blocks, so that texts of many matches take time in proportion."""
    none = F.expr(f"cast(array() as array<{kind}>)")
    pair = lambda s, out: F.struct(s.alias("s"), out.alias("out"))

    def within(a: Column, x: Column) -> Column:
        return pair(step(a["s"], x), F.concat(a["out"], F.array(emit(a["s"], x).cast(kind))))

    def across(a: Column, block: Column) -> Column:
        return _let(F.aggregate(block, pair(a["s"], none), within), lambda b: pair(b["s"], F.concat(a["out"], F.array(b["out"]))))

    nested = F.expr(f"cast(array() as array<array<{kind}>>)")
    return _let(xs, lambda bound: F.flatten(F.aggregate(_blocks(bound), pair(state, nested), across)["out"]))


def _distinct(xs: Column) -> Column:
    """Sorted entries without repeats; array_distinct compares all pairs of structs."""
    return _let(F.sort_array(xs), lambda bound: F.filter(bound, lambda x, i: (i == 0) | (x != F.get(bound, i - 1))))


PLACED = "array<struct<start: int, end: int, match: string, left: string, right: string>>"


def placed(text: Column, pattern: str, found: Column) -> Column:
    """All matches, of which ``found`` has the strings, as (start, end, match, left, right): 40 characters before (within
    the gap) and the one after. Places come from the lengths of matches and of the gaps between them."""

    def one(gap: Column) -> Column:
        sizes = F.zip_with(gap, found, lambda g, m: F.struct(F.length(g).alias("g"), F.coalesce(F.length(m), F.lit(0)).alias("m")))
        starts = _scan(sizes, F.lit(0), lambda a, x: a + x["g"] + x["m"], lambda a, x: a + x["g"], "int")

        def row(x: Column, i: Column) -> Column:
            return F.struct(x["b"].alias("start"), (x["b"] + F.length(x["m"])).alias("end"), x["m"].alias("match"), F.right(F.get(gap, i), F.lit(40)).alias("left"), F.left(F.get(gap, i + 1), F.lit(1)).alias("right"))

        return F.transform(F.zip_with(found, F.slice(starts, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b"))), row)

    return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), one)).otherwise(F.lit(None).cast(PLACED))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        return a + F.when((n - i) % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def _octets(match: Column) -> Column:
    parts = F.split(F.regexp_replace(match, r"[^0-9]+", "."), r"\.")
    return F.forall(parts, lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255))


def _iban(match: Column) -> Column:
    packed = F.regexp_replace(match, r"\x20", "")
    moved = F.concat(F.substring(packed, 5, 99), F.left(packed, F.lit(4)))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(moved), F.lit(1))), F.lit(0), step) == 1


def base_ok(kind: str, match: Column) -> Column:
    digits = _digits(match)
    return {"email": F.lit(True), "ip": _octets(match), "card": F.length(digits).between(14, 19) & _luhn(digits), "phone": F.length(digits).between(10, 15)}[kind]


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    if kind == "email":
        return F.lower(match).rlike(r"[a-z]{2,12}$")
    if kind == "ssn":
        return ~match.rlike(r"^(?:000|666|9[0-9]{2})|-00-|-0000$")
    if kind == "iban":
        return _iban(match) & F.length(match).between(15, 42)
    return {"ip": _octets(match), "card": n.between(14, 19) & _luhn(digits), "phone": n.between(10, 15)}[kind]


def _around(char: Column, none: Column) -> Column:
    return F.when(none | char.rlike(r"^[\s(\[{<\"',:;=.!?)\]}>]"), 0).when(char.rlike("^[A-Za-z0-9]"), 2).otherwise(1)


def _features(kind: str, c: Column) -> Column:
    """(kind, start, end, code): the features packed into one number."""
    match, left = c["match"], F.lower(c["left"])
    marks = F.regexp_replace(match, r"[A-Za-z0-9+]", "")
    separator = F.when(marks == "", 0).when(marks.rlike(r"^\x20+$"), 1).when(marks.rlike("^-+$"), 2).when(marks.rlike(r"^\.+$"), 3).otherwise(4)
    context = F.when(left.rlike(AGAINST), 0).when(left.rlike(FOR[kind]), 2).otherwise(1)
    last = F.right(c["left"], F.lit(1))
    values = [
        F.lit(KINDS.index(kind)), F.least(F.length(_digits(match)), F.lit(21)) if kind != "email" else F.least(F.length(_digits(match)), F.lit(2)), separator if kind != "email" else F.when(match.rlike(r"^[^\s()\[\]{}]+$"), 0).otherwise(4),
        _valid(kind, match).cast("int"), match.rlike(r"^(\+|00)").cast("int"), context, _around(last, last == ""), _around(c["right"], c["right"] == ""),
    ]
    code = F.lit(0)
    for value, size in zip(values, CARDINALITY, strict=True):
        code = code * size + F.least(value, F.lit(size - 1))
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), code.cast("int").alias("code"))


def unpacked(code: Column) -> list[Column]:
    out = []
    for i, size in enumerate(CARDINALITY):
        rest = int(np.prod(CARDINALITY[i + 1 :]))
        out.append((F.floor(code / rest) % size).cast("int"))
    return out


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base (array of (kind, start, end)) and proposed (array of (kind, start, end, code))."""
    t = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    worth = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": t.contains("+")}
    many = t.rlike(r"[0-9][\x20./()-]{0,3}[0-9]{2}")
    wide = {"email": worth["email"] | t.rlike(r"[\x20\[({](?:at|AT)[\x20\])}]"), "ip": worth["ip"] | t.rlike("[0-9],[0-9]")}
    patterns = {f"__b{i}__": (worth[k], BASE[k]) for i, k in enumerate(KINDS[:BASE_KINDS])} | {f"__g{i}__": (wide.get(k, many), g) for i, (k, g) in enumerate(GENERATORS)}
    found = docs.withColumns({n: F.when(w, F.regexp_extract_all(t, F.lit(p), F.lit(0))) for n, (w, p) in patterns.items()})
    found = found.withColumns({n: placed(t, p, F.col(n)) for n, (_, p) in patterns.items()})
    passes = lambda kind: lambda c: base_ok(kind, c["match"])
    featured = lambda kind: lambda c: _features(kind, c)
    as_span = lambda i: lambda c: F.struct(F.lit(i).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    no_base, no_code = F.expr("cast(array() as array<struct<kind: int, start: int, end: int>>)"), F.expr("cast(array() as array<struct<kind: int, start: int, end: int, code: int>>)")
    base = [F.coalesce(F.transform(F.filter(f"__b{i}__", passes(k)), as_span(i)), no_base) for i, k in enumerate(KINDS[:BASE_KINDS])]
    made = [F.coalesce(F.transform(f"__g{i}__", featured(k)), no_code) for i, (k, _) in enumerate(GENERATORS)]
    kept = [c for c in docs.columns if c.lower() not in ("base", "proposed")]
    return found.select(*[F.col(quoted(c)) for c in kept], F.concat(*base).alias("base"), _distinct(F.concat(*made)).alias("proposed"))


# Boosting ----------------------------------------------------------------------------------------------------------


class Trees:
    """Gradient-boosted trees of logistic loss on counted feature vectors, and a threshold for each kind, from counts of
    rows that were held back for this and from SEEDS."""

    def __init__(self, codes: list[int], positives: list[int], totals: list[int], held: tuple[list[int], list[int], list[int]] = ((), (), ())):
        self.x = np.concatenate([_vectors(codes), np.array([f for f, _, _ in SEEDS])])
        # a corpus count weighs as its square root, so that common formats don't drown rare ones
        n, p = np.array([*totals, *[w for *_, w in SEEDS]], float), np.array([*positives, *[w * y for _, y, w in SEEDS]], float)
        self.weight, self.rate = np.sqrt(n) * np.where(np.arange(len(n)) < len(codes), 1, np.sqrt(n)), p / n
        self.trees: list = []
        score = np.zeros(len(self.x))
        for _ in range(ROUNDS):
            prob = 1 / (1 + np.exp(-score))
            tree = self._grow(np.arange(len(self.x)), self.weight * (self.rate - prob), self.weight * prob * (1 - prob), DEPTH)
            self.trees.append(tree)
            score += self._apply(tree, self.x)
        # the thresholds come from rows held back, and from the formats of SEEDS
        others, seeds = np.concatenate([_vectors(held[0]), self.x[len(codes) :]]), slice(len(codes), None)
        n, p = np.array(held[2], float), np.array(held[1], float)
        weight, rate = np.concatenate([np.sqrt(n), self.weight[seeds]]), np.concatenate([p / n, self.rate[seeds]])
        self.thresholds = [self._threshold(k, self.probabilities(others), weight, rate, others[:, 0]) for k in range(len(KINDS))]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))))

    def _grow(self, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
        value = lambda r: RATE * grad[r].sum() / (hess[r].sum() + 1)
        worth = lambda r: grad[r].sum() ** 2 / (hess[r].sum() + 1)
        best = (1e-6, None)
        for f in range(self.x.shape[1]) if depth else ():
            for cut in np.unique(self.x[rows, f])[:-1]:
                low = self.x[rows, f] <= cut
                gain = worth(rows[low]) + worth(rows[~low]) - worth(rows)
                if gain > best[0]:
                    best = (gain, (f, int(cut), rows[low], rows[~low]))
        if best[1] is None:
            return float(value(rows))
        f, cut, low, high = best[1]
        return f, cut, self._grow(low, grad, hess, depth - 1), self._grow(high, grad, hess, depth - 1)

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self._apply(low, x), self._apply(high, x))

    @staticmethod
    def _threshold(kind: int, prob: np.ndarray, weight: np.ndarray, rate: np.ndarray, kinds: np.ndarray) -> float:
        """The lowest score from which on the weighted precision of a kind is PRECISION; at least a half."""
        own = np.flatnonzero(kinds == kind)
        order = own[np.argsort(-prob[own], kind="stable")]
        w = weight[order]
        precision = np.cumsum(w * rate[order]) / np.cumsum(w)
        last = np.append(np.diff(prob[order]) < 0, True)  # no threshold between equal scores
        good = np.flatnonzero((precision >= PRECISION) & last)
        return max(0.5, float(prob[order[good[-1]]])) if len(good) else 1.0

    def score(self, code: Column) -> Column:
        """The score of a packed code. Feature vectors are few (the product of CARDINALITY), so the trees are applied to
        each of them once, and a candidate looks its own up in a constant array."""
        scores = self.probabilities(_vectors(np.arange(np.prod(CARDINALITY))))
        return F.get(F.split(F.lit(",".join(f"{x:.9f}" for x in scores)), ",").cast("array<double>"), code)


def _vectors(codes) -> np.ndarray:
    """The features of packed codes, a row for each."""
    sizes = [int(np.prod(CARDINALITY[i + 1 :])) for i in range(len(CARDINALITY))]
    return np.array(codes, np.int64).reshape(-1, 1) // sizes % CARDINALITY


SPAN = "struct<start: int, later: int, end: int, kind: int, code: int>"


def _events(base: str, proposed: str) -> Column:
    """Base spans (later = 0) and candidates (later = 1) by start; of one start, base spans first."""
    made = lambda of, later, code: F.transform(of, lambda c: F.struct(c["start"].alias("start"), F.lit(later).alias("later"), c["end"].alias("end"), c["kind"].alias("kind"), code(c).alias("code")))
    return F.sort_array(F.concat(made(base, 0, lambda c: F.lit(0)), made(proposed, 1, lambda c: c["code"])))


def _held(base: str, proposed: str) -> Column:
    """Candidates as (code, held): whether a base span of the same kind holds them. Base spans of one kind don't overlap,
    so it's the last one before; its end is kept for each kind while the spans are read by start."""
    ends = lambda of: F.struct(*[of(k).alias(f"e{k}") for k in range(BASE_KINDS)])
    step = lambda s, x: ends(lambda k: F.when((x["later"] == 0) & (x["kind"] == k), x["end"]).otherwise(s[f"e{k}"]))
    last = lambda s, x: F.coalesce(*[F.when(x["kind"] == k, s[f"e{k}"]) for k in range(BASE_KINDS)], F.lit(-1))
    seen = _scan(_events(base, proposed), ends(lambda k: F.lit(-1)), step, lambda s, x: F.struct(x["later"].alias("later"), x["code"].alias("code"), (x["end"] <= last(s, x)).alias("held")), "struct<later: int, code: int, held: boolean>")
    return F.filter(seen, lambda c: c["later"] == 1)


def _clear(base: str, proposed: str) -> Column:
    """Candidates, by start, that touch no base span: none that began before ends behind their start, and none begins
    before their end."""
    ahead = _scan(_events(base, proposed), F.lit(-1), lambda s, x: F.when(x["later"] == 0, F.greatest(s, x["end"])).otherwise(s), lambda s, x: F.when((x["later"] == 1) & (x["start"] < s), None).otherwise(x), SPAN)
    back = _scan(F.reverse(F.filter(ahead, lambda x: x.isNotNull())), F.lit(2**31 - 1), lambda s, x: F.when(x["later"] == 0, x["start"]).otherwise(s), lambda s, x: F.when((x["later"] == 1) & (x["end"] <= s), x), SPAN)
    return F.reverse(F.filter(back, lambda x: x.isNotNull()))


RATED = "struct<rank: double, start: int, till: int, kind: int, end: int>"


def _best(rated: Column) -> Column:
    """Of spans by start, the best first, each that touches none chosen so far. Spans are parted where nothing reaches
    over a gap; within a part all are compared with those chosen."""
    touches = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    none = F.expr(f"cast(array() as array<{RATED}>)")
    fresh = lambda s, x: x["start"] >= s["end"]
    state = lambda end, part: F.struct(end.alias("end"), part.alias("part"))
    step = lambda s, x: F.when(fresh(s, x), state(x["end"], F.array(x))).otherwise(state(F.greatest(s["end"], x["end"]), F.concat(s["part"], F.array(x))))
    # a last entry behind all others ends the last part
    ended = F.concat(rated, F.array(F.struct(F.lit(0.0), F.lit(2**31 - 1), F.lit(0), F.lit(0), F.lit(2**31 - 1)).cast(RATED)))
    parts = _scan(ended, state(F.lit(-1), none), step, lambda s, x: F.when(fresh(s, x), s["part"]).otherwise(none), f"array<{RATED}>")
    chosen = lambda part: F.aggregate(F.sort_array(part), none, lambda kept, c: F.when(F.exists(kept, lambda o: touches(o, c)), kept).otherwise(F.concat(kept, F.array(c))))
    return F.flatten(F.transform(parts, lambda p: F.when(F.size(p) > 1, chosen(p)).otherwise(p)))


def fit(found: DataFrame) -> Trees:
    """From the result of candidates(); its rows are counted by feature vector, of which there are at most a fixed number.
    Rows of a quarter, by a hash of their candidates, are held back for the thresholds."""
    part = (F.pmod(F.xxhash64("proposed"), F.lit(4)) == 0).alias("back")
    seen = found.where(F.size("proposed") > 0).select(part, F.explode(_held("base", "proposed")).alias("c")).select("back", "c.*")
    features = unpacked(F.col("code"))
    label = (F.col("held") | ((features[FEATURES.index("context")] == 2) & (features[FEATURES.index("valid")] == 1))).cast("long")
    rows = seen.groupBy("back", "code").agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("n")).orderBy("code").collect()
    counts = lambda back: tuple([r[c] for r in rows if r["back"] == back] for c in ("code", "p", "n"))
    return Trees(*counts(False), counts(True))


def select_spans(found: DataFrame, trees: Trees) -> DataFrame:
    """The result of candidates() with spans, (start, kind number, end, kind), in place of proposed."""
    limits = F.array(*[F.lit(t) for t in trees.thresholds])
    rated = F.transform(_clear("base", "proposed"), lambda c: F.struct((-trees.score(c["code"])).alias("rank"), c["start"].alias("start"), (-c["end"]).alias("till"), c["kind"].alias("kind"), c["end"].alias("end")))
    scored = found.withColumn("__good__", F.when(F.size("proposed") > 0, F.filter(rated, lambda c: -c["rank"] >= F.get(limits, c["kind"]))).otherwise(F.expr(f"cast(array() as array<{RATED}>)")))
    names = F.array(*[F.lit(k) for k in KINDS])
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("number"), c["end"].alias("end"), F.get(names, c["kind"]).alias("kind"))
    added = F.when(F.size("__good__") > 0, _best(F.col("__good__"))).otherwise(F.col("__good__"))
    return scored.withColumn("spans", F.sort_array(F.concat(F.transform("base", span), F.transform(added, span)))).drop("__good__", "proposed")


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base and spans. Candidates are written to the shared folder once, for fitting and for selection."""
    renamed = docs.select(*[F.col(quoted(c)).alias(f"__{i}__") for i, c in enumerate(docs.columns)])
    found = as_table(candidates(renamed, f"__{docs.columns.index(text)}__"), "pii")
    made = select_spans(found, fit(found))
    kept = [(i, c) for i, c in enumerate(docs.columns) if c.lower() not in ("base", "spans")]
    return made.select(*[F.col(f"__{i}__").alias(c) for i, c in kept], "base", "spans")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span, joined where they overlap, replaced by its kind in brackets; same columns."""
    renamed = docs.select(*[F.col(quoted(c)).alias(f"__{i}__") for i, c in enumerate(docs.columns)])
    at = f"__{docs.columns.index(text)}__"
    found = find_pii(renamed, at)

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(F.col(at), a["done"] + 1, F.greatest(s["start"] - a["done"], F.lit(0)))
        out = F.when(s["start"] >= a["done"], F.concat(a["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(a["out"])
        return F.struct(F.greatest(a["done"], s["end"]).alias("done"), out.alias("out"))

    whole = F.aggregate("spans", F.struct(F.lit(0).alias("done"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col(at), a["done"] + 1, F.length(F.col(at)))))
    cut = found.withColumn(at, F.when(F.size("spans") > 0, whole).otherwise(F.col(at)))
    return cut.select(*[F.col(f"__{i}__").alias(c) for i, c in enumerate(docs.columns)])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = as_table(candidates(docs).drop("text"), "pii")
    made = select_spans(found, fit(found))
    names = F.array(*[F.lit(k) for k in KINDS])
    count = lambda i: F.size(F.filter("base", lambda b: b["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    ordered = F.sort_array(F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"))))
    listed = lambda of, kind: F.array_join(F.transform(of, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return made.select("doc_id", *[count(i) for i in range(BASE_KINDS)], F.sha2(listed(ordered, lambda s: F.get(names, s["kind"])).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans"), lambda s: s["kind"]).alias("spans"))
