"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

A word's vector is three hashed parts: two of the whole word, so that words rarely share both, and one of its first
letters. Filters of one to three words run over the whole text, their maxima are pooled and a logistic layer scores
them. The network is trained in numpy on the driver, on a bounded sample of labelled rows (MOST_LABELLED of either
label, chosen by a hash of the id, never from the held-out quarter). Thresholds for each language, as predicted from the
text, are calibrated on all rows of the sample, each scored by a network that other parts of it trained. The score is
scaled so that each language's threshold is THRESHOLD.

Defined results: a null or empty text has the score of no words; without labelled rows of both kinds every score is 0;
rows whose label is null are not learned from; repeated rows are scored each by itself; an empty table gives an empty
result; extra columns stay, and give way to an output of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import langid
from tallyforge.llm.common import alnum_words, quoted, table, with_outputs

#: Rows of either label that the network is fitted on at most.
MOST_LABELLED = 3000
THRESHOLD = 0.3
BITS, WORD_DIMS, PREFIX_DIMS, PREFIX_BYTES = 16, 8, 4, 7
WIDTHS, FILTERS = (1, 2, 3), 16
EPOCHS, BATCH, RATE = 5, 32, 0.05
#: Parts of the sample; each is scored, for the thresholds, by a network that the others train.
FOLDS = 3
#: In a language's threshold all other languages' rows weigh as much as so many rows of label 1, however many there are.
PRIOR = 10
#: Words scored at a time; longer texts are cut with an overlap, which pooling undoes.
BLOCK = 40_000
_MASK = (1 << BITS) - 1


class WordSlots(dict):
    """Word -> its three slots in one number, remembered for up to ``most`` words."""

    def __init__(self, most: int = 60_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        whole, first = xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(word[:PREFIX_BYTES], 1)
        self[word] = v = (whole & _MASK) | (whole >> BITS & _MASK) << BITS | (first & _MASK) << 2 * BITS
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        packed = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.stack([packed & _MASK, packed >> BITS & _MASK, packed >> 2 * BITS], axis=1).astype(np.uint16)


@dataclass
class Network:
    tables: list[np.ndarray]
    kernels: list[np.ndarray]  # by width: (width, dims, filters)
    biases: list[np.ndarray]
    out: np.ndarray
    constant: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def vectors(self, slots: np.ndarray) -> np.ndarray:
        return np.concatenate([t[slots[:, i]] for i, t in enumerate(self.tables)], axis=1)

    def laid_out(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word vectors of all documents with blank rows after each, the documents' first rows and how many windows begin
        in each: one at every word and one after the last, so that none reaches the next document."""
        blank = max(WIDTHS)
        sizes = np.array([len(d) + blank for d in docs])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x = np.zeros((sizes.sum() + blank + 1, sum(t.shape[1] for t in self.tables)), np.float32)
        keep = np.ones(len(x), bool)
        for s, d in zip(starts, docs, strict=True):
            keep[s + len(d) : s + len(d) + blank] = False
        keep[sizes.sum() :] = False
        if keep.any():
            x[keep] = self.vectors(np.concatenate([d for d in docs if len(d)]))
        return x, starts, sizes - blank + 1

    def convolved(self, x: np.ndarray, width: int) -> np.ndarray:
        kernel = self.kernels[width - 1]
        n = len(x) - max(WIDTHS)
        return sum(x[j : j + n] @ kernel[j] for j in range(width))

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.constant

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        parts, owner, last = [], [], []
        for i, d in enumerate(docs):
            for at in range(0, max(1, len(d)), BLOCK):
                parts.append(d[at : at + BLOCK + max(WIDTHS) - 1])
                owner.append(i)
                last.append(at + BLOCK >= len(d))
        pooled = np.full((len(docs), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        group, size = [], 0
        for k in range(len(parts) + 1):
            if group and (k == len(parts) or size + len(parts[k]) > BLOCK):
                x, starts, sizes = self.laid_out([parts[g] for g in group])
                # a part that goes on has its windows' beginnings up to the next part's only
                ends = starts + np.where([last[g] for g in group], sizes, BLOCK)
                bounds = np.stack([starts, ends], axis=1).ravel()
                maxima = np.concatenate([np.maximum.reduceat(self.convolved(x, w), bounds, axis=0)[::2] + b for w, b in zip(WIDTHS, self.biases, strict=True)], axis=1)
                np.maximum.at(pooled, [owner[g] for g in group], maxima)
                group, size = [], 0
            if k < len(parts):
                group.append(k)
                size += len(parts[k])
        return 1 / (1 + np.exp(-self.logits(np.maximum(pooled, 0)).clip(-30, 30)))

    def calibrated(self, score: float, lang: str | None) -> float:
        """The score, scaled so that the language's threshold becomes THRESHOLD."""
        t = self.thresholds.get(lang, self.threshold)
        return THRESHOLD * score / t if score < t else THRESHOLD + (1 - THRESHOLD) * (score - t) / max(1 - t, 1e-9)


def train(docs: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Network:
    """Adagrad on batches of both labels in equal parts. One dimension of each table starts as how far a slot's
    document frequency among label 1 is from what it would be by chance, in standard deviations."""
    rng = np.random.default_rng(seed)
    size, share = 1 << BITS, labels.mean()
    dims = [WORD_DIMS, WORD_DIMS, PREFIX_DIMS]
    tables = [rng.normal(0, 0.1, (size, d)).astype(np.float32) for d in dims]
    for i, t in enumerate(tables):
        seen = np.zeros((2, size))
        for d, y in zip(docs, labels, strict=True):
            seen[int(y), np.unique(d[:, i])] += 1
        expected = seen.sum(axis=0) * share
        t[:, 0] = ((seen[1] - expected) / np.sqrt(expected + 1)).clip(-3, 6) / 3
    total = sum(dims)
    kernels = [rng.normal(0, 0.15, (w, total, FILTERS)).astype(np.float32) for w in WIDTHS]
    firsts = np.cumsum([0, *dims[:-1]])
    for k in kernels:
        k[:, firsts, : FILTERS // 2] += 0.4
    net = Network(tables, kernels, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)
    params = [*net.tables, *net.kernels, *net.biases, net.out]
    sums = [np.full(p.shape, 1e-2, np.float32) for p in params]

    def descend(i: int, grad: np.ndarray) -> None:
        sums[i] += grad * grad
        params[i] -= RATE * grad / np.sqrt(sums[i])

    ones, zeros = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    constant_sum = 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(zeros)
        for at in range(0, len(order), BATCH // 2):
            some = order[at : at + BATCH // 2]
            chosen = np.concatenate([some, rng.choice(ones, len(some))])
            x, starts, sizes = net.laid_out([docs[i] for i in chosen])
            slots = np.zeros((len(x), 3), np.int64)
            for s, i in zip(starts, chosen, strict=True):
                slots[s : s + len(docs[i])] = docs[i]
            real = np.zeros(len(x), bool)
            for s, i in zip(starts, chosen, strict=True):
                real[s : s + len(docs[i])] = True
            pooled, places = [], []
            for w, b in zip(WIDTHS, net.biases, strict=True):
                c = net.convolved(x, w)
                at_max = np.array([s + c[s : s + n].argmax(axis=0) for s, n in zip(starts, sizes, strict=True)])
                places.append(at_max)
                pooled.append(np.take_along_axis(c, at_max, axis=0) + b)
            raw = np.concatenate(pooled, axis=1)
            active = np.maximum(raw, 0)
            d = (1 / (1 + np.exp(-net.logits(active).clip(-30, 30))) - (labels[chosen] == 1)) / len(chosen)
            back = d[:, None] * net.out[None, :] * (raw > 0)
            rows, grads = [], []
            kernel_grads = []
            for k, (w, place) in enumerate(zip(WIDTHS, places, strict=True)):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                grad = np.empty_like(net.kernels[k])
                for j in range(w):
                    grad[j] = np.einsum("nf,nfd->df", g, x[place + j])
                    rows.append((place + j).ravel())
                    grads.append((g[:, :, None] * net.kernels[k][j].T[None]).reshape(-1, total))
                kernel_grads.append((grad, g.sum(axis=0)))
            for k, (grad, bias) in enumerate(kernel_grads):
                descend(3 + k, grad + 1e-4 * net.kernels[k])
                descend(3 + len(WIDTHS) + k, bias)
            descend(3 + 2 * len(WIDTHS), active.T @ d.astype(np.float32) + 1e-4 * net.out)
            slope = float(d.sum())
            constant_sum += slope * slope
            net.constant -= RATE * slope / constant_sum**0.5
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            used = real[rows] & (np.abs(grads).max(axis=1) > 0)
            rows, grads = rows[used], grads[used]
            for i, (a, n) in enumerate(zip(firsts, dims, strict=True)):
                slot, back_to = np.unique(slots[rows, i], return_inverse=True)
                grad = np.zeros((len(slot), n), np.float32)
                np.add.at(grad, back_to, grads[:, a : a + n])
                sums[i][slot] += grad * grad
                net.tables[i][slot] -= RATE * grad / np.sqrt(sums[i][slot])
    return net


def platt(z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Chances of label 1 by a weighted logistic line through log odds z, by Newton's method. Targets are drawn in from 0
    and 1 as if each label had one more row of the other, so few rows that part well don't make a steep line."""
    ones, zeros = weights[labels == 1].sum(), weights[labels == 0].sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([z, np.ones(len(z))], axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ line).clip(-30, 30)))
        slope = x.T @ (weights * (p - target)) + 1e-3 * (line - [1, 0])
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        line -= step * min(1, 2 / np.abs(step).max(initial=1e-9))
        if np.abs(step).max() < 1e-6:
            break
    line[0] = max(line[0], 1e-3)  # a higher score is never a lower chance
    return 1 / (1 + np.exp(-(x @ line).clip(-30, 30)))


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Midway between the two scores whose parting has the best F1 that the calibrated chances let expect."""
    inner = scores.astype(float).clip(1e-6, 1 - 1e-6)
    chances = platt(np.log(inner / (1 - inner)), labels, weights)
    order = np.argsort(-scores)
    s, w, hit = scores[order], weights[order], (weights * chances)[order]
    f1 = 2 * np.cumsum(hit) / (np.cumsum(w) + hit.sum())
    last = np.append(np.diff(s) < 0, True)  # no threshold between equal scores
    best = int(np.argmax(np.where(last, f1, -1)))
    below = s[best + 1] if best + 1 < len(s) else 0.0
    return float(np.clip((s[best] + below) / 2, 0.02, 0.98))


@dataclass
class ToxicityModel:
    network: Network | None
    languages: langid.LanguageModel


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", lang: str = "lang", most_labelled: int = MOST_LABELLED) -> ToxicityModel:
    """Labels are joined by id; the chosen ids are at most about 2 * most_labelled, so they are broadcast."""
    languages = langid.fit(docs, text, lang, id_col, docs_per_language=400) if lang in docs.columns else langid.LanguageModel([])
    learned = labels.where(F.col(quoted(label)).isin(0, 1) & ~F.coalesce(langid.held_out(id_col), F.lit(True)))
    ids = learned.groupBy(F.col(quoted(id_col)).alias("__id__")).agg(F.max(quoted(label)).alias("__label__"))
    chosen = langid.sample_of(ids, "__label__", "__id__", most_labelled).limit(3 * most_labelled)
    rows = docs.select(F.col(quoted(id_col)).alias("__id__"), F.col(quoted(text)).cast("string").alias("text")).join(F.broadcast(chosen), "__id__")
    rows = rows.where("text is not null").groupBy("__id__").agg(F.min(F.struct("text", "__label__")).alias("row")).select("__id__", "row.*")
    # words become slots, and languages are told, on the executors: the driver gets 6 bytes for a word
    known_languages = docs.sparkSession.sparkContext.broadcast(languages)

    def make():
        slots, identifier = WordSlots(), langid.Identifier(known_languages.value)
        return lambda texts: [[slots.of(alnum_words(t)).tobytes() for t in texts], [identifier.predict(t)[0] for t in texts]]

    rows = with_outputs(rows, "text", make, "slots binary, spoken string", drop=("text",)).orderBy("__id__").collect()
    y = np.array([r["__label__"] for r in rows])
    if len(set(y.tolist())) < 2:
        return ToxicityModel(None, languages)
    part = np.array([xxhash.xxh3_64_intdigest(str(r["__id__"]), 3) % FOLDS for r in rows])
    spoken = np.array([r["spoken"] for r in rows])
    texts = [np.frombuffer(r["slots"], np.uint16).reshape(-1, 3) for r in rows]
    del rows
    network, scores, judged = train(texts, y), np.zeros(len(y)), np.zeros(len(y), bool)
    for k in range(FOLDS):  # each row is scored by a network that hasn't learned from it
        own = np.flatnonzero(part == k)
        others = np.flatnonzero(part != k)
        if len(own) and len(set(y[others].tolist())) == 2:
            scores[own] = train([texts[i] for i in others], y[others]).scores([texts[i] for i in own])
            judged[own] = True
    if len(set(y[judged].tolist())) < 2:  # a handful of rows: their own scores must do
        scores, judged = network.scores(texts), np.ones(len(y), bool)
    scores, y, spoken = scores[judged], y[judged], spoken[judged]
    network.threshold = best_threshold(scores, y, np.ones(len(y)))
    for lang_value in sorted(set(spoken.tolist())):
        own = spoken == lang_value
        if (y[own] == 1).any():
            elsewhere = min(1.0, PRIOR / max(1, (y[~own] == 1).sum()))
            network.thresholds[lang_value] = best_threshold(scores, y, np.where(own, 1.0, elsewhere))
    return ToxicityModel(network, languages)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs``, but for the columns in ``drop``, with score (0 to 1) and predicted (1 if score >= THRESHOLD). Only the
    text is read."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = known.value
        slots, identifier = WordSlots(), langid.Identifier(m.languages)

        def work(texts):
            if m.network is None:
                return [[0.0] * len(texts), [0] * len(texts)]
            raw = m.network.scores([slots.of(alnum_words(t)) for t in texts]) if texts else []
            made = [float(np.clip(m.network.calibrated(float(s), identifier.predict(t)[0]), 0, 1)) for s, t in zip(raw, texts, strict=True)]
            return [made, [int(s >= THRESHOLD) for s in made]]

        return work

    return with_outputs(docs, text, make, "score double, predicted int", drop)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Documents that are not predicted to be toxic; the columns are those of ``docs``."""
    renamed = docs.select(*[F.col(quoted(c)).alias(f"__{i}__") for i, c in enumerate(docs.columns)])
    kept = score(renamed, model, f"__{docs.columns.index(text)}__").where("predicted = 0")
    return kept.select(*[F.col(f"__{i}__").alias(c) for i, c in enumerate(docs.columns)])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    found = score(docs.select("doc_id", "text", F.coalesce(langid.held_out("doc_id"), F.lit(False)).alias("held_out")), model, drop=("text",))
    return found.select("doc_id", "held_out", "score", "predicted")
