"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only the document has a label. A sentence's score is a
logistic function of its words, each as often as it occurs, and the bag's is their noisy-or, 1 - prod(1 - p): one
offending sentence is enough. The weights are fitted to the documents' labels through
the noisy-or, and the fitted sentence scores then say where the offence is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import map_rows

#: The most labelled documents that the classifier is fitted on (by hash of doc_id).
MAX_LABELLED = 4000
#: A feature is used if so many of the toxic labelled texts hold it, and if the likelihood ratio
#: statistic of label against feature is at least this.
MIN_DOCS, MIN_G2 = 4, 16.0
#: Lengths of stems. A stem is the only sign of words that are too rare each to be learnt.
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.7
_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGES = ".,;:!?\"'()[]{}<>%#*&$|_-"


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences with a word."""
    return [m.span() for m in _SENTENCE.finditer(text) if not m.group().isspace()]


def words(sentence: str) -> list[str]:
    return [x for w in sentence.lower().replace(",", " ").split() if (x := w.strip(_EDGES))]


def features(word: str) -> tuple[str, ...]:
    """A word, and the stems of STEMS letters that longer words begin with."""
    return (word, *(f"{word[:n]}*" for n in STEMS if len(word) > n))


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    starts: set = field(init=False)

    def __post_init__(self):
        self.starts = {w[:4] for w in self.weights}

    def sentence_scores(self, text: str) -> list[float]:
        return [p for _, _, p in self.scored_sentences(text)]

    def scored_sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of every sentence with a word."""
        get, starts, out = self.weights.get, self.starts, []
        plain = 1 / (1 + math.exp(-self.bias))
        for a, z in sentences(text):
            w = words(text[a:z])
            if w:
                odd = [x for x in w if x[:4] in starts]
                if odd:
                    total = self.bias + sum(get(f, 0.0) for x in odd for f in features(x))
                    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))
                else:
                    p = plain
                out.append((a, z, p))
        return out

    def score(self, text: str) -> float:
        return noisy_or(self.sentence_scores(text))


def noisy_or(p: list[float]) -> float:
    """0 for an empty bag."""
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if p else 0.0


def select(bags: list[list[list]], y: list[int]) -> dict[str, int]:
    """The features that toxic texts hold more often than chance has it, numbered."""
    n = Counter(y)
    held: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for bag, label in zip(bags, y, strict=True):
        held[label].update({f for s in bag for f in s})
    out = []
    for f, k1 in held[1].items():
        k0 = held[0][f]
        if k1 < MIN_DOCS or k1 * n[0] <= k0 * n[1]:
            continue
        p = (k0 + k1) / (n[0] + n[1])
        g2 = sum(2 * x * math.log(x / e) for x, e in ((k1, n[1] * p), (n[1] - k1, n[1] * (1 - p)), (k0, n[0] * p), (n[0] - k0, n[0] * (1 - p))) if x and e)
        if g2 >= MIN_G2:
            out.append(f)
    return {f: i for i, f in enumerate(sorted(out))}


def fit(texts: list[str], labels: list[int], epochs: int = 300, rate: float = 0.1, l2: float = 0.05) -> Model:
    """Full-batch Adam on the log loss of the noisy-or; deterministic. Equal texts count once, as
    toxic if any of them is. Without texts of both labels there is nothing to learn: every
    score is then close to 0."""
    one: dict[str, int] = {}
    for t, v in zip(texts, labels, strict=True):
        one[t] = max(one.get(t, 0), int(v > 0))
    bags = {t: [[f for w in words(t[a:z]) for f in features(w)] for a, z in sentences(t)] for t in one}
    bags = {t: [s for s in b if s] for t, b in bags.items()}
    y = np.array([one[t] for t, b in bags.items() if b], float)
    bags = [b for b in bags.values() if b]
    if not len(y) or y.min() == y.max():
        return Model(-12.0, {})
    vocab = select(bags, y.astype(int).tolist())
    sent_doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    flat = [[vocab[f] for f in s if f in vocab] for b in bags for s in b]
    col = np.array([i for s in flat for i in s], np.int64)
    row = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    w, bias = np.zeros(len(vocab)), -4.0
    m, v, n_docs = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1), len(bags)
    for t in range(1, epochs + 1):
        z = np.clip(np.bincount(row, w[col], len(flat)) + bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        log_q = np.minimum(np.bincount(sent_doc, np.log1p(-p), n_docs), -1e-9)
        bag = -np.expm1(log_q)
        # d loss / d z of a sentence: p where the label is 0, and -p (1 - bag) / bag where it is 1
        g = p * np.where(y > 0, -(1 - bag) / np.maximum(bag, 1e-9), 1.0)[sent_doc] / n_docs
        grad = np.r_[np.bincount(col, g[row], len(vocab)) + l2 * w / n_docs, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(float(bias), {x: float(w[i]) for x, i in vocab.items()})


def held_out():
    """Rows that no label is learnt from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most max_labelled documents that aren't held out. Repeated labels of a document
    count once, 1 before 0, and of several texts of one doc_id the first in order; null labels and null doc_ids are passed over."""
    one = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    # at most max_labelled rows of two numbers: bounded for a broadcast
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").join(F.broadcast(one), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text or "" for r in rows], [r.toxic for r in rows])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, worst_start, worst_end (code
    points of the sentence that scores highest; null where there is no sentence). Null text
    counts as empty, of score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows):
        m = shared.value
        for doc_id, out, text in rows:
            scored = m.scored_sentences(text)
            p = [x for _, _, x in scored]
            score, worst = noisy_or(p), (None, None)
            if score >= THRESHOLD:
                worst = scored[int(np.argmax(p))][:2]
            yield doc_id, out, score, int(score >= THRESHOLD), *worst

    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(rows, "doc_id long, held_out boolean, score double, predicted int, worst_start int, worst_end int", run)


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, score of every sentence that scores threshold or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows):
        m = shared.value
        for doc_id, text in rows:
            for a, z in sentences(text or ""):
                p = m.score(text[a:z])
                if p >= threshold:
                    yield doc_id, a, z, p

    return map_rows(docs.select("doc_id", "text"), "doc_id long, start int, end int, score double", run)
