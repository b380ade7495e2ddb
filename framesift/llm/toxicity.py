"""Operator 4: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed unigrams, bigrams and one-word skip-grams of the whole text (words of
letters and digits, case folded), each with value 1.  Training follows the FTRL-proximal
update: every coordinate has its own learning rate from its own sum of squared gradients, and an L1 term
keeps coordinates at exactly zero until their evidence exceeds it, so the weights that remain are few.

Training is fitted on about ``TRAIN_ROWS`` labelled ids at most (chosen by a hash of doc_id), one row of each, and of those on as many
as have about ``TRAIN_FEATURES`` features together (both documented bounds): their features are hashed in parallel, and one task runs the
sequential updates over them.  ``HELD_BACK`` of them only choose the operating point, the margin with the best F1, which the
bias takes up, so that a score of 0.5 is the decision.  Weights are at most 2**``BITS`` numbers, which
bounds what is broadcast.  Scoring reads every row once.

Defined results: null and blank texts have only the bias; documents without a label, or with a null
one, are scored but not learned from; repeated rows are scored one by one, and of those that repeat a labelled doc_id the one with the greatest features is learned from; without any labelled row to learn
from all scores are 0; a null doc_id counts as held out False and is never learned from;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from framesift.llm.arrow import map_rows
from framesift.llm.words import MIX, hash_share, mixed
from framesift.plans.shared import write_shared

BITS = 20
TRAIN_ROWS = 16_000
#: Features in the training task, four bytes each.
TRAIN_FEATURES = 32_000_000
HELD_BACK = 0.15
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
TOKEN = re.compile(r"[^\W_]+")
SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
FEATURES = T.StructType([T.StructField("order", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("features", T.ArrayType(T.IntegerType()))])
WEIGHTS = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("weight", T.DoubleType())])


class Hasher:
    """Feature indices of texts; hashes of words are remembered."""

    def __init__(self, bits: int = BITS, limit: int = 300_000) -> None:
        self.size, self.limit, self.known = np.uint64((1 << bits) - 1), limit, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct indices; index 0 is the bias, present in every text."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
        hashes = []
        for w in TOKEN.findall((text or "").casefold()):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 7)
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        with np.errstate(over="ignore"):
            parts = [h, mixed(h[:-1] * MIX + h[1:]), mixed(h[:-2] * MIX + h[2:] + np.uint64(3))]
        return np.unique(np.r_[np.uint64(0), np.concatenate(parts) % self.size + np.uint64(1)]).astype(np.int64)


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """The FTRL-proximal state: z and n of every coordinate."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, bound: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most about ``bound`` labelled rows for which ``learn`` holds.

    The share of labelled ids to take follows from their number; the ids taken are bounded, so they
    are broadcast and the texts never shuffled.
    """
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(learn)
    taken = ids.where(hash_share(4, bound, ids.count(), "doc_id"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "doc_id")


def best_margin(margins: np.ndarray, labels: np.ndarray) -> float:
    """The margin between two examples from which on "positive" has the best F1; 0 without both labels."""
    if not 0 < labels.sum() < len(labels):
        return 0.0
    order = np.argsort(-margins, kind="stable")
    m, y = margins[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][m[:-1] == m[1:]] = -1  # equal margins fall on one side
    i = int(np.argmax(f1))
    return float((m[i] + m[i + 1]) / 2) if i + 1 < len(m) else float(m[i])


def _train(bits: int, epochs: int):
    def run(tables):
        import pandas as pd

        examples = sorted(((o, np.array(f, np.int32), int(y)) for t in tables for o, y, f in zip(t["order"], t["toxic"], t["features"], strict=True)), key=lambda e: (e[0], e[2], len(e[1])))
        kept = int(len(examples) * (1 - HELD_BACK))
        model = Ftrl(1 << bits)
        for _ in range(epochs):
            for _, at, label in examples[:kept]:
                model.learn(at, label)
        used = np.flatnonzero(np.abs(model.z) > model.l1)
        weights = np.zeros(1 << bits)
        weights[used] = model.weights(used)
        rest = examples[kept:]
        weights[0] -= best_margin(np.array([weights[at].sum() for _, at, _ in rest]), np.array([y for *_, y in rest], int))
        used = np.flatnonzero(weights)
        yield pd.DataFrame({"at": used.astype(np.int32), "weight": weights[used]})

    return run


def train(rows: DataFrame, bits: int = BITS, epochs: int = EPOCHS, most_features: int = TRAIN_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights of the coordinates that are not zero; the ids in ``rows`` are bounded by ``training_rows``."""

    def features(examples: Iterator[tuple]) -> Iterable[tuple]:
        hasher = Hasher(bits)
        return ((order, toxic, hasher(text).tolist()) for order, toxic, text in examples)

    hashed = map_rows(rows.select(F.xxhash64(F.lit(6), "doc_id"), "toxic", "text"), features, FEATURES, weight=lambda r: 4 * len(r[2]))
    one = write_shared(hashed.groupBy("order").agg(F.max(F.struct("toxic", "features")).alias("_x")).select("order", "_x.*"), "toxic-features")
    total = one.agg(F.sum(F.size("features"))).first()[0] or 0
    found = one.where(hash_share(5, most_features, total, "order")).repartition(1).mapInPandas(_train(bits, epochs), WEIGHTS).toPandas()
    return found["at"].to_numpy(np.int64), found["weight"].to_numpy(float)


def score(docs: DataFrame, at: np.ndarray, weight: np.ndarray, bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every row; the compact weights are broadcast."""
    held = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weight))

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        weights, hasher = np.zeros(1 << bits), Hasher(bits)
        indices, values = held.value
        weights[indices] = values
        for doc_id, text in rows:
            yield doc_id, float(sigmoid(weights[hasher(text)].sum())) if len(indices) else 0.0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, run, SCORES)


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, bound: int = TRAIN_ROWS) -> DataFrame:
    """Scores of all documents by a model of the labelled rows for which ``learn`` (over doc_id) holds."""
    at, weight = train(training_rows(docs, labels, learn, bound))
    return score(docs, at, weight)
