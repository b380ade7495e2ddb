"""Operator 7: document quality by hierarchical empirical Bayes.

A logistic classifier over statistics of the whole text gives each document's evidence as log odds
against the training rate of good documents.  Hosts and paths below them (here: source, and source with
language) get Beta posteriors of their rate of good documents from the documents' soft labels:

    host = (good + k1 * global) / (n + k1),   path = (good + k2 * host) / (n + k2)

with the strengths k1 and k2 estimated from the spread of the rates between groups (method of moments), so
sparse sites shrink toward the global rate and rich ones speak for themselves.  The final probability adds
the document's evidence to the path's log odds.

Texts are read once into a small table of statistics; the sums per group are combined before the
shuffle, so a hot source costs one row a task.  The classifier is fitted on about ``TRAIN_ROWS``
labelled rows at most (chosen by a hash of doc_id, a documented bound).

Defined results: null and blank texts have zero statistics and quality 0, and are rejected; null
sources and languages are groups of their own; rows without a label, or with a null one, are scored
but not learned from; repeated rows are scored one by one, and of those that repeat a labelled doc_id the one with the greatest statistics is learned from; without labels of both kinds, the evidence
is 0 and the probability 0.5, which keeps the document; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from framesift.llm.arrow import map_rows
from framesift.llm.words import hash_share, row_keys
from framesift.plans.shared import write_shared

TRAIN_ROWS = 16_000
#: Bounds of the estimated strengths, in documents.
STRENGTH = (1.0, 10_000.0)
FEATURES = ["log_words", "mean_word", "upper", "symbols", "digits", "pipes", "repeated_words", "same_as_before", "top_word", "repeated_lines", "ends", "letters"]
STATISTICS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("row", T.LongType()), T.StructField("row2", T.LongType()), *(T.StructField(f, T.DoubleType()) for f in FEATURES),
])
LETTERS = re.compile(r"[^\W\d_]+")
SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()-]|!!|\|")


def statistics(text: str | None) -> list[float]:
    """The values of ``FEATURES``; ratios are of characters, words or lines."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(FEATURES)
    letters = sum(map(len, LETTERS.findall(text)))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    longest = max((c * len(w) for w, c in counts.items()), default=0)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(n), (chars - n + 1) / n, upper / n, sum(map(len, SYMBOLS.findall(text))) / chars, sum(c.isdigit() for c in set(text)) and len(re.findall(r"\d", text)) / chars,
        text.count("|") / n, 1 - len(counts) / n, same / n, longest / chars, 1 - len(set(lines)) / max(1, len(lines)),
        sum(x[-1] in ".!?" for x in lines) / max(1, len(lines)), letters / chars,
    ]


def _statistics(rows: Iterator[tuple]) -> Iterable[tuple]:
    for doc_id, host, path, row, row2, text in rows:
        yield (doc_id, host, path, row, row2, *map(float, statistics(text)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge-regularised logistic regression (bias last) by iteratively reweighted least squares."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def expanded(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised statistics and their squares, held within five spreads."""
    z = np.clip((x - mean) / spread, -5, 5)
    return np.c_[z, z * z]


def classifier(stats: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, spread, weights, rate of good documents) from at most about ``bound`` labelled ids, one row of each."""
    ids = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    taken = ids.where(hash_share(7, bound, ids.count(), "doc_id"))
    one = stats.join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(F.max(F.struct(*FEATURES)).alias("x"), F.max("quality").alias("quality"))
    rows = one.select("doc_id", "x.*", "quality").toPandas().sort_values("doc_id")
    x, y = rows[FEATURES].to_numpy(float), rows["quality"].to_numpy(float)
    width = len(FEATURES)
    if not 0 < y.sum() < len(y):
        return np.zeros(width), np.ones(width), np.zeros(2 * width + 1), 0.5
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    return mean, spread, fit_logistic(expanded(x, mean, spread), y), float(y.mean())


def evidence(stats: DataFrame, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, rate: float) -> DataFrame:
    """Adds ``evidence``, the classifier's log odds less those of the training rate, and ``soft``, its probability."""
    if not weights.any():
        return stats.withColumn("evidence", F.lit(0.0)).withColumn("soft", F.lit(rate))
    logit = F.lit(float(weights[-1]))
    for i, name in enumerate(FEATURES):
        z = F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col(name) - float(mean[i])) / float(spread[i])))
        logit = logit + z * float(weights[i]) + z * z * float(weights[len(FEATURES) + i])
    with_logit = stats.withColumn("logit", F.greatest(F.lit(-15.0), F.least(F.lit(15.0), logit)))
    prior = math.log(rate / (1 - rate))
    return with_logit.withColumn("evidence", F.col("logit") - prior).withColumn("soft", 1 / (1 + F.exp(-F.col("logit")))).drop("logit")


def strength(groups: DataFrame, parent: str) -> float:
    """The Beta strength that explains how group rates spread around ``parent`` (method of moments)."""
    n, rate = F.col("n"), F.col("good") / F.col("n")
    sums = groups.where("n >= 2").agg(
        F.sum(n * (rate - F.col(parent)) ** 2).alias("between"), F.sum(F.col(parent) * (1 - F.col(parent))).alias("noise"),
        F.sum(F.col(parent) * (1 - F.col(parent)) * n).alias("scale"),
    ).first()
    if not sums["scale"]:
        return STRENGTH[1]
    excess = (sums["between"] or 0.0) - sums["noise"]
    variance = excess / sums["scale"]  # the share of the largest possible variance that groups show beyond chance
    return STRENGTH[1] if variance <= 0 else min(STRENGTH[1], max(STRENGTH[0], 1 / variance - 1))


def with_site(pages: DataFrame, url: str = "url", levels: int = 1) -> DataFrame:
    """Adds ``host`` (lower case, without www. and port) and ``path`` (the first ``levels`` folders) of a url; null for none."""
    whole = F.col(url).cast("string")
    host = F.regexp_extract(F.lower(whole), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    path = F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*((?:/[^/?#]+(?=/)){0,%d})" % levels, 1)
    return pages.withColumns({"host": F.when(host != "", host), "path": F.when(host != "", path)})


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", bound: int = TRAIN_ROWS) -> DataFrame:
    """Per row: doc_id, row, row2, host, path, evidence, host_rate, path_rate, quality (probability of good), keep.

    ``row`` and ``row2`` are two hashes of id and text that tell repeated ids apart.  ``host`` and ``path`` name columns of
    ``docs``; ``with_site`` derives them from a url.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"),
        *row_keys(docs), text.alias("text"),
    )
    stats = write_shared(map_rows(rows, _statistics, STATISTICS), "statistics")
    mean, spread, weights, rate = classifier(stats, labels, bound)
    scored = evidence(stats, mean, spread, weights, rate)
    paths = write_shared(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("soft").alias("good")), "paths")
    whole = paths.agg((F.sum("good") / F.sum("n")).alias("rate")).first()["rate"]
    overall = min(1 - 1e-6, max(1e-6, 0.5 if whole is None else float(whole)))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("parent", F.lit(overall))
    k1 = strength(hosts, "parent")
    host_rates = hosts.select(F.col("host").alias("of_host"), ((F.col("good") + k1 * F.col("parent")) / (F.col("n") + k1)).alias("host_rate"))
    known = write_shared(paths.join(host_rates, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host"), "path-rates")
    k2 = strength(known, "host_rate")
    path_rates = known.select(
        F.col("host").alias("of_host"), F.col("path").alias("of_path"), "host_rate", ((F.col("good") + k2 * F.col("host_rate")) / (F.col("n") + k2)).alias("path_rate")
    )
    same = scored["host"].eqNullSafe(path_rates["of_host"]) & scored["path"].eqNullSafe(path_rates["of_path"])
    joined = scored.join(path_rates, same)
    probability = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))))))
    has_words = F.col("log_words") > 0
    final = joined.withColumn("quality", F.when(has_words, probability).otherwise(F.lit(0.0)))
    return final.select("doc_id", "row", "row2", "host", "path", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= 0.5).alias("keep"))
