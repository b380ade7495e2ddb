"""Operator 12: quality rules as a learned decision list.

Each text gets a few interpretable statistics.  Sequential covering learns from labelled rows when to reject: a rule grows on
two thirds of them by adding the threshold condition with the greatest information gain until it covers no good row, is pruned
from its end on the other third, and is kept if its precision there, with one row of each kind added, is at least
``PRECISION``; what it covers is set aside and the next rule is learned from the rest, until one fails.  The rules become
one ordered conditional expression of Spark (``verdict``) or of SQL (``verdict_sql``): the first that holds decides, and none keeps the text.

Fixed base rules come first: fewer than ``LEAST_WORDS`` words, or more than ``MOST_REPEATED`` per cent of them in windows of eight words that
occur again.  Rules are learned from rows that pass these.

The fit takes about ``TRAIN_ROWS`` labelled ids at most, by a hash (a documented bound), and one row of each id; everything else covers
every row, and whole texts.

Defined results: null and blank texts have zero statistics and fail the base rules; rows without a label, or with a null one, are judged but
not learned from; of rows that repeat a labelled doc_id the one with the greatest statistics is learned from, all are judged one by one; a null doc_id is
never learned from; without labels of both kinds there are no rules, and the base rules alone decide; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from framesift.llm.arrow import map_rows
from framesift.llm.words import hash_share
from framesift.plans.shared import write_shared

TRAIN_ROWS = 16_000
LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8
PRECISION = 0.8
#: Bounds of the list and of a rule, and the thresholds tried for a statistic at each step.
MOST_RULES, MOST_CONDITIONS, CUTS = 32, 5, 48

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["mean_word", "symbols", "dup_lines", "repeated", "distinct_words", "top_word", "same_as_before", "upper_words", "digits", "punctuation", "letters", "line_words", "line_ends"]
FEATURES = ["n_words", *SHARES]
STATISTICS = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(c, T.DoubleType()) for c in SHARES)])

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
_ASCII_LETTERS = bytes(b for b in range(128) if chr(b).isalpha())
_DIGITS = b"0123456789"
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def repeated_words(ids: np.ndarray, size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` (a power of two) words that occurs more than once; exact, by doubling ranks."""
    ranks, reach = ids, 1
    while reach < size:
        if len(ids) < 2 * reach:
            return 0
        pairs = ranks[:-reach] * (int(ranks.max()) + 1) + ranks[reach:]
        found, ranks = np.unique(pairs, return_inverse=True)
        if len(found) == len(pairs):
            return 0  # longer windows are distinct too
        reach *= 2
    often = np.bincount(ranks)[ranks] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def repeated_lines(text: str) -> tuple[int, int, int]:
    """Lines with a word, those equal to an earlier one, and those that end in a stop."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines), len(lines) - len(set(lines)), sum(x.rstrip(BLANKS)[-1] in ".!?:;\"”»" for x in lines)


def statistics(text: str | None) -> tuple:
    """The values of ``COUNTS`` and ``SHARES``."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS))
    if not n:
        return (0, 0, symbols, 0, 0, *[0.0] * len(SHARES))
    chars = len(text) - sum(map(text.count, BLANKS))
    counts = Counter(words)
    number = {w: i for i, w in enumerate(counts)}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    lines, again, ends = repeated_lines(text)
    repeated = repeated_words(ids)
    letters, digits, marks = (len(data) - len(data.translate(None, of)) for of in (_ASCII_LETTERS, _DIGITS, _PUNCTUATION))
    beyond = len(text) - len(data.translate(None, bytes(range(128, 256))))  # code points that are not ASCII
    return (
        n, chars, symbols, again, repeated,
        chars / n, symbols / chars, again / lines, repeated / n, len(counts) / n, max(counts.values()) / n, int((ids[1:] == ids[:-1]).sum()) / n,
        sum(w.isupper() and len(w) > 1 for w in words) / n, digits / chars, marks / chars, (letters + beyond) / chars, n / lines, ends / lines,
    )


def _statistics(rows: Iterator[tuple]) -> Iterable[tuple]:
    for doc_id, text in rows:
        yield (doc_id, *statistics(text))


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, ``COUNTS``, ``SHARES``) of every row; texts are read once."""
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _statistics, STATISTICS)


@dataclass(frozen=True)
class Condition:
    """``feature`` above ``cut``, or not above it."""

    feature: str
    above: bool
    cut: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.cut if self.above else values <= self.cut

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.cut) if self.above else F.col(self.feature) <= F.lit(self.cut)

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} CAST({self.cut!r} AS DOUBLE)"


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions; ``right`` and ``wrong`` count the rows it was pruned on."""

    conditions: tuple[Condition, ...]
    right: int
    wrong: int


def covered(x: np.ndarray, conditions: Iterable[Condition]) -> np.ndarray:
    mask = np.ones(len(x), bool)
    for c in conditions:
        mask &= c.holds(x[:, FEATURES.index(c.feature)])
    return mask


def cuts_of(values: np.ndarray, digits: int = 4) -> list[float]:
    """Thresholds midway between neighbouring quantiles, of a few significant digits, which people can read."""
    known = np.unique(np.quantile(values, np.linspace(0, 1, CUTS)))
    return sorted({float(f"{c:.{digits}g}") for c in (known[1:] + known[:-1]) / 2})


def grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Conditions in the order of their gain, until no good row is covered or none gains."""
    conditions: list[Condition] = []
    at = np.arange(len(x))
    while len(conditions) < MOST_CONDITIONS and 0 < bad[at].sum() < len(at):
        p0, n0 = bad[at].sum(), len(at) - bad[at].sum()
        best, gain = None, 1e-9
        for f, name in enumerate(FEATURES):
            values = x[at, f]
            for cut in cuts_of(values):
                high = values > cut
                p, n = int((high & bad[at]).sum()), int(high.sum())
                for above, right, all_ in ((True, p, n), (False, int(p0) - p, len(at) - n)):
                    if right and all_ < len(at):
                        won = right * (math.log2(right / all_) - math.log2(p0 / (p0 + n0)))
                        if won > gain:
                            best, gain = Condition(name, above, cut), won
        if best is None:
            break
        conditions.append(best)
        at = at[best.holds(x[at, FEATURES.index(best.feature)])]
    return conditions


def prune(conditions: list[Condition], x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best difference of right and wrong on other rows; the shortest of equals."""
    options = []
    for k in range(1, len(conditions) + 1):
        mask = covered(x, conditions[:k])
        right, wrong = int(bad[mask].sum()), int((~bad[mask]).sum())
        options.append(((right - wrong) / max(1, right + wrong), right, -k, wrong))
    worth, right, k, wrong = max(options)
    return Rule(tuple(conditions[:-k]), right, wrong)


def learn(x: np.ndarray, bad: np.ndarray, grown: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """An ordered list of rules; ``grown`` marks the rows rules grow on, the others prune them."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < MOST_RULES:
        one, other = left & grown, left & ~grown
        conditions = grow(x[one], bad[one])
        if not conditions:
            break
        rule = prune(conditions, x[other], bad[other])
        if (rule.right + 1) / (rule.right + rule.wrong + 2) < precision:
            break
        rules.append(rule)
        left &= ~covered(x, rule.conditions)
    return rules


def fit(stats: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> list[Rule]:
    """Rules from at most about ``bound`` labelled ids; ``stats`` is a written table."""
    ids = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    taken = ids.where(hash_share(12, bound, ids.count(), "_id"))
    judged = stats.where(~base_failed()).join(F.broadcast(taken), F.col("doc_id") == F.col("_id"))
    one = judged.groupBy("doc_id").agg(F.max(F.struct(*FEATURES)).alias("x"), F.max("quality").alias("quality"))
    rows = one.select("x.*", "quality", F.xxhash64(F.lit(13), "doc_id").alias("order")).toPandas().sort_values("order")
    bad = rows["quality"].to_numpy() == 0
    if not 0 < bad.sum() < len(bad):
        return []
    return learn(rows[FEATURES].to_numpy(float), bad, np.arange(len(rows)) % 3 != 0)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, 0 for none."""
    out = None
    for number, rule in enumerate(rules, 1):
        met = F.lit(True)
        for c in rule.conditions:
            met = met & c.column()
        out = F.when(met, number) if out is None else out.when(met, number)
    return F.lit(0) if out is None else out.otherwise(0)


def verdict_sql(rules: list[Rule]) -> str:
    """The same as ``verdict`` in SQL."""
    cases = "".join(f" WHEN {' AND '.join(c.sql() for c in rule.conditions)} THEN {number}" for number, rule in enumerate(rules, 1))
    return f"CASE{cases} ELSE 0 END" if rules else "0"


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``base_failed``, ``rule`` (0: none) and ``kept``."""
    told = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return told.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """Statistics and decision of every row."""
    stats = write_shared(with_statistics(docs), "rule-statistics")
    return judged(stats, fit(stats, labels, bound))
