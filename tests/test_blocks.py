"""Scans in blocks against the same operators over one window a key."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from framesift.operators import blocks as B, sequence as Q


@pytest.fixture(scope="module")
def rows(spark):
    """Runs long and short, one of a third of all rows, ties, a null key, runs without times, and one whose times fall along the order."""
    r, data = random.Random(1), []
    for run, n in enumerate([2500, 2, 1, 0, 40, 200, 3, 700, 31, 30, 29, 64, 300]):
        t = 0
        for i in range(n):
            t += r.choice([0, 0, 1, 5, r.randrange(400)])
            ms = None if run == 8 and i == 7 else 1000 - t if run == 12 else t
            data.append((None if run == 11 else run, ms, r.randrange(3), i))
    return spark.createDataFrame(data, "run int, ms long, sub int, id long")


def table(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("mode", ["ms", "idx", "seq"])
def test_runs(rows, mode):
    found, want = (Q.split_runs(rows, ["run"], "ms", ["id"], mode, "sub", 100, 2, run_rows=n) for n in (0, sys.maxsize))
    assert table(found.select(want.columns)) == table(want)


def test_fixed_windows_and_groups(rows):
    found, want = (Q.fixed_windows(rows, ["run"], ["ms", "id"], 7, n) for n in (0, sys.maxsize))
    assert table(found.select(want.columns)) == table(want)
    found, want = (Q.with_group(rows, ["run"], {"n": F.count(F.lit(1))}, n) for n in (0, sys.maxsize))
    assert table(found) == table(want)


@pytest.mark.parametrize(("seconds", "size", "tail"), [(0.9, 5, 3), (30, 30, 5), (0.001, 1, 1), (5000, 7, 5), (0.3, 2, 40), (0, 6, 2)])
@pytest.mark.parametrize("order", [["ms", "id"], ["id"]])
def test_timed_windows(rows, seconds, size, tail, order):
    found, want = (Q.clip_windows(rows, ["run"], order, "ms", seconds, size, tail, n) for n in (0, sys.maxsize))
    assert table(found.select(want.columns)) == table(want)


def test_a_hot_run_is_spread(spark, rows):
    one = rows.where("run = 0")
    blocks = B.in_blocks(one, ["run"], ["ms", "id"]).groupBy("_block").count().collect()
    assert len(blocks) >= 4 and max(b["count"] for b in blocks) < 1500


def test_no_rows(rows):
    none = rows.limit(0)
    assert B.placed(none, ["run"], ["ms", "id"], "at").count() == 0
    assert B.timed_windows(none, ["run"], ["ms", "id"], "ms", 5.0, 3, 2, None).count() == 0
