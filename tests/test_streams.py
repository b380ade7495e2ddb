"""Keyed streams: out-of-order batches, restarts, bounded state and lifetimes."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from framesift.operators import sequence as Q
from framesift.plans import fixtures as fx
from framesift.streaming import ingest as R, timed as Z, watch as D


def plain_windows(frames, span, size, tail):
    """W4 by its rule: windows of a run, then the tail; a run of one time has windows of every ``size``."""
    if frames[0][0] == frames[-1][0]:
        return [frames[i : i + size] for i in range(0, len(frames), size)]
    out = [[frames[0]]]
    for f in frames[1:]:
        if len(out[-1]) >= size and f[0] - out[-1][0][0] >= span:
            out.append([])
        out[-1].append(f)
    if len(out[-1]) < tail:
        last = out.pop()
        if out:
            out[-1] += last
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 20), st.integers(1, 6), st.integers(1, 8))
def test_cutting_equals_the_rule(steps, span, size, tail):
    frames, t = [], 0
    for i, s in enumerate(steps):
        t += s
        frames.append((t, i))
    runs = [[frames[0]]]
    for a, b in zip(frames, frames[1:], strict=False):
        if b[0] - a[0] > 20:
            runs.append([])
        runs[-1].append(b)
    want = [(r, n, [i for _, i in w], w[0][0], w[-1][0]) for r, run in enumerate(runs) for n, w in enumerate(plain_windows(run, span, size, tail))]
    cutting = Z.Cutting(20, span, size, tail)
    found = []
    for f in frames:
        found += cutting.add(*f)
        cutting = Z.Cutting(20, span, size, tail, *cutting.state())  # as it comes back from state
    assert found + list(cutting.end()) == want


def test_clips_of_late_frames(spark, tmp_path):
    r = random.Random(2)
    rows, t = [], 1000
    for i in range(300):
        t += r.choice([0, 20, 100, 900, 4000])
        rows.append((f"run{i % 3}", t, i))
    frames = spark.createDataFrame(rows, "run string, ms long, id long")
    fx.arrivals(frames, "ms", 4, 20_000, str(tmp_path / "in"))
    stream = fx.arriving(spark, "run string, ms long, id long", "ms", str(tmp_path / "in"))
    with R.rocks_state(spark):
        got = R.run_to_table(Z.stream_timed_clips(stream, 5000, 3.0, 4, 3, "20 seconds"), "clips", "append", str(tmp_path / "c")).where("run IS NOT NULL").collect()
    runs = Q.split_runs(frames, ["run"], "ms", ["id"], gap_ms=5000)
    cut = Q.clip_windows(runs, ["run", "run_no"], ["ms", "id"], "ms", 3.0, 4, 3)
    want = {}
    for w in cut.orderBy("ms", "id").collect():
        want.setdefault((w["run"], w["run_no"], w["window_no"]), []).append(w["id"])
    assert {(g["run"], g["run_no"], g["window_no"]): list(g["frame_ids"]) for g in got} == want and len(got) == len(want)


def test_sessions_keep_a_gap_of_just_ten_seconds(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 10_000), ("a", 20_001), ("b", 5)], "k string, ms long").select("k", F.timestamp_millis("ms").alias("ts"))
    assert sorted(map(tuple, Z.session_runs(rows, "k", "ts", 10_000).collect())) == [("a", 1, 20_001, 20_001), ("a", 2, 0, 10_000), ("b", 1, 5, 5)]


def test_error_counts_are_forgotten(spark, tmp_path):
    folder = str(tmp_path / "in")
    day = 86_400_000
    batches = [[("a", day, "m1", False), ("b", day, "n1", False)], [("a", day + 5, "m2", False), ("a", day + 4, "m0", False), ("b", day + 1, None, True)], [("z", 50 * day, "far", False)], [("a", 51 * day, "again", False)]]
    seen = []
    for rows in batches:  # one run each, from the checkpoint
        spark.createDataFrame(rows, "clip_id string, at long, message string, valid boolean").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("clip_id string, at long, message string, valid boolean").parquet(folder).withColumn("ts", F.timestamp_millis("at"))
        with R.rocks_state(spark):
            told = R.run_to_table(Z.stream_error_counts(stream, "1 hour", 3, 10 * day), "errors", "update", str(tmp_path / "c"))
            seen.append({r["clip_id"]: (r["n_errors"], r["last_error"], r["decision"]) for r in told.collect()})
    assert seen[0] == {"a": (1, "m1", None), "b": (1, "n1", None)}
    assert seen[1] == {"a": (3, "m2", "REVIEW"), "b": (1, "n1", None)}
    assert seen[3]["a"] == (1, "again", None)  # forgotten after ten days


def test_old_deliveries_leave_the_state(spark, tmp_path):
    """Keys are dropped once the watermark has passed them; a repeat that comes later is counted as late, not delivered again."""
    folder, hour = str(tmp_path / "in"), 3_600_000
    states = []
    for rows in ([(i, hour) for i in range(100)], [(i, hour + 1) for i in range(50)] + [(200, 40 * hour)], [(i, hour) for i in range(20)] + [(201, 41 * hour)]):
        spark.createDataFrame(rows, "id long, ms long").coalesce(1).write.mode("append").parquet(folder)
        stream = fx.arriving(spark, "id long, ms long", "ms", folder, 1)
        query = R.once_each(stream, ["id"], ("ts", "2 hours")).writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        states += [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
    assert max(s.numRowsTotal for s in states) >= 100 and states[-1].numRowsTotal <= 2
    assert sum(s.numRowsDroppedByWatermark for s in states) == 20
    left = spark.read.format("statestore").option("path", str(tmp_path / "c")).load()
    assert {r[0] for r in left.select("key.id").collect()} <= {200, 201}


def test_a_folder_is_watched_over_restarts(spark, tmp_path):
    media, kept, checkpoint = tmp_path / "media", str(tmp_path / "manifest"), str(tmp_path / "c")

    def arrive(*names):
        for name in names:
            (media / name).parent.mkdir(parents=True, exist_ok=True)
            (media / name).write_bytes(b"x")

    def look(most=1):
        D.watch(D.media_stream(spark, str(media), "*.mp4", 100), kept, checkpoint, spark.createDataFrame([("a/manual", 2)], "dir string, step int"), 10, most)
        return Counter((r["path"].split("media/")[1], r["outcome"], r["round"]) for r in D.manifest(spark, kept).collect())

    arrive("old/1.mp4", "old/2.mp4", "old/note.txt")
    assert look() == Counter({("old/1.mp4", "seed", 0): 1, ("old/2.mp4", "seed", 0): 1})
    assert look() == look()  # nothing new, nothing done
    arrive("b/1.mp4", "c/1.mp4", "a/manual/1.mp4")
    second = look()
    assert second[("b/1.mp4", "submit", 1)] == second[("c/1.mp4", "later", 1)] == second[("a/manual/1.mp4", "manual_dir", 1)] == 1
    arrive("d/1.mp4")
    third = look()
    assert third[("c/1.mp4", "submit", 2)] == third[("d/1.mp4", "later", 2)] == 1 and third[("b/1.mp4", "submit", 1)] == 1


def test_a_repeated_round_is_the_same(spark, tmp_path):
    kept = str(tmp_path / "manifest")
    jobs = spark.createDataFrame([], "dir string, step int")
    found = spark.createDataFrame([("x/1", "x"), ("y/1", "y")], "path string, dir string")
    for number in (0, 1, 1):
        D._write_round(found if number == 0 else spark.createDataFrame([("p/1", "p"), ("q/1", "q")], "path string, dir string"), kept, number, jobs, 10, 1)
    assert Counter(r["outcome"] for r in D.manifest(spark, kept).collect()) == Counter({"seed": 2, "submit": 1, "later": 1})


@pytest.mark.parametrize("delay", [None])
def test_no_rows(spark, delay):
    none = spark.createDataFrame([], "k string, ts timestamp")
    assert Z.session_runs(none, "k", "ts", 10, delay).count() == 0
