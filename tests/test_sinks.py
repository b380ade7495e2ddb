"""Label files, JSON arrays, exports, partition merges, ontology edits, sign codes, and the overlap automaton."""

import json
import time
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from framesift.functions.jsontext import SuffixAutomaton, longest_common
from framesift.operators import boxes as B, merge as M, sequence as Q, tags as T
from framesift.sources import label_files as L, readers as S, writers as K


def files(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file() and not p.name.startswith("."))


LABELS = [("train", "a", ["0 0.5 0.5 0.1 0.1", "1 0.2 0.2 0.1 0.1"]), ("val", "b", ["2 0.5 0.5 1 1"]), ("train", "c", []), ("train", "d", None)]


def test_label_files(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = spark.createDataFrame(LABELS, "split string, name string, lines array<string>")
    L.write_label_files(rows, ["car", "人"], path)
    assert files(path) == ["data.yaml", "labels/train/a.txt", "labels/train/c.txt", "labels/train/d.txt", "labels/val/b.txt"]
    assert (tmp_path / "set/labels/train/a.txt").read_text() == "0 0.5 0.5 0.1 0.1\n1 0.2 0.2 0.1 0.1\n" and (tmp_path / "set/labels/train/c.txt").read_text() == ""
    assert (tmp_path / "set/data.yaml").read_text() == f"path: {path}\ntrain: images/train\nval: images/val\nnames:\n  0: car\n  1: 人\n"
    read = {(r["image_id"], r["cls"]) for r in S.label_files(spark, f"{path}/labels").select("image_id", F.col("cls").cast("int").alias("cls")).collect()}
    assert read == {("a", 0), ("a", 1), ("b", 2)}
    other = spark.createDataFrame([("train", "a", ["9 0 0 1 1"]), ("val", "e", ["1 0 0 1 1"])], "split string, name string, lines array<string>")
    L.write_label_files(other, [], path)  # what is there stays
    assert (tmp_path / "set/labels/train/a.txt").read_text().startswith("0 ") and (tmp_path / "set/labels/val/e.txt").exists()
    L.write_label_files(other, [], path, "replace")
    assert (tmp_path / "set/labels/train/a.txt").read_text() == "9 0 0 1 1\n"


def test_a_failed_task_leaves_no_label_file(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = spark.range(0, 40, 1, 4).select(F.lit("train").alias("split"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("name"), F.array(F.lit("0 0 0 1 1")).alias("lines"), "id")
    broken = rows.withColumn("split", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("split")))
    with pytest.raises(Exception, match="lost"):
        L.write_label_files(broken, [], path)
    for _ in range(50):  # tasks that are being killed may take a moment to notice
        if not files(tmp_path):
            break
        time.sleep(0.1)
    assert files(tmp_path) == []
    L.write_label_files(rows, [], path)
    assert len(files(path)) == 41


def test_no_labels(spark, tmp_path):
    L.write_label_files(spark.createDataFrame([], "split string, name string, lines array<string>"), ["x"], str(tmp_path / "set"))
    assert files(tmp_path / "set") == ["data.yaml"]


@pytest.mark.parametrize("n", [0, 1, 7])
def test_a_json_array(spark, tmp_path, n):
    rows = spark.range(0, n, 1, 3).select("id", F.concat(F.lit("x, \"y\"\n["), F.col("id").cast("string")).alias("text"))
    K.write_json_array(rows, str(tmp_path / "a"))
    whole = "".join((tmp_path / "a" / f).read_text() for f in files(tmp_path / "a") if f.startswith("part-"))
    assert sorted(x["id"] for x in json.loads(whole)) == list(range(n))
    assert sorted(map(tuple, K.read_json_array(spark, str(tmp_path / "a"), rows.schema).collect())) == sorted(map(tuple, rows.collect()))


def test_partitions_that_no_key_touches_stay(spark, tmp_path):
    path, part = str(tmp_path / "t"), F.expr("id div 100")
    rows = spark.range(1000).select("id", F.lit("old").alias("status"), (F.col("id") * 2).alias("n"))
    M.write_base(rows, path, part)
    before = set(files(f"{path}/base"))
    new = spark.createDataFrame([(i, "new", None) for i in range(300, 310)] + [(5000, "added", 1)], "id long, status string, n long")
    M.add_delta(new, path, part, 1)
    M.add_delta(new, path, part, 1)  # a repeated write
    M.add_delta(spark.createDataFrame([(305, None, 7), (306, "newer", None)], "id long, status string, n long"), path, part, 2)
    want = {i: ("old", 2 * i) for i in range(1000)} | {i: ("new", 2 * i) for i in range(300, 310)} | {5000: ("added", 1), 305: ("new", 7), 306: ("newer", 612)}
    keys, columns = ["id"], ["status", "n"]
    assert {r["id"]: (r["status"], r["n"]) for r in M.merged(spark, path, rows.schema, keys, columns).collect()} == want
    assert M.compact(spark, path, rows.schema, keys, columns) == [3, 50]
    after = set(files(f"{path}/base"))
    assert {f for f in before if "part=3/" not in f} <= after and not {f for f in before if "part=3/" in f} & after
    assert not (tmp_path / "t/delta").exists() and M.compact(spark, path, rows.schema, keys, columns) == []
    assert {r["id"]: (r["status"], r["n"]) for r in M.merged(spark, path, rows.schema, keys, columns).collect()} == want


def plain_common(a, b):
    best, table = 0, [0] * (len(b) + 1)
    for x in a:
        table = [0] + [table[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *table)
    return best


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abc", max_size=40), st.text(alphabet="abc", max_size=40))
def test_overlap_equals_the_full_table(a, b):
    assert longest_common(a, b) == (plain_common(a, b) if a and b else 0)
    assert len(SuffixAutomaton(b).link) <= max(2, 2 * len(b))


def test_ontology_edits(spark):
    values = spark.createDataFrame([("road", "wet"), ("road", "dry")], "dim string, value string")
    aliases = spark.createDataFrame([("road", "damp", "dry")], "dim string, alias string, value string")
    assert {tuple(r) for r in T.alias_added(values, aliases, "road", "damp", "wet").collect()} == {("road", "damp", "wet")}
    with pytest.raises(ValueError, match="no such value"):
        T.alias_added(values, aliases, "road", "x", "ice")
    with pytest.raises(ValueError, match="already a value"):
        T.alias_added(values, aliases, "road", "dry", "wet")
    given_up = spark.createDataFrame([], "dim string, tag string")
    once = T.dismissed(T.dismissed(given_up, "road", "mud"), "road", "mud")
    assert [tuple(r) for r in once.collect()] == [("road", "mud")] and T.restored(once, "road", "mud").count() == 0


def test_sign_codes(spark):
    want = {"1.1": "warning", "3_24_n20": "speed_limit", "3.25": "prohibition", "2.4": "mandatory", "4_1_1": "mandatory", "5.19.1": "guide", "6_2": "guide", "7.3": None, "8.2": None, "Светофор": "traffic_light", "x": None, "": None, "13.24": None, " 1_2 ": "warning"}
    rows = spark.createDataFrame([(c,) for c in [*want, None]], "code string").withColumn("cls", B.gost_class(F.col("code")))
    assert {r["code"]: r["cls"] for r in rows.collect()} == want | {None: None}


def test_new_outputs(spark):
    rows = spark.createDataFrame([("b/x.jpg",), ("a/x.jpg",), ("a/y.png",), ("a/z.png",)], "path string")
    known = spark.createDataFrame([("s_z",)], "key string")
    assert {(r["path"], r["key"]) for r in B.new_outputs(rows, known, "s").collect()} == {("a/x.jpg", "s_x"), ("a/y.png", "s_y")}
    assert B.new_outputs(rows, None, "s").count() == 3


def test_rebuilt_clips(spark):
    frames = spark.createDataFrame([(i, f"d/IMG_{i:04d}.jpg", i, "v/a.mp4" if i < 40 else None, float(i), i) for i in range(60)], "id long, path string, position long, video_path string, timestamp double, frame_index long")
    old = spark.createDataFrame([("a_00000", list(range(30)), "yes"), ("a_00001", [1, 2], "no")], "clip_id string, frame_ids array<long>, vlm_result string")
    found = {r["clip_id"]: (len(r["frame_ids"]), r["vlm_result"]) for r in Q.rebuild_clips(frames, old, fields=["vlm_result"]).collect()}
    assert found.pop("a_00000") == (30, "yes") and found.pop("a_00001") == (10, None) and list(found.values()) == [(20, None)]
