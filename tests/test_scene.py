"""Hand cases of the scene-data operators."""

import random

import pytest
from pyspark.sql import functions as F

from framesift.operators import boxes as B, catalog as C, decision, dedup as D, evaluate, normalize as N, search, sequence as seq, tags as T


@pytest.mark.parametrize(
    "path,want",
    [
        ("images/vidA/vidA_120.jpg", ("bucket:images/vidA", "seq", 0, 120)),
        ("images\\vidA\\vidA_7.JPG", ("bucket:images/vidA", "seq", 0, 7)),
        ("images/v3_1500_7.jpg", ("v:v3", "seq", 1500, 7)),
        ("images/100002_1783714217483_13_14.jpg", ("ms:images:_13_14", "ms", 1783714217483, 0)),
        ("images/1787120247.455.jpg", ("secms:images", "ms", 1787120247455, 0)),
        ("images/1787120247.45.jpg", ("secms:images", "ms", 1787120247450, 0)),
        ("images/IMG_000123.jpg", ("idx:images:IMG_", "idx", 123, 0)),
        ("images/1234.jpg", ("idx:images:1", "idx", 234, 0)),
        ("images/123.jpg", None),
        ("images/photo.jpg", None),
        (None, None),
    ],
)
def test_seq_key(spark, path, want):
    k = spark.createDataFrame([(path,)], "p string").select(seq.seq_key(F.col("p")).alias("k")).first()["k"]
    assert (tuple(k) if k else None) == want


def sequential_windows(frames, seconds, floor, tail):
    if not frames or any(m is None for m, _ in frames) or frames[0][0] == frames[-1][0]:
        return None
    done, open_ = [], []
    for ms, i in frames:
        if open_ and len(open_) >= floor and ms - open_[0][0] >= seconds * 1000:
            done.append(open_)
            open_ = []
        open_.append((ms, i))
    if len(open_) >= tail:
        done.append(open_)
    elif done:
        done[-1] += open_
    return [[i for _, i in w] for w in done]


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_clip_windows_equal_the_sequential_rule(spark, batch):
    r = random.Random(1)
    rows, want = [], {}
    for k in range(60):
        ms, frames = 0, []
        for i in range(r.randrange(1, 30)):
            ms += r.choice([0, 100, 400, 900])
            frames.append((ms if r.random() > 0.005 else None, i))
        rows += [(k, i, t) for t, i in frames]
        counted = [[i for _, i in frames[at : at + 3]] for at in range(0, len(frames), 3)]
        want[k] = counted if any(t is None for t, _ in frames) else sequential_windows(frames, 2, 3, 2)
        want[k] = counted if want[k] is None else want[k]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        cut = seq.clip_windows(spark.createDataFrame(rows, "k int, i int, ms long"), ["k"], ["i"], "ms", 2, 3, 2).orderBy("k", "i").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {k: {} for k in want}
    for x in cut:
        got[x["k"]].setdefault(x["window_no"], []).append(x["i"])
    for k, windows in got.items():
        assert list(windows) == list(range(len(windows)))
        assert list(windows.values()) == want[k]


def test_evenly_spaced(spark):
    for n in (1, 4, 5, 6, 13, 40):
        rows = spark.createDataFrame([(list(range(n)),)], "x array<int>")
        got = rows.select(seq.evenly_spaced(F.col("x"), 5).alias("p")).first()["p"]
        want = list(range(n)) if n <= 5 else list(dict.fromkeys(round(i * (n - 1) / 4) for i in range(5)))
        assert got == want


def test_builders_agree_on_gaps(spark):
    frames = spark.createDataFrame([(i, f"a/{1700000000 + (i if i < 7 else i + 60)}.5.jpg", i) for i in range(14)], "id long, path string, position long")
    clips = seq.build_seq_clips(frames, size=5, min_frames=3).orderBy("frame_ids").collect()
    assert [c["frame_ids"] for c in clips] == [[0, 1, 2, 3, 4], [5, 6], [7, 8, 9, 10, 11], [12, 13]]
    assert len({c["clip_id"] for c in clips}) == 4
    video = frames.select("id", F.lit("v/x.mp4").alias("video_path"), F.col("id").cast("double").alias("timestamp"), F.lit(0).alias("frame_index"))
    assert [c["frame_ids"] for c in seq.build_video_clips(video, 5, 3, 4.0).orderBy("clip_index").collect()] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11, 12, 13]]


TAGS = "map<string,array<struct<tag:string,source:string,confidence:double>>>"


def decide_one(spark, preset="balanced", parity=False, **given):
    keys = {"yolo_max_conf": None, "dino_max_conf": None, "yolo_labels": [], "dino_labels": [], "vlm_tags_ok": False, "vlm_event_conflict": False} | {k: v for k, v in given.items()}
    row = [(keys["yolo_max_conf"], keys["dino_max_conf"], "yolo_max_conf" in given, "dino_max_conf" in given, keys["yolo_labels"], keys["dino_labels"], keys["vlm_tags_ok"], keys["vlm_event_conflict"], {}, {"weather": [("雪天", "AI", 0.9)]} if given.get("snow") else {})]
    df = spark.createDataFrame(row, f"yolo_max_conf double, dino_max_conf double, has_yolo boolean, has_dino boolean, yolo_labels array<string>, dino_labels array<string>, vlm_tags_ok boolean, vlm_event_conflict boolean, final_tags {TAGS}, ai_tags {TAGS}")
    r = decision.decide(df, decision.preset(preset, parity)).first()
    return r["decision"], r["rule"], None if r["score"] is None else round(r["score"], 4)


def test_decisions(spark):
    both = {"yolo_labels": ["car", "person"], "dino_labels": ["car", "person"]}
    assert decide_one(spark, yolo_max_conf=0.9, dino_max_conf=0.85, **both) == ("AUTO_PASS", "auto_pass", 0.875)
    assert decide_one(spark, yolo_max_conf=0.6, dino_max_conf=0.5, yolo_labels=["car"], dino_labels=["truck"]) == ("REVIEW", "low_confidence", 0.55)
    assert decide_one(spark, yolo_max_conf=0.9, dino_max_conf=0.9, yolo_labels=["car"], dino_labels=["truck"]) == ("REVIEW", "model_conflict", 0.9)
    assert decide_one(spark, vlm_tags_ok=True) == ("AUTO_PASS", "vlm_only_auto_pass", None)
    assert decide_one(spark) == ("REVIEW", "default_review", None)
    assert decide_one(spark, yolo_max_conf=None, dino_max_conf=0.9) == ("REVIEW", "default_review", 0.9)
    assert decide_one(spark, yolo_max_conf=0.1, dino_max_conf=None) == ("REVIEW", "low_confidence", 0.1)
    assert decide_one(spark, "strict", True, yolo_max_conf=0.9, dino_max_conf=0.9, snow=True)[1] == "business_filter"
    assert decide_one(spark, "strict", True, yolo_max_conf=0.9, dino_max_conf=0.9, yolo_labels=["car"], dino_labels=["truck"]) == ("REVIEW", "default_review", None)


def test_evaluation_of_one_asset(spark):
    truth = [("weather", "雨天"), ("road", "城市道路"), ("time", "夜晚"), ("events", "行人横穿"), ("objects", "行人"), ("objects", "小车"), ("risk", "中风险")]
    guess = [("weather", "雨天"), ("weather", "阴天"), ("road", "城市道路"), ("time", "夜晚"), ("objects", "行人"), ("risk", "中风险")]
    t = spark.createDataFrame([("a", *x) for x in truth], "asset_id string, dim string, tag string")
    p = spark.createDataFrame([("m", "a", *x) for x in guess], "model string, asset_id string, dim string, tag string")
    r = evaluate.pooled(evaluate.asset_dim_metrics(t, p, evaluate.DIMS)).first()
    assert (r["tp"], r["fp"], r["fn"]) == (5, 1, 2) and abs(r["precision"] - 5 / 6) < 1e-3 and abs(r["recall"] - 5 / 7) < 1e-3
    x = spark.createDataFrame([(["car", "truck", "person", "cat"],)], "l array<string>").select(T.mapped_labels(F.col("l"), {"car": "小车", "truck": "大车", "person": "行人"}).alias("o")).first()
    assert x["o"] == ["小车", "大车", "行人"]


def test_tags(spark):
    ai = spark.createDataFrame([("a", "weather", "雨天", "AI", 0.9, 0), ("a", "weather", "阴天", "AI", 0.1, 1), ("a", "weather", "阴天", "AI", 0.4, 2), ("a", "weather", "阴天", "Rule", 1.0, 3)], "asset_id string, dim string, tag string, source string, confidence double, position int")
    human = spark.createDataFrame([("a", "weather", "阴天", "Human", 1.0, 0)], ai.schema)
    m = T.merged(ai)
    assert {(r["tag"], r["source"]): (r["confidence"], r["position"]) for r in m.collect()}["阴天", "AI"] == (0.4, 1)
    final = {(r["tag"], r["source"]) for r in T.final_tags(m, human.select(*m.columns)).collect()}
    assert final == {("雨天", "AI"), ("阴天", "Rule"), ("阴天", "Human")}


def test_tag_search_treats_missing_maps_as_empty(spark):
    a = spark.createDataFrame([(1, None, {"w": [("x", "AI", 1.0)]}), (2, {}, None), (3, {"w": None}, {"w": [("y", "AI", 1.0)]})], f"id int, final_tags {TAGS}, ai_tags {TAGS}")
    def found(f):
        return sorted(r["id"] for r in a.where(search.tag_match([F.col("final_tags"), F.col("ai_tags")], f)).collect())
    assert found({"w": ["x"]}) == [1] and found({}) == [1, 2, 3] and found({"w": [" "]}) == [1, 2, 3] and found({"w": ["x", "y"]}) == [1, 3] and found({"w": ["x"], "v": ["z"]}) == []


def test_greedy_groups_equal_the_greedy_scan(spark):
    r = random.Random(4)
    pairs = {(a, b) for _ in range(150) for a, b in [sorted(r.sample(range(60), 2))]}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, seen = {}, set()
    for i in sorted(near):
        if i not in seen:
            for j in [i, *sorted(near[i])]:
                if j not in seen:
                    seen.add(j)
                    want[j] = i
    got = {x["id"]: x["leader"] for x in D.greedy_groups(spark.createDataFrame(list(pairs), "a long, b long")).collect()}
    assert got == want


def test_near_hashes_miss_nothing(spark):
    r = random.Random(6)
    base = ["".join(r.choice("0123456789abcdef") for _ in range(16)) for _ in range(30)]
    rows = [(i, h) for i, h in enumerate(base)]
    for i in range(60):
        h = list(r.choice(base))
        for k in r.sample(range(16), r.randrange(0, 8)):
            h[k] = r.choice("0123456789abcdef")
        rows.append((100 + i, "".join(h)))
    old, new = rows[:30], [*rows[30:], (999, None)]
    got = {(x["new_id"], x["old_id"]) for x in D.near_hashes(spark.createDataFrame(new, "id long, phash string"), spark.createDataFrame(old, "id long, phash string")).collect()}
    assert got == {(a, b) for a, x in new if x for b, y in old if sum(p != q for p, q in zip(x, y, strict=True)) <= 5}


def test_vector_pairs(spark):
    import numpy as np

    r = np.random.default_rng(3)
    x = r.normal(size=(300, 16))
    x[150:200] = x[:50] + 0.05 * r.normal(size=(50, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, embedding array<float>")
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x.astype(float) @ x.astype(float).T >= 0.9, 1)), strict=True)}
    assert {(p["a"], p["b"]) for p in D.cosine_pairs(v, 0.9, block=40).collect()} == want
    top = D.top_k(v, v.where("id % 20 = 0"), 3, block=40).collect()
    scores = x.astype(float) @ x.astype(float).T
    assert len(top) == 45 and all(p["id"] == int(np.argsort(-scores[p["query"]], kind="stable")[p["rank"] - 1]) for p in top)


def test_json_helpers():
    from framesift.functions.jsontext import complete, first_object, longest_common, repaired

    assert first_object('x {"a": "}"} tail }') == '{"a": "}"}' and first_object("none") is None and first_object(None) is None
    assert repaired('{"a": [1, 2, {"b": 3}, {"c') == '{"a": [1, 2, {"b": 3}]}' and repaired('{"a": 1}') is None and repaired('{"a": "x, y') is None
    assert complete('{"a": "{"}') and not complete('{"a": {') and longest_common("abcdef", "xcdey") == 3


def test_exclusive_events(spark):
    rows = [(1, 0, "车辆切入", "灯", "a", 0.5), (1, 1, "车辆切出", "灯", "b", 0.5), (1, 2, "车辆加塞", "灯", "c", 0.5), (2, 0, "车辆切入", "灯", "a", 0.9), (2, 1, "车辆切出", "灯", "b", 0.1), (3, 0, "车辆切入", "", "a", 0.1), (3, 1, "车辆切入", "", "a", 0.9)]
    e = spark.createDataFrame(rows, "id int, position int, type string, anchor string, reason string, confidence double")
    got = sorted((r["id"], r["type"]) for r in N.deduplicated_events(e).collect())
    assert got == sorted([(1, "车辆加塞"), (2, "车辆切入"), (2, "车辆切出"), (3, "车辆切入")])


def test_boxes(spark):
    one = spark.createDataFrame([(10.0, 10.0, 30.0, 20.0, 100, 80)], "x0 double, y0 double, x1 double, y1 double, img_w int, img_h int")
    c = one.select(B.crop_window(*[F.col(x) for x in one.columns], least=32).alias("c")).first()["c"]
    assert tuple(c) == (0, 0, 60, 55)
    i = one.select(B.iou([F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)], [F.lit(1.0), F.lit(1.0), F.lit(3.0), F.lit(3.0)]).alias("i")).first()["i"]
    assert abs(i - 1 / 7) < 1e-12
    lines = spark.createDataFrame([("a", "1 0.5 0.5 0.2 0.1"), ("a", "2 0 0 1 0 1 1 0 1"), ("b", "1 2 3"), ("b", "")], "image_id string, value string")
    got = {r["cls"]: tuple(r["box"]) for r in B.parse_label_lines(lines).collect()}
    assert got == {1: (0.5, 0.5, 0.2, 0.1), 2: (0.5, 0.5, 1.0, 1.0)}


def test_catalog_refuses_and_keeps(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    with pytest.raises(ValueError):
        C.cleared_except(rows, rows.limit(0), "id", ["v"])
    with pytest.raises(ValueError):
        search.tag_hits(rows, {}, ["nope"])
    left = C.deleted({"t": (rows, "id")}, spark.createDataFrame([(1,)], "key int"))["t"]
    assert [r["id"] for r in left.collect()] == [2]


def test_components(spark):
    from framesift.plans.graph import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100, 101: 100}


def test_position(spark):
    from framesift.plans.order import with_position

    got = [r["position"] for r in with_position(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")), ["v"]).orderBy("v").collect()]
    assert got == list(range(1000))


def test_readers_and_writers(spark, tmp_path):
    from framesift.sources import readers, writers

    (tmp_path / "m" / "x").mkdir(parents=True)
    (tmp_path / "m" / "x" / "a.MP4").write_bytes(b"1")
    (tmp_path / "m" / "b.txt").write_bytes(b"1")
    assert [r["path"].rsplit("/", 1)[-1] for r in readers.media_files(spark, str(tmp_path / "m"), readers.VIDEO).collect()] == ["a.MP4"]
    (tmp_path / "meta.json").write_text('[{"id": 1, "path": "a"}, {"id": "x", "path": "b"}, {"id": 1, "path": "c"}, {"id": 2}, {"id": 3, "path": "d"}]')
    assert sorted((r["id"], r["path"]) for r in readers.read_frames(spark, str(tmp_path / "meta.json")).collect()) == [(1, "a"), (3, "d")]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "img1.txt").write_text("0 0.5 0.5 0.1 0.1\nbad\n")
    assert [(r["image_id"], r["cls"]) for r in readers.label_files(spark, str(tmp_path / "labels")).collect()] == [("img1", 0)]
    (tmp_path / "t.csv").write_text("filename,x_from,y_from,width,height,sign_class\na.jpg,1,2,3,4,s\nb.jpg,x,2,3,4,s\n")
    assert sorted((r["image_id"], r["bad"]) for r in readers.truth_csv(spark, str(tmp_path / "t.csv")).collect()) == [("a.jpg", False), ("b.jpg", True)]
    with pytest.raises(ValueError):
        writers.write_export(None, "x", "xml", [])


def test_stream_clips_equal_batch(spark, tmp_path):
    from framesift.streaming.ingest import CLIP, ClipCutter  # noqa: F401

    import pandas as pd

    class State:
        value = None

        def get(self):
            return self.value

        def exists(self):
            return self.value is not None

        def update(self, v):
            self.value = v

    cutter = ClipCutter(1000, 4, 2)
    cutter.state = State()
    ms = [0, 100, 200, 5000, 5100, 5200, 5300, 5400, 9000]
    out = []
    for part in (ms[:4], ms[4:]):
        for frame in cutter.handleInputRows(("r",), iter([pd.DataFrame({"ms": part, "id": part})]), None):
            out += frame["frame_ids"].tolist()
    assert out == [[0, 100, 200], [5000, 5100, 5200, 5300]]


def test_streams_keep_no_rows_on_the_driver(spark, tmp_path):
    from framesift.streaming.ingest import once_each, run_to_table

    for i in range(3):
        spark.range(i * 5, i * 5 + 10, 1, 1).selectExpr("id", "id % 4 AS kind").write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("id long, kind long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_to_table(once_each(read, ["id"]), "each", "append", str(tmp_path / "c1"))
    assert sorted(x["id"] for x in got.collect()) == list(range(20)) and got.inputFiles()
    counted = run_to_table(read.groupBy("kind").count(), "counts", "complete", str(tmp_path / "c2"))
    assert {x["kind"]: x["count"] for x in counted.collect()} == {0: 7, 1: 8, 2: 8, 3: 7} and counted.inputFiles()
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema("id long").parquet(str(tmp_path / "none"))
    assert run_to_table(empty, "none", "append", str(tmp_path / "c3")).count() == 0


def test_open_windows_are_flushed(spark, tmp_path):
    import itertools
    import time

    import pandas as pd

    from framesift.streaming.ingest import frames_in_order, open_clips, rocks_state, run_to_table, stream_clips

    frames = [(int(ms), i) for i, ms in enumerate(random.Random(2).choices(range(500), k=2000))]
    chunks = [pd.DataFrame(c, columns=["ms", "id"]) for c in itertools.batched(frames, 300)]
    assert list(frames_in_order(iter(chunks))) == sorted(frames)

    rows = [("a", ms, ms) for ms in (0, 100, 200, 5000, 5100)] + [("b", 7, 7), ("b", 8, 8)] + [("c", 1, 1)]
    spark.createDataFrame(rows, "run string, ms long, id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("run string, ms long, id long").parquet(str(tmp_path / "in"))
    with rocks_state(spark):
        closed = run_to_table(stream_clips(read, 1000, 4, 2), "clips", "append", str(tmp_path / "c1"))
        left = open_clips(spark, str(tmp_path / "c1"), 2)
        assert closed.columns == left.columns
        assert sorted((x["run"], x["clip_index"], x["frame_ids"]) for x in closed.union(left).collect()) == [("a", 0, [0, 100, 200]), ("a", 1, [5000, 5100]), ("b", 0, [7, 8])]
        # an unbounded stream: the timer closes quiet runs
        query = stream_clips(read, 1000, 4, 2, 100).writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "c2")).start()
        until = time.time() + 40
        while time.time() < until and spark.table("timed").count() < 3:
            time.sleep(0.2)
        query.stop()
        assert sorted((x["run"], x["clip_index"], x["frame_ids"]) for x in spark.table("timed").collect()) == [("a", 0, [0, 100, 200]), ("a", 1, [5000, 5100]), ("b", 0, [7, 8])]


def test_evenly_spaced_rows_collect_picks_only(spark):
    rows = spark.range(1, 40).selectExpr("explode(sequence(0L, id - 1)) AS item", "id AS k")
    got = {x["k"]: x["picks"] for x in seq.evenly_spaced_rows(rows, "k", "item", 5).collect()}
    assert got == {n: list(range(n)) if n <= 5 else [round(i * (n - 1) / 4) for i in range(5)] for n in range(1, 40)}
