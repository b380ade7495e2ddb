"""The pipeline on a small fixture: each stage's decisions against what was planted."""

import random

import pytest


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(0)
    path = tmp_path_factory.mktemp("tables")
    item = words(r, 30)
    docs = [(i, words(r, 120) + ".") for i in range(200)]
    docs += [(1000 + i, "BUY NOW!! " * 80) for i in range(60)]
    docs += [(2000 + i, docs[i][1]) for i in range(20)]
    docs += [(3000 + i, " ".join("swap" if j == 50 else w for j, w in enumerate(docs[i + 20][1].split()))) for i in range(20)]
    docs += [(4000, words(r, 40) + " " + item + " " + words(r, 40) + "."), (5000, words(r, 50) + " me@site.example.com " + words(r, 50) + ".")]
    table = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(not 1000 <= i < 2000), 0) for i, _ in docs if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict(docs)


def test_stages(spark, folder):
    import corpus_pipeline as p

    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    after = {}
    for i, (name, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/stage{i}")
        docs = spark.read.parquet(f"{path}/stage{i}")
        after[name] = docs
        if i < len(p.STAGES) - 1:
            assert docs.columns == columns
    ids = {n: {r["doc_id"] for r in d.select("doc_id").distinct().collect()} for n, d in after.items()}
    clean = {*range(200), 4000, 5000}
    assert ids["quality"] == {i for i in texts if not 1000 <= i < 2000}
    assert clean <= ids["simhash_dedup"] and not ids["simhash_dedup"] & set(range(2000, 2020)) and len(ids["simhash_dedup"] - clean) <= 2
    assert ids["decontamination"] == ids["simhash_dedup"] - {4000}
    masked = {r["doc_id"]: r for r in after["personal_data"].collect()}
    assert "[EMAIL]" in masked[5000]["text"] and masked[5000]["n_chars"] == len(masked[5000]["text"]) and masked[0]["text"] == texts[0]
    pieces = after["packing"]
    assert ids["packing"] == ids["decontamination"] and pieces.where("length & (length - 1) <> 0 OR offset <> 0").count() == 0
    assert p.run(spark, path).count() == pieces.count()


def test_stages_with_awkward_rows(spark, folder, tmp_path):
    """Nulls, empty and repeated rows, clashing columns and an empty table in every stage."""
    import corpus_pipeline as p

    path, texts = folder
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, row2 string, keep string, kind string, _x string"
    good, copy = texts[0], texts[1]
    item = texts[4000]
    rows = [(1, None), (2, ""), (3, " \n "), (None, good), (5, copy), (5, copy), (6, copy), (7, item), (None, item), (8, "BUY NOW!! " * 80), (9, "me@site.example.com " + texts[2])]
    docs = spark.createDataFrame([(i, t, None, None, None if t is None else len(t), "r", "s", "k", "email", None) for i, t in rows], schema)

    def ids(out):
        return sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in out.select("doc_id").collect())

    stages = dict(p.STAGES)
    kept = stages["quality"](spark, docs, path)
    assert ids(kept) == [-1, -1, 5, 5, 6, 7, 8, 9] and kept.columns == docs.columns  # all labels of these ids are 1, so every text with words stays
    assert ids(stages["simhash_dedup"](spark, docs, path)) == [-1, -1, 1, 5, 5, 7, 8, 9]  # blank texts are one group; rows of one id share their fate
    assert ids(stages["decontamination"](spark, docs, path)) == [-1, 1, 2, 3, 5, 5, 6, 8, 9]
    masked = {r["doc_id"]: r for r in stages["personal_data"](spark, docs, path).collect()}
    assert masked[9]["text"].startswith("[EMAIL] ") and masked[9]["n_chars"] == len(masked[9]["text"]) and masked[1]["text"] is None and masked[9]["kind"] == "email"
    pieces = stages["packing"](spark, docs, path).collect()
    assert sum(r["start"] == 0 for r in pieces) == len(rows) and [r["length"] for r in pieces if r["doc_id"] == 1] == [1]
    for stage in stages.values():
        assert stage(spark, docs.limit(0), path).count() == 0
