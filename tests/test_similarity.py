"""The hyperplane index: recall, hot buckets, copies, and how its candidates grow."""

import numpy as np
import pyarrow as pa
import pytest

from framesift.operators import dedup as D, similarity as S


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, embedding array<float>")


def exact(x, least):
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(x.astype(float) @ x.astype(float).T >= least, 1)), strict=True)}


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(5)
    centres = unit(r.normal(size=(60, 24)))
    return unit(np.concatenate([r.normal(size=(600, 24)), centres[r.integers(0, 60, 600)] + 0.045 * r.normal(size=(600, 24))]))


@pytest.mark.parametrize("least", [0.95, 0.8])
def test_recall(spark, clustered, least):
    found = S.indexed_pairs(frame(spark, clustered), least, 0.95, bucket=32).collect()
    want, got = exact(clustered, least), {(p["a"], p["b"]) for p in found}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 100
    assert all(abs(p["cosine"] - float(clustered[p["a"]].astype(float) @ clustered[p["b"]].astype(float))) < 1e-9 for p in found)


def test_hot_buckets_are_split_and_compared_in_blocks(spark):
    """A third of all vectors within a few degrees of each other fill a bucket of every table; the last round meets them all."""
    r = np.random.default_rng(6)
    close = unit(np.ones((1, 16)) + 0.02 * r.normal(size=(120, 16)))
    x = unit(np.concatenate([close, r.normal(size=(240, 16))]))
    got = {(p["a"], p["b"]) for p in S.indexed_pairs(frame(spark, x), 0.9, 0.95, bucket=8, hot=32).collect()}
    want = exact(x, 0.9)
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 5000


def test_copies_are_one_vector(spark):
    r = np.random.default_rng(7)
    x = unit(r.normal(size=(200, 16)))
    x[50:150] = x[3]
    x[160] = unit(x[3:4] + 0.05 * r.normal(size=(1, 16)))[0]
    x[170] = x[10]
    pairs, copies = S.similar_pairs(frame(spark, x), 0.9, 0.9999)
    assert {(p["a"], p["b"]) for p in pairs.collect()} == {(3, 160)}
    groups = {g["id"]: g["leader"] for g in S.spread_to_copies(D.greedy_groups(pairs), copies).collect()}
    whole = {g["id"]: g["leader"] for g in D.greedy_groups(D.cosine_pairs(frame(spark, x), 0.9)).collect()}
    assert groups == whole == {i: 3 for i in [3, *range(50, 150), 160]} | {10: 10, 170: 10}


def candidates(x, least, recall=0.95):
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int64)), pa.array(np.full(len(x), len(x))), pa.array(np.arange(len(x))), pa.array(x.tolist(), pa.list_(pa.float32()))], names=["key", "n", "id", "embedding"])
    out = next(iter(S._codes(lambda n: S.code_shape(n, least, recall), least, recall, 7)([batch])))
    _, n = np.unique(np.concatenate(out.column(0).to_pylist()), return_counts=True)
    return int((n * (n - 1) // 2).sum())


def test_candidates_follow_the_data():
    """Ten times the vectors: about ten times the candidates, not a hundred times."""
    r = np.random.default_rng(8)
    small, large = (candidates(unit(r.normal(size=(n, 32))), 0.95) for n in (3000, 30000))
    assert large < 20 * small
    for n in (10**3, 10**6, 10**9):
        bits, tables = S.code_shape(n, 0.95, 0.95)
        assert tables * n / 2**bits <= S.CANDIDATES and tables < 80


def test_empty_and_single(spark):
    none = frame(spark, unit(np.ones((1, 4)))).limit(0)
    assert S.similar_pairs(none, 0.9)[0].count() == 0
    assert S.similar_pairs(frame(spark, unit(np.ones((1, 4)))), 0.9)[0].count() == 0
