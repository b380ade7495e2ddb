"""Similar pairs of unit vectors through an index of random hyperplanes whose code length follows the number of vectors.

Every vector gets a code of ``bits`` signs in each of ``tables`` tables; vectors that share a code of a table meet in a bucket and are
verified there by one matrix product.  The number of bits grows with the logarithm of the number of vectors, so that a bucket holds about
``BUCKET`` of them at any size; the number of tables follows from the bits, the least cosine and the wanted recall.  A pair at cosine c shares a
table's code with probability p = (1 - acos(c) / pi) ** bits and is missed with (1 - p) ** tables.  Bits are
added until a vector meets about ``CANDIDATES`` others in all its tables, so the candidates grow as the vectors do; what grows faster, slowly, is the number of tables.

Equal vectors are one row first, so copies never fill a bucket.  Buckets that are still hot, because vectors lie close together, are
split again like a collection of their own: more bits, as many tables as keep the recall there, in up to ``ROUNDS`` rounds.  What cannot be split lies
within a few degrees, so nearly all of its pairs are results; it is compared in pairs of blocks of bounded size.  Only counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framesift.plans.shared import write_shared

#: Vectors a bucket is meant to hold; buckets of more than ``HOT`` are split again.
BUCKET, HOT = 128, 1024
#: Vectors that a vector meets in all its buckets, copies of a pair counted.
CANDIDATES = 256
ROUNDS, MOST_BITS, MOST_TABLES = 3, 40, 400
PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("cosine", T.DoubleType())])


def tables_for(bits: int, least: float, recall: float) -> int:
    """Tables that find a pair at ``least`` with ``recall``."""
    share = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    return max(1, min(MOST_TABLES, math.ceil(math.log(1 - recall) / math.log1p(-min(share, 1 - 1e-12)))))


def code_shape(count: int, least: float, recall: float, bucket: int = BUCKET, candidates: int = CANDIDATES) -> tuple[int, int]:
    """(bits, tables) for ``count`` vectors: at most about ``bucket`` of them share a code, and a vector meets about ``candidates`` in all tables.

    A bit more halves the buckets; it pays as long as the tables that it costs are fewer than half as many again, which they are above a cosine of 0.5.
    """
    bits = max(1, min(MOST_BITS, math.ceil(math.log2(max(2, count) / bucket))))
    while bits < MOST_BITS and tables_for(bits, least, recall) * count > candidates * 2**bits and 2 * tables_for(bits + 1, least, recall) <= 3 * tables_for(bits, least, recall):
        bits += 1
    return bits, tables_for(bits, least, recall)


def copies_of(vectors: DataFrame) -> DataFrame:
    """(id, embedding, first): ``first`` is the smallest id with the same vector.  A written table, as is the side it is joined
    with, so that adaptive execution can split a vector that very many rows share."""
    keyed = write_shared(vectors.select("id", "embedding", F.xxhash64("embedding").alias("_h"), F.xxhash64(F.lit(1), "embedding").alias("_h2")), "vectors")
    firsts = write_shared(keyed.groupBy("_h", "_h2").agg(F.min("id").alias("first")), "first-vectors")
    return write_shared(keyed.join(firsts, ["_h", "_h2"]).select("id", "embedding", "first"), "vector-copies")


def hyperplanes(bits: int, tables: int, dim: int, seed: int) -> np.ndarray:
    """Random normals, orthogonal within a table as far as there are dimensions: signs repeat each other less, so buckets are more even."""
    draw, rows = np.random.default_rng(seed), []
    for _ in range(tables):
        for begin in range(0, bits, dim):
            rows.append(np.linalg.qr(draw.standard_normal((dim, min(dim, bits - begin))))[0].T)
    return np.concatenate(rows).astype(np.float32)


def _codes(bits_of_size, least: float, recall: float, seed: int):
    """Keys of all tables for rows (key, size, id, embedding): the hash of the bucket it comes from, the table and the signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, planes = to_arrow_schema(KEYED), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            parent, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = np.stack(batch.column(3).to_pylist()).astype(np.float32)
            keys: list = [None] * len(x)
            for n in np.unique(size).tolist():
                bits, tables = bits_of_size(n)
                if (bits, tables) not in planes:
                    planes[bits, tables] = hyperplanes(bits, tables, x.shape[1], seed)
                at = np.flatnonzero(size == n)
                signs = (x[at] @ planes[bits, tables].T > 0).reshape(len(at), tables, bits)
                code = (signs * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(axis=2)
                with np.errstate(over="ignore"):
                    mixed = (parent[at].astype(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                    mixed = (mixed ^ (mixed >> np.uint64(29))) + np.arange(tables, dtype=np.uint64) * np.uint64(0x94D049BB133111EB) + code.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                for i, row in zip(at.tolist(), mixed.view(np.int64).tolist(), strict=True):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int64())), batch.column(2), batch.column(3)], schema=schema)

    return run


KEYED = T.StructType([T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def _matches(ids: np.ndarray, x: np.ndarray, own: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a bucket; with ``own`` (two blocks) only those between the blocks."""
    product = x @ x.T
    wanted = product >= least
    if own is not None and own.any() and not own.all():
        wanted &= own[:, None] != own[None, :]
    i, j = np.nonzero(np.triu(wanted, 1))
    return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), product[i, j]


def _in_buckets(least: float):
    """Verifies the buckets of rows (key, id, embedding) sorted by key: one bucket is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(PAIRS)

        def closed(parts: list) -> Iterator[pa.RecordBatch]:
            if sum(len(p[0]) for p in parts) > 1:
                found = _matches(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), None, least)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=schema)

        held, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = np.stack(batch.column(2).to_pylist()).astype(np.float64)
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            for low, high in zip(cuts, cuts[1:], strict=False):
                if key[low] != held:
                    yield from closed(parts)
                    held, parts = key[low], []
                parts.append((ids[low:high], x[low:high]))
        yield from closed(parts)

    return run


def _in_blocks(rows: DataFrame, least: float, size: int) -> DataFrame:
    """Exact pairs within each bucket of rows (key, n, id, embedding): members are dealt to blocks, blocks are compared in pairs."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    cells = rows.select("key", "id", "embedding", mine.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    keyed = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "id", "embedding")

    def compare(table: pa.Table) -> pa.Table:
        schema = to_arrow_schema(PAIRS)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        side = np.array(table.column("side").to_pylist(), bool)
        if i != j and (side.all() or not side.any()):
            return schema.empty_table()  # one block is empty
        x = np.stack(table.column("embedding").to_pylist()).astype(np.float64)
        found = _matches(table.column("id").to_numpy(), x, side if i != j else None, least)
        return pa.table([pa.array(c) for c in found], schema=schema)

    return keyed.groupBy("key", "i", "j").applyInArrow(compare, PAIRS)


def indexed_pairs(firsts: DataFrame, least: float, recall: float = 0.95, bucket: int = BUCKET, hot: int = HOT, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """Pairs (a < b, cosine) of different unit vectors (id, embedding) with an inner product of at least ``least``.

    No wrong pair is given; a pair at ``least`` is found with about ``recall`` in each round of splitting that its buckets need, closer
    ones more surely.  The result is the same on every run.
    """
    spark = firsts.sparkSession
    count = firsts.count()
    open_ = firsts.select(F.lit(0).cast("long").alias("key"), F.lit(count).cast("long").alias("n"), "id", "embedding")
    found = spark.createDataFrame([], PAIRS)
    for number in range(rounds):
        keyed = open_.mapInArrow(_codes(lambda n: code_shape(n, least, recall, bucket), least, recall, seed + number), KEYED)
        dealt = write_shared(keyed.select(F.explode("keys").alias("key"), "id", "embedding"), "vector-buckets")
        sizes = write_shared(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
        cold = dealt.join(sizes.where(F.col("n") <= hot).select("key"), "key", "left_semi")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = found.union(cold.select("key", "id", "embedding").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_in_buckets(least), PAIRS))
        over = sizes.where(F.col("n") > hot)
        if not over.limit(1).count():
            break
        # sizes are rounded to powers of two, so that few shapes of codes are needed
        rounded = F.pow(F.lit(2.0), F.ceil(F.log2("n"))).cast("long")
        open_ = write_shared(dealt.join(over.select("key", (rounded if number + 1 < rounds else F.col("n")).alias("n")), "key").select("key", "n", "id", "embedding"), "hot-vectors")
    else:
        found = found.union(_in_blocks(open_, least, hot))
    return found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def similar_pairs(vectors: DataFrame, least: float, recall: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(pairs between first copies, copies): links of different vectors, and (id, first) of all rows."""
    copies = copies_of(vectors)
    return indexed_pairs(copies.where("id = first").select("id", "embedding"), least, recall), copies.select("id", "first")


def spread_to_copies(groups: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, leader) of all rows from the groups of first copies.

    A vector's copies share all its neighbours, so the first copy's leader is theirs; a vector that is alone but for
    its copies is led by the first of them.
    """
    of = groups.select(F.col("id").alias("_f"), "leader")
    several = copies.groupBy("first").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("first").alias("_s"))
    joined = copies.join(of, F.col("first") == F.col("_f"), "left").join(several, F.col("first") == F.col("_s"), "left")
    return joined.where("leader IS NOT NULL OR _s IS NOT NULL").select("id", F.coalesce("leader", "first").alias("leader"))
