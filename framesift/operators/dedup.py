"""Exact, perceptual and embedding duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framesift.functions.paths import percent
from framesift.operators.leaders import all_pairs, leader_groups
from framesift.operators.similarity import similar_pairs, spread_to_copies
from framesift.plans.shared import write_shared

HASH_CHARACTERS, MOST_DIFFERENT = 16, 5
DUPLICATE_COSINE = 0.95


def equal_groups(rows: DataFrame, column: str) -> DataFrame:
    """Values that more than one row has, with the number of rows and the smallest id."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def duplicate_members(rows: DataFrame, column: str) -> DataFrame:
    """(id, column, first_id) of every row whose value another row has."""
    groups = equal_groups(rows, column).select(F.col(column).alias("_v"), "first_id")
    return rows.join(groups, F.col(column) == F.col("_v")).drop("_v")


def hash_distance(a: Column, b: Column, length: int = HASH_CHARACTERS) -> Column:
    """Differing characters of two hexadecimal hashes; 999 for unequal lengths."""
    steps = F.sequence(F.lit(1), F.lit(length))
    different = F.aggregate(steps, F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))
    return F.when(F.length(a) == F.length(b), different).otherwise(F.lit(999))


def hash_bands(value: Column, most: int = MOST_DIFFERENT, length: int = HASH_CHARACTERS, agree: int = 3) -> Column:
    """Keys of the hash: it is cut into most + ``agree`` pieces, and hashes that differ in at most ``most`` characters have ``agree`` of
    them in common, so one key for each combination of that many (56 keys of six characters by default) meets every such pair."""
    pieces = min(length, most + agree)
    edges = [length * i // pieces for i in range(pieces + 1)]
    parts = [F.substring(value, edges[i] + 1, edges[i + 1] - edges[i]) for i in range(pieces)]
    return F.array(*[F.concat(F.lit(f"{n}:"), *[parts[i] for i in c]) for n, c in enumerate(combinations(range(pieces), max(1, pieces - most)))])


def near_hashes(new: DataFrame, catalog: DataFrame, most: int = MOST_DIFFERENT) -> DataFrame:
    """(new_id, old_id, distance) of hashes at most ``most`` characters apart: joined by equal keys of several bands, then verified.

    Equal hashes are one row on each side before the bands are joined, so copies do not multiply.
    """
    n = new.select("phash").where("phash IS NOT NULL").distinct().select(F.col("phash").alias("a"), F.explode(hash_bands(F.col("phash"), most)).alias("band"))
    c = catalog.select("phash").where("phash IS NOT NULL").distinct().select(F.col("phash").alias("b"), F.explode(hash_bands(F.col("phash"), most)).alias("band"))
    pairs = n.join(c, "band").where(hash_distance(F.col("a"), F.col("b")) <= most).select("a", "b").distinct().withColumn("distance", hash_distance(F.col("a"), F.col("b")))
    left = new.select(F.col("id").alias("new_id"), F.col("phash").alias("_pa"))
    right = catalog.groupBy(F.col("phash").alias("_pb")).agg(F.min("id").alias("old_id"))
    return pairs.join(left, F.col("a") == F.col("_pa")).join(right, F.col("b") == F.col("_pb")).select("new_id", "old_id", "distance")


def new_asset_decisions(new: DataFrame, catalog: DataFrame, most: int = MOST_DIFFERENT) -> DataFrame:
    """Per new asset: skip (the same content under another source), mark_duplicate (a near hash) or keep."""
    content = catalog.groupBy(F.col("project").alias("_p"), F.col("sha256").alias("_h")).agg(F.min("source_id").alias("_low"), F.max("source_id").alias("_high"))
    near = near_hashes(new, catalog, most).groupBy(F.col("new_id").alias("_n")).agg(F.min("distance").alias("_d"))
    joined = new.join(content, (F.col("project") == F.col("_p")) & (F.col("sha256") == F.col("_h")), "left").join(near, F.col("id") == F.col("_n"), "left")
    other = (F.col("_low") != F.col("source_id")) | (F.col("_high") != F.col("source_id"))
    action = F.when(F.coalesce(other, F.lit(False)), "skip").when(F.col("_d").isNotNull(), "mark_duplicate").otherwise("keep")
    return joined.select("id", action.alias("action"), F.when(action == "mark_duplicate", F.concat(F.lit("phash_"), F.substring("phash", 1, 8))).alias("group_id"))


BLOCK = 1024


def cosine_pairs(vectors: DataFrame, least: float, block: int = BLOCK, count: int | None = None) -> DataFrame:
    """Exact pairs (a < b) of unit vectors (id, embedding) with an inner product of at least ``least``.

    Every vector meets every other, ``block`` rows at a time (``leaders.all_pairs``).  For very large tables and high cosines use
    ``similarity.indexed_pairs``, whose candidates share a bucket of an index.
    """
    return all_pairs(vectors, least, block, count=count)


def greedy_groups(pairs: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, leader): in ascending ids, an uncaptured node leads and captures its uncaptured neighbours.

    Equal to the lexicographically first maximal independent set with every other node at its smallest leader.
    Each round decides the nodes whose lower neighbours are all decided; states are written tables.
    """
    edges = write_shared(pairs.select(F.col("a").alias("low"), F.col("b").alias("high")).distinct(), "edges")
    nodes = edges.select(F.col("low").alias("id")).union(edges.select("high")).distinct()
    state = write_shared(nodes.withColumn("leads", F.lit(None).cast("boolean")), "leads")
    for _ in range(max_rounds):
        seen = edges.join(state.select(F.col("id").alias("_l"), "leads"), F.col("low") == F.col("_l")).groupBy("high").agg(
            F.max(F.coalesce("leads", F.lit(False))).alias("led"), F.min(F.col("leads").isNotNull()).alias("known")
        )
        joined = state.join(seen, F.col("id") == F.col("high"), "left")
        decided = F.when(F.col("high").isNull(), F.lit(True)).when(F.col("led"), F.lit(False)).when(F.col("known"), F.lit(True))
        state = write_shared(joined.select("id", F.coalesce("leads", decided).alias("leads")), "leads")
        if not state.where("leads IS NULL").limit(1).count():
            break
    else:
        raise RuntimeError(f"undecided nodes after {max_rounds} rounds")
    leaders = state.where("leads").select(F.col("id").alias("_l"))
    captured = edges.join(leaders, F.col("low") == F.col("_l")).groupBy("high").agg(F.min("low").alias("leader"))
    members = state.where("NOT leads").join(captured, F.col("id") == F.col("high")).select("id", "leader")
    return members.union(state.where("leads").select("id", F.col("id").alias("leader")))


def full_scan(assets: DataFrame, vectors: DataFrame, least: float = DUPLICATE_COSINE, recall: float | None = 0.99) -> DataFrame:
    """Members of three levels (id, level, group): equal content, then equal hash, then embedding groups of what is left.

    The pairs of the third level come from the hyperplane index with ``recall``; equal vectors are always found.  Without ``recall`` the groups are exact.
    """
    one = duplicate_members(assets, "sha256").select("id", F.lit(1).alias("level"), F.col("sha256").alias("group"))
    rest = assets.join(one.select("id"), "id", "left_anti")
    two = duplicate_members(rest, "phash").select("id", F.lit(2).alias("level"), F.col("phash").alias("group"))
    left = vectors.join(one.select("id").union(two.select("id")), "id", "left_anti")
    if recall is None:
        three = leader_groups(left, least)
    else:
        pairs, copies = similar_pairs(left, least, recall)
        three = spread_to_copies(greedy_groups(pairs), copies)
    return one.union(two).union(three.select("id", F.lit(3).alias("level"), F.col("leader").cast("string").alias("group")))


def scan_summary(members: DataFrame, total: DataFrame) -> DataFrame:
    """total, duplicate_count (all members of levels 1 and 2, of level 3 all but one), unique and rate."""
    per = members.groupBy("level", "group").agg(F.count("*").alias("n"))
    counted = per.agg(F.coalesce(F.sum(F.when(F.col("level") == 3, F.col("n") - 1).otherwise(F.col("n"))), F.lit(0)).alias("duplicate_count"))
    n = total.agg(F.count("*").alias("total"))
    joined = n.crossJoin(F.broadcast(counted))
    return joined.select("total", "duplicate_count", (F.col("total") - F.col("duplicate_count")).alias("unique"), F.when(F.col("total") < 2, "0.0%").otherwise(percent(F.col("duplicate_count"), F.greatest(F.lit(1), F.col("total")), 2)).alias("rate"))


def marked(metadata: Column, group: Column) -> Column:
    """The group ids with one more, without repeats."""
    return F.array_union(F.coalesce(metadata, F.array().cast("array<string>")), F.array(group))


TOP = T.StructType([T.StructField("query", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query, id, score, rank) of the k largest inner products of each query vector (id, embedding) with all vectors.

    Vectors are dealt to blocks by hash and shuffled once; the queries, the smaller side, go to every block.  A block's vectors are held
    while its queries stream past, and only the block's k best of each query are ranked together.
    """
    from pyspark.sql import Window as W

    n = max(1, -(-vectors.count() // block))
    rows = vectors.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("j"), F.lit(0).alias("side"), "id", "embedding")
    asks = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"), F.lit(1).alias("side"), "id", "embedding")
    tasks = min(n, max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(TOP)
        held, parts, block_ids, block_x = None, [], None, None
        for batch in batches:
            j, side, ids = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.r_[True, (j[1:] != j[:-1]) | (side[1:] != side[:-1]), True]) if len(j) else []
            for low, high in zip(cuts, cuts[1:], strict=False):
                x = np.stack(batch.column(3).slice(low, high - low).to_pylist()).astype(np.float64)
                if j[low] != held:
                    held, parts, block_x = j[low], [], None
                if side[low] == 0:
                    parts.append((ids[low:high], x))
                elif parts:
                    if block_x is None:
                        block_ids, block_x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    scores = x @ block_x.T
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # vectors come by ascending id, which breaks ties
                    columns = (np.repeat(ids[low:high], best.shape[1]), block_ids[best].ravel(), np.take_along_axis(scores, best, 1).ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    local = rows.union(asks).repartition(tasks, "j").sortWithinPartitions("j", "side", "id").mapInArrow(search, TOP)
    return local.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
