"""Operator 3: bottom-k sketches of word-shingle hashes as document fingerprints.

A sketch holds the ``k`` smallest distinct 32-bit hashes of a text's shingles (five words, ASCII
letters lower-cased).  The k smallest of two sketches' union are the sketch of both texts together, so
sketches of parts merge into the sketch of the whole.  From sketches alone come the resemblance (share
of the union's k smallest that both have), the number of distinct shingles ((k - 1) / the k-th
smallest as a fraction of the hash range; exact below k) and the containment (resemblance times
size of the union over size of the first).

Defined results: null and blank texts have the empty sketch; two empty sketches resemble each other
with 1.0, an empty and another one with 0.0; texts of fewer than five words have one shingle, the
whole sequence; repeated rows are separate neighbours in the order of doc_id, text hash; a null
doc_id comes last in descending order; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from framesift.llm.arrow import map_rows
from framesift.llm.words import mixed, run_hashes, word_hashes, words_of

SHINGLE_WORDS = 5
K = 128
RANGE = 1 << 32
#: Rows of one ordered block: neighbours are found within a block, and across its edge by a guest row.
BLOCK_ROWS = 2048
MAX_BLOCKS = 200_000

SKETCHES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("sketch", T.BinaryType())])
NEIGHBOURS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()), T.StructField("n_shingles", T.DoubleType()),
])


def sketch(text: str | None, k: int = K, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The k smallest distinct 32-bit shingle hashes, ascending."""
    return sketch_of(run_hashes(word_hashes(words_of(text)), shingle_words), k)


def sketch_of(hashes: np.ndarray, k: int = K) -> np.ndarray:
    with np.errstate(over="ignore"):
        short = (mixed(hashes) >> np.uint64(32)).astype(np.uint32)
    if len(short) > 4 * k:  # distinct values are needed only among the smallest; repeats may need more of them
        part = 4 * k
        least = np.unique(np.partition(short, part)[:part])
        if len(least) >= k:
            return least[:k]
    return np.unique(short)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    return len(np.intersect1d(np.intersect1d(union, a, True), b, True)) / len(union)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) * RANGE / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first's shingles that the second has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def to_hex(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def from_bytes(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", "<u4")


def sketches(docs: DataFrame, k: int = K, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, sketch) of every row; ``sketch`` is k little-endian unsigned 32-bit hashes, ascending."""

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for doc_id, text in rows:
            yield doc_id, sketch(text, k, shingle_words).astype("<u4").tobytes()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, run, SKETCHES, weight=lambda r: len(r[1]))


def merged_sketches(parts: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Sketches of groups of parts.  Partial results per partition come first, so a hot key meets
    with one row for each partition."""
    schema = T.StructType([*(parts.schema[c] for c in keys), T.StructField("sketch", T.BinaryType())])

    def combine(rows: Iterator[tuple]) -> Iterable[tuple]:
        held: dict[tuple, np.ndarray] = {}
        for *key, data in rows:
            key, new = tuple(key), from_bytes(data)
            held[key] = merge(held[key], new, k) if key in held else new
            if len(held) > 50_000:
                yield from ((*x, a.astype("<u4").tobytes()) for x, a in held.items())
                held.clear()
        yield from ((*x, a.astype("<u4").tobytes()) for x, a in held.items())

    def last(table):
        import pandas as pd

        a = np.empty(0, np.uint32)
        for data in table["sketch"]:
            a = merge(a, from_bytes(data), k)
        return pd.DataFrame([[*(table[c].iloc[0] for c in keys), a.astype("<u4").tobytes()]], columns=[*keys, "sketch"])

    return map_rows(parts.select(*keys, "sketch"), combine, schema).groupBy(*keys).applyInPandas(last, schema)


def _block(bounds: list[float], doc_id: int | None) -> int:
    """The block of an id: blocks follow descending ids; nulls close the last one."""
    return len(bounds) if doc_id is None else bisect.bisect_right(bounds, -doc_id)


def _with_guests(bounds: list[float], guests: dict[int | None, list[int]]):
    """Gives every row its block, and rows in ``guests`` again to the block whose last row they follow."""

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for doc_id, tie, text in rows:
            own = _block(bounds, doc_id)
            yield own, False, doc_id, tie, text
            for block in guests.get(doc_id, ()):
                yield block, True, doc_id, tie, text

    return run


BLOCKED = T.StructType([
    T.StructField("block", T.IntegerType()), T.StructField("guest", T.BooleanType()), T.StructField("doc_id", T.LongType()),
    T.StructField("tie", T.LongType()), T.StructField("text", T.StringType()),
])


def block_borders(ids: DataFrame, block_rows: int) -> tuple[list[float], dict[int | None, list[int]]]:
    """Borders of the blocks (as negated ids), and for each id that opens a block the block before it."""
    total = ids.count()
    blocks = min(MAX_BLOCKS, -(-total // block_rows))
    if blocks <= 1:
        return [], {}
    cuts = ids.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 1 / (4 * blocks))
    bounds = sorted({-c for c in cuts})

    def own_block(rows: Iterator[tuple]) -> Iterable[tuple]:
        return ((_block(bounds, doc_id), doc_id) for (doc_id,) in rows)

    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("doc_id", T.LongType())])
    firsts = map_rows(ids, own_block, schema).groupBy("block").agg(F.max("doc_id").alias("first")).orderBy("block").collect()
    guests: dict[int | None, list[int]] = {}
    if len(firsts) > 1:
        for before, row in zip([firsts[-1], *firsts], firsts, strict=False):
            guests.setdefault(row["first"], []).append(before["block"])
    return bounds, guests


def _compare(k: int, shingle_words: int):
    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        def finish(doc_id: int | None, text: str, own: np.ndarray, after: str, after_sketch: np.ndarray) -> tuple:
            cut = len(text) // 3
            edited = text[: len(text) - cut] + after[:cut]
            edited_sketch = sketch(edited, k, shingle_words)
            return (
                doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), to_hex(own), to_hex(edited_sketch),
                resemblance(own, edited_sketch, k), resemblance(own, after_sketch, k), distinct_count(own, k),
            )

        at = first = last = guest = None  # first, last and guest: (doc_id, text, sketch)
        for block, foreign, doc_id, _, text in rows:
            if block != at:
                if last:
                    yield finish(*last, *(guest or first)[1:])
                at, first, last, guest = block, None, None, None
            if foreign and guest:
                continue  # a repeated row of the id that opens the next block
            now = (doc_id, text or "", sketch(text, k, shingle_words))
            if foreign:
                guest = now
                continue
            if last:
                yield finish(*last, *now[1:])
            first, last = first or now, now
        if last:
            yield finish(*last, *(guest or first)[1:])

    return run


def sketch_neighbours(docs: DataFrame, k: int = K, shingle_words: int = SHINGLE_WORDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fingerprint of each text, of its edited text and their likeness, and the likeness to the next document.

    The order is doc_id descending; the edited text has its last third replaced by the beginning of
    the next document (after the last: the first).  Block borders come from the ids alone; each
    block is a task of its own, sorted and read as a stream, and gets the first row of the block after it as a guest.
    Texts are shuffled once.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text")
    )
    bounds, guests = block_borders(rows.select("doc_id"), block_rows)
    blocked = map_rows(rows, _with_guests(bounds, guests), BLOCKED, weight=lambda r: len(r[4] or ""), slice_rows=128)
    ordered = blocked.repartitionById(len(bounds) + 1, "block").sortWithinPartitions("block", F.desc("guest"), F.col("doc_id").desc_nulls_last(), "tie")
    return map_rows(ordered, _compare(k, shingle_words), NEIGHBOURS, slice_rows=64)
