"""Operator 9: SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint of B bytes is a set of B (position, byte) postings.  Two fingerprints that differ in at
most d bits differ in at most d bytes, so they share at least B - d postings: the guaranteed
minimum.  The index is read at the combinations of positions that any pair with that many
shared postings must have in common; pairs found there are tallied over all eight positions, most of them fall short of
the minimum and go, and those that reach it are verified bit by bit.

For 64-bit fingerprints and d = 3 any five of eight positions hold three within one half, so
eight keys of three positional bytes reach every link (``HALVES``).  Equal fingerprints are one
node; each node's rows in the index are counted, not its documents.

Long index lists.  A list is compared in one task, in blocks, and gives at most one link less than
its nodes (a spanning forest of its links), never all pairs.  So a node meets at most 8 x ``long_list`` others,
however large the corpus is: a list of over ``long_list`` nodes
is split by two further positions (any five shared positions that include the three have two
more), and those lists hold at most 2**24 distinct fingerprints since 40 of 64 bits are fixed;
from ``FLIP_FROM`` nodes on, they are searched by flipping up to three of the 24 free bits, linear in
their length.

Defined results: null or blank texts have fingerprint zero and link like any other; repeated
rows count as one document; a null doc_id takes part with its text but can name no component;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framesift.llm.arrow import map_rows
from framesift.llm.words import MIX, mixed, shingle_hashes, words_of
from framesift.plans.graph import connected_components
from framesift.plans.shared import write_shared

BYTES, DISTANCE = 8, 3
HALVES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
LONG_LIST = 4096
#: From this many nodes on, trying 2325 flips for each node is cheaper than comparing all pairs.
FLIP_FROM = 16384

FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """For an (n, w) array of 64-bit words, how many rows have each of the 64·w bits set.

    Rows are added in threes by carry-save adders; only the few words left at each weight are
    unpacked, so the cost is a few word operations a row instead of one for each bit.
    """
    width = rows.shape[1]
    totals = np.zeros(64 * width, np.int64)
    todo, weight = [rows], 1
    while todo:
        now, carried = np.concatenate(todo), []
        while len(now) >= 3:
            k = len(now) // 3
            x, y, z = now[:k], now[k : 2 * k], now[2 * k : 3 * k]
            half = x ^ y
            carried.append((x & y) | (half & z))
            now = np.concatenate([half ^ z, now[3 * k :]])
        if len(now):
            bits = np.unpackbits(now.astype("<u8").view(np.uint8).reshape(len(now), -1), axis=1, bitorder="little")
            totals += weight * bits.sum(axis=0, dtype=np.int64)
        todo, weight = carried, 2 * weight
    return totals


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits: each set where over half of the hashes have it set; zero without hashes."""
    if not len(hashes):
        return 0
    bits = bit_counts(hashes[:, None]) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(shingle_words: int):
    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for doc_id, text in rows:
            yield doc_id, _signed(fingerprint(shingle_hashes(words_of(text), shingle_words)))

    return run


def simhash(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every whole text as a signed long; one narrow pass."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, _fingerprints(shingle_words), FINGERPRINTS)


def byte_at(fp, position: int):
    return F.shiftright(fp, 8 * position).bitwiseAND(F.lit(255).cast("long"))


def positional_key(fp, positions: tuple[int, ...], number: int):
    """One long for the bytes at ``positions`` and the number of the combination."""
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(byte_at(fp, p))
    return key


LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)


def shared_bytes(diff: np.ndarray) -> np.ndarray:
    """Tally of equal positional bytes, for each 64-bit word of two fingerprints' difference (x ^ y)."""
    # the high bit of a byte stays clear only where the whole byte is zero
    return np.bitwise_count(~(((diff & LOW7) + LOW7) | diff | LOW7))


def verified(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs (broadcast) are links: first the count filter, then the differing bits of the pairs that pass it."""
    diff = x ^ y
    good = shared_bytes(diff) >= BYTES - distance
    good[good] = np.bitwise_count(diff[good]) <= distance
    return good


class Forest:
    """Union-find over positions of one index list."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _pairs_by_blocks(fps: np.ndarray, distance: int, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(fps), block):
        for j in range(i, len(fps), block):
            good = verified(fps[i : i + block, None], fps[None, j : j + block], distance)
            a, b = np.nonzero(np.triu(good, 1) if i == j else good)
            yield a + i, b + j


def _pairs_by_flips(fps: np.ndarray, distance: int, free: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of sorted distinct ``fps`` that agree outside the bytes ``free``."""
    bits = [np.uint64(1 << (8 * p + b)) for p in free for b in range(8)]
    for k in range(1, distance + 1):
        for flips in combinations(bits, k):
            other = fps ^ np.bitwise_or.reduce(flips)
            at = np.searchsorted(fps, other)
            hit = (at < len(fps)) & (fps[np.minimum(at, len(fps) - 1)] == other) & (other > fps)
            a = np.nonzero(hit)[0]
            a = a[verified(fps[a], fps[at[a]], distance)]
            yield a, at[a]


def _forest_links(fps: np.ndarray, distance: int, free: tuple[int, ...] = ()) -> list[tuple[int, int]]:
    fps = np.unique(fps)
    pairs = _pairs_by_flips(fps, distance, free) if free and len(fps) >= FLIP_FROM else _pairs_by_blocks(fps, distance)
    forest, links = Forest(len(fps)), []
    for a, b in pairs:
        links += [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if forest.join(i, j)]
    signed = fps.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in links]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Keys, where each key's list begins, and the other columns; the last list of a batch waits for its rest."""
    waiting: list[list[np.ndarray]] = []

    def cut(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
        key, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        return key, np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), *rest

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if waiting and last == 0 and waiting[0][0][0] == columns[0][-1]:
            waiting.append(columns)
            continue
        head = [*waiting, [c[:last] for c in columns]]
        if sum(len(x[0]) for x in head):
            yield cut(head)
        waiting = [[c[last:] for c in columns]]
    if waiting:
        yield cut(waiting)


def _search(distance: int, frees: list[tuple[int, ...]] | None = None, shift: int = 0):
    """Links of sorted index lists; ``frees``: the free positions by the key's number, above ``shift`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(LINKS)
        for key, starts, fp in _runs(batches):
            ends = np.r_[starts[1:], len(key)]
            links: list[tuple[int, int]] = []
            pairs = starts[ends - starts == 2]
            if len(pairs):
                x, y = fp[pairs], fp[pairs + 1]
                good = verified(x.view(np.uint64), y.view(np.uint64), distance)
                links += zip(x[good].tolist(), y[good].tolist(), strict=True)
            for i in np.flatnonzero(ends - starts > 2):
                own = fp[starts[i] : ends[i]].view(np.uint64)
                links += _forest_links(own, distance, frees[int(key[starts[i]]) >> shift] if frees else ())
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def _numbered_keys(combos: list[tuple[int, ...]]):
    return F.explode(F.array(*[positional_key(F.col("fp"), c, i) for i, c in enumerate(combos)]))


def link_fingerprints(nodes: DataFrame, distance: int = DISTANCE, long_list: int = LONG_LIST, partitions: int | None = None) -> DataFrame:
    """Links (a, b) that join the distinct 64-bit fingerprints in ``nodes.fp`` into the components of
    "at most ``distance`` bits differ" (``distance`` 3 or less)."""
    if not 0 <= distance <= 3:
        raise ValueError("the guaranteed minimum of five shared bytes holds for up to three bits")
    spark = nodes.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = nodes.select(_numbered_keys(HALVES).alias("key"), "fp")
    long_keys = write_shared(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > long_list).select("key"), "long-lists")
    if not long_keys.limit(1).count():
        return index.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_search(distance), LINKS)
    short = index.join(long_keys, "key", "left_anti").select("key", "fp")
    links = short.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_search(distance), LINKS)
    # two further positions beside each triple: 8 x 10 keys of five bytes, only for nodes in long lists
    fives = [(*three, *two) for three in HALVES for two in combinations([p for p in range(8) if p not in three], 2)]
    frees = [tuple(p for p in range(8) if p not in five) for five in fives]
    # the numbers of a key's triple, so a node is split only within its own long lists
    owned = index.join(long_keys, "key", "left_semi").select("fp", F.shiftright("key", 24).cast("int").alias("triple"))
    split = F.explode(F.array(*[F.struct(F.lit(i // 10).alias("triple"), positional_key(F.col("fp"), c, i).alias("key")) for i, c in enumerate(fives)]))
    parts = owned.select("fp", "triple", split.alias("part")).where("part.triple = triple").select("part.key", "fp").distinct()
    more = parts.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_search(distance, frees, 40), LINKS)
    return links.union(more)


def simhash_components(docs: DataFrame, shingle_words: int = 3, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most ``distance`` bits."""
    prints = write_shared(simhash(docs, shingle_words), "fingerprints")
    nodes = write_shared(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    links = link_fingerprints(nodes, distance)
    members = connected_components(links)
    in_group = members.join(nodes, members["node"] == nodes["fp"]).select("node", "component", "first_id")
    least = write_shared(in_group.groupBy("component").agg(F.min("first_id").alias("group_id")), "least-ids")
    named = members.join(least, "component").select("node", "group_id")
    owners = write_shared(
        nodes.join(named, nodes["fp"] == named["node"], "left").select(nodes["fp"].alias("node_fp"), F.coalesce("group_id", "first_id").alias("component_id")),
        "owners",
    )
    return prints.join(owners, prints["fp"] == owners["node_fp"]).select("doc_id", "fp", "component_id")
