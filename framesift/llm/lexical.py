"""Operator 11: ranked lexical search by hashed max-sketches with exact rescoring.

The index holds a row for each document: its number of terms, a sketch, and its distinct terms with their counts.  The sketch has ``ROWS`` rows
of coordinates, each ``LOAD`` to twice ``LOAD`` times as many as the document has distinct terms; every term is hashed to one coordinate of each row, where the
largest count that falls there is kept.  The impact of a term rises with its count, and the other parts of it
(document length, collection size, rarity) are the same for the whole document or the whole term, so the maxima of counts are the maxima of
impacts for any collection statistics: the index needs no second pass when these change.  Document frequencies leave the same
pass as partial counts and are added up when a batch of queries asks for its terms.

A search takes the queries in blocks.  A task looks all terms of the block up in the sketches of a batch of documents at once; the smallest of a
term's coordinates gives its bound, the weighted sum of these each item's.  Documents are then rescored exactly
from their own terms in the order of falling bounds, until the bound is below the score of the k-th best that this task has seen.
Only the best k of a task and item are shuffled.  The result is exact: a bound is never below the score.

Defined results: null and blank texts, and items without any term that occurs, have no rows; equal scores are ordered by doc_id, null ones last;
rows that repeat a doc_id are ranked one by one; an item that is repeated with its text is one item, several texts of one item_id are
ranked apart; an empty table on either side gives an empty result.  doc_id and item_id are read as long integers; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from framesift.llm.arrow import map_rows
from framesift.plans.shared import write_shared

TOP = 20
#: Rows of a sketch, and a row's coordinates for each distinct term, at least.
ROWS, LOAD = 4, 2
#: The largest count a coordinate tells; it stands for itself and all above.
MOST = 255
#: Documents of which a task holds the bounds at once, and terms of a block of queries.
BATCH, BLOCK_TERMS = 512, 200_000
#: Distinct terms after which a task hands over its partial document frequencies.
HELD_TERMS = 300_000

#: Bytes that part terms become spaces, A-Z become a-z; all others stay.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
INDEX = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("terms", T.BinaryType()),
    T.StructField("counts", T.BinaryType()), T.StructField("term", T.BinaryType()), T.StructField("df", T.LongType()),
])
FOUND = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Hashes:
    """64-bit hashes of terms, remembered up to a limit."""

    def __init__(self, limit: int = 300_000) -> None:
        self.known, self.limit = {}, limit

    def __call__(self, terms: Iterable[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        out = []
        for w in terms:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w, 11)
            out.append(h)
        return np.array(out, np.uint64)


def coordinates(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """A coordinate of each row for every hash; ``width`` is a power of two.  Rows step on by the upper half, made odd."""
    first, step, mask = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1), np.uint64(width - 1)
    return [((first + np.uint64(row) * step) & mask).astype(np.int64) for row in range(ROWS)]


def fold(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``ROWS`` rows of coordinatewise maxima of the counts."""
    width = 1 << max(3, (LOAD * len(hashes) - 1).bit_length())
    sketch = np.zeros((ROWS, width), np.uint8)
    rising = np.argsort(counts, kind="stable")  # of the values put at one place the last stays
    values = np.minimum(counts[rising], MOST).astype(np.uint8)
    for row, at in zip(sketch, coordinates(hashes, width), strict=True):
        row[at[rising]] = values
    return sketch


def build_index(docs: DataFrame) -> DataFrame:
    """The written index: rows with ``n`` are documents, rows with ``df`` partial document frequencies."""

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        hashes, seen = Hashes(), Counter()
        for doc_id, text in rows:
            terms = Counter(terms_of(text))
            counts = np.fromiter(terms.values(), np.uint32, len(terms))
            sketch = fold(hashes(terms), counts).tobytes() if terms else b""
            yield doc_id, int(counts.sum()), sketch, b" ".join(terms), counts.astype("<u4").tobytes(), None, None
            seen.update(terms.keys())
            if len(seen) > HELD_TERMS:
                yield from ((None, None, None, None, None, w, c) for w, c in seen.items())
                seen.clear()
        yield from ((None, None, None, None, None, w, c) for w, c in seen.items())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return write_shared(map_rows(rows, run, INDEX, weight=lambda r: len(r[2] or b"") + len(r[3] or b"") + len(r[4] or b"")), "lexical-index")


def impact(count: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * count) // (1000 * count + 12 * m)


class Block:
    """A batch of queries: their terms' hashes, and each item's (term, weight) pairs laid end to end."""

    def __init__(self, items: list[tuple[int | None, Counter]], frequency: dict[bytes, int], documents: int, length: int) -> None:
        self.documents, self.length = documents, length
        self.number = {w: i for i, w in enumerate(frequency)}
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.values()]
        self.hashes = Hashes()(frequency)
        self.ids, starts, of, by = [], [], [], []
        for item_id, terms in items:
            known = [(self.number[w], c) for w, c in terms.items() if w in self.number]
            if known:
                self.ids.append(item_id)
                starts.append(len(of))
                of += [i for i, _ in known]
                by += [c * weight[i] for i, c in known]
        self.starts, self.of, self.by = np.array(starts, np.int64), np.array(of, np.int64), np.array(by, np.int64)

    def m(self, n: int) -> int:
        return 75 + 25 * n * self.documents // self.length

    def sums(self, impacts: np.ndarray) -> np.ndarray:
        """Each item's sum of its weighted terms."""
        return np.add.reduceat(impacts[self.of] * self.by, self.starts)

    def exact(self, n: int, terms: bytes, counts: bytes) -> np.ndarray:
        """The scores of all items for one document."""
        count = np.zeros(len(self.hashes), np.int64)
        number = self.number
        for w, c in zip(terms.split(b" "), np.frombuffer(counts, "<u4").tolist(), strict=True):
            if w in number:
                count[number[w]] = c
        return self.sums(impact(count, self.m(n)))


class Bounds:
    """Upper bounds of all items' scores from a document's sketch."""

    def __init__(self, block: Block) -> None:
        self.block, self.places, self.tables = block, {}, {}

    def __call__(self, n: int, sketch: bytes) -> np.ndarray:
        rows = np.frombuffer(sketch, np.uint8).reshape(ROWS, -1)
        width = rows.shape[1]
        if width not in self.places:
            self.places[width] = coordinates(self.block.hashes, width)
        m = self.block.m(n)
        if m not in self.tables:
            if len(self.tables) > 10_000:
                self.tables.clear()
            table = self.tables[m] = impact(np.arange(MOST + 1, dtype=np.int64), m)
            table[MOST] = 1_000_000  # what no count exceeds
        least = None
        for row, at in zip(rows, self.places[width], strict=True):
            least = row[at] if least is None else np.minimum(least, row[at])
        return self.block.sums(self.tables[m][least])


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int) -> None:
        self.heaps, self.k, self.floor = [[] for _ in range(items)], k, np.ones(items, np.int64)

    def add(self, item: int, doc_id: int | None, score: int) -> None:
        heap, entry = self.heaps[item], (score, doc_id is not None, -(doc_id or 0))
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)
        if len(heap) == self.k:
            self.floor[item] = heap[0][0]


def rescore(batch: list[tuple], block: Block, bounds: Bounds, best: Best) -> int:
    """Ranks a batch of (doc_id, n, sketch, terms, counts); returns how many documents were scored exactly."""
    upper = np.stack([bounds(n, sketch) for _, n, sketch, *_ in batch], axis=1)
    scores: dict[int, np.ndarray] = {}
    for item in np.flatnonzero(upper.max(axis=1) >= best.floor).tolist():
        row = upper[item]
        open_ = np.flatnonzero(row >= best.floor[item])
        for i in open_[np.argsort(-row[open_], kind="stable")].tolist():
            if row[i] < best.floor[item]:
                break
            if i not in scores:
                doc_id, n, _, terms, counts = batch[i]
                scores[i] = block.exact(n, terms, counts)
            if scores[i][item] > 0:
                best.add(item, batch[i][0], int(scores[i][item]))
    return len(scores)


def _scan(held, k: int):
    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        block = held.value
        bounds, best, batch = Bounds(block), Best(len(block.ids), k), []
        for row in rows:
            batch.append(row)
            if len(batch) == BATCH:
                rescore(batch, block, bounds, best)
                batch = []
        if batch:
            rescore(batch, block, bounds, best)
        for item, heap in enumerate(best.heaps):
            yield from ((item, block.ids[item], -last if known else None, score) for score, known, last in heap)

    return run


def _first(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """The best k rows of each group, with their ``rank``."""
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each item (item_id, text).

    Items are dealt into blocks of about ``block_terms`` terms by a hash; each block reads the index once, not the texts.
    """
    spark = index.sparkSession
    documents, length = index.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + size // (4 * block_terms)
    found = spark.createDataFrame([], T.StructType([*FOUND.fields, T.StructField("rank", T.IntegerType())]))
    if documents and size:
        dealt = write_shared(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "lexical-items")
        for number in range(blocks):
            batch = [(r["item_id"], Counter(terms_of(r["text"]))) for r in dealt.where(F.col("block") == number).collect()]
            words = spark.createDataFrame([(w,) for w in sorted({w for _, terms in batch for w in terms})], "wanted binary")
            counted = index.where("df IS NOT NULL").join(F.broadcast(words), F.col("term") == F.col("wanted")).groupBy("term").agg(F.sum("df").alias("df"))
            frequency = {bytes(r["term"]): r["df"] for r in counted.collect()}
            block = Block(batch, frequency, documents, length)
            if not block.ids:
                continue
            rows = index.where("n > 0").select("doc_id", "n", "sketch", "terms", "counts")
            best = map_rows(rows, _scan(spark.sparkContext.broadcast(block), k), FOUND)
            # the tasks' lists meet in some groups an item first, so that no item's lists meet in one task at once
            found = found.unionByName(_first(_first(best.withColumn("part", F.spark_partition_id() % 64), k, "item", "part").drop("rank", "part"), k, "item"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    return search(build_index(docs), items, k)
