"""Operator 6: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Test items give seeds, their runs of ``SEED_WORDS`` words (letters and digits, lower case).  A seed's rarity is
the sum of its words' information (-log2 of their share in the corpus, counted over all documents, so passages
that leaked a thousand times do not make their own seeds common beyond their words).  Seeds of at least
``RARE_BITS`` bits are used, and of every item at least its rarest half, so no item is without seeds.

Where a seed occurs in a document, the passage around it is aligned with the item word by word (match +2,
mismatch -1, gap -1): as long as the item and on either side as many more words as a copy that reaches the
threshold can have been given (``slack``).  The local score is divided by that of a perfect copy.  From ``THRESHOLD`` on it is a leak: whole copies have 1.0, copies with
replaced, dropped or added words less, chance matches of single seeds far below.

Items are taken in blocks of at most ``BLOCK_WORDS`` words, each broadcast, so the test set may have any
size; documents are read once a block and never shuffled.  Words of documents are only looked up
among the items' words (``Vocabulary``): all others are alike, as they are in no seed and match nothing.

Defined results: null and blank texts and items match nothing; items of fewer than ``SEED_WORDS`` words
have themselves as their one seed; repeated rows give one result row each; null ids are carried;
empty tables give an empty result; long texts are searched whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from framesift.llm.arrow import map_rows
from framesift.llm.words import row_keys, run_hashes, without_rows, word_hashes
from framesift.plans.shared import write_shared

SEED_WORDS = 3
RARE_BITS = 26.0
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, 1
BLOCK_WORDS = 1_000_000
FILTER_BITS = 22
WORD = re.compile(r"[^\W_]+")
#: Letters and digits of Latin-1 in lower case, a space for anything else.
LATIN = bytes(ord(c.lower()) if WORD.match(c) else 32 for c in map(chr, range(256)))
#: Code points after which a piece of several texts is worked on.
PIECE_CHARS = 1 << 18

COUNTS = T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.LongType())])
LEAKS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("row2", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n_seeds", T.LongType()),
])


def words_of(text: str | None) -> list[bytes] | list[str]:
    """The words in lower case: Latin-1 bytes where the whole text can be so encoded, else strings."""
    text = text or ""
    try:
        return text.encode("latin-1").translate(LATIN).split()
    except UnicodeEncodeError:
        low = text.lower()
        return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


class Vocabulary:
    """The words of some items, numbered, with their hashes; any other word has the number after the last."""

    def __init__(self, texts: Iterable[str | None]) -> None:
        words = sorted({w.decode("latin-1") if isinstance(w, bytes) else w for text in texts for w in words_of(text)})
        self.size = len(words)
        self.numbers: dict[bytes | str, int] = {w: k for k, w in enumerate(words)}
        self.numbers |= {w.encode("latin-1"): k for k, w in enumerate(words) if ord(max(w)) < 256}
        self.hash = word_hashes([*(w.encode("utf-8", "replace") for w in words), b""])

    def of(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words, text after text, and how many words each text has."""
        words = [words_of(text) for text in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        return np.fromiter(map(self.numbers.get, chain.from_iterable(words), repeat(self.size)), np.int64, int(sizes.sum())), sizes


def pieces(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Runs of rows whose texts, the last column, have some ``PIECE_CHARS`` code points together."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or "")
        if size >= PIECE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local score and the position after its last passage word; rows are item words."""
    n = len(passage)
    slope = GAP * np.arange(n + 1)
    above, best, end = np.zeros(n + 1, np.int64), 0, 0
    for word in item:
        row = np.zeros(n + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] - GAP)
        # gaps along the row: the running maximum of score plus the price already paid
        row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + slope) - slope, 0)
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
        above = row
    return best, end


def slack(words: int, threshold: float) -> int:
    """The most words that can lie between the matches of an item of ``words`` words in a passage that scores ``threshold``."""
    return max(0, math.ceil(words * MATCH * (1 - threshold) / GAP))


def aligned_span(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score with the passage's first and last (exclusive) aligned word."""
    best, end = align(item, passage)
    if not best:
        return 0, 0, 0
    back, length = align(item[::-1], passage[:end][::-1])
    return best, end - length, end


class Seeds:
    """The items of one block with their words' hashes, and a sorted table of their seeds."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], bits: dict[int, float], default: float, seed_words: int) -> None:
        self.items = items
        rows: list[tuple[int, int, int]] = []
        for i, (_, hashes) in enumerate(items):
            runs = run_hashes(hashes, seed_words)
            size = min(seed_words, len(hashes))
            info = [bits.get(int(h), default) for h in hashes]
            rarity = [sum(info[p : p + size]) for p in range(len(runs))]
            rarest = sorted(range(len(runs)), key=lambda p: (-rarity[p], p))
            kept = {p for p in range(len(runs)) if rarity[p] >= RARE_BITS} | set(rarest[: (len(runs) + 1) // 2])
            rows += [(int(runs[p]), i, p) for p in sorted(kept)]
        rows.sort()
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)
        self.short = {len(h) for _, h in items if len(h) < seed_words}
        self.present = np.zeros(1 << FILTER_BITS, bool)
        self.present[(self.hash >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, runs: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, place in the item, place in the text) of each seed found."""
        likely = np.flatnonzero(self.present[(runs >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(likely) or not len(self.hash):
            return
        low, high = np.searchsorted(self.hash, runs[likely], "left"), np.searchsorted(self.hash, runs[likely], "right")
        for at, i, j in zip(likely[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            for s in range(i, j):
                yield int(self.item[s]), int(self.place[s]), at


def _count(vocabulary: Vocabulary, rows: Iterator[tuple]) -> Iterable[tuple]:
    counts, total = np.zeros(vocabulary.size + 1, np.int64), 0
    for piece in pieces(rows):
        numbers, _ = vocabulary.of(text for (text,) in piece)
        counts += np.bincount(numbers, minlength=vocabulary.size + 1)
        total += len(numbers)
    yield None, total
    yield from ((k, int(counts[k])) for k in np.flatnonzero(counts[:-1]).tolist())


def _find(vocabulary: Vocabulary, seeds: Seeds, seed_words: int, threshold: float, rows: Iterator[tuple]) -> Iterable[tuple]:
    for piece in pieces(rows):
        numbers, sizes = vocabulary.of(row[-1] for row in piece)
        hashes, owner, ends = vocabulary.hash[numbers], np.repeat(np.arange(len(piece)), sizes), np.cumsum(sizes)
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for size in sorted({seed_words, *seeds.short}):
            if len(hashes) >= size:
                for item, place, at in seeds.hits(run_hashes(hashes, size)):
                    text = int(owner[at])
                    if at + size <= ends[text]:  # no run goes on into the next text
                        at -= int(ends[text] - sizes[text])
                        found.setdefault(text, {}).setdefault(item, []).append((at - place, at))
        for text, items in sorted(found.items()):
            yield from _leaks(seeds, piece[text], hashes[ends[text] - sizes[text] : ends[text]], items, threshold)


def _leaks(seeds: Seeds, row: tuple, hashes: np.ndarray, found: dict[int, list[tuple[int, int]]], threshold: float) -> Iterator[tuple]:
    """The items of ``found`` (item, diagonals and places of its seeds) that a text of ``hashes`` holds."""
    *keys, text = row
    for item, spots in found.items():
        item_id, own = seeds.items[item]
        best, spare = (0.0, 0, 0), slack(len(own), threshold)
        spots = sorted(set(spots))
        at = 0
        while at < len(spots):  # spots on nearby diagonals share one passage
            last = at
            while last + 1 < len(spots) and spots[last + 1][0] - spots[last][0] <= spare:
                last += 1
            low, high = max(0, spots[at][0] - spare), min(len(hashes), spots[last][0] + len(own) + spare)
            # no score is above that of all the item's words that the passage has
            if np.isin(own, hashes[low:high]).sum() / len(own) >= threshold:
                score, start, end = aligned_span(own, hashes[low:high])
                best = max(best, (score / (MATCH * len(own)), -(low + start), low + end))
            at = last + 1
        if best[0] >= threshold:
            spans = [m.span() for m in WORD.finditer(text)]
            yield *keys, item_id, best[0], spans[-best[1]][0], spans[best[2] - 1][1], len(spots)


def find_leaks(docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and test item it holds: doc_id, row, row2, item_id, score of the best passage, its
    code points start and end, and the number of seeds found.

    ``row`` and ``row2`` are hashes of id and text, which mark the row where ids repeat or are null.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(docs), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (5 * block_words)))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        held = [(r["item_id"], r["text"]) for r in numbered.where(F.col("block") == block).orderBy("item_id", "text").toLocalIterator()]
        words = Vocabulary(text for _, text in held)
        held = [(item_id, words.hash[words.of([text])[0]]) for item_id, text in held]
        vocabulary = docs.sparkSession.sparkContext.broadcast(words)

        def count(batch: Iterator[tuple], vocabulary=vocabulary) -> Iterable[tuple]:
            return _count(vocabulary.value, batch)

        counted = map_rows(rows.select("text"), count, COUNTS).groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator()
        counts = {r["word"]: r["n"] for r in counted}
        tokens = counts.pop(None, 0)
        bits = {int(words.hash[k]): math.log2((tokens + 1) / (n + 1)) for k, n in counts.items()}
        seeds = docs.sparkSession.sparkContext.broadcast(Seeds([x for x in held if len(x[1])], bits, math.log2(tokens + 1), seed_words))

        def find(batch: Iterator[tuple], vocabulary=vocabulary, seeds=seeds) -> Iterable[tuple]:
            return _find(vocabulary.value, seeds.value, seed_words, threshold, batch)

        leaks = map_rows(rows, find, LEAKS)
        out = leaks if out is None else out.union(leaks)
    return out


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """``docs`` less the rows that hold a test item; all columns stay as they are."""
    return without_rows(docs, write_shared(leaks.select("row", "row2").distinct(), "leaked"))
