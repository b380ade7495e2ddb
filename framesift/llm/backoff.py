"""Operator 5: language-model scores from a weighted backoff automaton over smoothed n-grams.

Tokens are the words of the text (ASCII white space apart, ASCII letters lower-cased) and one end.  A state
is a context of up to ``order`` - 1 words that the training texts contain; its arcs are the words seen after
it, each with its smoothed log10 probability, and its failure arc leads to the context without its first word at the price
K / (c(h) + K), stored with the state:

    p(w | h) = (c(h w) + K p(w | shorter h)) / (c(h) + K),   p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

which sums to one over the vocabulary with one unknown word; K (``PRIORS``) is set for each length of context.  A text is read
once from left to right and carries its state: each token takes failure arcs until the state has an arc for it, then
that arc, whose target is the longest state that ends there; prices and log10 probabilities add up.  A block's texts
are read side by side.

No machine holds the whole automaton; each block of texts builds the part that its texts can reach.  Documents are dealt to blocks by
hash; a block asks for the counts of its own n-grams only.  Questions are hashes with the block's own training counts, cut into
buckets by hash; a bucket adds up all blocks' counts and answers each block with totals in the order of its
question.  So every count covers all training texts, a frequent word costs one entry a block, and
blocks and buckets have a bounded size at any input size.  Messages are the pairs of blocks and buckets that have an n-gram in common: their
number grows faster than the input while they shrink, and never beyond the n-grams asked for.  Tasks are at most ``MAX_TASKS``, each reading its blocks
one after the other.  Words have 64-bit hashes; longer n-grams have 16 bits more than the corpus's characters need to be
numbered, so fewer than one in 65,000 are mistaken for another at any size.

Defined results: null and blank texts are the end token alone; rows with ``learn`` null or false are
scored but not learned from; repeated rows are learned and scored one by one; without training rows N and
V are 0 and each token has probability 1; an empty table gives an empty result; very long texts are read whole; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from framesift.llm.arrow import map_rows
from framesift.llm.words import run_hashes, word_hashes, words_of
from framesift.plans.shared import write_shared

ORDER = 3
#: Weight of the shorter context's distribution, in counts, for contexts of one word, two and so on; the last holds for longer ones.
PRIORS = (800.0, 10.0)
BLOCK_CHARS = 6 << 20
#: Tokens that are read one after the other.
PIECE = 512
BUCKET_ENTRIES = 2_000_000
MAX_TASKS = 10_000
#: Bytes of texts that one task holds back to pack texts of the same block together.
HOLD_BYTES = 24 << 20

PACKED = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("data", T.BinaryType())])
QUESTIONS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("data", T.BinaryType())])
ANSWERS = T.StructType([
    T.StructField("block", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("data", T.BinaryType()),
    T.StructField("tokens", T.LongType()), T.StructField("distinct", T.LongType()),
])
SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
])


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Unsigned 64-bit arrays, byte plane by byte plane, so that the planes of small numbers vanish."""
    planes = [np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unsqueeze(data: bytes, arrays: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(arrays, 8, -1)
    return [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]


def _steps(hashes: np.ndarray) -> np.ndarray:
    """Differences of ascending hashes, the first one whole."""
    return np.diff(hashes, prepend=np.uint64(0))


def _pack(rows: Iterator[tuple]) -> Iterable[tuple]:
    held: dict[int, list[tuple]] = {}
    size = 0
    packer = zstandard.ZstdCompressor(level=3)

    def flush() -> Iterator[tuple]:
        for block, own in held.items():
            yield block, packer.compress(pickle.dumps(own, 5))
        held.clear()

    for block, doc_id, learn, text in rows:
        data = b" ".join(words_of(text))
        held.setdefault(block, []).append((doc_id, bool(learn), data))
        size += len(data)
        if size >= HOLD_BYTES:
            yield from flush()
            size = 0
    yield from flush()


def _unpack(rows: Iterable[bytes]) -> list[tuple]:
    return [x for data in rows for x in pickle.loads(zstandard.ZstdDecompressor().decompress(data))]


END = np.uint64(word_hashes([b""])[0])


class Grams:
    """The n-grams of one block: for each length its distinct hashes, a token that ends each, and
    token by token the n-gram that it ends (-1: none)."""

    def __init__(self, docs: list[tuple], order: int, bits: int) -> None:
        per_doc = [np.r_[word_hashes(data.split()), END] for _, _, data in docs]
        sizes = np.array([len(x) for x in per_doc])
        self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes
        self.learn = np.repeat([x[1] for x in docs], sizes)
        tokens = np.concatenate(per_doc)
        del per_doc
        offset = np.arange(len(tokens), dtype=np.int32) - np.repeat(self.starts, sizes).astype(np.int32)
        self.hashes, self.at, self.where = [], [], []
        for length in range(1, order + 1):
            whole = np.flatnonzero(offset >= length - 1).astype(np.int32)
            grams = tokens if length == 1 else run_hashes(tokens, length)[whole - length + 1] >> np.uint64(64 - bits) if len(whole) else tokens[:0]
            distinct, inverse = np.unique(grams, return_inverse=True)
            del grams
            at, where = np.full(len(tokens), -1, np.int32), np.zeros(len(distinct), np.int32)
            at[whole] = inverse
            where[inverse] = whole
            self.hashes.append(distinct)
            self.where.append(where)
            self.at.append(at)

    def own_counts(self, length: int) -> np.ndarray:
        at = self.at[length - 1]
        return np.bincount(at[(at >= 0) & self.learn], minlength=len(self.hashes[length - 1]))


def _cuts(hashes: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket begins in ascending hashes: buckets are equal ranges of the hash."""
    edges = np.array([(i << bits) // buckets for i in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(hashes, edges), len(hashes)]


def _ask(order: int, bits: int, buckets: int):
    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for block, own in groupby(rows, key=lambda r: r[0]):
            grams = Grams(_unpack(r[1] for r in own), order, bits)
            for length in range(1, order + 1):
                hashes, counts = grams.hashes[length - 1], grams.own_counts(length)
                cuts = _cuts(hashes, 64 if length == 1 else bits, buckets)
                for bucket in np.flatnonzero(np.diff(cuts)):
                    i, j = cuts[bucket], cuts[bucket + 1]
                    yield int(bucket), block, length, _squeeze(_steps(hashes[i:j]), counts[i:j])

    return run


def _answer(rows: Iterator[tuple]) -> Iterable[tuple]:
    for (bucket, length), own in groupby(rows, key=lambda r: (r[0], r[2])):
        blocks, hashes, counts = [], [], []
        for _, block, _, data in own:
            steps, c = _unsqueeze(data, 2)
            blocks.append(block)
            hashes.append(np.cumsum(steps, dtype=np.uint64))
            counts.append(c)
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        at = 0
        for i, (block, h) in enumerate(zip(blocks, hashes, strict=True)):
            first = i == 0 and length == 1
            yield block, length, bucket, _squeeze(totals[inverse[at : at + len(h)]]), int(totals.sum()) if first else 0, int((totals > 0).sum()) if first else 0
            at += len(h)


class Automaton:
    """States, arcs and failure arcs that a block's texts can reach.

    An n-gram of the block has one number over all lengths.  It is an arc of its context (all but its last word) where the
    training texts hold it, and a state where they hold it and it is short enough; 0 is the state of no context.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], priors: tuple[float, ...], total: int, vocabulary: int) -> None:
        order = len(counts)
        sizes = [len(h) for h in grams.hashes]
        self.base = np.cumsum([1, *sizes])
        n = int(self.base[-1])
        self.arc, self.weight, self.target = np.zeros(n, bool), np.zeros(n), np.zeros(n, np.int32)
        self.price, self.failure, self.level = np.zeros(n), np.zeros(n, np.int32), np.zeros(n, np.int8)
        shorter = context_count = None
        for length in range(1, order + 1):
            own = slice(int(self.base[length - 1]), int(self.base[length]))
            count = counts[length - 1]
            if length == 1:
                p = (count + 0.5) / (total + 0.5 * (vocabulary + 1))
                self.arc[own] = True  # words that were never seen share the unknown word's arc, which leads to no context
                suffix = np.zeros(len(count), np.int64)
            else:
                at, ends = grams.at[length - 2], grams.where[length - 1]
                prior = priors[min(length - 2, len(priors) - 1)]
                suffix = int(self.base[length - 2]) + at[ends]
                context_count = counts[length - 2][at[ends - 1]]
                p = np.where(context_count > 0, (count + prior * shorter[at[ends]]) / (context_count + prior), shorter[at[ends]])
                self.arc[own] = (count > 0) & (context_count > 0)
            self.weight[own] = np.log10(p)
            state = (count > 0) & (length < order)
            self.target[own] = np.where(state, np.arange(own.start, own.stop), self.target[suffix] if length > 1 else 0)
            if length < order:
                prior = priors[min(length - 1, len(priors) - 1)]
                self.price[own] = np.log10(prior / (count + prior))
                self.failure[own] = self.target[suffix] if length > 1 else 0
                self.level[own] = length
            shorter = p

    def scores(self, grams: Grams) -> np.ndarray:
        """One log10 probability a text: all texts of the block are read side by side from left to right.

        A state depends on the last ``order`` - 1 tokens only, so a long text is read in pieces, each of which takes up its state
        from the tokens before it.
        """
        order = len(grams.at)
        pieces = -(-grams.sizes // PIECE)
        text = np.repeat(np.arange(len(pieces)), pieces)
        begin = PIECE * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        sizes = np.minimum(PIECE, grams.sizes[text] - begin)
        warm = np.where(begin > 0, order - 1, 0)
        starts, sizes = grams.starts[text] + begin - warm, sizes + warm
        by_size = np.argsort(-sizes, kind="stable")
        starts, sizes, warm, text = starts[by_size], sizes[by_size], warm[by_size], text[by_size]
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # pieces that have a token at each step
        state, out = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
        for step, n in enumerate(active.tolist()):
            at, now = starts[:n] + step, state[:n]
            if step == order - 1:
                out[warm > 0] = 0.0
            for level in range(min(step, order - 1), -1, -1):
                here = np.flatnonzero((now >= 0) & (self.level[np.maximum(now, 0)] == level))
                if not len(here):
                    continue
                gram = int(self.base[level]) + grams.at[level][at[here]]
                taken = self.arc[gram]
                found, failed = here[taken], here[~taken]
                out[found] += self.weight[gram[taken]]
                now[found] = -1 - self.target[gram[taken]]  # done with this token
                out[failed] += self.price[now[failed]]
                now[failed] = self.failure[now[failed]]
            np.subtract(-1, now, out=now)
        return np.bincount(text, weights=out, minlength=len(pieces))


def _traverse(order: int, bits: int, priors: tuple[float, ...], total: int, vocabulary: int):
    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for _, own in groupby(rows, key=lambda r: r[0]):
            answers: dict[int, list[np.ndarray]] = {}
            packed = []
            for _, length, _, data in own:  # answers come first, by length and bucket
                if length:
                    answers.setdefault(length, []).append(_unsqueeze(data, 1)[0])
                else:
                    packed.append(data)
            docs = _unpack(packed)
            del packed
            grams = Grams(docs, order, bits)
            ids = [doc_id for doc_id, *_ in docs]
            del docs
            counts = [np.concatenate(answers.pop(n)).astype(np.int64) if n in answers else np.zeros(0, np.int64) for n in range(1, order + 1)]
            automaton = Automaton(grams, counts, priors, total, vocabulary)
            words = grams.at[0]
            known, bases = (np.add.reduceat(x[words], grams.starts) for x in ((counts[0] > 0).astype(np.int64), automaton.weight[1 : 1 + len(counts[0])]))
            scores = automaton.scores(grams)
            for i, doc_id in enumerate(ids):
                yield doc_id, int(grams.sizes[i]), int(known[i]), total, float(bases[i]), float(scores[i])

    return run


def backoff_scores(docs: DataFrame, learn: Column, order: int = ORDER, priors: tuple[float, ...] = PRIORS, block_chars: int = BLOCK_CHARS, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score (unigrams), score (the automaton's log10 probability).

    ``learn`` is a condition over the columns of ``docs``; its rows are the training texts.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), text.alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(64, int(chars).bit_length() + 16)
    blocks = max(1, -(-chars // block_chars))
    buckets = max(1, -(-chars * order // (6 * bucket_entries)))
    tasks = min(blocks, MAX_TASKS)
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "learn", "text")
    packed = map_rows(dealt, _pack, PACKED, weight=lambda r: len(r[1]), slice_rows=128)
    together = packed.repartition(tasks, "block").sortWithinPartitions("block")
    questions = map_rows(together, _ask(order, bits, buckets), QUESTIONS, weight=lambda r: len(r[3]), slice_rows=8)
    by_bucket = questions.repartition(min(buckets, MAX_TASKS), "bucket").sortWithinPartitions("bucket", "length", "block")
    answers = write_shared(map_rows(by_bucket, _answer, ANSWERS, weight=lambda r: len(r[3]), slice_rows=8), "counts")
    sums = answers.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    # length 0 marks texts; sorted after the answers, which come in the order of the block's own n-grams
    both = answers.select("block", "length", "bucket", "data").union(packed.select("block", F.lit(0), F.lit(0), "data"))
    ordered = both.repartition(tasks, "block").sortWithinPartitions("block", F.desc(F.col("length") > 0), "length", "bucket")
    return map_rows(ordered, _traverse(order, bits, priors, int(sums["tokens"] or 0), int(sums["distinct"] or 0)), SCORES, slice_rows=8)
