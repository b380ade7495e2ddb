"""Operator 10: packing by power-of-two decomposition.

Every document is tokenised, closed by one end id and cut into pieces whose lengths are
powers of two: as many pieces of ``max_length`` as fit, then the binary digits of the rest,
longest first.  Pieces of equal length belong to one bucket, and the bucket leads the sequence id, so ids of equal lengths are
neighbours; ``write_buckets`` writes one folder a bucket, from which batches of one shape are read.  Each piece is a sequence of its
own, so no sequence crosses documents and none needs padding.

Defined results: a null text counts as empty and yields the end id alone (one piece of
length 1); repeated rows are packed one by one; an empty table gives an empty result; very
long texts give many pieces of ``max_length``; other input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from framesift.llm.arrow import map_rows

END_ID = 1
MAX_LENGTH = 2048
#: Distinct white-space separated chunks whose ids one worker remembers (about 150 bytes each).
CACHE_CHUNKS = 400_000

#: Characters of texts after which they are tokenised together.
HELD_CHARS = 4 << 20
#: Where a piece's bucket stands in its sequence id.
BUCKET_SHIFT = 58

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("bucket", T.IntegerType()),
    T.StructField("ids", T.BinaryType()),
])


def power_pieces(n: int, max_length: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole maxima first, then falling powers of two."""
    pieces = [(start, max_length) for start in range(0, n - n % max_length, max_length)]
    at, rest = n - n % max_length, n % max_length
    for bit in range(max_length.bit_length() - 2, -1, -1):
        if rest >> bit & 1:
            pieces.append((at, 1 << bit))
            at += 1 << bit
    return pieces


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it
    is printable Latin-1, else the next free one from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in kept else next(spare)) for b in range(256)]


#: A tokenizer that lower-cases and never joins across white space gives these texts the ids of their chunks, however they are spelt.
PROBES = ["Ab cD", "one  TWO\nthree", "x 1,2 y. Z", "don't Stop it's", "é É ß", "a-b  (c) [D]", "under_score __ w", "12 345 6", " lead", "tail ", "\t!\u00a0? ..", "Ünï code ﬁ 漢字 かな"]


class ChunkIds:
    """Token ids of texts for a tokenizer that lower-cases and never joins across white space.

    Whether the tokenizer is one is tried on ``PROBES``; any other encodes whole texts.

    A chunk between white space always gets the same ids, so they are remembered per chunk, as
    little-endian unsigned 32-bit bytes: a document's ids are one join.  A new chunk that is a word
    of Latin letters with closing punctuation goes straight to the vocabulary's merges, word and
    punctuation apart; every other chunk goes through the whole tokenizer.
    """

    WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?]*)")

    def __init__(self, tokenizer_path: str, limit: int = CACHE_CHUNKS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.alphabet = str.maketrans(dict(enumerate(byte_characters())))
        self.limit = limit
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.by_chunks = self._chunks_alike()

    def _whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [b"".join([i.to_bytes(4, "little") for i in e.ids]) for e in encoded]

    def _chunks_alike(self) -> bool:
        """Whether the shortcuts give what the whole tokenizer gives."""
        try:
            chunked = self._by_chunks(PROBES)
        except Exception:  # a model without the byte alphabet refuses the words' shown form
            return False
        return chunked == self._whole(PROBES)

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            shown = word.encode().decode("latin-1").translate(self.alphabet)
            ids = self.words[word] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
        return ids

    def _learn(self, fresh: set[bytes]) -> None:
        rest = []
        for chunk in fresh:
            text = chunk.decode("utf-8", "replace")
            if found := self.WORD.fullmatch(text):
                ids = self._word(found[1].lower())
                self.chunks[chunk] = ids + self._word(found[2]) if found[2] else ids
            else:
                rest.append((chunk, text))
        encoded = self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
        for (chunk, _), e in zip(rest, encoded, strict=True):
            self.chunks[chunk] = b"".join([i.to_bytes(4, "little") for i in e.ids])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self._by_chunks(texts) if self.by_chunks else self._whole([t or "" for t in texts])

    def _by_chunks(self, texts: list[str | None]) -> list[bytes]:
        if len(self.chunks) > self.limit:
            self.chunks, self.words = {}, {}
        # lower-casing A-Z at once halves the forms; a special token's own spelling must stay as it is
        data = [(t or "").encode("utf-8", "replace") for t in texts]
        split = [(d if b"<|" in d else d.lower()).split() for d in data]
        if fresh := {c for chunks in split for c in chunks if c not in self.chunks}:
            self._learn(fresh)
        known = self.chunks
        return [b"".join([known[c] for c in chunks]) for chunks in split]


def _pack(tokenizer_path: str, end_id: int, max_length: int):
    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = ChunkIds(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        held: list[tuple] = []
        chars = 0

        def flush() -> Iterator[tuple]:
            for (doc_id, _), ids in zip(held, coder.encode([t for _, t in held]), strict=True):
                ids += end
                n = len(ids) // 4
                for start, length in power_pieces(n, max_length):
                    yield doc_id, start, length, n, length.bit_length() - 1, ids[4 * start : 4 * (start + length)]

        for row in rows:
            held.append(row)
            chars += len(row[1] or "")
            if len(held) >= 256 or chars >= HELD_CHARS:
                yield from flush()
                held, chars = [], 0
        yield from flush()

    return run


def pack_power_of_two(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, max_length: int = MAX_LENGTH) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, bucket (log2 of length), ids
    (binary, little-endian unsigned 32-bit), sequence_id and offset.

    ``max_length`` must be a power of two, 2**30 at most.  Every piece is one whole sequence: ``offset`` is 0 and
    ``sequence_id`` unique.  One narrow pass; nothing is shuffled, so a hot source costs nothing.
    The tokenizer file must lie at the same path on every machine.
    """
    if not 1 <= max_length <= 1 << 30 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two, 2**30 at most")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = map_rows(rows, _pack(tokenizer_path, end_id, max_length), PIECES, weight=lambda r: len(r[5]))
    in_bucket = F.shiftleft(F.col("bucket").cast("long"), BUCKET_SHIFT)
    return pieces.withColumns({"sequence_id": in_bucket.bitwiseOR(F.monotonically_increasing_id()), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces as Parquet, one folder for each length (``bucket=k`` holds those of 2**k ids), without a shuffle."""
    pieces.write.partitionBy("bucket").parquet(path)
