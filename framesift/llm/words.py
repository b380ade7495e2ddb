"""Words and shingle hashes of whole texts.

Words are runs of bytes other than ASCII white space in the UTF-8 text, ASCII letters lower-cased:
``bytes.lower().split()`` is exactly that rule.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

SEED = 42
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words joined by one space, repeats included;
    fewer words: of the whole sequence; no words: empty."""
    h = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    runs = zip(*(words[i : len(words) - size + 1 + i] for i in range(size)), strict=True)
    return np.array([h(b" ".join(run), SEED) for run in runs], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shifts and odd multipliers), vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w, SEED) for w in words], np.uint64) if words else np.empty(0, np.uint64)


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` word hashes, order kept; fewer: one for the whole sequence."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = hashes[: n - size + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, size):
            out = mixed(out * MIX + hashes[i : n - size + 1 + i])
    return out


#: Steps of a hash share: so fine that a share of a bounded sample is never rounded to none.
SHARE_STEPS = 1 << 62


def hash_share(salt: int, bound: int, total: int, *columns: str | Column) -> Column:
    """A condition for about ``bound`` of ``total`` rows (all where there are fewer), by a hash of ``columns``."""
    taken = SHARE_STEPS if total <= bound else max(1, SHARE_STEPS * bound // total)
    return F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(SHARE_STEPS)) < F.lit(taken)


def row_keys(docs: DataFrame, first: str = "row", second: str = "row2") -> list[Column]:
    """Two independent 64-bit hashes of doc_id and text, which mark a row where ids repeat or are null."""
    text = docs["text"].cast("string")
    return [F.xxhash64(docs["doc_id"], text).alias(first), F.xxhash64(F.lit(1), docs["doc_id"], text).alias(second)]


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` less the rows whose keys are in ``rows`` (row, row2; a written table); columns stay as they are.

    The marked rows grow with the documents, so they are never broadcast.
    """
    marked = rows.select(F.col("row").alias("_row"), F.col("row2").alias("_row2")).distinct().hint("merge")
    one, two = row_keys(docs)
    return docs.join(marked, (one == F.col("_row")) & (two == F.col("_row2")), "left_anti")
