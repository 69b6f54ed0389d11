"""What the text operators share: written intermediate tables, words and stable hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenejobs.functions.tables import written

__all__ = ["GAP", "SLICE_BYTES", "SPACES", "TABLE_ENTRIES", "U64", "HashedTexts", "gram_hashes", "groups", "make_room", "mixed", "signed", "slices", "unused", "word_count", "words_of", "written"]

#: The characters between words: space and tab to carriage return.
SPACES = " \t\n\x0b\f\r"
#: The same as a regular expression, a run of them.
GAP = r"[\x20\x09-\x0D]+"
#: A process keeps about so many entries in each of its word tables.
TABLE_ENTRIES = 600_000
#: Arrow batches are worked through in slices of about so many bytes of text.
SLICE_BYTES = 4_000_000
#: A slice has so many texts at most, so a text's place in it fits 16 bits.
SLICE_TEXTS = 1 << 16

U64 = np.uint64
_MIX_A, _MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null has none."""
    trimmed = F.coalesce(F.btrim(text, F.lit(SPACES)), F.lit(""))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, GAP))).cast("long")


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * _MIX_A
    x = x ^ (x >> U64(27))
    x = x * _MIX_B
    return x ^ (x >> U64(31))


def make_room(table: dict, wanted: set) -> None:
    """Once a table is full, only what is wanted now stays in it."""
    if len(table) > TABLE_ENTRIES:
        stay = {w: table[w] for w in wanted.intersection(table)}
        table.clear()
        table.update(stay)


_STEP = U64(0x9E3779B97F4A7C15)


def gram_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k consecutive words, in order; empty below k words."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    out = np.full(n, k, dtype=U64)
    for i in range(k):
        out *= _STEP
        out += word_hashes[i : i + n]
    return mixed(out)


_INVERSE = U64(pow(int(_STEP), -1, 1 << 64))
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=U64) * _STEP)
_IS_GAP = np.isin(np.arange(256), list(SPACES.encode()))
#: Bytes whose words are hashed at once.
HASH_BLOCK = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the power 0, 1, ... modulo 2**64, at least n of them."""
    if len(_POWERS.get(int(base), ())) < n:
        _POWERS[int(base)] = np.multiply.accumulate(np.r_[U64(1), np.full(max(n, HASH_BLOCK) - 1, base)])
    return _POWERS[int(base)]


def hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable 64-bit hashes of the words in an array of bytes, and where they begin.

    A word's hash is the sum of its bytes' values times powers of an odd number, so all words
    of a block come from one running sum, with the power of their place divided out.
    """
    gap = np.r_[True, _IS_GAP[data], True]
    begin = np.flatnonzero(gap[:-1] & ~gap[1:])
    end = np.flatnonzero(~gap[:-1] & gap[1:])
    out, i = np.empty(len(begin), U64), 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + HASH_BLOCK, side="right")))
        low, n = begin[i], int(end[j - 1] - begin[i])
        sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_VALUES[data[low : low + n]] * _powers(_STEP, n)[:n], out=sums[1:])
        out[i:j] = (sums[end[i:j] - low] - sums[begin[i:j] - low]) * _powers(_INVERSE, n)[begin[i:j] - low]
        i = j
    return mixed(out + (end - begin).astype(U64)), begin


class HashedTexts:
    """Word hashes of several texts in one array; text i has words begin[i] to end[i]."""

    def __init__(self, texts: list[bytes | None]) -> None:
        texts = [t or b"" for t in texts]
        self.hashes, at = hash_words(np.frombuffer(b"\n".join(texts), np.uint8))
        self.end = np.searchsorted(at, np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))))
        self.counts = np.diff(self.end, prepend=0)
        self.begin = self.end - self.counts
        self.owner = np.repeat(np.arange(len(texts)), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words that lie in one text, and their positions."""
        at = np.flatnonzero(np.arange(len(self.owner)) + k <= self.end[self.owner])
        return gram_hashes(self.hashes, k)[at] if len(at) else np.empty(0, U64), at


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark longs."""
    return x.view(np.int64)


def slices(texts: list, limit: int = SLICE_BYTES):
    """Index ranges over texts that hold about `limit` bytes each, and SLICE_TEXTS texts at most."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) if t else 0
        if total >= limit or i + 1 - start == SLICE_TEXTS:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins in an ordered array, and its length."""
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    return first, np.diff(np.r_[first, len(ordered)])


def unused(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name
