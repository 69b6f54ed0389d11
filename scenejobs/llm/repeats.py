"""Substring dedup: fixed-block anchors, probed by every rolling window, find the word windows that an earlier document holds."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenejobs.llm.shared import SLICE_BYTES, U64, HashedTexts, groups, signed, written

#: A repeat is a window of so many consecutive words.
WINDOW = 13
#: Reference blocks have so many words and don't overlap, so every window holds one whole, wherever it starts.
BLOCK = 7
#: Bits of a block's hash. Blocks only propose windows, which are compared by 64 bits.
KEY_BITS = 48
#: Documents are dealt to slices of about so many bytes of text.
DOCUMENT_SLICE = SLICE_BYTES
#: About so many bytes of text give the probes that meet in one bucket.
BUCKET_BYTES = 12_000_000
_FILL = (1 << 32) - 1


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers as 32-bit steps; a step too long for 32 bits is led by filling steps, which are no numbers."""
    steps = np.diff(values, prepend=U64(0))
    fill, rest = np.divmod(steps, U64(_FILL))
    out = np.full(len(values) + int(fill.sum()), _FILL, "<u4")
    out[np.arange(len(values)) + np.cumsum(fill).astype(np.int64)] = rest
    return out.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    """The inverse of pack_sorted()."""
    steps = np.frombuffer(data, "<u4")
    return np.cumsum(steps, dtype=U64)[steps != _FILL]


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


class Slice:
    """Hashed texts of a slice in order of id, but for short ones and all but the first of equal ones, and what was answered to it."""

    def __init__(self, texts: pa.Table, answers: pa.Table) -> None:
        self.table = texts.sort_by("id").combine_chunks()
        ids = self.table["id"].combine_chunks()
        self.ids, self.texts = ids, self.table["text"].cast(pa.binary()).to_pylist()
        new = pc.not_equal(ids.slice(1), ids.slice(0, max(len(ids) - 1, 0))).to_numpy(zero_copy_only=False)
        self.rank = np.cumsum(np.r_[False, new].astype(np.int64)) if len(ids) else np.empty(0, np.int64)
        first = pc.is_in(ids, value_set=answers["id"].combine_chunks()).to_numpy(zero_copy_only=False)
        long = np.fromiter((len(_words(t)) >= WINDOW for t in self.texts), bool, len(self.texts))
        self.copies = long & ~first
        self.hashed = HashedTexts([t if f and n else None for t, f, n in zip(self.texts, first, long)])

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Key and position of every rolling window of BLOCK words."""
        grams, at = self.hashed.grams(BLOCK)
        return grams >> U64(64 - KEY_BITS), at

    def is_block(self, at: np.ndarray) -> np.ndarray:
        """Whether a reference block begins at each position."""
        return (at - self.hashed.begin[self.hashed.owner[at]]) % BLOCK == 0

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        return self.hashed.grams(WINDOW)

    def rank_at(self, at: np.ndarray) -> np.ndarray:
        return self.rank[self.hashed.owner[at]]

    def extended(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hits of keys extended both ways: hashes and positions of all windows of WINDOW words around them."""
        probes, at = self.probes()
        hit = at[np.isin(probes, keys)]
        change = np.zeros(len(self.hashed.owner) + 1, np.int64)
        np.add.at(change, np.maximum(hit - (WINDOW - BLOCK), self.hashed.begin[self.hashed.owner[hit]]), 1)
        np.add.at(change, hit + 1, -1)
        windows, at = self.windows()
        wanted = np.cumsum(change[:-1])[at] > 0
        return windows[wanted], at[wanted]

    def stays(self, foreign: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which words of the hashed texts stay.

        foreign are windows whose first document lies in another slice; those of own have it
        here, and go from the other documents only. Neighbouring windows that go make up the
        maximal repeats.
        """
        windows, at = self.windows()
        goes = np.isin(windows, foreign)
        among = np.flatnonzero(np.isin(windows, own))
        among = among[np.argsort(windows[among], kind="stable")]
        first, count = groups(windows[among])
        rank = self.rank_at(at[among])
        goes[among] |= rank > np.repeat(rank[first], count)
        change = np.zeros(len(self.hashed.owner) + 1, np.int64)
        np.add.at(change, at[goes], 1)
        np.add.at(change, at[goes] + WINDOW, -1)
        return np.cumsum(change[:-1]) == 0


def _joined(answers: pa.Table, name: str) -> np.ndarray:
    """The hashes of all lists of an answer's column."""
    lists = answers[name].combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).view(U64) if len(lists) else np.empty(0, U64)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(signed(values), pa.int64()))


def _distinct(hashes: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, first of each hash in that order (with the least rank), and whether several ranks have it; ranks must ascend."""
    order = np.argsort(hashes, kind="stable")
    first, count = groups(hashes[order])
    return order, first, rank[order[first]] != rank[order[first + count - 1]]


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_words, n_removed, kept (the words that stay, joined by a space) for every row.

    A word goes if a window of 13 words over it also starts in a document with a smaller id.

    1. Documents of 13 words or more that are equal word by word are grouped by digest; all
       but those with the smallest id go wholly and take no further part.
    2. The others are cut into reference blocks of seven words that don't overlap, and probe
       these with every rolling window of seven words. A block that several documents hold
       is a hit in each of them.
    3. Hits are extended both ways to all windows of 13 words around them, which meet again by
       hash: documents with a larger id than the first lose the words they cover.
       Neighbouring windows that go join to maximal repeats.

    Documents are dealt to slices of a few megabytes by a number of their row, so neither a
    repeated id nor equal rows make a slice larger. A slice asks for its distinct
    keys, packed by the bucket of keys that they fall into, and each bucket answers to the
    slices; so a passage that most documents hold is one entry per slice, no group is ever
    paired, and slices and buckets are of bounded size at any size of the corpus.

    Windows count as equal if their 64-bit hashes are. Null and blank texts have 0 words. Rows
    with an equal id don't repeat each other; rows with a null id neither lose words nor take any.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    known = texts.where("id IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slices, bits = size // DOCUMENT_SLICE + 1, max(0, int(size // BUCKET_BYTES).bit_length())
    slice_of = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_slices)).alias("slice")
    low = KEY_BITS - bits

    def digest(texts: pa.Table) -> pa.Table:
        words = map(_words, texts["text"].cast(pa.binary()).to_pylist())
        digests = [xxhash.xxh3_128_digest(b" ".join(w)) if len(w) >= WINDOW else None for w in words]
        return pa.table({"slice": texts["slice"], "id": texts["id"], "digest": pa.array(digests, pa.binary())})

    def ask_blocks(texts: pa.Table, answers: pa.Table) -> pa.Table:
        part = Slice(texts, answers)
        keys, at = part.probes()
        order, first, several = _distinct(keys, part.rank_at(at))
        block = np.logical_or.reduceat(part.is_block(at)[order], first) if len(first) else np.empty(0, bool)
        keys = keys[order[first]]
        begin, count = groups(keys >> U64(low))
        cells = [(k, pack_sorted(keys[a : a + n] - (U64(k) << U64(low))), np.packbits(block[a : a + n]).tobytes(), np.packbits(several[a : a + n]).tobytes()) for k, a, n in zip((keys[begin] >> U64(low)).tolist(), begin, count)]
        bucket, packed, blocks, severals = zip(*cells) if cells else ((), (), (), ())
        number = pa.array([texts["slice"][0].as_py()] * len(cells), pa.int64())
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "slice": number, "n": pa.array(count, pa.int64()), "keys": pa.array(packed, pa.binary()), "blocks": pa.array(blocks, pa.binary()), "several": pa.array(severals, pa.binary())})

    def answer_blocks(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        keys = np.concatenate([unpack_sorted(x) for x in table["keys"].to_pylist()])
        flags = [np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(table[c].to_pylist(), n.tolist())]).astype(bool) for c in ("blocks", "several")]
        owner = np.repeat(np.arange(len(n)), n)
        order = np.argsort(keys, kind="stable")
        first, count = groups(keys[order])
        hit = np.logical_or.reduceat(flags[0][order], first) & ((count > 1) | flags[1][order[first]])
        chosen = order[np.repeat(hit, count)]
        chosen = np.sort(chosen)
        counts = np.bincount(owner[chosen], minlength=len(n))
        found = _lists(keys[chosen] + (U64(table["bucket"][0].as_py()) << U64(low)), counts)
        return pa.table({"slice": table["slice"], "keys": found}).filter(pa.array(counts > 0))

    def ask_windows(texts: pa.Table, answers: pa.Table) -> pa.Table:
        part = Slice(texts, answers)
        hashes, at = part.extended(_joined(answers, "keys"))
        order, first, several = _distinct(hashes, part.rank_at(at))
        hashes, least = hashes[order[first]], part.hashed.owner[at[order[first]]]
        begin, count = groups(hashes >> U64(64 - bits) if bits else np.zeros(len(hashes), U64))
        ends = pa.array(np.r_[0, np.cumsum(count)], pa.int32())
        ids = pa.ListArray.from_arrays(ends, part.ids.take(pa.array(least)))
        bucket = (hashes[begin] >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(begin), np.int64)
        number = pa.array([texts["slice"][0].as_py()] * len(begin), pa.int64())
        packed = pa.array([np.packbits(several[a : a + n]).tobytes() for a, n in zip(begin, count)], pa.binary())
        return pa.table({"bucket": bucket, "slice": number, "hashes": _lists(hashes, count), "least": ids, "several": packed})

    def answer_windows(table: pa.Table) -> pa.Table:
        lists = table["hashes"].combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        hashes, owner = lists.flatten().to_numpy(zero_copy_only=False).view(U64), np.repeat(np.arange(len(n)), n)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(table["several"].to_pylist(), n.tolist())]).astype(bool)
        rank = np.unique(table["least"].combine_chunks().flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = np.lexsort((rank, hashes))
        first, count = groups(hashes[order])
        foreign = np.zeros(len(hashes), bool)
        foreign[order] = rank[order] > np.repeat(rank[order[first]], count)
        found = {name: (hashes[chosen], np.bincount(owner[chosen], minlength=len(n))) for name, chosen in (("foreign", foreign), ("own", several & ~foreign))}
        return pa.table({"slice": table["slice"], **{name: _lists(*x) for name, x in found.items()}}).filter(pa.array(found["foreign"][1] + found["own"][1] > 0))

    def cut(texts: pa.Table, answers: pa.Table) -> pa.Table:
        part = Slice(texts, answers)
        stays = part.stays(_joined(answers, "foreign"), _joined(answers, "own"))
        count, removed, kept = [], [], []
        for text, copy, a, b in zip(part.texts, part.copies, part.hashed.begin, part.hashed.end):
            words = _words(text)
            count.append(len(words))
            words = [] if copy else words if a == b else list(compress(words, stays[a:b]))
            removed.append(count[-1] - len(words))
            kept.append(b" ".join(words))
        return pa.table({"id": part.ids, "n_words": pa.array(count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = list(map(_words, batch.column(1).cast(pa.binary()).to_pylist()))
            n = pa.array(map(len, words), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pc.multiply(n, 0), pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    dealt = known.select("id", "text", slice_of).repartition("slice").groupBy("slice")  # one exchange, which every pass below reads
    digests = written(dealt.applyInArrow(digest, f"slice long, id {kind}, digest binary").where("digest IS NOT NULL").distinct())
    least = digests.groupBy("digest").agg(F.min("id").alias("id"))
    firsts = digests.join(least, ["digest", "id"]).select("id", "slice").distinct()  # ids that come first, in every slice that holds them
    asked = dealt.cogroup(firsts.groupBy("slice")).applyInArrow(ask_blocks, "bucket long, slice long, n long, keys binary, blocks binary, several binary")
    shared = asked.groupBy("bucket").applyInArrow(answer_blocks, "slice long, keys array<long>")
    asked = dealt.cogroup(firsts.unionByName(shared, allowMissingColumns=True).groupBy("slice")).applyInArrow(ask_windows, f"bucket long, slice long, hashes array<long>, least array<{kind}>, several binary")
    gone = asked.groupBy("bucket").applyInArrow(answer_windows, "slice long, foreign array<long>, own array<long>")
    out = f"id {kind}, n_words long, n_removed long, kept string"
    rows = dealt.cogroup(firsts.unionByName(gone, allowMissingColumns=True).groupBy("slice")).applyInArrow(cut, out)
    return rows.unionAll(texts.where("id IS NULL").mapInArrow(whole, out)).withColumnRenamed("id", id_col)
