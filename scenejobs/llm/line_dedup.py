"""Line dedup: winnowed line hashes find runs of lines that occurred before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenejobs.llm.shared import U64, gram_hashes, groups, mixed, signed, unused, written

#: Runs of so many lines are removed where they come again, however short the lines are.
RUN_LINES = 3
#: So are shorter runs that hold so many words.
RUN_WORDS = 20
#: Documents are dealt by id to slices of about so many lines.
SLICE_LINES = 200_000


def line_hashes(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of each line that has a word; the others take no part."""
    lines = [x for x in (text or b"").split(b"\n") if x.strip()]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), U64, len(lines))
    return hashes, np.fromiter((len(x.split()) for x in lines), np.int32, len(lines))


def minima(hashes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Position of the least hash in the window that begins at each of at, the last one on ties."""
    ordered = mixed(hashes)
    best = at + window - 1
    for k in range(window - 2, -1, -1):
        best = np.where(ordered[at + k] < ordered[best], at + k, best)
    return best


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the minimum of every window of consecutive hashes.

    Two equal runs of `window` hashes select the same positions, relative to their starts.
    """
    return np.unique(minima(hashes, np.arange(max(0, len(hashes) - window + 1)), window))


class Lines:
    """Line hashes of a slice of documents in order of id."""

    def __init__(self, table: pa.Table, run_lines: int, run_words: int) -> None:
        table = table.sort_by("id").combine_chunks()
        self.ids, self.same, lists = table["id"].combine_chunks(), table["same"].combine_chunks(), table["lines"].combine_chunks()
        self.hashes, self.words = lists.flatten().to_numpy(zero_copy_only=False).view(U64), table["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.end = np.cumsum(sizes)
        self.begin, self.owner = self.end - sizes, np.repeat(np.arange(len(sizes)), sizes)
        new = pc.not_equal(self.ids.slice(1), self.ids.slice(0, max(len(self.ids) - 1, 0))).to_numpy(zero_copy_only=False)
        self.rank = np.cumsum(np.r_[False, new].astype(np.int64)) if len(self.ids) else np.empty(0, np.int64)
        self.run_lines, self.run_words = run_lines, run_words

    def runs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Length, and starts of the least runs of that length that count: run_lines lines, or fewer with run_words words."""
        to_end, sums = (self.end[self.owner] if len(self.owner) else self.owner) - np.arange(len(self.owner)), np.r_[0, np.cumsum(self.words, dtype=np.int64)]
        for k in range(1, self.run_lines + 1):
            at = np.flatnonzero(to_end >= k)
            yield k, at if k == self.run_lines else at[sums[at + k] - sums[at] >= self.run_words]

    def fingerprints(self) -> np.ndarray:
        """Positions of the least hash in each run that counts: equal runs have it at the same place."""
        return np.unique(np.concatenate([minima(self.hashes, at, k) for k, at in self.runs()]))

    def around(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and length of the runs that hold a hit: each hit extended both ways."""
        marked = np.r_[0, np.cumsum(np.isin(self.hashes, hits))]
        found = [(gram_hashes(self.hashes, k)[at], at, np.full(len(at), k)) for k, starts in self.runs() if len(at := starts[marked[starts + k] > marked[starts]])]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64))

    def places(self, at: np.ndarray) -> pa.Array:
        """Document and line number as structs that order as places do."""
        return pa.StructArray.from_arrays([self.ids.take(pa.array(self.owner[at])), pa.array((at - self.begin[self.owner[at]]).astype(np.int32))], ["id", "at"])


def _maximal(at: list[int], size: list[int], ids: list, places: list[int]) -> list[tuple[int, int, object, int]]:
    """Matched runs (start, length, source, start there), in order, joined where they go on at the same distance from the same source."""
    out: list[list] = []
    for a, n, d, p in sorted(zip(at, size, ids, places), key=lambda x: (str(x[2]), x[3] - x[0], x[0])):
        last = out[-1] if out else None
        if last and last[2] == d and last[3] - last[0] == p - a and a <= last[0] + last[1]:
            last[1] = max(last[1], a + n - last[0])
        else:
            out.append([a, n, d, p])
    return sorted(map(tuple, out), key=lambda x: (x[0], x[1], str(x[2]), x[3]))


def repeated_runs(docs: DataFrame, run_lines: int = RUN_LINES, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """Returns id, runs (array of struct start, length, source_id, source_start) for documents that repeat lines.

    start numbers lines with a word. A run counts if it has run_lines lines, or fewer that hold
    run_words words, and is a repeat if its equal starts at an earlier place, by document id
    and then line.

    1. Winnowing: the least line hash of every run that counts is its fingerprint, so equal
       runs have one at the same place. Fingerprints that occur once are let go.
    2. Each that is left is extended both ways to the runs that hold it. These are joined to the
       first place of their equals.
    3. Joined runs that go on at the same distance from their source make up maximal runs.

    Documents are dealt to slices by a number of their row, so neither a repeated id nor equal
    rows make a slice larger. A slice names each hash once, with its first place, so
    a line or passage that most documents share is one row per slice and makes no pairs. Rows
    with an equal id are documents of their own, but what they share at the same line number
    is no repeat, as neither place is earlier. Rows with a null id repeat nothing and are no
    source. An empty table gives no rows.
    """
    return _runs_of_rows(docs, run_lines, id_col, text_col, run_words).drop("same")


def _runs_of_rows(docs: DataFrame, run_lines: int, id_col: str, text_col: str, run_words: int) -> DataFrame:
    """repeated_runs() with same, a hash of the row's text, which tells rows with an equal id apart."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("same")).where(F.col(id_col).isNotNull())
    kind = texts.schema["id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_hashes(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [pa.array([signed(h) for h, _ in found], pa.list_(pa.int64())), pa.array([w for _, w in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["id", "same", "lines", "words"])

    def ask_fingerprints(table: pa.Table) -> pa.Table:
        part = Lines(table, run_lines, run_words)
        hashes = np.sort(part.hashes[part.fingerprints()])
        first, count = groups(hashes)
        return pa.table({"slice": pa.array(np.full(len(first), table["slice"][0].as_py())), "hash": signed(hashes[first]), "n": pa.array(count, pa.int64())})

    def ask_runs(table: pa.Table, answers: pa.Table) -> pa.Table:
        part = Lines(table, run_lines, run_words)
        hashes, at, _ = part.around(answers["hash"].to_numpy().view(U64))
        order = np.lexsort((at - part.begin[part.owner[at]], part.rank[part.owner[at]], hashes))  # by id and line, as places go
        first, count = groups(hashes[order])
        return pa.table({"slice": pa.array(np.full(len(first), table["slice"][0].as_py())), "hash": signed(hashes[order[first]]), "place": part.places(at[order[first]]), "n": pa.array(count, pa.int64())})

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        part = Lines(table, run_lines, run_words)
        answers = answers.combine_chunks()
        known, place = answers["hash"].to_numpy().view(U64), answers["first"].combine_chunks() if len(answers) else None
        if place is None or not len(part.hashes):
            return pa.table({"id": part.ids.slice(0, 0), "same": part.same.slice(0, 0), "runs": pa.array([], runs_type)})
        starts, at, size = zip(*[(gram_hashes(part.hashes, k)[s], s, np.full(len(s), k)) for k, s in part.runs()])
        hashes, at, size = np.concatenate(starts), np.concatenate(at), np.concatenate(size)
        order = np.argsort(known)
        spot = np.minimum(np.searchsorted(known[order], hashes), len(known) - 1)
        joined = known[order][spot] == hashes
        at, size, spot = at[joined], size[joined], order[spot[joined]]
        source, own = place.take(pa.array(spot)), part.places(at)
        later = ~(pc.equal(source.field(0), own.field(0)).to_numpy(zero_copy_only=False) & pc.equal(source.field(1), own.field(1)).to_numpy(zero_copy_only=False))
        at, size, source = at[later], size[later], source.filter(pa.array(later))
        by = np.argsort(part.owner[at], kind="stable")
        first, count = groups(part.owner[at[by]])
        line, ids, places, rows = at - part.begin[part.owner[at]], source.field(0).to_pylist(), source.field(1).to_pylist(), []
        for a, n in zip(first, count):
            chosen = by[a : a + n]
            found = _maximal(line[chosen].tolist(), size[chosen].tolist(), [ids[i] for i in chosen], [places[i] for i in chosen])
            rows.append([dict(zip(("start", "length", "source_id", "source_start"), r)) for r in found])
        chosen = pa.array(part.owner[at[by[first]]])
        return pa.table({"id": part.ids.take(chosen), "same": part.same.take(chosen), "runs": pa.array(rows, runs_type)})

    from pyspark.sql.pandas.types import to_arrow_type

    runs_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source_id", to_arrow_type(texts.schema["id"].dataType)), ("source_start", pa.int32())]))
    lines = written(texts.mapInArrow(hashed, f"id {kind}, same long, lines array<long>, words array<int>").where("size(lines) > 0").withColumn("row", F.monotonically_increasing_id()))
    n = (lines.agg(F.sum(F.size("lines"))).first()[0] or 0) // SLICE_LINES + 1
    dealt = lines.select("id", "same", "lines", "words", F.pmod(F.xxhash64("row"), F.lit(n)).alias("slice")).repartition("slice").groupBy("slice")
    marks = dealt.applyInArrow(ask_fingerprints, "slice long, hash long, n long")
    often = marks.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    hits = marks.join(often, "hash", "left_semi").select("slice", "hash")
    asked = written(dealt.cogroup(hits.groupBy("slice")).applyInArrow(ask_runs, f"slice long, hash long, place struct<id:{kind},at:int>, n long"))
    first = asked.groupBy("hash").agg(F.min("place").alias("first"), F.sum("n").alias("n")).where("n > 1").select("hash", "first")
    answers = asked.select("slice", "hash").join(first, "hash").select("slice", "hash", "first")
    found = dealt.cogroup(answers.groupBy("slice")).applyInArrow(extend, f"id {kind}, same long, runs array<struct<start:int,length:int,source_id:{kind},source_start:int>>")
    return found.withColumnRenamed("id", id_col)


def without_lines(text: bytes | None, gone: set[int]) -> bytes | None:
    """The text without the numbered lines; lines without a word have no number and stay."""
    if text is None or not gone:
        return text
    k, kept = 0, []
    for line in text.split(b"\n"):
        numbered = bool(line.strip())
        if not (numbered and k in gone):
            kept.append(line)
        k += numbered
    return b"\n".join(kept)


def dedup_lines(docs: DataFrame, run_lines: int = RUN_LINES, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """The rows of docs with the text freed from later repeated runs of lines, see repeated_runs(); adds n_gone.

    Null, empty and short texts stay as they are; a text may become empty. All columns stay,
    but for one named n_gone, which is replaced.
    """
    docs = docs.drop("n_gone")
    key, same, runs = unused(docs, "id"), unused(docs, "same"), unused(docs, "runs")
    gone = _runs_of_rows(docs, run_lines, id_col, text_col, run_words).select(F.col(id_col).alias(key), F.col("same").alias(same), F.col("runs").alias(runs)).dropDuplicates([key, same])
    joined = docs.join(gone, (docs[id_col] == F.col(key)) & (F.xxhash64(docs[text_col]) == F.col(same)), "left").select(*[docs[c] for c in docs.columns], runs)

    @F.arrow_udf("text string, n_gone long")
    def rewrite(texts: pa.Array, runs: pa.Array) -> pa.Array:
        gone = [{k for r in found or () for k in range(r["start"], r["start"] + r["length"])} for found in runs.to_pylist()]
        kept = pa.array(map(without_lines, texts.cast(pa.binary()).to_pylist(), gone), pa.binary()).cast(pa.string())
        return pa.StructArray.from_arrays([kept, pa.array(map(len, gone), pa.int64())], ["text", "n_gone"])

    # Python gets only the texts that lose lines, not the whole rows of all; not deterministic, or Spark would call it again for each use of what it returns
    found = unused(joined, "found")
    joined = joined.withColumn(found, rewrite.asNondeterministic()(F.when(F.col(runs).isNotNull(), F.col(text_col)), F.col(runs)))
    text = F.when(F.col(runs).isNotNull(), F.col(found)["text"]).otherwise(F.col(text_col)).alias(text_col)
    return joined.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.col(found)["n_gone"].alias("n_gone"))
