"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the n-grams.
BUCKETS = 1 << 14
#: Lengths of the n-grams, in code points.
LENGTHS = (1, 2, 3)
#: The classifier is fitted on about so many labelled documents of each language at most.
SAMPLE_PER_LANGUAGE = 5_000
#: Additive smoothing.
SMOOTHING = 0.5
#: Code points that are hashed at once; longer texts are counted in pieces that overlap.
PIECE = 1 << 18
#: Texts that are counted at once.
ROWS = 32


def _chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Code points of several texts in chunks of about PIECE: the code points, their text, their piece and their place in it."""
    pending, size = [], 0

    def joined() -> tuple[np.ndarray, ...]:
        sizes = [len(part) for _, part in pending]
        place = np.arange(sum(sizes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.concatenate([part for _, part in pending]), np.repeat([row for row, _ in pending], sizes), np.repeat(np.arange(len(pending)), sizes), place

    for row, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for start in range(0, len(codes), PIECE):
            pending.append((row, codes[start : start + PIECE + max(LENGTHS) - 1]))
            size += len(pending[-1][1])
            if size >= PIECE:
                yield joined()
                pending, size = [], 0
    if pending:
        yield joined()


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of counts, one for each text: where each row ends, its buckets in ascending order, and how often each occurs.

    Every n-gram of each whole text counts; long texts are hashed in pieces that overlap.
    """
    ends, buckets, counts = [0], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for first in range(0, len(texts), ROWS):
        chosen = texts[first : first + ROWS]
        total = np.zeros(len(chosen) * BUCKETS, dtype=np.int64)
        for codes, row, piece, place in _chunks(chosen):
            for n in LENGTHS:
                m = max(0, len(codes) - n + 1)
                at = np.flatnonzero((piece[:m] == piece[n - 1 :]) & (place[:m] < PIECE))
                h = np.full(len(at), 0x9E3779B1 * n & 0xFFFFFFFF, dtype=np.uint32)
                for i in range(n):
                    h = (h ^ codes[at + i]) * np.uint32(0x85EBCA6B)
                    h ^= h >> np.uint32(13)
                bucket = (h * np.uint32(0xC2B2AE35)) >> np.uint32(18)
                total += np.bincount(row[at] * BUCKETS + bucket, minlength=len(total))
        found = np.flatnonzero(total)
        ends += (ends[-1] + np.cumsum(np.bincount(found // BUCKETS, minlength=len(chosen)))).tolist()
        buckets.append(found % BUCKETS)
        counts.append(total[found])
    return np.array(ends[1:]), np.concatenate(buckets), np.concatenate(counts)


def log_likelihoods(texts: list[str], log_prob: np.ndarray) -> np.ndarray:
    """The sparse matrix of the texts' counts times the matrix of log probabilities (buckets by languages)."""
    end, bucket, count = ngram_counts(texts)
    sums = np.zeros((len(texts), log_prob.shape[1]))
    begin = np.r_[0, end[:-1]].astype(np.int64)
    some = np.flatnonzero(end > begin)
    if len(some):
        sums[some] = np.add.reduceat(count[:, None] * log_prob[bucket], begin[some], axis=0)
    return sums


@dataclass
class LanguageModel:
    """Languages in order, and the log probability of each bucket (rows) in each language (columns)."""

    languages: list[str]
    log_prob: np.ndarray


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fits on documents with a language and a text.

    Of each language about sample_per_language documents are used at most, chosen by a hash
    of the id, so reruns agree; that bounds the fit whatever the size of the corpus. What
    comes to the driver is one count per language and bucket. Without any labelled row the
    model knows no language, and every prediction is `und`.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL")
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample_per_language)) / F.count(F.lit(1))).alias("share"))
    shares = {r["lang"]: r["share"] for r in share.collect()}  # one row per language
    if not shares:
        return LanguageModel([], np.zeros((BUCKETS, 0)))
    drawn = F.pmod(F.xxhash64(F.lit("language sample"), F.col("id")), F.lit(1_000_003)) / 1_000_003
    cut = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(v))])
    rows = rows.where("text IS NOT NULL").where(drawn < cut[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            table = batch.to_pydict()
            for lang in set(table["lang"]):
                _, bucket, n = ngram_counts([t for t, own in zip(table["text"], table["lang"]) if own == lang])
                np.add.at(totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64)), bucket, n)
        for lang, total in totals.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["lang", "bucket", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    languages = sorted(shares)
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    column = {lang: i for i, lang in enumerate(languages)}
    np.add.at(counts, (table["bucket"].to_numpy(dtype=np.int64), table["lang"].map(column).to_numpy(dtype=np.int64)), table["n"].to_numpy(dtype=np.float64))
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)))


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (probability of that language) to every row.

    The log-probability matrix is broadcast; its size is buckets times languages. A task
    multiplies the sparse counts of a batch of whole texts with it. Languages have equal
    priors. Null texts and texts without a letter get `und` with score 0. Ties go to the
    language that sorts first. All columns stay, repeated rows and null ids like any others;
    columns named lang_pred or score are replaced.
    """
    session = docs.sparkSession
    shared = session.sparkContext.broadcast((model.languages, model.log_prob))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, log_prob = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            lettered = [i for i, t in enumerate(texts) if t and languages and any(c.isalpha() for c in t)]
            for first in range(0, len(lettered), ROWS):
                rows = lettered[first : first + ROWS]
                likelihood = log_likelihoods([texts[i] for i in rows], log_prob)
                best = likelihood.argmax(axis=1)
                score = 1.0 / np.exp(likelihood - likelihood.max(axis=1, keepdims=True)).sum(axis=1)
                for i, k, x in zip(rows, best, score):
                    names[i], scores[i] = languages[k], float(x)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"
    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text_col).alias("__text")).mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that the fit must not see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
