"""Corpus pipeline: five stages from raw documents to packed training sequences.

Every stage judges rows, not ids: ids may be null or repeated, rows may be equal, texts null or
empty, tables empty, and there may be further columns of any name. All stages but the last
return the columns that they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenejobs.functions.tables import delete, temporary_tables
from scenejobs.llm import jaccard_join, language_id, line_dedup, mixing, packing
from scenejobs.llm.shared import word_count, words_of, written

#: Tokens of a packed sequence.
SEQUENCE_TOKENS = 2048
#: A language is accepted from this probability on.
LEAST_SCORE = 0.5


def _folded(docs: DataFrame, *used: str) -> DataFrame:
    """docs with the columns used and rest, a struct of all others, so that no name of theirs can clash."""
    return docs.select(*used, F.struct(F.lit(0).alias("__"), *[docs[c] for c in docs.columns if c not in used]).alias("rest"))


def _unfolded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a folded table again; n_chars follows the text."""
    own = set(rows.columns)
    return rows.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" and "text" in own else F.col(c) if c in own and c in ("doc_id", "text", "source") else F.col("rest")[c].alias(c) for c in columns])


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null texts, those without a letter or with a doubtful language go.

    Where no row has a known language, none is found, and all go.
    """
    model = language_id.fit_languages(docs)
    found = language_id.predict_languages(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")), model, text_col="row.text")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go, and documents of which no word is left with them.

    Rows with a null id stay as they are; rows with an equal id are judged each by its own text.
    """
    found = line_dedup.dedup_lines(_folded(docs, "doc_id", "text"))
    return _unfolded(found.where((F.col("n_gone") == 0) | (word_count(F.col("text")) > 0)), docs.columns)


def _numbered(docs: DataFrame, *used: str) -> DataFrame:
    """docs, folded, with row, a number of its own for each row, and same, a hash of all columns; written, so both stay."""
    same = F.xxhash64(*docs.columns, *[F.isnull(c) for c in docs.columns])
    kept = [c for c in docs.columns if c not in used]
    folded = docs.select(*used, F.struct(F.lit(0).alias("__"), *kept).alias("rest"), same.alias("__same"), F.monotonically_increasing_id().alias("__row"))
    return written(folded)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near-duplicates stays.

    Each row is judged by itself: rows that share an id are compared like any others, and of
    equal rows one stays, even if they hold no word. A row with a null id is a class of its own.
    """
    named = _numbered(docs.where("doc_id IS NOT NULL"), "doc_id", "text")
    found = jaccard_join.jaccard_components(named, id_col="__row").withColumnRenamed("n_shingles", "n")
    rows = named.select("__row", "__same", "doc_id").join(found, "__row")
    alike = [F.when(F.col("n") > 0, F.col("component_id")), *[F.when(F.col("n") == 0, F.col(c)) for c in ("doc_id", "__same")]]
    firsts = rows.groupBy(*alike).agg(F.min(F.struct("doc_id", "__same", "__row")).alias("first")).select(F.col("first.__row").alias("__row"))
    return _unfolded(named.join(firsts, "__row", "left_semi"), docs.columns).unionAll(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; one that is taken in part keeps its first words.

    Size and share belong to the row, not to its id: rows with a null or a repeated id are taken
    by their own words like any others. Texts without a word are not taken.
    """
    named = _numbered(docs, "doc_id", "text", "source")
    taken = mixing.mix(named, carry=("__same", "__row")).select("__row", "size", "taken").where("taken > 0")
    rows = named.join(taken, "__row").withColumn("part", F.col("taken") % F.col("size"))
    copies = F.expr("transform(sequence(1L, (taken + size - 1) div size), i -> CASE WHEN i * size <= taken THEN 0L ELSE part END)")
    rows = rows.withColumn("first", F.explode(copies))
    text = F.when(F.col("first") > 0, F.array_join(F.slice(words_of(F.col("text")), F.lit(1), F.col("first").cast("int")), " ")).otherwise(F.col("text"))
    return _unfolded(rows.withColumn("text", text), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of SEQUENCE_TOKENS tokens.

    A null or empty text is one piece that holds the end alone; repeated rows give their pieces again.
    """
    pieces = packing.cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=SEQUENCE_TOKENS)
    return packing.pack(pieces, SEQUENCE_TOKENS)


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the language model or the packing; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; each reads what the one before has written.

    What a stage has written for itself, and the result of the one before, is deleted behind it.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        with temporary_tables(spark) as made:
            docs = written(stage(spark, docs, sf_dir))
            result = made.pop()
        delete(spark, last)
        last = [result]
    return docs
