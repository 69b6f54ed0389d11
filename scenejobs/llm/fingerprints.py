"""Document fingerprints: threshold-scaled sketches of word shingles, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenejobs.llm.shared import words_of, written

#: Words of a shingle.
SHINGLE_WORDS = 5
#: One shingle hash in so many is retained.
SCALE = 4


def sketch(text: Column, scale: int = SCALE) -> Column:
    """Ascending distinct shingle hashes of a text that lie below the fraction 1/scale.

    Shingles are runs of five words of the text with A-Z in lower case; a text with fewer
    words is one shingle. The threshold is the same for all documents, so sketches merge by
    union, and the share of one sketch found in another estimates containment however
    unequal the documents are. If no hash lies below, the smallest one stands in, so that only
    a text without words (null, empty, blank) has an empty sketch. A stand-in tells equal texts
    from others, but no sketch of a longer text would hold it: see containment().
    """
    small = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word_hashes = F.transform(words_of(small), lambda w: F.xxhash64(w))
    return F.flatten(F.transform(F.array(word_hashes), lambda h: _retained(_shingles(h), scale)))


def _shingles(h: Column) -> Column:
    starts = F.sequence(F.lit(0), F.size(h) - SHINGLE_WORDS)
    long = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE_WORDS)]))
    return F.when(F.size(h) >= SHINGLE_WORDS, long).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))


def _threshold(scale: int) -> int:
    return -(2**63) + 2**64 // scale


def _retained(shingles: Column, scale: int) -> Column:
    below = F.sort_array(F.array_distinct(_below(shingles, scale)))
    least = F.filter(F.array(F.array_min(shingles)), lambda x: x.isNotNull())
    return F.flatten(F.transform(F.array(F.struct(below.alias("b"), least.alias("m"))), lambda s: F.when(F.size(s["b"]) > 0, s["b"]).otherwise(s["m"])))


def as_text(values: Column) -> Column:
    """A sketch as a string of hexadecimal hashes."""
    return F.array_join(F.transform(values, lambda x: F.lower(F.hex(x))), " ")


def _below(values: Column, scale: int) -> Column:
    return F.filter(values, lambda x: x < F.lit(_threshold(scale)))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together: the union, in which a stand-in yields to any hash below the threshold."""
    both = F.sort_array(F.array_union(a, b))
    below = _below(both, scale)
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; 1 for two empty ones.

    Two stand-ins are the least hashes of their texts and agree with the probability of the
    similarity; one against a hash below the threshold can't be the least of both.
    """
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(common / (F.size(a) + F.size(b) - common))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a that lies in b; 1 if a is empty, null (unknown) if a has no hash below the threshold and isn't b."""
    unknown = (F.size(a) > 0) & (F.get(a, F.lit(0)) >= F.lit(_threshold(scale))) & (a != b)
    return F.when(F.size(a) == 0, 1.0).when(~unknown, F.size(F.array_intersect(a, b)) / F.size(a))


def followers(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Returns id and next_id: the next larger distinct id, after the largest the smallest.

    Only ids move: they are dealt in ranges, each range finds the followers inside, and a
    table with one row per range links the ranges. Null ids are left out.
    """
    dealt = ids.select(id_col).where(F.col(id_col).isNotNull()).distinct().repartitionByRange(id_col)
    ranges = written(dealt.withColumn("range", F.spark_partition_id()))
    firsts = ranges.groupBy("range").agg(F.min(id_col).alias("first"))
    in_order = W.orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(in_order), F.first("first").over(in_order.rowsBetween(W.unboundedPreceding, 0))).alias("after"))
    inside = ranges.withColumn("inside", F.lead(id_col).over(W.partitionBy("range").orderBy(id_col)))
    return inside.join(firsts, "range").select(id_col, F.coalesce("inside", "after").alias("next_id"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Fingerprints every text and its edited text, and compares them and the next document's.

    The edited text is the text whose last quarter (floor of code points / 4) gives way to as
    many first code points of the next document (all, if it has fewer). Next is the next
    larger id, after the largest the smallest; among rows with an equal id the smallest text
    speaks for the id. A document that stands alone follows itself; a row with a null id has
    no next document, and an empty text stands for it. Null texts count as empty.

    Texts are dealt by id once; each hands the wanted start of its text and its sketch to the
    document before it, which is a quarter of a text at most. Sketches are worked out where
    they are used, as that is cheaper than moving them with the texts.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    links = followers(texts, "id").join(texts.groupBy("id").agg(F.max(F.floor(F.length("text") / 4)).alias("wanted")), "id")
    dealt = texts.where("id IS NOT NULL")  # both joins read one exchange of it, which Spark splits where an id has very many rows
    heads = dealt.alias("d").join(links.alias("l"), F.expr("d.id = l.next_id"))
    heads = heads.select(F.col("l.id").alias("id"), F.struct(F.substring(F.col("d.text"), F.lit(1), F.col("wanted").cast("int")).alias("head"), sketch(F.col("d.text"), scale).alias("sketch")).alias("next"))
    heads = heads.groupBy("id").agg(F.min("next").alias("next"))
    rows = dealt.join(heads, "id", "left")
    rows = rows.unionAll(texts.where("id IS NULL").withColumn("next", F.lit(None).cast(rows.schema["next"].dataType)))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    empty = F.array().cast("array<long>")
    rows = rows.select(
        "id", sketch(F.col("text"), scale).alias("sketch"), n.cast("long").alias("n_chars"), F.coalesce("next.sketch", empty).alias("next_sketch"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next.head", F.lit("")), F.lit(1), cut)).alias("edited"),
    )
    rows = rows.select("*", sketch(F.col("edited"), scale).alias("edited_sketch"))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited", "sketch", "edited_sketch",
        likeness(F.col("sketch"), F.col("edited_sketch")).cast("double").alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).cast("double").alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch"), scale).cast("double").alias("contained_in_edited"),
    )
