"""Mixing sources to target weights: exact word budgets by distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenejobs.llm.shared import word_count, written

#: A document is taken at most so many times.
MAX_EPOCHS = 3
#: About so many documents of a source lie in one range of the random key.
RANGE_ROWS = 4_000


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code point order, null last, weigh 1, 2, 3 and so on in turn and share the
    total size by weight. No target exceeds max_epochs times its source's size; what is above
    goes to the others by weight. With sources in order of cap to weight, the capped ones
    are a leading run, found by one running sum over this table of a row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    per = per.withColumn("cap", F.col("source_size") * max_epochs)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("left_size", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left_size") / F.col("left_weight"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    per = per.withColumn("common", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"])
    target = F.when(F.col("common").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight")))
    return per.select("source", "source_size", F.round(target, 6).alias("target"))


def _in_ranges(rows: DataFrame, digits: int) -> DataFrame:
    """Adds part, a range of the order of key and tie within a source: the key's leading digits, and around and within keys of very many rows parts of their own.

    Parts sort as the rows in them: the digits, the last key of very many rows that is not
    beyond, whether the row is beyond that, and in such a key the leading digits of the tie.
    """
    digits_of = lambda c: F.substring(c, 1, digits)
    many = rows.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RANGE_ROWS)
    many = many.groupBy("source", digits_of("key").alias("lead")).agg(F.collect_list("key").alias("many"))  # RANGE_ROWS rows stand behind each
    joined = rows.withColumn("lead", digits_of("key")).alias("r").join(many.alias("m"), F.expr("r.source <=> m.source AND r.lead = m.lead"), "left").select(*[F.col(f"r.{c}") for c in rows.columns], "r.lead", "many")
    last = F.coalesce(F.array_max(F.filter("many", lambda k: k <= F.col("key"))), F.lit(""))
    joined = joined.withColumn("last", last)
    return joined.withColumn("part", F.struct("lead", "last", (F.col("key") > F.col("last")).alias("beyond"), F.when(F.col("key") == F.col("last"), digits_of("tie")).otherwise("").alias("tie_lead"))).drop("lead", "many", "last")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Returns id, source, size, source_size, target, taken and the columns to carry for every row.

    size is the number of words. A document's random key is the digest of its id, so reruns
    agree. Within a source the documents lie in order of key; whole passes are taken while
    they fit the target, and in the last pass the words up to the exact budget, so one
    document per source may be taken in part. The order is dealt in ranges of the key's
    leading digits, as many as give a range about RANGE_ROWS documents of the corpus: sums of
    the ranges give each range its start, and a running sum within the range does the rest,
    so that a source with most of the rows is spread over all tasks. Rows of one id lie in
    order of a digest of their row's number, and an id with more than RANGE_ROWS rows is
    dealt in ranges of that digest, too. Texts are read once, for the table of sizes.

    Null and empty texts have size 0 and take 0. A null source is a source. Repeated rows
    are rows of their own. The key of a row without an id is the digest of its text.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string")))
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), F.md5(F.monotonically_increasing_id().cast("string")).alias("tie"), *carry))
    digits = len(f"{rows.count() // RANGE_ROWS:x}")
    rows = _in_ranges(rows, digits)
    targets = source_targets(rows, max_epochs)
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    ahead = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)))
    starts = parts.alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source")).select("p.source", "p.part", "part_start", "source_size", "target")
    inside = W.partitionBy("r.source", "r.part").orderBy("key", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.alias("r").withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.alias("r").join(starts.alias("s"), F.expr("r.source <=> s.source AND r.part = s.part"))
    budget = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(budget / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long")
    rest = budget - passes * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("part_start") - F.col("before")))
    return placed.select(
        F.col("id").alias(id_col), F.col("r.source").alias(source_col), "size", "source_size", "target",
        F.when(passes >= max_epochs, F.col("size") * max_epochs).otherwise(F.col("size") * passes + part).cast("long").alias("taken"), *carry,
    )
