"""Orders over whole tables, dealt in ranges so that no task holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenejobs.functions.tables import written


def running(df: DataFrame, order: str, total: Column, name: str) -> DataFrame:
    """Adds name, the running sum of total in ascending order of a column (without ties), and after, the next row's value of that column.

    Rows are dealt in ranges of the column; one row per range carries the sums and first
    values over, and running sums within the ranges do the rest.
    """
    dealt = written(df.withColumn(name, total).repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    of_ranges = W.orderBy("__range")
    ranges = dealt.groupBy("__range").agg(F.sum(name).alias("__sum"), F.min(order).alias("__first"))
    ranges = ranges.select("__range", F.coalesce(F.sum("__sum").over(of_ranges.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.lead("__first").over(of_ranges).alias("__next"))
    inside = W.partitionBy("__range").orderBy(order)
    rows = dealt.withColumn(name, F.sum(name).over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("after", F.lead(order).over(inside))
    return rows.join(ranges, "__range").withColumns({name: F.col(name) + F.col("__before"), "after": F.coalesce("after", "__next")}).drop("__range", "__before", "__next")
