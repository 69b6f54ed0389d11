"""Chains of linked elements as a tree of steps: each step is written once, and only whole chains are spelt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenejobs.functions.tables import together, written

#: Columns of a tree level: its scenario, number in the level, parent's number in the level before, element, and the elements of the chain as a bit set.
_NODE = ["sid", "node", "parent", "element", "seen"]


def numbered(elements: DataFrame) -> DataFrame:
    """sid, element, bit: each scenario's distinct elements, numbered from 0."""
    return elements.select("sid", "element").distinct().withColumn("bit", F.row_number().over(W.partitionBy("sid").orderBy("element")) - 1)


def _holds(seen: str, bit: Column) -> Column:
    return F.coalesce(F.get(seen, F.floor(bit / 64).cast("int")), F.lit(0)).bitwiseAND(F.expr("shiftleft(1L, next_bit % 64)")) != 0


def _with_bit(seen: Column, bit: str) -> Column:
    """The set with one more bit: an array of 64-bit words, as long as its highest bit needs."""
    words = F.expr(f"sequence(0, greatest(size({seen}) - 1, {bit} div 64))")
    return F.transform(words, lambda i: F.coalesce(F.get(F.expr(seen), i.cast("int")), F.lit(0).cast("long")).bitwiseOR(F.when(i == F.expr(f"{bit} div 64"), F.expr(f"shiftleft(1L, {bit} % 64)")).otherwise(F.lit(0).cast("long"))))


def grow(starts: DataFrame, links: DataFrame, goes_on: str, carry: dict[str, str]) -> list[DataFrame]:
    """Levels of the tree of chains: the starts, then what each round adds, until none grows.

    starts has sid, element and the columns of carry; links has sid, element, next and what
    carry reads. A node is extended by every link from its element whose next is not in its
    chain, if the condition goes_on holds for it. carry gives the columns that a child takes
    along as expressions over its parent's columns and the link's. Every node is written once, with
    its parent's number and a bit set of its chain's elements.
    """
    bits = written(numbered(starts.select("sid", "element").unionByName(links.select("sid", F.col("next").alias("element")))))
    links = written(links.join(bits.select("sid", F.col("element").alias("next"), F.col("bit").alias("next_bit")), ["sid", "next"]))
    first = starts.join(bits, ["sid", "element"]).withColumn("seen", _with_bit("array()", "bit"))
    level = written(first.select("sid", F.monotonically_increasing_id().alias("node"), F.lit(None).cast("long").alias("parent"), "element", "seen", *carry))
    levels = []
    while not levels or not level.isEmpty():
        levels.append(level)
        grown = level.where(goes_on).withColumnRenamed("node", "above").drop("parent").join(links, ["sid", "element"]).where(~_holds("seen", F.col("next_bit")))
        level = written(grown.select("sid", F.monotonically_increasing_id().alias("node"), F.col("above").alias("parent"), F.col("next").alias("element"), _with_bit("seen", "next_bit").alias("seen"), *[F.expr(e).alias(c) for c, e in carry.items()]))
    return levels


def spelt_out(levels: list[DataFrame], ends: list[DataFrame]) -> DataFrame:
    """sid, path: the elements from the start to each end; ends has the nodes of each level that are ends.

    From the last level on, every end looks up its node and its parent's number; a row is
    written for each element of each path, and then these are put in order.
    """
    rows, open_ = [], None
    for k in range(len(levels) - 1, -1, -1):
        here = ends[k].select("sid", F.lit(k).alias("level"), F.col("node").alias("end"), "node")
        asked = here if open_ is None else here.unionByName(open_)
        found = written(asked.join(levels[k].select("sid", "node", "parent", "element"), ["sid", "node"]).withColumn("pos", F.lit(k)))
        rows.append(found)
        open_ = found.select("sid", "level", "end", F.col("parent").alias("node"))
    whole = together(rows).groupBy("sid", "level", "end").agg(F.array_sort(F.collect_list(F.struct("pos", "element"))).alias("p"))
    return whole.select("sid", F.transform("p", lambda p: p["element"]).alias("path"))
