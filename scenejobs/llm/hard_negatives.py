"""Hard negatives: exact inner products of the rows that distances to stored pivots can't rule out."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenejobs.functions.ranges import running
from scenejobs.functions.tables import temporary_tables
from scenejobs.llm.shared import groups, written

#: Pivots: a bounded number of rows whose distances to all rows are stored.
PIVOTS = 8
#: They are chosen among so many rows, those with the least hash.
PIVOT_SAMPLE = 1_000
#: Rows and anchors of one comparison. A row moves once for each block of anchors it meets, and the other way round.
BLOCK_ROWS, BLOCK_ANCHORS = 4096, 16_384
#: Tables of more rows have so many blocks, until these are as large as the largest of anchors.
BLOCKS = 64
#: Anchors that are bracketed and multiplied out together.
STRIPE = 64
#: Components are held to this size, so that sums of 64-bit products stay exact.
LARGEST = 1 << 28
#: Distances are compared with this much room for rounding, relative to the largest norm.
ROOM = 1e-9


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b as doubles if these hold every sum of products of their rows, else as they are."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(float), b.astype(float)) if reach < 2**53 else (a, b)


def _stack(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _farthest(rows: np.ndarray, wanted: int) -> np.ndarray:
    """Rows that lie far from each other: each the farthest from those before it."""
    chosen, near = [0], np.full(len(rows), np.inf)
    while len(chosen) < min(wanted, len(rows)):
        near = np.minimum(near, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(near.argmax()))
    return rows[chosen]


def _table(rows: DataFrame, is_anchor: Column, scale: int) -> tuple[DataFrame, float, int, int]:
    """Written rows (row, id, label, v, anchor, far), the largest squared norm, the longest vector and the number of rows.

    v holds the integers floor(scale * x); far the distances to the pivots after every vector
    has got one more component, which brings all to the largest norm: then the distance from
    an anchor (whose further component is 0) falls exactly as the inner product rises.
    """
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    some = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = rows.where(F.coalesce(some, F.lit(False))).select(F.col("vec_id").alias("id"), "label", whole.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    kept = written(kept.withColumns({"row": F.monotonically_increasing_id(), "norm": F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)}))
    most = kept.agg(F.max("norm").alias("norm"), F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    largest, width, n = most["norm"] or 0.0, most["width"] or 0, most["n"]
    drawn = kept.orderBy(F.xxhash64("v", "id"), "id", "row").limit(PIVOT_SAMPLE).select("v", "norm").toPandas()
    if not len(drawn):
        return kept.withColumn("far", F.array().cast("array<double>")), largest, width, n
    lifted = np.column_stack([_stack(drawn["v"], width), np.sqrt(np.maximum(largest - drawn["norm"], 0))])
    pivots = _farthest(lifted, PIVOTS)

    def measure(frames):
        for frame in frames:
            v = _stack(frame["v"], width).astype(float)
            high = np.sqrt(np.maximum(largest - frame["norm"].to_numpy(), 0))
            flat = [((v - p[:-1]) ** 2).sum(axis=1) for p in pivots]
            far = [np.sqrt(d + (high - p[-1]) ** 2) for d, p in zip(flat, pivots)]
            ask = [np.sqrt(d + p[-1] ** 2) for d, p in zip(flat, pivots)]
            yield frame.assign(far=list(np.column_stack(far)), ask=list(np.column_stack(ask)))

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept.columns) + ", far array<double>, ask array<double>"
    return written(kept.mapInPandas(measure, schema)), largest, width, n


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Adds block: rows of one label that lie near one pivot side by side, `size` to a block.

    Rows are numbered in the order of label, nearest pivot, distance and row, which has no ties,
    so no label, vector or id makes a block larger.
    """
    near = F.array_min("far")
    ordered = running(rows.withColumn("order", F.struct("label", F.array_position("far", near).alias("home"), near.alias("near"), "row")), "order", F.lit(1).cast("long"), "place")
    return ordered.withColumn("block", F.floor((F.col("place") - 1) / size)).drop("order", "place", "after")


def _spans(rows: DataFrame, *more: Column) -> DataFrame:
    """block, first and last label, low and high: the least and greatest distance to each pivot, and more aggregates."""
    at = lambda f: F.array(*[f(F.get("far", F.lit(i))) for i in range(PIVOTS)])
    return rows.groupBy("block").agg(F.min("label").alias("first"), F.max("label").alias("last"), at(F.min).alias("low"), at(F.max).alias("high"), *more)


def _pairs(asking: DataFrame, spans: DataFrame, room: float, alike: bool) -> DataFrame:
    """ask, block: blocks that may hold rows between nearest and farthest of an anchor of the block ask.

    By the triangle inequality two rows are at least as far apart as their distances to any
    pivot differ, and at most as far as these add up to; for blocks, spans take their place.
    One row stands for a block on both sides.
    """
    mine = asking.select(F.col("block").alias("ask"), *[F.col(c).alias(f"ask_{c}") for c in ("first", "last", "low", "high")], "nearest", "farthest")
    both = F.arrays_zip("low", "high", "ask_low", "ask_high")
    apart = F.array_max(F.transform(both, lambda s: F.greatest(s["low"] - s["ask_high"], s["ask_low"] - s["high"])))
    together = F.array_min(F.transform(both, lambda s: s["high"] + s["ask_high"]))
    labels = (F.col("first") <= F.col("ask_last")) & (F.col("ask_first") <= F.col("last")) if alike else ~((F.col("first") == F.col("last")) & (F.col("first") == F.col("ask_first")) & (F.col("first") == F.col("ask_last")))
    return mine.join(spans, labels & (apart <= F.col("farthest") + room) & (together >= F.col("nearest") - room)).select("ask", "block")


def _compared(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work(anchors, rows) on every pair of blocks, each a group of its own."""
    pairs = written(pairs)
    a = anchors.withColumnRenamed("block", "ask").join(pairs, "ask")
    b = rows.join(pairs, "block")
    return a.groupBy("ask", "block").cogroup(b.groupBy("ask", "block")).applyInPandas(work, schema)


def _stripes(asking: pd.DataFrame, held: pd.DataFrame, width: int, room: float, alike: bool, lowest: np.ndarray | None = None, highest: np.ndarray | None = None):
    """For each anchor its place in asking, the places in held (by id and row) of rows that may lie between nearest and farthest, and their scores.

    Anchors with one nearest pivot (and label, if alike) go together, those at like distances
    side by side; a row that is out of bracket for all of them is not multiplied out. Brackets
    of single pairs would cost more than the products. Of the rest only scores from lowest to
    highest are given, where these are set; anchors without any are left out.
    """
    far, ask = np.stack(held["far"]), np.stack(asking["far"])
    v, q = _exact(_stack(held["v"], width), _stack(asking["v"], width))
    label, row, own, me = (frame[c].to_numpy() for frame in (held, asking) for c in ("label", "row"))
    nearest, farthest = asking["nearest"].to_numpy(), asking["farthest"].to_numpy()
    kind = ask.argmin(axis=1) + (own.astype(np.int64) * ask.shape[1] if alike else 0)
    order = np.lexsort((ask.min(axis=1), kind))
    parts = [order[i : min(i + STRIPE, begin + n)] for begin, n in zip(*groups(kind[order])) for i in range(begin, begin + n, STRIPE)]
    for part in parts:
        low, high = ask[part].min(axis=0), ask[part].max(axis=0)
        open_ = (np.maximum(far - high, low - far).max(axis=1) <= farthest[part].max() + room) & ((far + high).min(axis=1) >= nearest[part].min() - room)
        some = np.flatnonzero(open_ & np.isin(label, own[part]) if alike else open_)
        scores = q[part] @ (v if len(some) == len(v) else v[some]).T
        allowed = (own[part, None] == label[some]) == alike
        if alike:
            allowed &= me[part, None] != row[some]
        if lowest is not None:
            allowed &= scores >= lowest[part, None]
        if highest is not None:
            allowed &= scores <= highest[part, None]
        for i in np.flatnonzero(allowed.any(axis=1)):
            chosen = np.flatnonzero(allowed[i])
            yield int(part[i]), some[chosen], scores[i, chosen].astype(np.int64)


def _first(scores: np.ndarray, wanted: int) -> np.ndarray:
    """Places of the `wanted` highest scores, the highest first and equal ones in order."""
    if len(scores) > wanted:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - wanted)[len(scores) - wanted])
    else:
        kept = np.arange(len(scores))
    return kept[np.argsort(-scores[kept], kind="stable")[:wanted]]


def mine(rows: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, least: float = 0.5, most: float = 0.95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of every anchor and positive.

    rows has vec_id, label, embedding; is_anchor says which rows are anchors. Rows with a null
    label or vector, or a component that is null or not finite, take no part. Scores are inner
    products of floor(scale * component), higher ones first, ties by smaller vec_id (null last)
    and then by any fixed order; shorter vectors count as filled with zeros, and components are
    held to LARGEST. An anchor's positives are its first `positives` other rows of its label;
    of each, the first `negatives` rows of other labels whose score is between least and most
    of the positive's (whole hundredths) are returned. Rows that share an id are rows like any
    others, and each anchor row among them returns its own.

    Anchors meet rows in blocks of bounded size, as the anchors are a stated share of all rows.
    Distances to pivots bracket every distance by the triangle inequality: pairs of blocks and
    then rows whose bracket lies outside what is wanted drop out, the rest is checked exactly.
    """
    low_share, high_share = round(least * 100), round(most * 100)
    with temporary_tables(rows.sparkSession) as made:
        table, largest, width, n = _table(rows, is_anchor, scale)
        made.pop()  # the table itself stays
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if "ask" not in table.columns:
        return rows.sparkSession.createDataFrame([], schema)
    room = ROOM * math.sqrt(largest)
    with temporary_tables(rows.sparkSession) as made:
        blocks = written(_blocks(table.select("row", "id", "label", "v", "far"), max(BLOCK_ROWS, min(n // BLOCKS, BLOCK_ANCHORS))))
        made.pop()
    spans = written(_spans(blocks))

    # Of an anchor's label, positives + 1 rows, itself perhaps among them, are no farther from a pivot than the last of so many nearest to it.
    of_block = [F.slice(F.array_sort(F.collect_list(F.get("far", F.lit(i)))), 1, positives + 1).alias(f"d{i}") for i in range(PIVOTS)]  # of one block's rows
    nearest = blocks.groupBy("block", "label").agg(*of_block).select("label", F.posexplode(F.array(*[f"d{i}" for i in range(PIVOTS)])).alias("pivot", "ds")).select("label", "pivot", F.explode("ds").alias("d"))
    nearest = nearest.withColumn("k", F.row_number().over(W.partitionBy("label", "pivot").orderBy("d"))).where(F.col("k") <= positives + 1)
    reach = nearest.where(F.col("k") == positives + 1).groupBy("label").agg(F.array(*[F.max(F.when(F.col("pivot") == i, F.col("d"))) for i in range(PIVOTS)]).alias("reach"))
    within = F.array_min(F.transform(F.arrays_zip("far", "reach"), lambda s: s["far"] + s["reach"]))  # null: fewer rows of the label, so all count
    asking = table.where("anchor").select("row", "id", "label", "v", F.col("ask").alias("far"), "norm").join(reach, "label", "left")
    asking = written(_blocks(asking.withColumns({"nearest": F.lit(0.0), "farthest": F.coalesce(within, F.lit(float("inf")))}).drop("reach"), BLOCK_ANCHORS))

    def like(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["id", "row"], na_position="last", ignore_index=True)
        out = []
        for i, at, scores in _stripes(a, b, width, room, True):
            first = _first(scores, positives)
            out.append(np.stack([np.full(len(first), i), at[first], scores[first]]))
        i, at, score = np.concatenate([np.empty((3, 0), np.int64), *out], axis=1)
        return pd.DataFrame({"row": a["row"].to_numpy()[i], "positive_row": b["row"].to_numpy()[at], "positive_id": b["id"].astype("Int64").array[at], "positive_score": score})

    near = lambda asked: _spans(asked, F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"))
    found = _compared(asking, blocks, _pairs(near(asking), spans, room, True), like, "row long, positive_row long, positive_id long, positive_score long")
    order = [F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_row"]
    found = found.withColumn("k", F.row_number().over(W.partitionBy("row").orderBy(*order))).where(F.col("k") <= positives)

    # A negative's score lies in a band below a positive's: a band of distances.
    share = lambda part, up: F.expr(f"(positive_score div 100) * {part} + (positive_score % 100 * {part} + {up}) div 100")
    bands = found.withColumns({"low": share(low_share, 99), "high": share(high_share, 0)}).where("positive_score >= 0 AND low <= high")
    bands = bands.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "positive_id", "positive_score", "low", "high"))).alias("bands"), F.min("low").alias("low"), F.max("high").alias("high"))
    distance = lambda score: F.sqrt(F.greatest(F.col("norm") + largest - 2 * F.col(score), F.lit(0.0)))
    asking = asking.drop("nearest", "farthest").join(bands, "row").withColumns({"nearest": distance("high"), "farthest": distance("low")}).drop("norm")
    asking = written(asking)

    def unlike(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["id", "row"], na_position="last", ignore_index=True)
        ks, lows, highs = (a[c].map(np.asarray).to_list() for c in ("k", "lows", "highs"))
        out = []
        for i, at, scores in _stripes(a, b, width, room, False, a["low"].to_numpy(), a["high"].to_numpy()):
            order = np.argsort(-scores, kind="stable")
            below = -scores[order]
            begin, end = np.searchsorted(below, -highs[i], side="left"), np.searchsorted(below, -lows[i], side="right")
            place = begin[:, None] + np.arange(negatives)
            band, n = np.nonzero(place < end[:, None])
            first = order[place[band, n]]
            out.append(np.stack([np.full(len(first), i), ks[i][band], at[first], scores[first]]))
        i, k, at, score = np.concatenate([np.empty((4, 0), np.int64), *out], axis=1)
        return pd.DataFrame({"row": a["row"].to_numpy()[i], "k": k, "negative_row": b["row"].to_numpy()[at], "negative_id": b["id"].astype("Int64").array[at], "negative_score": score})

    banded = asking.withColumns({"k": F.col("bands.k"), "lows": F.col("bands.low"), "highs": F.col("bands.high")}).drop("bands")
    hard = _compared(banded, blocks, _pairs(near(asking), spans, room, False), unlike, "row long, k int, negative_row long, negative_id long, negative_score long")
    order = [F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_row"]
    hard = hard.withColumn("rank", F.row_number().over(W.partitionBy("row", "k").orderBy(*order)).cast("int")).where(F.col("rank") <= negatives)
    of_anchor = asking.select("row", F.col("id").alias("anchor_id"), F.explode("bands").alias("band")).select("row", "anchor_id", "band.k", "band.positive_id", "band.positive_score")
    return of_anchor.join(hard, ["row", "k"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
