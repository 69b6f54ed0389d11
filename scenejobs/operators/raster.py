"""Raster tables: points and boxes to pixels, colour modes, foreground, training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenejobs.functions.geometry import rotated, segment_hits_box

CHANNELS = ["r", "g", "b"]


def rasterize_points(points: DataFrame, half: float, res: int) -> DataFrame:
    """sid, row, col, r, g, b: type-2 points as cells coloured by direction; the last point drawn wins.

    points has sid, fid, pt_idx, global_type, x, y, dir_x, dir_y. Row 0 is the top of the view.
    """
    cell = 2 * half / res
    kept = points.where((F.col("global_type") == 2) & (F.abs("x") < half) & (F.abs("y") < half))
    col, row = F.floor((F.col("x") + half) / cell).cast("int"), F.floor((half - F.col("y")) / cell).cast("int")
    cells = kept.select("sid", F.least(row, F.lit(res - 1)).alias("row"), F.least(col, F.lit(res - 1)).alias("col"), F.struct("fid", "pt_idx").alias("drawn"), F.struct("dir_x", "dir_y").alias("d"))
    last = cells.groupBy("sid", "row", "col").agg(F.max_by("d", "drawn").alias("d"))
    return last.select("sid", "row", "col", (F.col("d.dir_x") / 2 + 0.5).alias("r"), (F.col("d.dir_y") / 2 + 0.5).alias("g"), F.lit(0.0).alias("b"))


def rasterize_lines(points: DataFrame, half: float, res: int) -> DataFrame:
    """sid, row, col, r, g, b: the lines between successive type-2 points as cells coloured by the direction of their first point; the last line drawn wins.

    points as for rasterize_points(). A line colours every cell that it touches: per column, the rows
    between its heights at the column's sides. Parts outside the view are left out; points
    without a place end a line; a polyline of one point has none.
    """
    cell = 2 * half / res
    w = W.partitionBy("sid", "fid").orderBy("pt_idx")
    u, v = (F.col("x") + half) / cell, (half - F.col("y")) / cell
    drawn = points.where(F.col("global_type") == 2).select("sid", F.struct("fid", "pt_idx").alias("drawn"), F.struct("dir_x", "dir_y").alias("d"), u.alias("u1"), v.alias("v1"), F.lead(u).over(w).alias("u2"), F.lead(v).over(w).alias("v2"))
    drawn = drawn.where(" AND ".join(f"abs({c}) < double('inf')" for c in ("u1", "v1", "u2", "v2")))
    low, high = lambda c: F.least(f"{c}1", f"{c}2"), lambda c: F.greatest(f"{c}1", f"{c}2")
    inside = drawn.where((low("u") < res) & (high("u") >= 0) & (low("v") < res) & (high("v") >= 0))
    span = lambda a, b: F.sequence(F.greatest(F.floor(a), F.lit(0)), F.least(F.floor(b), F.lit(res - 1)))
    columns = inside.select("*", F.explode(span(low("u"), high("u"))).alias("col"))

    def height(at: Column) -> Column:
        there = F.col("v1") + (F.col("v2") - F.col("v1")) * (at - F.col("u1")) / (F.col("u2") - F.col("u1"))
        return F.least(F.greatest(there, low("v")), high("v"))

    flat = F.col("u1") == F.col("u2")
    left, right = height(F.greatest(F.col("col").cast("double"), low("u"))), height(F.least(F.col("col") + 1.0, high("u")))
    columns = columns.withColumns({"a": F.when(flat, F.col("v1")).otherwise(left), "b": F.when(flat, F.col("v2")).otherwise(right)})
    columns = columns.where((F.least("a", "b") < res) & (F.greatest("a", "b") >= 0))
    cells = columns.select("sid", "drawn", "d", F.col("col").cast("int").alias("col"), F.explode(span(F.least("a", "b"), F.greatest("a", "b")).cast("array<int>")).alias("row"))
    last = cells.groupBy("sid", "row", "col").agg(F.max_by("d", "drawn").alias("d"))
    return last.select("sid", "row", "col", (F.col("d.dir_x") / 2 + 0.5).alias("r"), (F.col("d.dir_y") / 2 + 0.5).alias("g"), F.lit(0.0).alias("b"))


def filled(cells: DataFrame, res: int) -> DataFrame:
    """All res x res pixels of each image; cells without a colour are grey (0.5, 0.5, 0)."""
    every = cells.select("sid").distinct().select("sid", F.explode(F.sequence(F.lit(0), F.lit(res - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(res - 1))).alias("col"))
    grey = {"r": 0.5, "g": 0.5, "b": 0.0}
    return every.join(cells, ["sid", "row", "col"], "left").select(F.col("sid").alias("image_id"), "row", "col", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in grey.items()])


def agents_on_lanes(boxes: DataFrame, segments: DataFrame, cell: float = 10.0) -> DataFrame:
    """Boxes (sid, track_index, x, y, length, width, heading) that a lane segment (sid, x1, y1, x2, y2) meets.

    Both sides are dealt to grid cells by their bounding rectangles, so only neighbours are tested.
    """
    reach = F.hypot("length", "width") / 2

    def cells(low, high):
        return F.sequence(F.floor(low / cell), F.floor(high / cell))

    b = boxes.select("*", F.explode(cells(F.col("x") - reach, F.col("x") + reach)).alias("gx")).select("*", F.explode(cells(F.col("y") - reach, F.col("y") + reach)).alias("gy"))
    s = segments.select("sid", "x1", "y1", "x2", "y2", F.explode(cells(F.least("x1", "x2"), F.greatest("x1", "x2"))).alias("gx")).select("*", F.explode(cells(F.least("y1", "y2"), F.greatest("y1", "y2"))).alias("gy"))
    pairs = b.join(s, ["sid", "gx", "gy"])
    hit = pairs.where(segment_hits_box(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "x", "y", "length", "width", "heading"))))
    return boxes.join(hit.select("sid", "track_index").distinct(), ["sid", "track_index"], "left_semi")


def rasterize_boxes(agents: DataFrame, half: float, res: int) -> DataFrame:
    """sid, row, col, value: cells whose centre lies in a rotated box, valued displacement / 60 + 0.5; the last agent drawn wins.

    agents has sid, track_index, x, y, length, width, heading, displacement (metres per step).
    """
    cell = 2 * half / res
    reach = F.hypot("length", "width") / 2
    index = lambda v: F.least(F.greatest(F.floor(v / cell), F.lit(0)), F.lit(res - 1)).cast("int")
    inside = agents.where((F.abs("x") - reach < half) & (F.abs("y") - reach < half))
    cols = F.explode(F.sequence(index(F.col("x") - reach + half), index(F.col("x") + reach + half))).alias("col")
    rows = F.explode(F.sequence(index(half - F.col("y") - reach), index(half - F.col("y") + reach))).alias("row")
    cells = inside.select("*", cols).select("*", rows)
    dx, dy = (F.col("col") + 0.5) * cell - half - F.col("x"), half - (F.col("row") + 0.5) * cell - F.col("y")
    u, v = rotated(dx, dy, -F.col("heading"))
    hit = cells.where((F.abs(u) <= F.col("length") / 2) & (F.abs(v) <= F.col("width") / 2))
    return hit.groupBy("sid", "row", "col").agg((F.max_by("displacement", "track_index") / 60 + 0.5).alias("value"))


def training_pixels(pixels: DataFrame, coordinates: bool = False, size: int | None = None) -> DataFrame:
    """image_id, row, col, r, g, b: means of 2 x 2 blocks, scaled to [-1, 1]; cx and cy on demand."""
    block = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    small = pixels.groupBy("image_id", block("row"), block("col")).agg(*[((F.avg(c) - 0.5) / 0.5).alias(c) for c in CHANNELS])
    if coordinates:
        small = small.withColumns({"cx": F.col("col") / (size - 1) - 0.5, "cy": F.col("row") / (size - 1) - 0.5})
    return small


def channel_mode(pixels: DataFrame) -> DataFrame:
    """image_id, channel, mode: left edge of the fullest of 256 bins on [0, 1], the lowest on ties."""
    tall = pixels.unpivot("image_id", CHANNELS, "channel", "v")
    bins = tall.groupBy("image_id", "channel", F.least(F.floor(F.col("v") * 256), F.lit(255)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    best = bins.groupBy("image_id", "channel").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"))
    return best.select("image_id", "channel", (F.col("bin") / 256).alias("mode"))


def foreground(pixels: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Pixels whose red or green is more than threshold from its image's mode."""
    modes = channel_mode(pixels)
    wide = modes.groupBy("image_id").agg(*[F.max(F.when(F.col("channel") == c, F.col("mode"))).alias(f"mode_{c}") for c in "rg"])
    far = lambda c: F.abs(F.col(c) - F.col(f"mode_{c}")) > threshold
    return pixels.join(wide, "image_id").where(far("r") | far("g")).select(pixels.columns)


def step_displacement(tracks: DataFrame) -> DataFrame:
    """Adds displacement: metres to the next step's place; null at the last."""
    w = W.partitionBy("sid", "track_index").orderBy("t")
    return tracks.withColumn("displacement", F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")))
