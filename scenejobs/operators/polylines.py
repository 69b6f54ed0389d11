"""Polylines around the ego vehicle: selection, segments, chunks, resampling and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenejobs.functions.geometry import rotated
from scenejobs.functions.tables import written
from scenejobs.operators import chains


def ego_pose(tracks: DataFrame, scenarios: DataFrame, t: int = 10) -> DataFrame:
    """sid, ego_x, ego_y, ego_heading of the self-driving car at step t."""
    rows = tracks.where(F.col("t") == t).join(scenarios.select("sid", F.col("sdc_track_index").alias("track_index")), ["sid", "track_index"])
    return rows.select("sid", F.col("x").alias("ego_x"), F.col("y").alias("ego_y"), F.col("heading").alias("ego_heading"))


def within_radius(points: DataFrame, ego: DataFrame, radius: float, types: list[int] | None = None) -> DataFrame:
    """Points at most radius from the ego, of the wanted types; polylines without any vanish."""
    kept = points if types is None else points.where(F.col("global_type").isin(types))
    near = kept.join(ego, "sid").where(F.hypot(F.col("x") - F.col("ego_x"), F.col("y") - F.col("ego_y")) <= radius)
    return near.select(points.columns)


def to_ego(points: DataFrame, ego: DataFrame) -> DataFrame:
    """Points moved so that the ego is the origin; not turned."""
    moved = points.join(ego, "sid").withColumns({"x": F.col("x") - F.col("ego_x"), "y": F.col("y") - F.col("ego_y")})
    return moved.select(points.columns)


def segment_on_gap(points: DataFrame, threshold: float = 1.0, every: int = 1) -> DataFrame:
    """sid, seg, pos, fid, pt_idx, global_type, x, y, dir_x, dir_y: the scenario's points cut at gaps.

    Takes every so-many-th point of the scenario in feature order, whatever its lane, and
    begins a segment where the step is longer than threshold. The first point of a segment
    of two or more takes the direction of the second.
    """
    order = W.partitionBy("sid").orderBy("fid", "pt_idx")
    rows = points.withColumn("rn", F.row_number().over(order) - 1).where(F.col("rn") % every == 0)
    gap = F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)) > threshold
    rows = rows.withColumn("gap", F.coalesce(gap.cast("int"), F.lit(0)))
    rows = rows.withColumn("seg", F.sum("gap").over(order.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy("sid", "seg").orderBy("fid", "pt_idx")
    rows = rows.withColumn("pos", F.row_number().over(inside) - 1)
    second = lambda c: F.when(F.col("pos") == 0, F.coalesce(F.lead(c).over(inside), F.col(c))).otherwise(F.col(c))
    return rows.select("sid", "seg", "pos", "fid", "pt_idx", "global_type", "x", "y", second("dir_x").alias("dir_x"), second("dir_y").alias("dir_y"))


def chunk_pad(segments: DataFrame, n: int) -> DataFrame:
    """sid, seg, chunk, points, valid: pieces of n points, padded with zeros; valid marks real points."""
    struct = F.struct(F.pmod("pos", F.lit(n)).alias("i"), "x", "y", "dir_x", "dir_y")
    pieces = segments.groupBy("sid", "seg", F.floor(F.col("pos") / n).alias("chunk")).agg(F.sort_array(F.collect_list(struct)).alias("p"))
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("dir_x"), F.lit(0.0).alias("dir_y"))
    real = F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["dir_x"].alias("dir_x"), p["dir_y"].alias("dir_y")))
    places = F.sequence(F.lit(0), F.lit(n - 1))
    return pieces.select("sid", "seg", "chunk", F.transform(places, lambda i: F.coalesce(F.get(real, i), zero)).alias("points"), F.transform(places, lambda i: i < F.size("p")).alias("valid"))


def normalize_direction(points: DataFrame, padded: bool = True) -> DataFrame:
    """dir_x and dir_y of each scenario brought to [0, 0.99]; padding zeros take part in the range, a constant gives 0."""
    w = W.partitionBy("sid")
    out = {}
    for c in ("dir_x", "dir_y"):
        low, high = F.min(c).over(w), F.max(c).over(w)
        if padded:
            low, high = F.least(low, F.lit(0.0)), F.greatest(high, F.lit(0.0))
        out[c] = F.when(high == low, 0.0).otherwise((F.col(c) - low) / (high - low) * 0.99)
    return points.withColumns(out)


def select_types_in_view(segments: DataFrame, types: list[int], half: float) -> DataFrame:
    """Segments whose first point has one of the types, without points outside the view.

    too_less marks the rows of scenarios in which no segment has the type; such a scenario has
    one row without a point.
    """
    first = W.partitionBy("sid", "seg").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    marked = segments.withColumn("wanted", F.first("global_type").over(first).isin(types))
    kept = marked.where(F.col("wanted") & (F.abs("x") <= half) & (F.abs("y") <= half)).drop("wanted")
    flags = marked.groupBy("sid").agg((~F.bool_or("wanted")).alias("too_less"))
    return flags.join(kept, "sid", "left").where("too_less OR seg IS NOT NULL").select(*kept.columns, "too_less")


def cut_on_curvature(segments: DataFrame, threshold: float = 50e-4) -> DataFrame:
    """Adds piece: segments of five or more points are cut where the second gradient of the curvature exceeds threshold."""
    w = W.partitionBy("sid", "seg").orderBy("pos")

    def gradient(c: str):
        ahead, behind = F.lead(c).over(w), F.lag(c).over(w)
        return F.when(behind.isNull(), ahead - F.col(c)).when(ahead.isNull(), F.col(c) - behind).otherwise((ahead - behind) / 2)

    rows = segments
    for name, source in (("x1", "dir_x"), ("y1", "dir_y"), ("x2", "x1"), ("y2", "y1")):
        rows = rows.withColumn(name, gradient(source))
    speed = F.col("x1") ** 2 + F.col("y1") ** 2
    rows = rows.withColumn("k", F.when(speed == 0, 0.0).otherwise(F.abs(F.col("x2") * F.col("y1") - F.col("x1") * F.col("y2")) / F.pow(speed, F.lit(1.5))))
    rows = rows.withColumn("k1", gradient("k")).withColumn("k2", gradient("k1"))
    size = F.count(F.lit(1)).over(W.partitionBy("sid", "seg"))
    cut = ((F.col("k2") > threshold) & (F.col("pos") > 0)).cast("int")
    piece = F.when(size >= 5, F.sum(cut).over(w.rowsBetween(W.unboundedPreceding, 0))).otherwise(0)
    return rows.withColumn("piece", piece).select(*segments.columns, "piece")


#: What resample() measures a lane by, and what it places along each measure.
_MEASURES = {"place": (["x", "y", "z"], ["x", "y", "z"]), "turn": (["dir_x", "dir_y", "dir_z"], ["dir_x", "dir_y", "dir_z"]), "theta": (["pt_idx", "theta"], ["theta"])}


def resample(points: DataFrame, n: int = 128) -> DataFrame:
    """sid, fid, k, x, y, z, dir_x, dir_y, dir_z, theta, global_type: lanes of three or more points at n even steps.

    Places run along their own arc length, directions along theirs, theta along that of index and
    theta; the type is copied. A lane whose directions never change has null directions. All
    three measures share one order of the points; their values meet again by step.
    """
    w, every = W.partitionBy("sid", "fid").orderBy("pt_idx"), W.partitionBy("sid", "fid")
    values = [c for _, placed in _MEASURES.values() for c in placed]
    step = lambda columns: F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in columns[1:]), (F.col(columns[0]) - F.lag(columns[0]).over(w)) ** 2))
    rows = points.withColumns({f"d_{m}": F.coalesce(step(by), F.lit(0.0)) for m, (by, _) in _MEASURES.items()})
    rows = rows.withColumns({f"s_{m}": F.sum(f"d_{m}").over(w.rowsBetween(W.unboundedPreceding, 0)) for m in _MEASURES})
    rows = rows.withColumns({f"u_{m}": F.when(F.max(f"s_{m}").over(every) > 0, F.col(f"s_{m}") / F.max(f"s_{m}").over(every)) for m in _MEASURES} | {"m": F.count(F.lit(1)).over(every), "kind": F.first("global_type").over(w.rowsBetween(W.unboundedPreceding, 0))}).where("m >= 3")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in (*values, *[f"u_{m}" for m in _MEASURES])})
    rows = rows.withColumns({f"end_{m}": F.max(F.when(F.col(f"next_u_{m}") > F.col(f"u_{m}"), F.col(f"next_u_{m}"))).over(every) for m in _MEASURES})

    def steps(m: str, placed: list[str]) -> Column:
        """The steps that lie between a point and the next along a measure, with the values there."""
        u, after = F.col(f"u_{m}"), F.col(f"next_u_{m}")
        start, end = F.ceil(u * (n - 1)), F.when(after == F.col(f"end_{m}"), n - 1).otherwise(F.ceil(after * (n - 1)) - 1)
        at = lambda k: (k / (n - 1) - u) / (after - u)
        filled = lambda k: F.struct(k.cast("int").alias("k"), *[(F.col(c) + (F.col(f"next_{c}") - F.col(c)) * at(k) if c in placed else F.lit(None).cast("double")).alias(c) for c in values], F.lit(m == "place").alias("own"))
        return F.coalesce(F.when((after > u) & (start <= end), F.transform(F.sequence(start, end), filled)), F.array())

    each = rows.select("sid", "fid", "kind", F.explode(F.concat(*[steps(m, placed) for m, (_, placed) in _MEASURES.items()])).alias("e")).select("sid", "fid", "kind", "e.*")
    met = each.groupBy("sid", "fid", "k").agg(*[F.max(c).alias(c) for c in values], F.first("kind").alias("global_type"), F.max("own").alias("own"))
    return met.where("own").drop("own")


def pack(polylines: DataFrame, rows: int, columns: list[str], fill: float = 0.2, scenarios: DataFrame | None = None) -> DataFrame:
    """sid, slot, mask, empty and the columns: the first rows polylines of a scenario, missing ones filled.

    polylines has sid, fid and the columns (one row per polyline), numbers or arrays of one length,
    such as the coordinates of resampled points. Scenarios of the table scenarios without any
    polyline give slots of zeros with empty set; mask is 0 in them, too.
    """
    w = W.partitionBy("sid").orderBy("fid")
    kept = polylines.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < rows).withColumn("mask", F.lit(1))
    known = polylines.select("sid").distinct().withColumn("empty", F.lit(False))
    if scenarios is not None:
        known = scenarios.select("sid").distinct().join(known, "sid", "left").withColumn("empty", F.coalesce("empty", F.lit(True)))
    slots = known.select("sid", "empty", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("slot"))
    arrays = [c for c, kind in polylines.dtypes if c in columns and kind.startswith("array")]
    sizes = F.broadcast(polylines.agg(*[F.max(F.size(c)).alias(f"__{c}") for c in arrays], F.lit(0).alias("__")))  # one row
    value = F.when(F.col("empty"), 0.0).otherwise(fill)
    filled = lambda c: F.coalesce(c, F.array_repeat(value, F.coalesce(f"__{c}", F.lit(0))) if c in arrays else value).alias(c)
    return slots.join(kept, ["sid", "slot"], "left").crossJoin(sizes).select("sid", "slot", F.coalesce("mask", F.lit(0)).alias("mask"), "empty", *[filled(c) for c in columns])


def unpack(packed: DataFrame) -> DataFrame:
    """The polylines of a packed table, without the filled slots."""
    return packed.where("mask = 1").drop("mask", "empty")


def nearest_polylines(centers: DataFrame, points: DataFrame, k: int, offset: tuple[float, float] = (30.0, 0.0)) -> DataFrame:
    """The k polylines nearest to each centre, in its frame: a row per point.

    sid, center_index, rank, fid, pt_idx, x, y, z, dir_x, dir_y, valid, prev_x, prev_y, mean_x, mean_y.
    points has sid, fid, pt_idx, x, y, z, dir_x, dir_y, valid. Polylines are ranked by the
    distance of the mean of their valid points to the centre plus offset (turned by the
    centre's heading); only one row per polyline is ranked, points are joined back after.
    Points that aren't valid are 0; the first point is its own predecessor; mean_x and mean_y
    are the mean of the valid points in the centre's frame.
    """
    seen = points.where("valid")
    means = seen.groupBy("sid", "fid").agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    dx, dy = rotated(F.lit(offset[0]), F.lit(offset[1]), F.col("heading"))
    c = centers.select("sid", "center_index", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), "heading")
    pairs = c.join(means, "sid").withColumn("d", F.hypot(F.col("mean_x") - F.col("cx") - dx, F.col("mean_y") - F.col("cy") - dy))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("sid", "center_index").orderBy("d", "fid"))).where(F.col("rank") <= k)
    rows = ranked.join(points.select("sid", "fid", "pt_idx", "x", "y", "z", "dir_x", "dir_y", "valid"), ["sid", "fid"])
    turned = lambda a, b: rotated(a, b, -F.col("heading"))
    (x, y), (u, v), (mx, my) = turned(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")), turned(F.col("dir_x"), F.col("dir_y")), turned(F.col("mean_x") - F.col("cx"), F.col("mean_y") - F.col("cy"))
    masked = lambda value, name: F.when(F.col("valid"), value).otherwise(0.0).alias(name)
    rows = rows.select(
        "sid", "center_index", "rank", "fid", "pt_idx", masked(x, "x"), masked(y, "y"), masked(F.col("z") - F.col("cz"), "z"), masked(u, "dir_x"), masked(v, "dir_y"), "valid", mx.alias("mean_x"), my.alias("mean_y")
    )
    w = W.partitionBy("sid", "center_index", "fid").orderBy("pt_idx")
    return rows.withColumns({f"prev_{a}": F.coalesce(F.lag(a).over(w), F.col(a)) for a in "xy"})


def cut_at_endpoints(segments: DataFrame, half: float, near: float = 1.5, apart: float = 2.0) -> DataFrame:
    """sid, seg, piece, pos, x, y: polylines cut where a free endpoint of another one touches them.

    segments has sid, seg, pos, x, y. An endpoint is free if it lies more than 1 m inside the
    view on both axes and no opposite endpoint (its own line's included) is closer than apart.
    It cuts lines of four or more points at their nearest point, if that is within near and
    more than three points from both ends. Pieces of fewer than three points are dropped.
    """
    n = F.count(F.lit(1)).over(W.partitionBy("sid", "seg"))
    rows = segments.withColumn("n", n)
    ends = rows.where("pos = 0 OR pos = n - 1").select("sid", "seg", "x", "y", (F.col("pos") == 0).alias("start")).withColumn("end_id", F.struct("seg", "start"))
    gx, gy = (lambda c, cell: F.floor(F.col(c) / cell)), (lambda c, cell: F.sequence(F.floor(F.col(c) / cell) - 1, F.floor(F.col(c) / cell) + 1))
    inner = ends.where((F.abs("x") < half - 1) & (F.abs("y") < half - 1))
    around = lambda df, cell: df.withColumn("gx", F.explode(gy("x", cell))).withColumn("gy", F.explode(gy("y", cell)))
    other = ends.select("sid", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("start").alias("o_start"), gx("x", apart).alias("gx"), gx("y", apart).alias("gy"))
    met = around(inner, apart).join(other, ["sid", "gx", "gy"]).where((F.col("start") != F.col("o_start")) & (F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) < apart)).select("sid", "end_id").distinct()
    free = inner.join(met, ["sid", "end_id"], "left_anti")
    points = rows.where("n >= 4").select("sid", F.col("seg").alias("p_seg"), F.col("pos").alias("p_pos"), "n", F.col("x").alias("px"), F.col("y").alias("py"), gx("x", near).alias("gx"), gx("y", near).alias("gy"))
    hits = around(free, near).join(points, ["sid", "gx", "gy"]).where("seg != p_seg").withColumn("d", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).where(F.col("d") <= near)
    best = hits.groupBy("sid", "end_id", "p_seg", "n").agg(F.min(F.struct("d", "p_pos")).alias("m"))
    cuts = best.where((F.col("m.p_pos") > 3) & (F.col("m.p_pos") < F.col("n") - 3)).select("sid", F.col("p_seg").alias("seg"), F.col("m.p_pos").alias("pos"), F.lit(1).alias("cut")).distinct()
    order = W.partitionBy("sid", "seg").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    split = rows.join(cuts, ["sid", "seg", "pos"], "left").withColumn("piece", F.sum(F.coalesce("cut", F.lit(0))).over(order))
    size = F.count(F.lit(1)).over(W.partitionBy("sid", "seg", "piece"))
    return split.withColumn("size", size).where("size >= 3 OR size = n").select("sid", "seg", "piece", "pos", "x", "y")


def root_leaf_paths(ends: DataFrame, half: float, edge: float = 0.5, link: float = 0.5) -> DataFrame:
    """sid, path: all simple chains of polylines from a root to the first leaf.

    ends has sid, seg, start_x, start_y, end_x, end_y. A root starts, a leaf ends within edge of
    the view's border; a link joins an end to a start at most link away. A polyline enters
    a chain once, so the rounds, which go on until no chain grows, come to an end; every
    step is written once, see chains.grow().
    """
    border = lambda x, y: F.least(F.abs(F.abs(x) - half), F.abs(F.abs(y) - half)) <= edge
    ends = ends.withColumns({"root": border("start_x", "start_y"), "leaf": border("end_x", "end_y")})
    cell = lambda c: F.floor(F.col(c) / link)
    a = ends.select("sid", F.col("seg").alias("last"), "end_x", "end_y", F.explode(F.sequence(cell("end_x") - 1, cell("end_x") + 1)).alias("gx"), cell("end_y").alias("gy0"))
    a = a.select("*", F.explode(F.sequence(F.col("gy0") - 1, F.col("gy0") + 1)).alias("gy"))
    b = ends.select("sid", F.col("seg").alias("next"), F.col("leaf").alias("next_leaf"), "start_x", "start_y", cell("start_x").alias("gx"), cell("start_y").alias("gy"))
    links = written(a.join(b, ["sid", "gx", "gy"]).where(F.hypot(F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y")) <= link).select("sid", "last", "next", "next_leaf"))
    first = ends.where("root").select("sid", F.col("seg").alias("element"), "leaf")
    levels = chains.grow(first, links.withColumnRenamed("last", "element"), "NOT leaf", {"leaf": "next_leaf"})
    return chains.spelt_out(levels, [level.where("leaf") for level in levels])


def vertices_and_edges(points: DataFrame) -> DataFrame:
    """sid, path_id, vertices: paths as lists of vertex keys; points at the same place share the first key.

    points has sid, path_id, pos, x, y; a key is the (path_id, pos) of the first point there.
    """
    first = W.partitionBy("sid", "x", "y")
    keyed = points.withColumn("key", F.min(F.struct("path_id", "pos")).over(first))
    listed = keyed.groupBy("sid", "path_id").agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("v"))
    return listed.select("sid", "path_id", F.transform("v", lambda v: v["key"]).alias("vertices"))
