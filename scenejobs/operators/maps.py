"""Map polylines: decoding, directions, headings and polygon outlines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenejobs.functions.geometry import wrap_angle

#: Global type code of each kind and sub-type.
LANE_CODES = {1: 1, 2: 2, 3: 3}
ROAD_LINE_CODES = {1: 6, 2: 7, 3: 8, 4: 9, 5: 10, 6: 11, 7: 12, 8: 13}
ROAD_EDGE_CODES = {1: 15, 2: 16}
UNKNOWN_CODE = -1
STOP_SIGN_CODE, CROSSWALK_CODE, SPEED_BUMP_CODE, DRIVEWAY_CODE = 17, 18, 19, 20
#: Kinds in the order in which a feature is tried.
KINDS = ["lane", "road_line", "road_edge", "stop_sign", "crosswalk", "speed_bump", "driveway"]


def _code(sub_type: Column, codes: dict[int, int]) -> Column:
    table = F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])
    return F.coalesce(table[sub_type], F.lit(UNKNOWN_CODE))


def explode_map(scenarios: DataFrame) -> DataFrame:
    """sid, feature_id, kind, feature_pos, pt_idx, x, y, z, global_type: one row per map point.

    map_features is an array of structs with one member set per feature; the first member set
    decides the kind, and a feature with none is an error. A stop sign is one point.
    """
    f = F.col("f")
    kind = reduce(lambda rest, k: F.when(f[k].isNotNull(), k).otherwise(rest), reversed(KINDS), F.raise_error(F.concat(F.lit("feature without a kind: "), f["id"].cast("string"))).cast("string"))
    rows = scenarios.select("sid", F.posexplode("map_features").alias("feature_pos", "f")).withColumn("kind", kind)
    is_kind = lambda k: F.col("kind") == k
    points = (
        F.when(is_kind("lane"), f["lane"]["polyline"]).when(is_kind("road_line"), f["road_line"]["polyline"]).when(is_kind("road_edge"), f["road_edge"]["polyline"])
        .when(is_kind("stop_sign"), F.array(f["stop_sign"]["position"])).when(is_kind("crosswalk"), f["crosswalk"]["polygon"])
        .when(is_kind("speed_bump"), f["speed_bump"]["polygon"]).otherwise(f["driveway"]["polygon"])
    )
    code = (
        F.when(is_kind("lane"), _code(f["lane"]["type"], LANE_CODES)).when(is_kind("road_line"), _code(f["road_line"]["type"], ROAD_LINE_CODES))
        .when(is_kind("road_edge"), _code(f["road_edge"]["type"], ROAD_EDGE_CODES)).when(is_kind("stop_sign"), STOP_SIGN_CODE)
        .when(is_kind("crosswalk"), CROSSWALK_CODE).when(is_kind("speed_bump"), SPEED_BUMP_CODE).otherwise(DRIVEWAY_CODE)
    )
    rows = rows.select("sid", f["id"].alias("feature_id"), "kind", "feature_pos", code.alias("global_type"), F.posexplode(points).alias("pt_idx", "p"))
    return rows.select("sid", "feature_id", "kind", "feature_pos", "pt_idx", "p.x", "p.y", "p.z", "global_type")


def polyline_direction(points: DataFrame) -> DataFrame:
    """Adds dir_x, dir_y, dir_z: the unit step from the point before; 0 at the first point."""
    w = W.partitionBy("sid", "fid").orderBy("pt_idx")
    steps = points.withColumns({f"d{c}": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for c in "xyz"})
    length = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    norm = F.greatest(F.least(length, F.lit(1e9)), F.lit(1e-6))
    return steps.withColumns({f"dir_{c}": F.col(f"d{c}") / norm for c in "xyz"}).drop("dx", "dy", "dz")


def polyline_heading(points: DataFrame, wrap: bool = True) -> DataFrame:
    """Adds theta: heading to the next point; the last repeats the one before, a lone point has 0."""
    w = W.partitionBy("sid", "fid").orderBy("pt_idx")
    ahead = points.withColumn("ahead", F.atan2(F.lead("y").over(w) - F.col("y"), F.lead("x").over(w) - F.col("x")))
    theta = F.coalesce("ahead", F.lag("ahead").over(w), F.lit(0.0))
    return ahead.withColumn("theta", wrap_angle(theta) if wrap else theta).drop("ahead")


def all_polylines(*tables: DataFrame) -> DataFrame:
    """All kinds as one table, coordinates as float32; an empty scenario gives no rows."""
    whole = reduce(lambda a, b: a.unionByName(b), tables)
    return whole.select(*[F.col(c).cast("float").alias(c) if kind == "double" else F.col(c) for c, kind in whole.dtypes])


def densify_polygon(points: DataFrame) -> DataFrame:
    """sid, fid, edge, step, x, y: the closed ring with ceil(length) * 2 + 1 even points per edge, edge ends left out."""
    w = W.partitionBy("sid", "fid").orderBy("pt_idx")
    first = w.rowsBetween(W.unboundedPreceding, 0)
    edges = points.select("sid", "fid", F.col("pt_idx").alias("edge"), "x", "y", *[F.coalesce(F.lead(c).over(w), F.first(c).over(first)).alias(f"to_{c}") for c in "xy"])
    n = (F.ceil(F.hypot(F.col("to_x") - F.col("x"), F.col("to_y") - F.col("y"))) * 2 + 1).cast("int")
    rows = edges.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("step"))
    return rows.select("sid", "fid", "edge", "step", *[(F.col(c) + (F.col(f"to_{c}") - F.col(c)) * F.col("step") / F.col("n")).alias(c) for c in "xy"])
