"""Object tracks and agent-centred samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenejobs.functions.geometry import box_corners, rotated, segment_hits_box, wrap_angle

#: Object type codes.
VEHICLE, PEDESTRIAN, CYCLIST = 1, 2, 3
#: Seconds per step.
STEP = 0.1
#: Side in metres of the cells in which sight lines meet boxes.
SIGHT_CELL = 10.0


def explode_tracks(scenarios: DataFrame) -> DataFrame:
    """One row per track and step of nested records, heading wrapped."""
    rows = scenarios.select("sid", F.posexplode("tracks").alias("track_index", "k")).select("sid", "track_index", F.col("k.id").alias("object_id"), F.col("k.object_type").alias("object_type"), F.posexplode("k.states").alias("t", "s"))
    return rows.select(
        "sid", "track_index", "object_id", "object_type", "t", F.col("s.center_x").alias("x"), F.col("s.center_y").alias("y"), F.col("s.center_z").alias("z"),
        "s.length", "s.width", "s.height", wrap_angle(F.col("s.heading")).alias("heading"), F.col("s.velocity_x").alias("vx"), F.col("s.velocity_y").alias("vy"), "s.valid",
    )


def split_history(tracks: DataFrame, now: int = 10) -> tuple[DataFrame, DataFrame]:
    """Past (up to now) and future rows."""
    return tracks.where(F.col("t") <= now), tracks.where(F.col("t") > now)


def agent_state(tracks: DataFrame, t: int) -> DataFrame:
    """sid, track_index, x, y, yaw, speed, corners of the valid rows at step t."""
    rows = tracks.where((F.col("t") == t) & F.col("valid"))
    corners = box_corners(*(F.col(c) for c in ("x", "y", "length", "width", "heading")))
    return rows.select("sid", "track_index", "x", "y", F.col("heading").alias("yaw"), F.hypot("vx", "vy").alias("speed"), corners.alias("corners"))


def impute_backward(tracks: DataFrame) -> DataFrame:
    """Steps with x = 0 take velocity and heading of the next good step and its place, moved back in time.

    A gap at the end has no source and stays.
    """
    good = F.when(F.col("x") != 0, F.struct("t", "x", "y", "vx", "vy", "heading"))
    after = W.partitionBy("sid", "track_index").orderBy("t").rowsBetween(0, W.unboundedFollowing)
    rows = tracks.withColumn("src", F.first(good, ignorenulls=True).over(after))
    fill = (F.col("x") == 0) & F.col("src").isNotNull()
    back = STEP * (F.col("src.t") - F.col("t"))
    changed = {c: F.when(fill, F.col(f"src.{c}") - back * F.col(f"src.v{c}")).otherwise(F.col(c)) for c in "xy"}
    changed |= {c: F.when(fill, F.col(f"src.{c}")).otherwise(F.col(c)) for c in ("vx", "vy", "heading")}
    return rows.withColumns(changed).drop("src")


def center_objects(tracks: DataFrame, scenarios: DataFrame, now: int = 10) -> DataFrame:
    """sid, center_index, track_index, x, y, z, heading, vx, vy of the listed tracks at now, in list order."""
    listed = scenarios.select("sid", F.posexplode("predict_list").alias("center_index", "track_index"))
    states = tracks.where(F.col("t") == now).select("sid", "track_index", "x", "y", "z", "heading", "vx", "vy")
    return listed.join(states, ["sid", "track_index"]).select("sid", "center_index", "track_index", "x", "y", "z", "heading", "vx", "vy")


def to_center_frame(tracks: DataFrame, centers: DataFrame) -> DataFrame:
    """Every track step in the frame of every centre of its scenario; adds center_index and center_track."""
    c = centers.select("sid", "center_index", F.col("track_index").alias("center_track"), *[F.col(k).alias(f"c_{k}") for k in ("x", "y", "z", "heading")])
    rows = tracks.join(c, "sid")
    x, y = rotated(F.col("x") - F.col("c_x"), F.col("y") - F.col("c_y"), -F.col("c_heading"))
    vx, vy = rotated(F.col("vx"), F.col("vy"), -F.col("c_heading"))
    moved = {"x": x, "y": y, "z": F.col("z") - F.col("c_z"), "vx": vx, "vy": vy, "heading": F.col("heading") - F.col("c_heading")}
    return rows.withColumns(moved).select("sid", "center_index", "center_track", *[k for k in tracks.columns if k != "sid"])


def agent_features(samples: DataFrame, scenarios: DataFrame, now: int = 10, typo: bool = False) -> DataFrame:
    """sid, center_index, track_index, t, features: 29 numbers per past step of a track in a centre's frame.

    Place and size (6), vehicle, pedestrian, cyclist, is-centre, is-self flags (5), one-hot step
    and its time (12), sine and cosine of the heading (2), velocity (2), acceleration (2, the
    first step takes the second's). Invalid steps are all 0. typo=True leaves the pedestrian
    flag 0, as the reference's misspelt label does.
    """
    w = W.partitionBy("sid", "center_index", "track_index").orderBy("t")
    past = samples.where(F.col("t") <= now).join(scenarios.select("sid", "sdc_track_index"), "sid")
    for c in "xy":
        a = (F.col(f"v{c}") - F.lag(f"v{c}").over(w)) / STEP
        past = past.withColumn(f"a{c}", a)
        past = past.withColumn(f"a{c}", F.coalesce(f"a{c}", F.lead(f"a{c}").over(w), F.lit(0.0)))
    flag = lambda c: c.cast("double")
    values: list[Column] = [F.col(c).cast("double") for c in ("x", "y", "z", "length", "width", "height")]
    values += [flag(F.col("object_type") == VEHICLE), F.lit(0.0) if typo else flag(F.col("object_type") == PEDESTRIAN), flag(F.col("object_type") == CYCLIST)]
    values += [flag(F.col("track_index") == F.col("center_track")), flag(F.col("track_index") == F.col("sdc_track_index"))]
    values += [flag(F.col("t") == k) for k in range(now + 1)] + [F.col("t").cast("double")]
    values += [F.sin("heading"), F.cos("heading"), *(F.col(c) for c in ("vx", "vy", "ax", "ay"))]
    features = F.array(*[F.when(F.col("valid"), v).otherwise(0.0) for v in values])
    return past.select("sid", "center_index", "track_index", "t", features.alias("features"))


def future_labels(samples: DataFrame, now: int = 10) -> DataFrame:
    """sid, center_index, t, x, y, vx, vy of the centre's own future, 0 where invalid."""
    own = samples.where((F.col("t") > now) & (F.col("track_index") == F.col("center_track")))
    return own.select("sid", "center_index", "t", *[F.when(F.col("valid"), F.col(c)).otherwise(0.0).alias(c) for c in ("x", "y", "vx", "vy")])


def select_interesting(samples: DataFrame, lists: DataFrame) -> DataFrame:
    """sid, center_index, slot, track_index: the listed tracks of each centre in list order, padded to the longest list.

    lists has sid, center_index, track_list, whose first entry is the centre itself.
    """
    longest = lists.agg(F.max(F.size("track_list")).alias("longest"))
    slots = lists.crossJoin(F.broadcast(longest)).select("sid", "center_index", F.explode(F.sequence(F.lit(0), F.col("longest") - 1)).alias("slot"), "track_list")
    wanted = slots.select("sid", "center_index", "slot", F.get("track_list", F.col("slot")).alias("track_index"))
    present = samples.select("sid", "center_index", "track_index").distinct().withColumn("present", F.lit(True))
    return wanted.join(present, ["sid", "center_index", "track_index"], "left").select("sid", "center_index", "slot", F.when(F.col("present"), F.col("track_index")).alias("track_index"))


def last_valid(samples: DataFrame, now: int = 10) -> DataFrame:
    """sid, center_index, track_index, last_x, last_y, last_future: place of the last valid past step and step number of the last valid future one, 0 by default."""
    seen = lambda cond: F.when(cond & F.col("valid"), F.col("t"))
    past = seen(F.col("t") <= now)
    rows = samples.groupBy("sid", "center_index", "track_index").agg(F.max_by("x", past).alias("last_x"), F.max_by("y", past).alias("last_y"), F.max(seen(F.col("t") > now) - now - 1).alias("last_future"))
    return rows.fillna({"last_x": 0.0, "last_y": 0.0, "last_future": 0})


def predictions_to_world(preds: DataFrame, centers: DataFrame) -> DataFrame:
    """Predicted x and y turned by the centre's heading and moved to its place; other columns are carried."""
    c = centers.select("sid", "center_index", F.col("x").alias("c_x"), F.col("y").alias("c_y"), F.col("heading").alias("c_heading"))
    rows = preds.join(c, ["sid", "center_index"])
    x, y = rotated(F.col("x"), F.col("y"), F.col("c_heading"))
    return rows.withColumns({"x": x + F.col("c_x"), "y": y + F.col("c_y")}).select(preds.columns)


def normalize_to(points: DataFrame, center_x: Column, center_y: Column, angle: Column, zeros_stay: bool = True) -> DataFrame:
    """x and y shifted and turned by -angle, heading wrapped, velocity turned; a coordinate that was 0 stays 0."""
    x, y = rotated(F.col("x") - center_x, F.col("y") - center_y, -angle)
    vx, vy = rotated(F.col("vx"), F.col("vy"), -angle)
    moved = {"x": x, "y": y, "heading": wrap_angle(F.col("heading") - angle), "vx": vx, "vy": vy}
    if zeros_stay:
        moved = {k: F.when(F.col(k) == 0, 0.0).otherwise(v) for k, v in moved.items()}
    return points.withColumns({k: v for k, v in moved.items() if k in points.columns})


def visible_agents(states: DataFrame, max_dist: float) -> DataFrame:
    """sid, t, ego, target of valid rows within max_dist whose sight line crosses no other agent's box.

    states has sid, t, track_index, is_ego, x, y, length, width, heading. An occluder counts only
    if both its coordinates differ from ego's and target's. Pairs are cut to max_dist; a sight
    line and a box are tested where a grid cell that the line crosses lies in the box's bounding rectangle.
    """
    agent = lambda p: states.select("sid", "t", *[F.col(c).alias(f"{p}_{c}") for c in ("track_index", "is_ego", "x", "y", "length", "width", "heading")])
    pairs = agent("e").where("e_is_ego").join(agent("a"), ["sid", "t"]).where("e_track_index != a_track_index")
    pairs = pairs.where(F.hypot(F.col("a_x") - F.col("e_x"), F.col("a_y") - F.col("e_y")) <= max_dist).select("sid", "t", "e_track_index", "e_x", "e_y", "a_track_index", "a_x", "a_y")
    cell = lambda c: F.floor(c / SIGHT_CELL)
    low, high = lambda c: F.least(f"e_{c}", f"a_{c}"), lambda c: F.greatest(f"e_{c}", f"a_{c}")
    lines = pairs.withColumn("gx", F.explode(F.sequence(cell(low("x")), cell(high("x")))))
    height = lambda x: F.least(F.greatest(F.col("e_y") + (F.col("a_y") - F.col("e_y")) * (x - F.col("e_x")) / (F.col("a_x") - F.col("e_x")), low("y")), high("y"))
    flat = F.col("e_x") == F.col("a_x")
    left, right = height(F.greatest(F.col("gx") * SIGHT_CELL, low("x"))), height(F.least((F.col("gx") + 1) * SIGHT_CELL, high("x")))
    ends = [F.when(flat, F.col(own)).otherwise(side) for own, side in (("e_y", left), ("a_y", right))]
    lines = lines.withColumn("gy", F.explode(F.sequence(cell(F.least(*ends)), cell(F.greatest(*ends)))))
    reach = F.hypot(F.col("o_length"), F.col("o_width")) / 2
    spots = lambda c: F.explode(F.sequence(cell(F.col(f"o_{c}") - reach), cell(F.col(f"o_{c}") + reach)))
    boxes = agent("o").withColumn("gx", spots("x")).withColumn("gy", spots("y"))
    differs = (F.col("o_x") != F.col("e_x")) & (F.col("o_y") != F.col("e_y")) & (F.col("o_x") != F.col("a_x")) & (F.col("o_y") != F.col("a_y"))
    hit = segment_hits_box(*(F.col(c) for c in ("e_x", "e_y", "a_x", "a_y", "o_x", "o_y", "o_length", "o_width", "o_heading")))
    hidden = lines.join(boxes, ["sid", "t", "gx", "gy"]).where(differs & hit).select("sid", "t", "e_track_index", "a_track_index").distinct()
    seen = pairs.join(hidden, ["sid", "t", "e_track_index", "a_track_index"], "left_anti")
    return seen.select("sid", "t", F.col("e_track_index").alias("ego"), F.col("a_track_index").alias("target"))
