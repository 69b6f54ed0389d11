"""Lane topology and routes."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenejobs.functions.geometry import wrap_angle
from scenejobs.functions.tables import written
from scenejobs.operators import chains
from scenejobs.operators.curves import fit_path
from scenejobs.operators.nearest import within_reach

#: Height in metres of the strips in which path points meet polygon edges.
EDGE_CELL = 4.0


def reference_lanes(agents: DataFrame, lane_points: DataFrame) -> DataFrame:
    """sid, track_index, fid, start: the lanes an agent may be on.

    agents has sid, track_index, is_pedestrian, x, y. Pedestrians look 10 m and 5 m further
    until a lane is hit, and start at 0; the others look 5 m and 3.5 m further, and start ten
    points before the nearest one. The first level that hits is min over lanes in closed form,
    over the lanes that within_reach() finds.
    """
    a = agents.select("sid", "track_index", "is_pedestrian", F.col("x").alias("ax"), F.col("y").alias("ay"))
    base, step = F.when(F.col("is_pedestrian"), 10.0).otherwise(5.0), F.when(F.col("is_pedestrian"), 5.0).otherwise(3.5)

    def lanes_hit(pairs: DataFrame) -> DataFrame:
        of_lane = pairs.groupBy("sid", "track_index", "is_pedestrian", "fid").agg(F.min(F.struct("d", "pt_idx")).alias("m"))
        of_lane = of_lane.withColumn("level", F.greatest(F.lit(0), F.floor((F.col("m.d") - base) / step) + 1))
        hit = of_lane.withColumn("first", F.min("level").over(W.partitionBy("sid", "track_index"))).where("level = first")
        return hit.withColumn("reach", base + F.col("first") * step)

    hit = within_reach(a, lane_points.select("sid", "fid", "pt_idx", "x", "y"), ("sid", "track_index"), "sid", lanes_hit)
    start = F.when(F.col("is_pedestrian"), 0).otherwise(F.greatest(F.lit(0), F.col("m.pt_idx") - 10))
    return hit.select("sid", "track_index", "fid", start.cast("int").alias("start"))


def neighbor_lanes(current: DataFrame, neighbors: DataFrame, lane_points: DataFrame) -> DataFrame:
    """sid, track_index, side, fid, start: left and right neighbours at an agent's place.

    current has sid, track_index, fid, idx, x, y (one row per current lane); neighbors has sid,
    fid, side, pos, neighbor_id, self_start, self_end. The last listed neighbour whose range
    holds idx counts unless it is current itself; start is its point nearest the agent.
    """
    n = neighbors.select("sid", "fid", "side", "pos", "neighbor_id", "self_start", "self_end")
    found = current.join(n, ["sid", "fid"]).where("idx BETWEEN self_start AND self_end")
    own = current.select("sid", "track_index", F.col("fid").alias("neighbor_id"))
    found = found.join(own, ["sid", "track_index", "neighbor_id"], "left_anti")
    last = found.groupBy("sid", "track_index", "side", "x", "y").agg(F.max_by("neighbor_id", F.struct("pos", "neighbor_id")).alias("fid"))
    at = last.select("sid", "track_index", "side", "fid", F.col("x").alias("ax"), F.col("y").alias("ay")).join(lane_points.select("sid", "fid", "pt_idx", "x", "y"), ["sid", "fid"])
    d = F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"))
    return at.groupBy("sid", "track_index", "side", "fid").agg(F.min_by("pt_idx", F.struct(d, "pt_idx")).alias("start"))


def _first_of(keys: tuple[str, ...], *order: str) -> Callable[[DataFrame], DataFrame]:
    """For within_reach(): the nearest point as struct m of its distance and order, the first in order on ties."""
    return lambda pairs: pairs.groupBy(*keys).agg(F.min(F.struct("d", *order)).alias("m")).withColumn("reach", F.col("m.d"))


def nearest_point(positions: DataFrame, points: DataFrame) -> DataFrame:
    """sid, track_index, fid, pt_idx, dist of the nearest point; the first on ties."""
    a = positions.select("sid", "track_index", F.col("x").alias("ax"), F.col("y").alias("ay"))
    best = within_reach(a, points.select("sid", "fid", "pt_idx", "x", "y"), ("sid", "track_index"), "sid", _first_of(("sid", "track_index"), "fid", "pt_idx"))
    return best.select("sid", "track_index", "m.fid", "m.pt_idx", F.col("m.d").alias("dist"))


def map_match(positions: DataFrame, points: DataFrame, degrees: float = 10.0, keys: tuple[str, ...] = ("sid", "track_index")) -> DataFrame:
    """The keys, fid, pt_idx: nearest waypoint among those headed alike; null if there is none or its lane id is not positive.

    positions has the keys, sid among them, x, y, heading; points has theta; the difference of
    headings is folded to [0, pi].
    """
    a = positions.select(*keys, F.col("x").alias("ax"), F.col("y").alias("ay"), "heading")
    p = points.select("sid", "fid", "pt_idx", "x", "y", "theta")
    alike = F.abs(wrap_angle(F.col("heading") - F.col("theta"))) <= math.radians(degrees)
    best = within_reach(a, p, keys, "sid", _first_of(keys, "fid", "pt_idx"), alike).where("m.fid > 0")
    return positions.select(*keys).join(best, list(keys), "left").select(*keys, "m.fid", "m.pt_idx")


def reference_path(tracks: DataFrame, lane_points: DataFrame, topology: DataFrame, now: int, every: int = 10, near_end: int = 40, behind: int = 200, length: int = 1200, always_on: bool = False) -> DataFrame:
    """sid, track_index, k, x, y, yaw, curvature: a smooth path every 0.1 m along the lanes that a track follows, around its place at step now.

    tracks has sid, track_index, t, x, y, heading; lane_points has theta; topology has sid, fid, entry,
    exit (the first lane that leads in and out, or null). Waypoints are the matches of every so
    many steps. Before them come the points of the first matched lane up to its match, after
    the whole entry lane if the match is among its first near_end points; behind them the
    last lane from its match on, and the exit lane if fewer than near_end points are left
    (with always_on: in any case, and that lane's exit, too). Of these every fifth point
    counts. Without a match at an end nothing is added there; a track of fewer than two
    different waypoints has no path. Tracks are independent groups of some hundred points.
    """
    key = ["sid", "track_index"]
    ends = tracks.groupBy(*key).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    at = tracks.join(ends, key).where((F.col("t") == F.col("t1")) | ((F.col("t") - F.col("t0")) % every == 0))
    met = written(map_match(at, lane_points, keys=(*key, "t")).where("fid IS NOT NULL").join(ends, key))
    points = lane_points.select("sid", "fid", "pt_idx", "x", "y")
    main = met.where((F.col("t") - F.col("t0")) % every == 0).join(points, ["sid", "fid", "pt_idx"]).select(*key, F.lit(1).alias("part"), F.col("t").alias("lane"), "pt_idx", "x", "y")
    first, last = (met.where(F.col("t") == F.col(c)).select(*key, "fid", F.col("pt_idx").alias("i")).join(topology.select("sid", "fid", "entry", "exit"), ["sid", "fid"], "left") for c in ("t0", "t1"))
    last = last.join(points.groupBy("sid", "fid").agg(F.count(F.lit(1)).alias("n")), ["sid", "fid"])
    whole = lambda df, lane, part, place: df.select(*key, F.col(lane).alias("fid")).join(points, ["sid", "fid"]).select(*key, F.lit(part).alias("part"), F.lit(place).alias("lane"), "pt_idx", "x", "y")
    own = lambda df, cond, part, place: df.join(points, ["sid", "fid"]).where(cond).select(*key, F.lit(part).alias("part"), F.lit(place).alias("lane"), "pt_idx", "x", "y")
    going_on = last if always_on else last.where(F.col("n") - F.col("i") < near_end)
    parts = [main, whole(first.where(F.col("i") < near_end), "entry", 0, 0), own(first, "pt_idx < i", 0, 1), own(last, "pt_idx >= i", 2, 0), whole(going_on, "exit", 2, 1)]
    if always_on:
        after = topology.select("sid", F.col("fid").alias("exit"), F.col("exit").alias("second"))
        parts.append(whole(going_on.join(after, ["sid", "exit"]), "second", 2, 2))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy(*key, "part").orderBy("lane", "pt_idx")) - 1).where("part = 1 OR place % 5 = 0")
    rows = rows.join(tracks.where(F.col("t") == now).select(*key, F.col("x").alias("now_x"), F.col("y").alias("now_y")), key)

    def smooth(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "place"])
        x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
        names = [*key, "k", "x", "y", "yaw", "curvature"]
        if not ((x != x[0]) | (y != y[0])).any():
            return pd.DataFrame(columns=names)
        line = fit_path(x, y, 0.1)
        place = np.hypot(line[:, 0] - frame["now_x"].iloc[0], line[:, 1] - frame["now_y"].iloc[0]).argmin()
        cut = line[max(place - behind, 0) :][:length]
        out = pd.DataFrame(cut[:, :4], columns=["x", "y", "yaw", "curvature"])
        return out.assign(sid=frame["sid"].iloc[0], track_index=frame["track_index"].iloc[0], k=np.arange(len(out)))[names]

    kinds = {f.name: f.dataType.simpleString() for f in tracks.schema.fields}
    return rows.groupBy(*key).applyInPandas(smooth, f"sid {kinds['sid']}, track_index {kinds['track_index']}, k int, x double, y double, yaw double, curvature double")


def lane_sequences(exits: DataFrame, starts: DataFrame, sizes: DataFrame, limit: int = 300) -> DataFrame:
    """sid, path: all chains of exit lanes from each start lane.

    A chain grows until the points of the lanes after the first exceed limit or no exit is
    left. A lane enters a chain once, so cycles end, and so do the rounds: they go on until no
    chain grows. Every step of a chain is written once, see chains.grow(). exits has sid, fid, exit_fid; sizes has sid, fid, n.
    """
    links = exits.select("sid", F.col("fid").alias("element"), F.col("exit_fid").alias("next")).join(sizes.select("sid", F.col("fid").alias("next"), "n"), ["sid", "next"])
    first = starts.select("sid", F.col("fid").alias("element"), F.lit(0).cast("long").alias("points"))
    levels = chains.grow(first, links, f"points <= {limit}", {"points": "points + n"})
    after = [*levels[1:], levels[0].limit(0)]
    ends = [level.join(more.select("sid", F.col("parent").alias("node")).distinct(), ["sid", "node"], "left_anti") for level, more in zip(levels, after)]
    return chains.spelt_out(levels, ends)


def annotate_path(path: DataFrame, signals: DataFrame, crosswalks: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds annotation to path points: 0 at a stop signal, 1 in a crosswalk, else the speed limit in m/s.

    path has sid, fid, pt_idx, x, y; signals sid, x, y, state (1, 4 and 7 stop); crosswalks sid,
    polygon_id, pt_idx, x, y; limits sid, fid, speed_limit_mph. A point lies inside a polygon
    if a ray from it crosses an odd number of edges; points and edges meet in strips of y.
    """
    cell = 0.2
    grid = lambda c: F.floor(F.col(c) / cell)
    key = ["sid", "fid", "pt_idx"]
    stops = signals.where(F.col("state").isin(1, 4, 7)).select("sid", F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(F.sequence(grid("x") - 1, grid("x") + 1)).alias("gx"), grid("y").alias("gy0"))
    stops = stops.select("sid", "sx", "sy", "gx", F.explode(F.sequence(F.col("gy0") - 1, F.col("gy0") + 1)).alias("gy"))
    at_stop = path.withColumns({"gx": grid("x"), "gy": grid("y")}).join(stops, ["sid", "gx", "gy"]).where(F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")) < 0.2).select(*key).distinct()
    w = W.partitionBy("sid", "polygon_id").orderBy("pt_idx")
    first = w.rowsBetween(W.unboundedPreceding, 0)
    edges = crosswalks.select("sid", "polygon_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce(F.lead("x").over(w), F.first("x").over(first)).alias("x2"), F.coalesce(F.lead("y").over(w), F.first("y").over(first)).alias("y2"))
    tall = lambda low, high: F.sequence(F.floor(low / EDGE_CELL), F.floor(high / EDGE_CELL))
    edges = edges.where("y1 != y2").withColumn("cell", F.explode(tall(F.least("y1", "y2"), F.greatest("y1", "y2"))))
    crossing = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    inside = path.withColumn("cell", F.floor(F.col("y") / EDGE_CELL)).join(edges, ["sid", "cell"]).where(crossing).groupBy(*key, "polygon_id").count().where("count % 2 = 1").select(*key).distinct()
    rows = path.join(at_stop.withColumn("stop", F.lit(0.0)), key, "left").join(inside.withColumn("walk", F.lit(1.0)), key, "left").join(limits.select("sid", "fid", "speed_limit_mph"), ["sid", "fid"], "left")
    return rows.select(*path.columns, F.coalesce("stop", "walk", F.col("speed_limit_mph") / 2.237).alias("annotation"))


def signal_and_speed(path: DataFrame, signals: DataFrame, limits: DataFrame, near: float = 0.2) -> DataFrame:
    """Adds signal and speed to path points: the state of the first signal closer than near, else 0, and the lane's limit in m/s.

    path has sid, fid, pt_idx, x, y; signals sid, signal_id, x, y, state; limits sid, fid, speed_limit_mph.
    """
    grid = lambda c: F.floor(F.col(c) / near)
    key = ["sid", "fid", "pt_idx"]
    spots = signals.select("sid", "signal_id", "state", F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(F.sequence(grid("x") - 1, grid("x") + 1)).alias("gx"), grid("y").alias("gy0"))
    spots = spots.select("*", F.explode(F.sequence(F.col("gy0") - 1, F.col("gy0") + 1)).alias("gy"))
    met = path.withColumns({"gx": grid("x"), "gy": grid("y")}).join(spots, ["sid", "gx", "gy"]).where(F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")) < near)
    first = met.groupBy(*key).agg(F.min_by("state", "signal_id").alias("signal"))
    rows = path.join(first, key, "left").join(limits.select("sid", "fid", "speed_limit_mph"), ["sid", "fid"], "left")
    return rows.select(*path.columns, F.coalesce("signal", F.lit(0)).alias("signal"), (F.col("speed_limit_mph") / 2.237).alias("speed"))


def drop_overlapping(sequences: DataFrame) -> DataFrame:
    """The rows (sid, track_index, pos, path) of the lane sequences that no kept one makes redundant.

    In order of pos (different within an agent), a sequence that is still there removes any
    other of its agent, before or after, whose tail after the first lane is equal or whose
    lanes all lie in it. A sequence without lanes lies in every other one.

    Sequences meet those that hold their rarest lane, the only ones they can lie in, and those
    of an equal tail through the first of them. In rounds, a sequence is settled once no
    unsettled one before it could remove it; the first of each agent always is.
    """
    agent = ["sid", "track_index"]
    rows = written(sequences.select(*agent, "pos", "path", F.expr("slice(path, 2, greatest(size(path) - 1, 0))").alias("tail"), F.array_distinct("path").alias("lanes")))
    held = rows.select(*agent, "pos", "lanes", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("any"), F.lit(None).cast("long").alias("lane"))), F.transform("lanes", lambda x: F.struct(F.lit(False).alias("any"), x.cast("long").alias("lane"))))).alias("e")).select(*agent, "pos", "lanes", "e.*")
    often = held.groupBy(*agent, "any", "lane").agg(F.count(F.lit(1)).alias("n"))
    same = lambda a, b: F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in (*agent, "any", "lane")))
    rarest = held.alias("h").join(often.alias("o"), same("h", "o")).groupBy(*[f"h.{c}" for c in (*agent, "pos")]).agg(F.min(F.struct("n", "h.any", "h.lane")).alias("r"), F.first("lanes").alias("own"))
    rarest = rarest.select(*agent, F.col("pos").alias("inner"), "own", "r.any", "r.lane")
    inside = rarest.alias("r").join(held.alias("h"), same("r", "h")).where((F.col("inner") != F.col("pos")) & (F.size(F.array_except("own", "lanes")) == 0))
    inside = written(inside.select(*[F.col(f"r.{c}") for c in agent], "inner", F.col("pos").alias("outer")))
    open_ = rows.select(*agent, "pos", "tail")
    acting = written(open_.limit(0))
    while not open_.isEmpty():
        by_tail = lambda df, name: df.groupBy(*agent, "tail").agg(F.min("pos").alias(name))
        by_lanes = lambda df: inside.join(df.select(*agent, F.col("pos").alias("outer")), [*agent, "outer"]).where("outer < inner").select(*agent, F.col("inner").alias("pos"))
        left = open_.join(by_tail(acting, "first"), [*agent, "tail"], "left").where("first IS NULL OR first > pos").drop("first").join(by_lanes(acting), [*agent, "pos"], "left_anti")
        left = written(left)
        ready = left.join(by_tail(left, "first"), [*agent, "tail"]).where("first = pos").drop("first").join(by_lanes(left), [*agent, "pos"], "left_anti").select(*agent, "pos", "tail")
        acting = written(acting.unionByName(ready))
        open_ = left.join(acting.select(*agent, "pos"), [*agent, "pos"], "left_anti")
    gone = inside.join(acting.select(*agent, F.col("pos").alias("outer")), [*agent, "outer"]).select(*agent, F.col("inner").alias("pos"))
    stay = acting.select(*agent, "pos").join(gone, [*agent, "pos"], "left_anti")
    return sequences.join(stay, [*agent, "pos"], "left_semi")


def lane_bfs(starts: DataFrame, lanes: DataFrame, waypoint_budget: int, lane_budget: int) -> DataFrame:
    """sid, agent, pos, lane_id, first, last, reached: lanes found from an agent's start lanes, in order of discovery.

    starts has sid, agent, pos, lane_id, start; lanes has sid, lane_id, n (points), exits (array
    of ids) and neighbors (array of struct id, first, last; left ones before right ones).
    Lanes are expanded first come first served: for each exit its neighbours and then the exit
    itself join, once each, up to lane_budget lanes. reached counts points along the way; a
    lane that would pass waypoint_budget is cut there and not expanded; a start lane may hold
    one point more. Order decides, so a scenario's lanes and agents are one group.
    """

    def walk(lane: dict, begin: pd.DataFrame) -> list[tuple]:
        found, queue = {}, []

        def add(lane_id: int, first: int, size: int, before: int) -> None:
            """Takes in one lane of size points from first on, reached after `before` points."""
            if before + size > waypoint_budget:
                found[lane_id] = (first, first + waypoint_budget if not before else waypoint_budget - before, waypoint_budget)
            else:
                found[lane_id] = (first, first + size, before + size)
                queue.append(lane_id)

        for r in begin.itertuples():
            size = int(lane[r.lane_id].n - r.start)
            if size == waypoint_budget + 1:  # a start lane may pass the budget by its last point
                found[r.lane_id] = (int(r.start), int(r.start) + size, size)
            else:
                add(r.lane_id, int(r.start), size, 0)
        while queue and len(found) < lane_budget:
            parent = queue.pop(0)
            reached = found[parent][2]
            if reached >= waypoint_budget:
                continue
            for child in lane[parent].exits:
                if child not in lane:
                    continue
                nearby = [(b["id"], b["first"], b["last"] + 1 - b["first"]) for b in lane[child].neighbors]
                for lane_id, first, size in [*nearby, (child, 0, int(lane[child].n))]:
                    if lane_id in lane and lane_id not in found and len(found) < lane_budget:
                        add(lane_id, first, size, reached)
        return [(i, k, *v) for i, (k, v) in enumerate(found.items())]

    def run(begin: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        lane = {r.lane_id: r for r in known.itertuples()}
        begin = begin[begin["lane_id"].isin(lane)].sort_values("pos")
        rows = [(begin["sid"].iloc[0], agent, *r) for agent, own in begin.groupby("agent") for r in walk(lane, own)]
        return pd.DataFrame(rows, columns=["sid", "agent", "pos", "lane_id", "first", "last", "reached"])

    kinds = {f.name: f.dataType.simpleString() for f in starts.schema.fields}
    starts = starts.select(*[F.col(c).alias(c) for c in starts.columns])  # names of its own, as both may come from one table
    return starts.groupBy("sid").cogroup(lanes.groupBy("sid")).applyInPandas(run, f"sid {kinds['sid']}, agent {kinds['agent']}, pos int, lane_id long, first int, last int, reached int")
