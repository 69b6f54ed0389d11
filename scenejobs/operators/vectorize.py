"""Raster images back to lanes and agents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenejobs.functions.geometry import wrap_angle
from scenejobs.operators.nearest import within_reach

#: The eight neighbours of a pixel, in turn around it.
AROUND = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def agent_speed(boxes: DataFrame, pixels: DataFrame, modes: DataFrame) -> DataFrame:
    """image_id, agent_idx, speed from the mean colour of the 5 x 5 window around a box.

    boxes has image_id, agent_idx, row, col; modes has image_id, mode_r, mode_g.
    """
    window = boxes.select("image_id", "agent_idx", F.explode(F.sequence(F.col("row") - 2, F.col("row") + 2)).alias("row"), "col")
    window = window.select("image_id", "agent_idx", "row", F.explode(F.sequence(F.col("col") - 2, F.col("col") + 2)).alias("col"))
    means = window.join(pixels, ["image_id", "row", "col"]).groupBy("image_id", "agent_idx").agg(*[F.avg(c).alias(c) for c in "rgb"])
    moving = (F.abs(1 - F.col("r") - F.col("mode_r")) > 0.05) | (F.abs(F.col("g") - F.col("mode_g")) > 0.05)
    return means.join(modes, "image_id").select("image_id", "agent_idx", F.when(moving, F.abs(F.col("b") - 0.5) * 60).otherwise(0.0).alias("speed"))


def snap_to_lane(agents: DataFrame, lane_points: DataFrame, max_dist: float = 3.0) -> DataFrame:
    """image_id, agent_idx, yaw, speed, vx, vy from the nearest lane point.

    lane_points has image_id, lane_id, pt_idx, x, y, dx, dy. Speed is held to [2, 10] near a lane, else 0.
    """
    asked = agents.select("image_id", "agent_idx", F.col("x").alias("ax"), F.col("y").alias("ay"), "speed")

    def nearest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("image_id", "agent_idx", "speed").agg(F.min(F.struct("d", "lane_id", "pt_idx", "dx", "dy")).alias("p")).withColumn("reach", F.col("p.d"))

    near = within_reach(asked, lane_points.select("image_id", "lane_id", "pt_idx", "x", "y", "dx", "dy"), ("image_id", "agent_idx"), "image_id", nearest)
    speed = F.when(F.col("p.d") < max_dist, F.least(F.greatest("speed", F.lit(2.0)), F.lit(10.0))).otherwise(0.0)
    found = near.select("image_id", "agent_idx", F.atan2("p.dy", "p.dx").alias("yaw"), speed.alias("speed"))
    return found.withColumns({"vx": F.col("speed") * F.cos("yaw"), "vy": F.col("speed") * F.sin("yaw")})


def pixels_to_world(df: DataFrame, map_range: float, res: int) -> DataFrame:
    """Pixel places to metres around the centre, y upward; yaw, vy, curvature k and arc length s change along."""
    scale = map_range / res
    changes = {
        "x": F.col("x") * scale - map_range / 2, "y": map_range / 2 - F.col("y") * scale, "yaw": -F.col("yaw") if "yaw" in df.columns else None,
        "vy": -F.col("vy") if "vy" in df.columns else None, "k": F.col("k") / scale if "k" in df.columns else None, "s": F.col("s") * scale if "s" in df.columns else None,
    }
    return df.withColumns({c: v for c, v in changes.items() if c in df.columns})


def skeleton_nodes(skeleton: DataFrame) -> DataFrame:
    """image_id, row, col, crossings of pixels whose crossing number is 1 or at least 3.

    The crossing number counts the steps from background to skeleton around a pixel.
    """
    spots = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for i, (dr, dc) in enumerate(AROUND)]))
    wanted = skeleton.select("image_id", "row", "col", spots.alias("o")).select("image_id", F.col("row").alias("r0"), F.col("col").alias("c0"), "o.i", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
    found = wanted.join(skeleton, ["image_id", "row", "col"], "left_semi").groupBy("image_id", "r0", "c0").agg(F.collect_set("i").alias("on"))
    on = lambda i: F.array_contains("on", i)
    crossings = sum(((~on(i) & on((i + 1) % 8)).cast("int") for i in range(1, 8)), (~on(0) & on(1)).cast("int"))
    nodes = found.select("image_id", F.col("r0").alias("row"), F.col("c0").alias("col"), crossings.alias("crossings"))
    return nodes.where("crossings = 1 OR crossings >= 3")


def edge_flow(path_points: DataFrame, pixels: DataFrame, ends: int = 20) -> DataFrame:
    """image_id, edge_id, keep: whether an edge's path runs along the colours under it.

    path_points has image_id, edge_id, pt_idx, row, col. Colours are directions; their unit
    vectors (128 subtracted, y downward) are summed and compared with the yaw from the first
    to the last of the path's final points; under 90 degrees the path keeps its direction.
    """
    size = W.partitionBy("image_id", "edge_id")
    p = path_points.withColumn("n", F.count(F.lit(1)).over(size)).join(pixels, ["image_id", "row", "col"])
    u, v = F.col("r") * 255 - 128, 128 - F.col("g") * 255
    norm = F.greatest(F.hypot(u, v), F.lit(1e-6))
    late = F.col("pt_idx") >= F.greatest(F.col("n") - ends, F.lit(0))
    at = F.when(late, F.col("pt_idx"))
    sums = p.groupBy("image_id", "edge_id").agg(F.sum(u / norm).alias("u"), F.sum(v / norm).alias("v"), *[f(c, at).alias(f"{c}{k}") for c in ("row", "col") for k, f in ((0, F.min_by), (1, F.max_by))])
    return sums.select("image_id", "edge_id", (F.col("u") * (F.col("col1") - F.col("col0")) + F.col("v") * (F.col("row1") - F.col("row0")) > 0).alias("keep"))


def close_gaps(terminals: DataFrame, threshold: float = 8.0) -> DataFrame:
    """image_id, a, b: terminals of different edges that are each other's nearest within threshold.

    terminals has image_id, terminal, edge_id, x, y. Grid cells of the threshold's size keep the
    search local; pairing is mutual, so the order of rows doesn't matter.
    """
    gx, gy = F.floor(F.col("x") / threshold), F.floor(F.col("y") / threshold)
    a = terminals.select("image_id", F.col("terminal").alias("a"), F.col("edge_id").alias("ea"), F.col("x").alias("ax"), F.col("y").alias("ay"), gx.alias("gx"), gy.alias("gy"))
    b = terminals.select("image_id", F.col("terminal").alias("b"), F.col("edge_id").alias("eb"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.sequence(gx - 1, gx + 1)).alias("gx"), gy.alias("gy0"))
    b = b.select("*", F.explode(F.sequence(F.col("gy0") - 1, F.col("gy0") + 1)).alias("gy")).drop("gy0")
    pairs = a.join(b, ["image_id", "gx", "gy"]).withColumn("d", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).where((F.col("ea") != F.col("eb")) & (F.col("d") <= threshold))
    best = pairs.groupBy("image_id", "a").agg(F.min(F.struct("d", "b")).alias("m")).select("image_id", "a", F.col("m.b").alias("b"))
    back = best.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))
    return best.join(back, ["image_id", "a", "b"]).where("a < b")


def downsample_path(points: DataFrame, ratio: int) -> DataFrame:
    """Every ratio-th point of a path (image_id, edge_id, pt_idx); adds k, the new position.

    The last point is added if n modulo ratio exceeds half the ratio, else it takes the last kept
    one's place. Paths of ratio points or fewer give their second and last point.
    """
    n = F.count(F.lit(1)).over(W.partitionBy("image_id", "edge_id"))
    rows = points.withColumn("n", n)
    last_kept = F.floor((F.col("n") - 1) / ratio) * ratio
    appended = F.col("n") % ratio > ratio / 2
    long = F.when(F.col("pt_idx") == F.col("n") - 1, True).when(F.col("pt_idx") == last_kept, appended).otherwise(F.col("pt_idx") % ratio == 0)
    short = (F.col("pt_idx") == 1) | (F.col("pt_idx") == F.col("n") - 1)
    kept = rows.where(F.when(F.col("n") > ratio, long).otherwise(short)).drop("n")
    return kept.withColumn("k", F.row_number().over(W.partitionBy("image_id", "edge_id").orderBy("pt_idx")) - 1)


def is_smooth(points: DataFrame, threshold: float = 500.0) -> DataFrame:
    """image_id, edge_id, smooth: whether no change of yaw per metre exceeds threshold degrees, repeated yaws left out.

    points has image_id, edge_id, pt_idx, yaw, s.
    """
    first = points.groupBy("image_id", "edge_id", "yaw").agg(F.min("pt_idx").alias("pt_idx"), F.min_by("s", "pt_idx").alias("s"))
    w = W.partitionBy("image_id", "edge_id").orderBy("pt_idx")
    rate = F.abs(F.degrees(F.lead("yaw").over(w) - F.col("yaw")) / (F.lead("s").over(w) - F.col("s")))
    return first.withColumn("rate", rate).groupBy("image_id", "edge_id").agg((F.coalesce(F.max("rate"), F.lit(0.0)) <= threshold).alias("smooth"))


def lanes_output(polylines: DataFrame) -> DataFrame:
    """x, y, 0 and the unit direction of each point's yaw, with the keys of the input."""
    keys = [c for c in polylines.columns if c not in ("x", "y", "yaw", "k", "s")]
    return polylines.select(*keys, "x", "y", F.lit(0.0).alias("z"), F.cos("yaw").alias("dx"), F.sin("yaw").alias("dy"), F.lit(0.0).alias("dz"))


def pair_edges_at_node(ends: DataFrame) -> DataFrame:
    """image_id, node, end, partner, bend, voted, votes: edge ends that go on in each other, both ways round.

    ends has image_id, node, end, yaw (pointing away from the node). Each end votes for the end
    whose yaw is closest to opposite, the smaller one on ties; one vote matches the two. voted
    marks the ends that vote for their partner, votes counts those that an end has got.
    """
    a, b = (ends.select("image_id", "node", F.col("end").alias(n), F.col("yaw").alias(f"yaw_{n}")) for n in "ab")
    pairs = a.join(b, ["image_id", "node"]).where("a != b").withColumn("bend", F.abs(wrap_angle(F.col("yaw_a") - F.col("yaw_b") - math.pi)))
    votes = pairs.groupBy("image_id", "node", "a").agg(F.min(F.struct(F.round("bend", 9).alias("bend"), "b")).alias("m")).select("image_id", "node", "a", F.col("m.b").alias("b"), F.col("m.bend").alias("bend"), F.lit(True).alias("voted"))
    back = votes.select("image_id", "node", F.col("b").alias("a"), F.col("a").alias("b"), "bend", F.lit(False).alias("voted"))
    both = votes.unionByName(back).groupBy("image_id", "node", F.col("a").alias("end"), F.col("b").alias("partner"), "bend").agg(F.max("voted").alias("voted"))
    got = votes.groupBy("image_id", "node", F.col("b").alias("end")).agg(F.count(F.lit(1)).alias("votes"))
    return both.join(got, ["image_id", "node", "end"], "left").withColumn("votes", F.coalesce("votes", F.lit(0)))


def directed(edges: DataFrame, flow: DataFrame) -> DataFrame:
    """Edges (image_id, edge_id, n1, n2, path) turned to run with the colours under them; those that already do, or have none, stay.

    flow has image_id, edge_id, keep, see edge_flow().
    """
    rows = edges.join(flow.select("image_id", "edge_id", "keep"), ["image_id", "edge_id"], "left").withColumn("keep", F.coalesce("keep", F.lit(True)))
    turned = lambda a, b: F.when(F.col("keep"), a).otherwise(b)
    return rows.select("image_id", "edge_id", turned(F.col("n1"), F.col("n2")).alias("n1"), turned(F.col("n2"), F.col("n1")).alias("n2"), turned(F.col("path"), F.reverse("path")).alias("path"))


def inlets_and_outlets(edges: DataFrame) -> DataFrame:
    """image_id, node, edge_id, kind: nodes with one edge end, an inlet where the directed edge starts and an outlet where it ends."""
    ends = F.explode(F.array(*[F.struct(F.col(n).alias("node"), F.lit(kind).alias("kind")) for n, kind in (("n1", "inlet"), ("n2", "outlet"))]))
    rows = edges.select("image_id", "edge_id", ends.alias("e")).select("image_id", "edge_id", "e.*")
    return rows.groupBy("image_id", "node").agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("edge_id"), F.min("kind").alias("kind")).where("n = 1").select("image_id", "node", "edge_id", "kind")


def cut_lanes(edges: DataFrame, offset: int = 5, min_len: int = 25) -> DataFrame:
    """image_id, edge_id, path, start_type, start, end_type, end: lanes with their junction ends cut back by offset points.

    edges has image_id, edge_id, start_terminal, end_terminal, path (points with x and y), in the
    direction of travel. A terminal edge is cut at its junction; an inner one of min_len
    points or more at both ends, if points are left. A lane leaves a junction at a node of
    type exit and enters the next at one of type entry, at the cut points rounded to 0.1;
    terminals are of type map_entry and map_exit; what is not cut has neither.
    """
    n = F.size("path")
    enough = n > 2 * offset + 1
    inner = enough & (n >= min_len) & ~F.col("start_terminal") & ~F.col("end_terminal")
    front, rear = inner | (enough & F.col("end_terminal") & ~F.col("start_terminal")), inner | (enough & F.col("start_terminal") & ~F.col("end_terminal"))
    skip, drop = F.when(front, offset).otherwise(0), F.when(rear, offset).otherwise(0)
    rows = edges.select("*", F.slice("path", skip + 1, n - skip - drop).alias("cut"), front.alias("front"), rear.alias("rear"))
    spot = lambda i: F.struct(*[F.round(F.element_at("cut", i)[c], 1).alias(c) for c in "xy"])
    start_type = F.when(F.col("start_terminal"), "map_entry").when(F.col("front"), "exit")
    end_type = F.when(F.col("end_terminal"), "map_exit").when(F.col("rear"), "entry")
    return rows.select("image_id", "edge_id", F.col("cut").alias("path"), start_type.alias("start_type"), F.when(start_type.isNotNull(), spot(1)).alias("start"), end_type.alias("end_type"), F.when(end_type.isNotNull(), spot(-1)).alias("end"))


def connect_intersections(entries: DataFrame, exits: DataFrame, routes: DataFrame, near: float = 3.0, least_inliers: float = 0.5, points: int = 33) -> DataFrame:
    """image_id, entry, exit, kind, curve: the connections over junctions, from where a lane ends to where one begins.

    entries and exits have image_id, node, x, y, yaw; routes has image_id, source, target, nodes and
    waypoints (x, y) of the shortest path between them. A route over another entry or exit is
    none. Of the others, those with at most one inner node are direct; those whose direction
    and final bend are within 10 degrees are straight; a turn changes the yaw by up to 135
    degrees, its final bend lies in [-5, 95] degrees and within the factor two of the
    first, and at least least_inliers of the waypoints lie within near of the Bezier curve.
    """
    a = entries.select("image_id", F.col("node").alias("source"), *[F.col(c).alias(f"{c}1") for c in ("x", "y", "yaw")])
    b = exits.select("image_id", F.col("node").alias("target"), *[F.col(c).alias(f"{c}2") for c in ("x", "y", "yaw")])
    ends = entries.select("image_id", "node").unionByName(exits.select("image_id", "node")).distinct()
    key = ["image_id", "source", "target"]
    inner = routes.select(*key, F.explode(F.expr("slice(nodes, 2, greatest(size(nodes) - 2, 0))")).alias("node"))
    over = inner.join(ends, ["image_id", "node"], "left_semi").select(*key).distinct()
    return connections(routes.join(over, key, "left_anti").join(a, ["image_id", "source"]).join(b, ["image_id", "target"]), near, least_inliers, points)


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once a row: the optimizer copies no expression across a generator, as it does into filters and into lambdas."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def connections(rows: DataFrame, near: float = 3.0, least_inliers: float = 0.5, points: int = 33) -> DataFrame:
    """The second half of connect_intersections(): rows are routes with their ends' x1, y1, yaw1, x2, y2, yaw2."""
    first = wrap_angle(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")) - F.col("yaw1"))
    rows = _once(rows, {"first": first, "diff": wrap_angle(F.col("yaw2") - F.col("yaw1")), "d": F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / 3})
    final = wrap_angle(F.col("diff") - F.col("first"))
    rows = _once(rows, {"final": F.when(F.col("first") < 0, -final).otherwise(final)})
    small, ratio = math.radians(10), F.abs(F.col("first") / F.col("final"))
    turn = (F.abs("diff") <= math.radians(135)) & F.col("final").between(math.radians(-5), math.radians(95)) & (F.col("final") != 0) & (ratio > 0.5) & (ratio < 2)
    kind = F.when(F.size("nodes") - 2 <= 1, "direct").when((F.abs("first") <= small) & (F.abs("final") <= small), "straight").when(turn, "turn")
    rows = _once(rows, {"kind": kind}).where("kind IS NOT NULL")
    handles = {f"{c}{k}": (F.col(f"{c}1") + F.col("d") * turned("yaw1") if k == "a" else F.col(f"{c}2") - F.col("d") * turned("yaw2")) for c, turned in (("x", F.cos), ("y", F.sin)) for k in "ab"}
    rows = _once(rows, handles)

    def at(c: str, t: Column) -> Column:
        p0, p1, p2, p3, u = F.col(f"{c}1"), F.col(f"{c}a"), F.col(f"{c}b"), F.col(f"{c}2"), 1 - t
        return p0 * u * u * u + p1 * 3 * u * u * t + p2 * 3 * u * t * t + p3 * t * t * t

    curve = F.transform(F.array(*[F.lit(i / (points - 1)) for i in range(points)]), lambda t: F.struct(at("x", t).alias("x"), at("y", t).alias("y")))
    rows = _once(rows, {"curve": curve})
    inliers = F.size(F.filter("waypoints", lambda w: F.exists("curve", lambda p: F.hypot(p["x"] - w["x"], p["y"] - w["y"]) <= near)))
    kept = rows.where((F.col("kind") != "turn") | (inliers >= least_inliers * F.size("waypoints")))
    return kept.select("image_id", F.col("source").alias("entry"), F.col("target").alias("exit"), "kind", "curve")
