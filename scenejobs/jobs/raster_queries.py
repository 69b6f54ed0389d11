"""Queries of the raster and vectorise operators and their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scenejobs.functions.tables import shared_folder, written
from scenejobs.jobs.map_queries import DIRECTION_SQL, _r
from scenejobs.jobs.registry import query, rounded
from scenejobs.operators import maps, raster, splicing, vectorize
from scenejobs.sources import images, scenes, views
from scenejobs.sources.views import with_views

CELLS_SQL = DIRECTION_SQL + """,
drawn AS (SELECT sid, CAST(least(floor((40 - y) / 1.25), 63) AS INT) AS row, CAST(least(floor((x + 40) / 1.25), 63) AS INT) AS col, fid * 100 + pt_idx AS o, dir_x, dir_y FROM directed WHERE global_type = 2 AND abs(x) < 40 AND abs(y) < 40),
cells AS (SELECT sid, row, col, arg_max(dir_x, o) / 2 + 0.5 AS r, arg_max(dir_y, o) / 2 + 0.5 AS g, 0.0::DOUBLE AS b FROM drawn GROUP BY 1, 2, 3)"""
LINES_SQL = DIRECTION_SQL + """,
spot AS (SELECT sid, fid, pt_idx, (x + 40) / 1.25 AS u, (40 - y) / 1.25 AS v, dir_x, dir_y FROM directed WHERE global_type = 2),
line AS (SELECT sid, fid * 100 + pt_idx AS o, dir_x, dir_y, u AS u1, v AS v1, lead(u) OVER w AS u2, lead(v) OVER w AS v2 FROM spot WINDOW w AS (PARTITION BY sid, fid ORDER BY pt_idx)),
colm AS (SELECT *, unnest(range(greatest(CAST(floor(least(u1, u2)) AS INT), 0), least(CAST(floor(greatest(u1, u2)) AS INT), 63) + 1)) AS col FROM line WHERE u2 IS NOT NULL AND least(u1, u2) < 64 AND greatest(u1, u2) >= 0 AND least(v1, v2) < 64 AND greatest(v1, v2) >= 0),
ends AS (SELECT *, CASE WHEN u1 = u2 THEN v1 ELSE least(greatest(v1 + (v2 - v1) * (greatest(CAST(col AS DOUBLE), least(u1, u2)) - u1) / (u2 - u1), least(v1, v2)), greatest(v1, v2)) END AS a,
  CASE WHEN u1 = u2 THEN v2 ELSE least(greatest(v1 + (v2 - v1) * (least(CAST(col + 1 AS DOUBLE), greatest(u1, u2)) - u1) / (u2 - u1), least(v1, v2)), greatest(v1, v2)) END AS b FROM colm),
crossed AS (SELECT sid, o, dir_x, dir_y, CAST(col AS INT) AS col, CAST(unnest(range(greatest(CAST(floor(least(a, b)) AS INT), 0), least(CAST(floor(greatest(a, b)) AS INT), 63) + 1)) AS INT) AS row FROM ends WHERE least(a, b) < 64 AND greatest(a, b) >= 0),
cells AS MATERIALIZED (SELECT sid, row, col, arg_max(dir_x, o) / 2 + 0.5 AS r, arg_max(dir_y, o) / 2 + 0.5 AS g, 0.0::DOUBLE AS b FROM crossed GROUP BY 1, 2, 3)"""
PIXELS_SQL = LINES_SQL + """,
spots AS (SELECT sid, CAST(i // 64 AS INT) AS row, CAST(i % 64 AS INT) AS col FROM (SELECT sid, unnest(range(4096)) AS i FROM (SELECT DISTINCT sid FROM cells))),
pixels AS (SELECT s.sid AS image_id, s.row, s.col, coalesce(r, 0.5) AS r, coalesce(g, 0.5) AS g, coalesce(b, 0) AS b FROM spots s LEFT JOIN cells c ON c.sid = s.sid AND c.row = s.row AND c.col = s.col)"""
# Colours and how many cells have them: each coloured cell, and per image the grey rest.
COUNTED_SQL = """tones AS (SELECT sid AS image_id, r, g, b, 1 AS n FROM cells UNION ALL SELECT sid, 0.5, 0.5, 0.0, 4096 - count(*) FROM cells GROUP BY 1),
bins AS (SELECT image_id, channel, CAST(least(floor(v * 256), 255) AS INT) AS bin, CAST(sum(n) AS BIGINT) AS n FROM (SELECT image_id, n, unnest(['r', 'g', 'b']) AS channel, unnest([r, g, b]) AS v FROM tones) GROUP BY 1, 2, 3),
modes AS MATERIALIZED (SELECT image_id, channel, bin / 256.0::DOUBLE AS mode FROM (SELECT *, row_number() OVER (PARTITION BY image_id, channel ORDER BY n DESC, bin) AS rn FROM bins) WHERE rn = 1)"""
MODES_SQL = PIXELS_SQL + ",\n" + COUNTED_SQL
HALF, RES = 40.0, 64


def _directed(spark, sf_dir):
    return maps.polyline_direction(views.lane_points(spark, sf_dir))


def _pixels(spark, sf_dir):
    """All pixels of the images of lanes drawn as lines."""
    return written(raster.filled(raster.rasterize_lines(_directed(spark, sf_dir), HALF, RES), RES))


def _agents(spark, sf_dir, t=10):
    return views.tracks(spark, sf_dir).where(f"t = {t} AND valid")


@query("r1_rasterize_points", with_views(["lane_points"], f"WITH {CELLS_SQL} SELECT sid, row, col, {_r('r', 'g', 'b')} FROM cells"))
def r1(spark, sf_dir):
    return rounded(raster.rasterize_points(_directed(spark, sf_dir), HALF, RES))


@query("r1_rasterize_lines", with_views(["lane_points"], f"WITH {LINES_SQL} SELECT sid, row, col, {_r('r', 'g', 'b')} FROM cells"))
def r1_lines(spark, sf_dir):
    return rounded(raster.rasterize_lines(_directed(spark, sf_dir), HALF, RES))


BOX_SQL = """boxes AS (SELECT * REPLACE (length * 4 AS length, width * 4 AS width) FROM tracks WHERE t = 10 AND valid AND object_type = 1),
seg AS (SELECT sid, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM lane_points WINDOW w AS (PARTITION BY sid, fid ORDER BY pt_idx)),
f AS (SELECT o.sid, o.track_index, length / 2 AS hl, width / 2 AS hw, (x1 - x) * cos(heading) + (y1 - y) * sin(heading) AS ax, (y1 - y) * cos(heading) - (x1 - x) * sin(heading) AS ay,
  (x2 - x) * cos(heading) + (y2 - y) * sin(heading) AS cx, (y2 - y) * cos(heading) - (x2 - x) * sin(heading) AS cy FROM boxes o JOIN seg s ON s.sid = o.sid WHERE x2 IS NOT NULL),
c AS (SELECT sid, track_index, CASE WHEN abs(cx - ax) < 1e-12 THEN CASE WHEN abs(ax) > hl THEN 2 ELSE 0 END ELSE least((-hl - ax) / (cx - ax), (hl - ax) / (cx - ax)) END AS lx,
  CASE WHEN abs(cx - ax) < 1e-12 THEN CASE WHEN abs(ax) > hl THEN -1 ELSE 1 END ELSE greatest((-hl - ax) / (cx - ax), (hl - ax) / (cx - ax)) END AS hx,
  CASE WHEN abs(cy - ay) < 1e-12 THEN CASE WHEN abs(ay) > hw THEN 2 ELSE 0 END ELSE least((-hw - ay) / (cy - ay), (hw - ay) / (cy - ay)) END AS ly,
  CASE WHEN abs(cy - ay) < 1e-12 THEN CASE WHEN abs(ay) > hw THEN -1 ELSE 1 END ELSE greatest((-hw - ay) / (cy - ay), (hw - ay) / (cy - ay)) END AS hy FROM f)"""


@query("r2_agents_on_lanes", with_views(["lane_points", "tracks"], f"WITH {BOX_SQL} SELECT DISTINCT sid, track_index FROM c WHERE greatest(lx, ly, 0) <= least(hx, hy, 1)"))
def r2(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("sid", "fid").orderBy("pt_idx")
    points = views.lane_points(spark, sf_dir)
    segments = points.select("sid", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 IS NOT NULL")
    boxes = _agents(spark, sf_dir).where("object_type = 1").withColumns({c: F.col(c) * 4 for c in ("length", "width")})
    return raster.agents_on_lanes(boxes, segments).select("sid", "track_index")


@query("r3_rasterize_boxes", with_views(["tracks"], """WITH d AS (SELECT *, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS displacement FROM tracks WINDOW w AS (PARTITION BY sid, track_index ORDER BY t)),
a AS (SELECT * FROM d WHERE t = 10 AND valid AND displacement IS NOT NULL),
g AS (SELECT CAST(i // 64 AS INT) AS row, CAST(i % 64 AS INT) AS col FROM (SELECT unnest(range(4096)) AS i)),
h AS (SELECT sid, row, col, track_index, displacement FROM a, g WHERE abs(((col + 0.5) * 1.25 - 40 - x) * cos(heading) + (40 - (row + 0.5) * 1.25 - y) * sin(heading)) <= length / 2
  AND abs((40 - (row + 0.5) * 1.25 - y) * cos(heading) - ((col + 0.5) * 1.25 - 40 - x) * sin(heading)) <= width / 2)
SELECT sid, row, col, round(arg_max(displacement, track_index) / 60 + 0.5, 4) AS value FROM h GROUP BY 1, 2, 3"""))
def r3(spark, sf_dir):
    moving = raster.step_displacement(views.tracks(spark, sf_dir)).where("t = 10 AND valid AND displacement IS NOT NULL")
    return rounded(raster.rasterize_boxes(moving, HALF, RES))


@query("r4_training_pixels", with_views(["lane_points"], f"""WITH {PIXELS_SQL}, o AS (SELECT image_id, CAST(floor(row / 2.0) AS INT) AS row, CAST(floor(col / 2.0) AS INT) AS col, (avg(r) - 0.5) / 0.5 AS r, (avg(g) - 0.5) / 0.5 AS g, (avg(b) - 0.5) / 0.5 AS b FROM pixels GROUP BY ALL)
SELECT image_id, row, col, {_r('r', 'g', 'b')} FROM (SELECT image_id, row, col, r, g, b FROM o)""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3")))
def r4(spark, sf_dir):
    return rounded(raster.training_pixels(_pixels(spark, sf_dir)))


@query("r5_channel_mode", with_views(["lane_points"], f"WITH {MODES_SQL} SELECT * FROM modes"))
def r5(spark, sf_dir):
    return raster.channel_mode(_pixels(spark, sf_dir))


FOREGROUND_SQL = f"""{LINES_SQL}, {COUNTED_SQL},
wide AS (SELECT image_id, max(mode) FILTER (channel = 'r') AS mr, max(mode) FILTER (channel = 'g') AS mg FROM modes GROUP BY 1),
rest AS (SELECT image_id, CAST(i // 64 AS INT) AS row, CAST(i % 64 AS INT) AS col FROM (SELECT image_id, unnest(range(4096)) AS i FROM wide WHERE abs(0.5 - mr) > 0.1 OR abs(0.5 - mg) > 0.1)),
fore AS MATERIALIZED (SELECT image_id, row, col, r, g, b FROM cells JOIN wide ON image_id = sid WHERE abs(r - mr) > 0.1 OR abs(g - mg) > 0.1
  UNION ALL SELECT image_id, row, col, 0.5, 0.5, 0.0 FROM rest WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.sid = image_id AND c.row = rest.row AND c.col = rest.col))"""


@query("r6_foreground", with_views(["lane_points"], f"WITH {FOREGROUND_SQL} SELECT image_id, row, col, {_r('r', 'g', 'b')} FROM fore"))
def r6(spark, sf_dir):
    return rounded(raster.foreground(_pixels(spark, sf_dir)))


@query("s3_read_pixels", with_views(["lane_points"], f"WITH {PIXELS_SQL} SELECT image_id, row, col, " + ", ".join(f"round(floor({c} * 255 + 0.5) / 255, 4) AS {c}" for c in "rgb") + " FROM pixels"))
def s3(spark, sf_dir):
    path = f"{shared_folder(spark)}/images-{uuid.uuid4().hex}"
    images.write_pixels(_pixels(spark, sf_dir), path)
    return rounded(scenes.read_pixels(spark, path))


@query("v2_agent_speed", with_views(["lane_points", "tracks"], f"""WITH {MODES_SQL},
wide AS (SELECT image_id, max(mode) FILTER (channel = 'r') AS mr, max(mode) FILTER (channel = 'g') AS mg FROM modes GROUP BY 1),
boxes AS (SELECT sid AS image_id, track_index AS agent_idx, floor((40 - y) / 1.25) AS row, floor((x + 40) / 1.25) AS col FROM tracks WHERE t = 10 AND valid AND abs(x) < 40 AND abs(y) < 40),
m AS (SELECT b.image_id, agent_idx, avg(r) AS r, avg(g) AS g, avg(p.b) AS b FROM boxes b JOIN pixels p ON p.image_id = b.image_id AND abs(p.row - b.row) <= 2 AND abs(p.col - b.col) <= 2 GROUP BY 1, 2)
SELECT image_id, agent_idx, round(CASE WHEN abs(1 - r - mr) > 0.05 OR abs(g - mg) > 0.05 THEN abs(b - 0.5) * 60 ELSE 0 END, 4) + 0.0::DOUBLE AS speed FROM m JOIN wide USING (image_id)"""))
def v2(spark, sf_dir):
    pixels = _pixels(spark, sf_dir)
    modes = raster.channel_mode(pixels).groupBy("image_id").agg(*[F.max(F.when(F.col("channel") == c, F.col("mode"))).alias(f"mode_{c}") for c in "rg"])
    boxes = _agents(spark, sf_dir).where("abs(x) < 40 AND abs(y) < 40").select(F.col("sid").alias("image_id"), F.col("track_index").alias("agent_idx"), F.floor((40 - F.col("y")) / 1.25).cast("int").alias("row"), F.floor((F.col("x") + 40) / 1.25).cast("int").alias("col"))
    return rounded(vectorize.agent_speed(boxes, pixels, modes))


@query("v3_snap_to_lane", with_views(["lane_points", "tracks"], f"""WITH {DIRECTION_SQL},
a AS (SELECT sid AS image_id, track_index AS agent_idx, x AS ax, y AS ay, sqrt(vx * vx + vy * vy) AS speed FROM tracks WHERE t = 10 AND valid),
n AS (SELECT image_id, agent_idx, speed, sqrt((x - ax) ** 2 + (y - ay) ** 2) AS d, dir_x, dir_y, row_number() OVER (PARTITION BY image_id, agent_idx ORDER BY sqrt((x - ax) ** 2 + (y - ay) ** 2), fid, pt_idx) AS rn FROM a JOIN directed l ON l.sid = a.image_id),
o AS (SELECT image_id, agent_idx, atan2(dir_y, dir_x) AS yaw, CASE WHEN d < 3 THEN least(greatest(speed, 2), 10) ELSE 0 END AS speed FROM n WHERE rn = 1),
p AS (SELECT *, speed * cos(yaw) AS vx, speed * sin(yaw) AS vy FROM o)
SELECT image_id, agent_idx, {_r('yaw', 'speed', 'vx', 'vy')} FROM p"""))
def v3(spark, sf_dir):
    agents = _agents(spark, sf_dir).select(F.col("sid").alias("image_id"), F.col("track_index").alias("agent_idx"), "x", "y", F.hypot("vx", "vy").alias("speed"))
    lanes = _directed(spark, sf_dir).select(F.col("sid").alias("image_id"), F.col("fid").alias("lane_id"), "pt_idx", "x", "y", F.col("dir_x").alias("dx"), F.col("dir_y").alias("dy"))
    return rounded(vectorize.snap_to_lane(agents, lanes))


@query("v4_pixels_to_world", with_views(["tracks"], "SELECT sid, track_index, t, round(x * (70.0::DOUBLE / 300) - 35, 4) + 0.0::DOUBLE AS x, round(35 - y * (70.0::DOUBLE / 300), 4) + 0.0::DOUBLE AS y, round(-vy, 4) + 0.0::DOUBLE AS vy FROM tracks"))
def v4(spark, sf_dir):
    return rounded(vectorize.pixels_to_world(views.tracks(spark, sf_dir).select("sid", "track_index", "t", "x", "y", "vy"), 70.0, 300))


NODES_SQL = """o AS (SELECT unnest(range(8)) AS i, unnest([-1, -1, 0, 1, 1, 1, 0, -1]) AS dr, unnest([0, 1, 1, 1, 0, -1, -1, -1]) AS dc),
n AS (SELECT f.image_id, f.row, f.col, i, EXISTS (SELECT 1 FROM fore q WHERE q.image_id = f.image_id AND q.row = f.row + dr AND q.col = f.col + dc) AS lit FROM fore f, o),
c AS (SELECT image_id, row, col, sum(CASE WHEN NOT a.lit AND b.lit THEN 1 ELSE 0 END) AS crossings FROM n a JOIN n b USING (image_id, row, col) WHERE b.i = (a.i + 1) % 8 GROUP BY 1, 2, 3),
nodes AS (SELECT image_id, row, col, CAST(crossings AS INT) AS crossings FROM c WHERE crossings = 1 OR crossings >= 3)"""


@query("v5_skeleton_nodes", with_views(["lane_points"], f"WITH {FOREGROUND_SQL}, {NODES_SQL} SELECT * FROM nodes"))
def v5(spark, sf_dir):
    return vectorize.skeleton_nodes(raster.foreground(_pixels(spark, sf_dir)).select("image_id", "row", "col"))


FLOW_SQL = f"""{PIXELS_SQL},
pp AS (SELECT sid AS image_id, fid AS edge_id, pt_idx, CAST(floor((40 - y) / 1.25) AS INT) AS row, CAST(floor((x + 40) / 1.25) AS INT) AS col FROM lane_points WHERE abs(x) < 40 AND abs(y) < 40),
n AS (SELECT *, count(*) OVER (PARTITION BY image_id, edge_id) AS n FROM pp),
j AS (SELECT n.*, r * 255 - 128 AS u, 128 - g * 255 AS v FROM n JOIN pixels p ON p.image_id = n.image_id AND p.row = n.row AND p.col = n.col),
s AS (SELECT image_id, edge_id, sum(u / greatest(sqrt(u * u + v * v), 1e-6)) AS u, sum(v / greatest(sqrt(u * u + v * v), 1e-6)) AS v,
  arg_min(row, pt_idx) FILTER (pt_idx >= greatest(n - 20, 0)) AS r0, arg_max(row, pt_idx) FILTER (pt_idx >= greatest(n - 20, 0)) AS r1, arg_min(col, pt_idx) FILTER (pt_idx >= greatest(n - 20, 0)) AS c0, arg_max(col, pt_idx) FILTER (pt_idx >= greatest(n - 20, 0)) AS c1 FROM j GROUP BY 1, 2),
flow AS (SELECT image_id, edge_id, u * (c1 - c0) + v * (r1 - r0) > 0 AS keep FROM s)"""
DIRECTED_SQL = FLOW_SQL + """,
e AS (SELECT sid AS image_id, fid AS edge_id, CAST(floor(arg_min(x, pt_idx) / 5) * 1000 + floor(arg_min(y, pt_idx) / 5) AS BIGINT) AS a, CAST(floor(arg_max(x, pt_idx) / 5) * 1000 + floor(arg_max(y, pt_idx) / 5) AS BIGINT) AS b,
  string_agg(CAST(pt_idx AS VARCHAR), ',' ORDER BY pt_idx) AS there, string_agg(CAST(pt_idx AS VARCHAR), ',' ORDER BY pt_idx DESC) AS back FROM lane_points GROUP BY 1, 2),
directed_edges AS (SELECT e.image_id, e.edge_id, CASE WHEN coalesce(keep, TRUE) THEN a ELSE b END AS n1, CASE WHEN coalesce(keep, TRUE) THEN b ELSE a END AS n2, CASE WHEN coalesce(keep, TRUE) THEN there ELSE back END AS path
  FROM e LEFT JOIN flow f ON f.image_id = e.image_id AND f.edge_id = e.edge_id)"""
TERMINAL_SQL = DIRECTED_SQL + """,
node_ends AS (SELECT image_id, edge_id, n1 AS node, 'inlet' AS kind FROM directed_edges UNION ALL SELECT image_id, edge_id, n2, 'outlet' FROM directed_edges)"""


@query("v8_edge_flow", with_views(["lane_points"], f"WITH {FLOW_SQL} SELECT image_id, edge_id, coalesce(keep, FALSE) AS keep FROM flow"))
def v8(spark, sf_dir):
    return _flow(spark, sf_dir).withColumn("keep", F.coalesce("keep", F.lit(False)))


def _flow(spark, sf_dir):
    points = views.lane_points(spark, sf_dir).where("abs(x) < 40 AND abs(y) < 40")
    path = points.select(F.col("sid").alias("image_id"), F.col("fid").alias("edge_id"), "pt_idx", F.floor((40 - F.col("y")) / 1.25).cast("int").alias("row"), F.floor((F.col("x") + 40) / 1.25).cast("int").alias("col"))
    return vectorize.edge_flow(path, _pixels(spark, sf_dir))


def _edges_by_flow(spark, sf_dir):
    points = views.lane_points(spark, sf_dir)
    edges = points.groupBy(F.col("sid").alias("image_id"), F.col("fid").alias("edge_id")).agg(F.sort_array(F.collect_list(F.struct("pt_idx", "x", "y"))).alias("path"))
    spot = lambda i: F.expr(f"floor(element_at(path, {i}).x / 5) * 1000 + floor(element_at(path, {i}).y / 5)")
    return vectorize.directed(edges.select("image_id", "edge_id", spot(1).alias("n1"), spot(-1).alias("n2"), "path"), _flow(spark, sf_dir))


@query("v8_directed_edges", with_views(["lane_points"], f"WITH {DIRECTED_SQL} SELECT * FROM directed_edges"))
def v8_directed(spark, sf_dir):
    rows = _edges_by_flow(spark, sf_dir)
    return rows.select("image_id", "edge_id", F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), F.array_join(F.transform("path", lambda p: p["pt_idx"].cast("string")), ",").alias("path"))


@query("v8_inlets_and_outlets", with_views(["lane_points"], f"WITH {TERMINAL_SQL} SELECT image_id, node, min(edge_id) AS edge_id, min(kind) AS kind FROM node_ends GROUP BY 1, 2 HAVING count(*) = 1"))
def v8_inlets(spark, sf_dir):
    found = vectorize.inlets_and_outlets(_edges_by_flow(spark, sf_dir))
    return found.withColumn("node", F.col("node").cast("long"))


TERMINALS_SQL = "ends AS (SELECT sid AS image_id, fid * 2 + CASE WHEN pt_idx = 0 THEN 0 ELSE 1 END AS terminal, fid AS edge_id, x, y FROM lane_points WHERE pt_idx IN (0, 31))"


PAIRS_SQL = TERMINALS_SQL + """,
p AS (SELECT a.image_id, a.terminal AS a, b.terminal AS b, row_number() OVER (PARTITION BY a.image_id, a.terminal ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.terminal) AS rn FROM ends a JOIN ends b ON a.image_id = b.image_id AND a.edge_id <> b.edge_id
  WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 8),
gaps AS (SELECT x.image_id, x.a, x.b FROM p x JOIN p y ON x.image_id = y.image_id AND x.a = y.b AND x.b = y.a WHERE x.rn = 1 AND y.rn = 1 AND x.a < x.b)"""


@query("v9_close_gaps", with_views(["lane_points"], f"WITH {PAIRS_SQL} SELECT * FROM gaps"))
def v9(spark, sf_dir):
    return vectorize.close_gaps(_terminals(spark, sf_dir))


def _terminals(spark, sf_dir):
    return views.lane_points(spark, sf_dir).where("pt_idx IN (0, 31)").selectExpr("sid AS image_id", "fid * 2 + CASE WHEN pt_idx = 0 THEN 0 ELSE 1 END AS terminal", "fid AS edge_id", "pt_idx = 31 AS at_end", "x", "y")


@query("v9_splice_gaps", with_views(["lane_points"], f"""WITH {PAIRS_SQL},
steps AS MATERIALIZED (SELECT image_id, a // 2 AS edge_id, a % 2 = 0 AS back, b // 2 AS next_edge, b % 2 = 1 AS next_back FROM (SELECT image_id, a, b FROM gaps UNION ALL SELECT image_id, b, a FROM gaps)),
walk AS (SELECT image_id, edge_id AS first_edge, back AS first_back, edge_id, back, [edge_id] AS es, [back] AS bs,
    NOT EXISTS (SELECT 1 FROM steps t WHERE t.image_id = s.image_id AND t.next_edge = s.edge_id AND t.next_back = s.back) AS begins FROM steps s
  UNION ALL SELECT w.image_id, first_edge, first_back, next_edge, next_back, list_append(es, next_edge), list_append(bs, next_back), begins FROM walk w JOIN steps s ON s.image_id = w.image_id AND s.edge_id = w.edge_id AND s.back = w.back
  WHERE NOT (next_edge = first_edge AND next_back = first_back)),
whole AS (SELECT w.image_id, es, bs FROM walk w LEFT JOIN steps s ON s.image_id = w.image_id AND s.edge_id = w.edge_id AND s.back = w.back
  WHERE es[1] < es[-1] AND CASE WHEN s.image_id IS NULL THEN begins ELSE s.next_edge = first_edge AND s.next_back = first_back AND NOT first_back AND first_edge = list_min(es) END
  UNION ALL SELECT DISTINCT sid, [fid], [FALSE] FROM lane_points WHERE NOT EXISTS (SELECT 1 FROM steps t WHERE t.image_id = sid AND t.edge_id = fid OR t.image_id = sid AND t.next_edge = fid)),
part AS (SELECT image_id, list_min(es) AS edge_id, array_to_string(list_transform(range(1, len(es) + 1), lambda i: es[i] || CASE WHEN bs[i] THEN '-' ELSE '+' END), ' ') AS edges, 32 * len(es) - 1 AS d, unnest(es) AS e, unnest(bs) AS back, unnest(range(len(es))) AS pos FROM whole)
SELECT image_id, edge_id, edges, CAST(d AS INT) AS d, CAST(pos * 32 + CASE WHEN back THEN 31 - pt_idx ELSE pt_idx END AS INT) AS k, {_r('x', 'y')} FROM part JOIN lane_points ON sid = image_id AND fid = e"""))
def v9_splice(spark, sf_dir):
    ends = written(_terminals(spark, sf_dir))
    edges = views.lane_points(spark, sf_dir).groupBy(F.col("sid").alias("image_id"), F.col("fid").alias("edge_id")).agg(F.sort_array(F.collect_list(F.struct("pt_idx", "x", "y"))).alias("path"))
    found = splicing.splice_gaps(edges, ends, written(vectorize.close_gaps(ends)))
    names = F.array_join(F.transform("edges", lambda e: F.concat(e["edge_id"].cast("string"), F.when(e["back"], "-").otherwise("+"))), " ")
    return rounded(found.select("image_id", "edge_id", names.alias("edges"), "d", F.posexplode("path").alias("k", "p")).select("image_id", "edge_id", "edges", "d", "k", "p.x", "p.y"))


ENDS_SQL = """e AS (SELECT graph_id AS image_id, n1 AS node, n2 AS "end", (n2 * 37 % 63) / 10.0::DOUBLE - 3.1 AS yaw FROM graph_edges)"""


@query("v10_pair_edges_at_node", with_views(["graph_edges"], f"""WITH {ENDS_SQL},
p AS (SELECT a.image_id, a.node, a."end", b."end" AS partner, round(abs((a.yaw - b.yaw) - 2 * pi() * floor((a.yaw - b.yaw) / (2 * pi())) - pi()), 9) AS bend
  FROM e a JOIN e b ON a.image_id = b.image_id AND a.node = b.node AND a."end" <> b."end"),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, node, "end" ORDER BY bend, partner) AS rn FROM p) WHERE rn = 1),
d AS (SELECT image_id, node, "end", partner, bend, TRUE AS voted FROM v UNION ALL SELECT image_id, node, partner, "end", bend, FALSE FROM v),
b AS (SELECT image_id, node, "end", partner, bend, bool_or(voted) AS voted FROM d GROUP BY 1, 2, 3, 4, 5),
g AS (SELECT image_id, node, partner AS "end", count(*) AS votes FROM v GROUP BY 1, 2, 3)
SELECT b.image_id, b.node, b."end", partner, round(bend, 4) AS bend, voted, coalesce(votes, 0) AS votes FROM b LEFT JOIN g ON g.image_id = b.image_id AND g.node = b.node AND g."end" = b."end\""""))
def v10(spark, sf_dir):
    return rounded(vectorize.pair_edges_at_node(views.graph_edges(spark, sf_dir).selectExpr("graph_id AS image_id", "n1 AS node", "n2 AS end", "(n2 * 37 % 63) / 10.0D - 3.1D AS yaw")))


@query("v11_cut_lanes", with_views(["lane_points"], """WITH l AS (SELECT sid AS image_id, fid AS edge_id, fid % 3 = 0 AS st, fid % 5 = 0 AS et, max(pt_idx) + 1 AS n FROM lane_points GROUP BY 1, 2),
k AS (SELECT l.*, pt_idx, x, y FROM lane_points p JOIN l ON l.image_id = p.sid AND l.edge_id = p.fid
  WHERE CASE WHEN st AND et THEN TRUE WHEN st THEN pt_idx < n - 5 WHEN et THEN pt_idx >= 5 ELSE pt_idx >= 5 AND pt_idx < n - 5 END),
c AS (SELECT *, min(pt_idx) OVER w AS a, max(pt_idx) OVER w AS b FROM k WINDOW w AS (PARTITION BY image_id, edge_id))
SELECT image_id, edge_id, pt_idx, round(x, 4) + 0.0::DOUBLE AS x, CASE WHEN pt_idx = a THEN CASE WHEN st THEN 'map_entry' ELSE 'exit' END WHEN pt_idx = b THEN CASE WHEN et THEN 'map_exit' ELSE 'entry' END ELSE '' END AS node_type,
  CASE WHEN pt_idx IN (a, b) THEN round(x, 1) ELSE 0 END + 0.0::DOUBLE AS node_x, CASE WHEN pt_idx IN (a, b) THEN round(y, 1) ELSE 0 END + 0.0::DOUBLE AS node_y FROM c"""))
def v11(spark, sf_dir):
    edges = views.lane_points(spark, sf_dir).groupBy(F.col("sid").alias("image_id"), F.col("fid").alias("edge_id")).agg(F.sort_array(F.collect_list(F.struct("pt_idx", "x", "y"))).alias("path"))
    cut = vectorize.cut_lanes(edges.withColumns({"start_terminal": F.expr("edge_id % 3 = 0"), "end_terminal": F.expr("edge_id % 5 = 0")}))
    rows = cut.withColumn("n", F.size("path")).select("*", F.posexplode("path").alias("i", "p"))
    at = lambda c: F.when(F.col("i") == 0, F.col(f"start{c}")).when(F.col("i") == F.col("n") - 1, F.col(f"end{c}"))
    return rounded(rows.select("image_id", "edge_id", "p.pt_idx", "p.x", F.coalesce(at("_type"), F.lit("")).alias("node_type"), F.coalesce(at(".x"), F.lit(0.0)).alias("node_x"), F.coalesce(at(".y"), F.lit(0.0)).alias("node_y")))


# Every lane whole, and again, as edge -1 - fid, up to a point of its own, which gives paths of 4 to 32 points.
@query("v14_downsample_path", with_views(["lane_points"], """WITH b AS (SELECT sid AS image_id, fid AS edge_id, pt_idx, x FROM lane_points UNION ALL SELECT sid, -1 - fid, pt_idx, x FROM lane_points WHERE pt_idx < 4 + fid % 29),
p AS (SELECT *, max(pt_idx) OVER (PARTITION BY image_id, edge_id) + 1 AS n FROM b),
k AS (SELECT *, CASE WHEN n <= 6 THEN pt_idx IN (1, n - 1) WHEN pt_idx = n - 1 THEN TRUE WHEN pt_idx = (n - 1) // 6 * 6 THEN n % 6 > 3 ELSE pt_idx % 6 = 0 END AS keep FROM p)
SELECT image_id, edge_id, pt_idx, CAST(row_number() OVER (PARTITION BY image_id, edge_id ORDER BY pt_idx) - 1 AS INT) AS k, round(x, 4) + 0.0::DOUBLE AS x FROM k WHERE keep"""))
def v14(spark, sf_dir):
    points = views.lane_points(spark, sf_dir)
    paths = points.selectExpr("sid AS image_id", "fid AS edge_id", "pt_idx", "x").unionAll(points.where("pt_idx < 4 + fid % 29").selectExpr("sid", "-1 - fid", "pt_idx", "x"))
    return rounded(vectorize.downsample_path(paths, 6).select("image_id", "edge_id", "pt_idx", F.col("k").cast("int").alias("k"), "x"))


@query("v15_is_smooth", with_views(["lane_points"], """WITH h AS (SELECT sid, fid, pt_idx, round(atan2(lead(y) OVER w - y, lead(x) OVER w - x), 2) AS yaw, CAST(pt_idx AS DOUBLE) / 4 AS s FROM lane_points WINDOW w AS (PARTITION BY sid, fid ORDER BY pt_idx)),
f AS (SELECT sid, fid, yaw, min(pt_idx) AS pt_idx, arg_min(s, pt_idx) AS s FROM h WHERE yaw IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT sid, fid, abs(degrees(lead(yaw) OVER w - yaw) / (lead(s) OVER w - s)) AS rate FROM f WINDOW w AS (PARTITION BY sid, fid ORDER BY pt_idx))
SELECT sid AS image_id, fid AS edge_id, coalesce(max(rate), 0) <= 500 AS smooth FROM r GROUP BY 1, 2"""))
def v15(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("sid", "fid").orderBy("pt_idx")
    yaw = F.round(F.atan2(F.lead("y").over(w) - F.col("y"), F.lead("x").over(w) - F.col("x")), 2)
    points = views.lane_points(spark, sf_dir).select(F.col("sid").alias("image_id"), F.col("fid").alias("edge_id"), "pt_idx", yaw.alias("yaw"), (F.col("pt_idx") / 4.0).alias("s"))
    return vectorize.is_smooth(points.where("yaw IS NOT NULL"))


@query("v16_lanes_output", with_views(["lane_points"], f"""WITH h AS (SELECT sid, fid, pt_idx, x, y, coalesce(atan2(lead(y) OVER w - y, lead(x) OVER w - x), 0) AS yaw FROM lane_points WINDOW w AS (PARTITION BY sid, fid ORDER BY pt_idx)),
o AS (SELECT sid, fid, pt_idx, x, y, 0.0::DOUBLE AS z, cos(yaw) AS dx, sin(yaw) AS dy, 0.0::DOUBLE AS dz FROM h) SELECT sid, fid, pt_idx, {_r('x', 'y', 'z', 'dx', 'dy', 'dz')} FROM o"""))
def v16(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("sid", "fid").orderBy("pt_idx")
    yaw = F.coalesce(F.atan2(F.lead("y").over(w) - F.col("y"), F.lead("x").over(w) - F.col("x")), F.lit(0.0))
    return rounded(vectorize.lanes_output(views.lane_points(spark, sf_dir).select("sid", "fid", "pt_idx", "x", "y", yaw.alias("yaw"))))
