"""Queries of the lane topology operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenejobs.jobs.map_queries import HEADING_SQL
from scenejobs.jobs.registry import query, rounded
from scenejobs.operators import lanes, maps
from scenejobs.sources import views
from scenejobs.sources.views import with_views

BASE = ["lane_points", "tracks"]
AGENTS_SQL = "agents AS (SELECT sid, track_index, object_type = 2 AS is_pedestrian, x AS ax, y AS ay, heading FROM tracks WHERE t = 10 AND valid)"


def _agents(spark, sf_dir):
    return views.tracks(spark, sf_dir).where("t = 10 AND valid").withColumn("is_pedestrian", F.expr("object_type = 2"))


@query("l1_reference_lanes", with_views(BASE, f"""WITH {AGENTS_SQL},
d AS (SELECT a.sid, track_index, is_pedestrian, fid, min(sqrt((x - ax) ** 2 + (y - ay) ** 2)) AS d, arg_min(pt_idx, sqrt((x - ax) ** 2 + (y - ay) ** 2)) AS i FROM agents a JOIN lane_points l ON l.sid = a.sid GROUP BY 1, 2, 3, 4),
v AS (SELECT *, greatest(0, floor((d - CASE WHEN is_pedestrian THEN 10 ELSE 5 END) / CASE WHEN is_pedestrian THEN 5 ELSE 3.5 END) + 1) AS level FROM d),
f AS (SELECT *, min(level) OVER (PARTITION BY sid, track_index) AS first FROM v)
SELECT sid, track_index, fid, CAST(CASE WHEN is_pedestrian THEN 0 ELSE greatest(0, i - 10) END AS INT) AS start FROM f WHERE level = first"""))
def l1(spark, sf_dir):
    return lanes.reference_lanes(_agents(spark, sf_dir), views.lane_points(spark, sf_dir))


@query("l2_neighbor_lanes", with_views([*BASE, "lane_topology"], f"""WITH {AGENTS_SQL},
near AS (SELECT a.sid, track_index, ax, ay, fid, pt_idx AS idx, row_number() OVER (PARTITION BY a.sid, track_index ORDER BY sqrt((x - ax) ** 2 + (y - ay) ** 2), fid, pt_idx) AS rn FROM agents a JOIN lane_points l ON l.sid = a.sid),
found AS (SELECT n.sid, track_index, ax, ay, b.fid FROM near n JOIN lane_rank a ON a.sid = n.sid AND a.fid = n.fid JOIN lane_rank b ON b.sid = a.sid AND b.rank = a.rank + 1 WHERE rn = 1 AND idx BETWEEN 0 AND 25),
p AS (SELECT f.sid, track_index, f.fid, pt_idx, row_number() OVER (PARTITION BY f.sid, track_index ORDER BY sqrt((x - ax) ** 2 + (y - ay) ** 2), pt_idx) AS rn FROM found f JOIN lane_points l ON l.sid = f.sid AND l.fid = f.fid)
SELECT sid, track_index, 'left' AS side, fid, pt_idx AS start FROM p WHERE rn = 1"""))
def l2(spark, sf_dir):
    points, agents = views.lane_points(spark, sf_dir), _agents(spark, sf_dir)
    current = lanes.nearest_point(agents, points).withColumnRenamed("pt_idx", "idx").join(agents.select("sid", "track_index", "x", "y"), ["sid", "track_index"])
    rank = views.lanes(spark, sf_dir).withColumnRenamed("beside", "neighbor_id").where("neighbor_id IS NOT NULL")
    neighbors = rank.selectExpr("sid", "fid", "'left' AS side", "0 AS pos", "neighbor_id", "0 AS self_start", "25 AS self_end")
    return lanes.neighbor_lanes(current, neighbors, points)


@query("l3_nearest_point", with_views(BASE, f"""WITH {AGENTS_SQL},
n AS (SELECT a.sid, track_index, fid, pt_idx, sqrt((x - ax) ** 2 + (y - ay) ** 2) AS dist, row_number() OVER (PARTITION BY a.sid, track_index ORDER BY sqrt((x - ax) ** 2 + (y - ay) ** 2), fid, pt_idx) AS rn FROM agents a JOIN lane_points l ON l.sid = a.sid)
SELECT sid, track_index, fid, pt_idx, round(dist, 4) AS dist FROM n WHERE rn = 1"""))
def l3(spark, sf_dir):
    return rounded(lanes.nearest_point(_agents(spark, sf_dir), views.lane_points(spark, sf_dir)))


@query("l4_map_match", with_views(BASE, f"""WITH {AGENTS_SQL}, {HEADING_SQL},
n AS (SELECT a.sid, track_index, fid, pt_idx, row_number() OVER (PARTITION BY a.sid, track_index ORDER BY sqrt((x - ax) ** 2 + (y - ay) ** 2), fid, pt_idx) AS rn FROM agents a JOIN headed l ON l.sid = a.sid
  WHERE abs((heading - raw + pi()) - 2 * pi() * floor((heading - raw + pi()) / (2 * pi())) - pi()) <= radians(10.0))
SELECT a.sid, a.track_index, coalesce(CASE WHEN n.fid > 0 THEN n.fid END, -1) AS fid, coalesce(CASE WHEN n.fid > 0 THEN n.pt_idx END, -1) AS pt_idx FROM agents a LEFT JOIN n ON n.sid = a.sid AND n.track_index = a.track_index AND rn = 1"""))
def l4(spark, sf_dir):
    found = lanes.map_match(_agents(spark, sf_dir), maps.polyline_heading(views.lane_points(spark, sf_dir)))
    return found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("fid", "pt_idx")})


@query("l5_lane_sequences", with_views(["lane_topology"], """WITH chains AS (SELECT sid, [fid] AS path, 0 AS points FROM lane_rank
  UNION ALL SELECT c.sid, list_append(c.path, t.exit_fid), c.points + 32 FROM chains c JOIN lane_topology t ON t.sid = c.sid AND t.fid = c.path[len(c.path)] WHERE c.points <= 300 AND NOT list_contains(c.path, t.exit_fid))
SELECT sid, array_to_string(path, ',') AS path FROM chains c WHERE points > 300 OR NOT EXISTS (SELECT 1 FROM lane_topology t WHERE t.sid = c.sid AND t.fid = c.path[len(c.path)])"""))
def l5(spark, sf_dir):
    known = views.lanes(spark, sf_dir)
    found = lanes.lane_sequences(views.lane_topology(spark, sf_dir), known, known.selectExpr("sid", "fid", "32L AS n"))
    return found.select("sid", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


SIGNALS_SQL = """signals AS (SELECT sid, round(x * 2) / 2 AS sx, round(y * 2) / 2 AS sy, t % 9 AS state FROM tracks),
walks AS (SELECT sid, fid, pt_idx, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM lane_points WHERE global_type = 3 WINDOW w AS (PARTITION BY sid, fid ORDER BY pt_idx))"""


@query("l9_annotate_path", with_views(BASE, f"""WITH {SIGNALS_SQL},
p AS (SELECT sid, fid, pt_idx, x, y FROM lane_points),
st AS (SELECT DISTINCT p.sid, p.fid, p.pt_idx FROM p JOIN signals s ON s.sid = p.sid WHERE state IN (1, 4, 7) AND sqrt((x - sx) ** 2 + (y - sy) ** 2) < 0.2),
wk AS (SELECT DISTINCT sid, fid, pt_idx FROM (SELECT p.sid, p.fid, p.pt_idx, w.fid AS g FROM p JOIN walks w ON w.sid = p.sid WHERE y1 <> y2 AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1))
SELECT p.sid, p.fid, p.pt_idx, round(CASE WHEN st.sid IS NOT NULL THEN 0 WHEN wk.sid IS NOT NULL THEN 1 ELSE (25 + 5 * (p.fid % 5)) / 2.237::DOUBLE END, 4) AS annotation
FROM p LEFT JOIN st ON st.sid = p.sid AND st.fid = p.fid AND st.pt_idx = p.pt_idx LEFT JOIN wk ON wk.sid = p.sid AND wk.fid = p.fid AND wk.pt_idx = p.pt_idx"""))
def l9(spark, sf_dir):
    points = views.lane_points(spark, sf_dir)
    signals = views.tracks(spark, sf_dir).selectExpr("sid", "round(x * 2) / 2 AS x", "round(y * 2) / 2 AS y", "t % 9 AS state")
    walks = points.where("global_type = 3").withColumnRenamed("fid", "polygon_id").select("sid", "polygon_id", "pt_idx", "x", "y")
    path = points.select("sid", "fid", "pt_idx", "x", "y")
    limits = path.select("sid", "fid").distinct().withColumn("speed_limit_mph", (25 + 5 * (F.col("fid") % 5)).cast("double"))
    return rounded(lanes.annotate_path(path, signals, walks, limits).select("sid", "fid", "pt_idx", "annotation"))


@query("l9_signal_and_speed", with_views(BASE, """WITH s AS (SELECT sid, track_index * 100 + t AS signal_id, round(x * 2) / 2 AS sx, round(y * 2) / 2 AS sy, t % 9 AS state FROM tracks),
m AS (SELECT p.sid, p.fid, p.pt_idx, arg_min(state, signal_id) AS signal FROM lane_points p JOIN s ON s.sid = p.sid WHERE sqrt((x - sx) ** 2 + (y - sy) ** 2) < 0.2 GROUP BY 1, 2, 3)
SELECT p.sid, p.fid, p.pt_idx, CAST(coalesce(signal, 0) AS INT) AS signal, round((25 + 5 * (p.fid % 5)) / 2.237::DOUBLE, 4) AS speed FROM lane_points p LEFT JOIN m ON m.sid = p.sid AND m.fid = p.fid AND m.pt_idx = p.pt_idx"""))
def l9_two(spark, sf_dir):
    path = views.lane_points(spark, sf_dir).select("sid", "fid", "pt_idx", "x", "y")
    signals = views.tracks(spark, sf_dir).selectExpr("sid", "track_index * 100 + t AS signal_id", "round(x * 2) / 2 AS x", "round(y * 2) / 2 AS y", "CAST(t % 9 AS INT) AS state")
    limits = path.select("sid", "fid").distinct().withColumn("speed_limit_mph", (25 + 5 * (F.col("fid") % 5)).cast("double"))
    return rounded(lanes.signal_and_speed(path, signals, limits).select("sid", "fid", "pt_idx", "signal", "speed"))
