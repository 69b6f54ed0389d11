"""Queries of the track operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenejobs.jobs.map_queries import CENTERS_SQL, EGO_SQL, _r
from scenejobs.jobs.registry import query, rounded
from scenejobs.operators import agents
from scenejobs.sources import views
from scenejobs.sources.views import with_views

SAMPLES_SQL = CENTERS_SQL + """,
samples AS (SELECT r.sid, c.center_index, c.track_index AS center_track, r.track_index, r.object_type, r.t, r.length, r.width, r.height, r.valid,
  (r.x - c.x) * cos(c.heading) + (r.y - c.y) * sin(c.heading) AS x, (r.y - c.y) * cos(c.heading) - (r.x - c.x) * sin(c.heading) AS y, r.z - c.z AS z,
  r.vx * cos(c.heading) + r.vy * sin(c.heading) AS vx, r.vy * cos(c.heading) - r.vx * sin(c.heading) AS vy, r.heading - c.heading AS heading FROM tracks r JOIN centers c ON c.sid = r.sid)"""
BASE = ["tracks", "scenarios"]


def _tracks(spark, sf_dir):
    return views.tracks(spark, sf_dir)


def _centers(spark, sf_dir):
    return agents.center_objects(_tracks(spark, sf_dir), views.scenarios(spark, sf_dir))


def _samples(spark, sf_dir):
    return agents.to_center_frame(_tracks(spark, sf_dir), _centers(spark, sf_dir))


@query("t2_split_history", with_views(["tracks"], "SELECT track_index, count(*) FILTER (t <= 10) AS past, count(*) FILTER (t > 10) AS future FROM tracks GROUP BY 1"))
def t2(spark, sf_dir):
    past, future = agents.split_history(_tracks(spark, sf_dir))
    both = past.select("track_index", F.lit(1).alias("p"), F.lit(0).alias("f")).unionAll(future.select("track_index", F.lit(0), F.lit(1)))
    return both.groupBy("track_index").agg(F.sum("p").alias("past"), F.sum("f").alias("future"))


@query("t3_agent_state", with_views(["tracks"], f"""WITH s AS (SELECT sid, track_index, x, y, heading AS yaw, sqrt(vx * vx + vy * vy) AS speed,
  x + 0.5 * length * cos(heading) - 0.5 * width * sin(heading) AS front_left_x, y + 0.5 * length * sin(heading) + 0.5 * width * cos(heading) AS front_left_y,
  x - 0.5 * length * cos(heading) + 0.5 * width * sin(heading) AS back_right_x, y - 0.5 * length * sin(heading) - 0.5 * width * cos(heading) AS back_right_y FROM tracks WHERE t = 10 AND valid)
SELECT sid, track_index, {_r('x', 'y', 'yaw', 'speed', 'front_left_x', 'front_left_y', 'back_right_x', 'back_right_y')} FROM s"""))
def t3(spark, sf_dir):
    corner = lambda i, n: [F.col("corners")[i][c].alias(f"{n}_{c}") for c in "xy"]
    return rounded(agents.agent_state(_tracks(spark, sf_dir), 10).select("sid", "track_index", "x", "y", "yaw", "speed", *corner(0, "front_left"), *corner(2, "back_right")))


@query("t4_impute_backward", with_views(["tracks"], f"""WITH n AS (SELECT *, min(CASE WHEN x <> 0 THEN t END) OVER (PARTITION BY sid, track_index ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS src FROM gaps),
o AS (SELECT n.sid, n.track_index, n.t, CASE WHEN n.x = 0 AND s.t IS NOT NULL THEN s.x - 0.1 * (s.t - n.t) * s.vx ELSE n.x END AS x, CASE WHEN n.x = 0 AND s.t IS NOT NULL THEN s.y - 0.1 * (s.t - n.t) * s.vy ELSE n.y END AS y,
  CASE WHEN n.x = 0 AND s.t IS NOT NULL THEN s.heading ELSE n.heading END AS heading FROM n LEFT JOIN gaps s ON s.sid = n.sid AND s.track_index = n.track_index AND s.t = n.src)
SELECT sid, track_index, t, {_r('x', 'y', 'heading')} FROM o""".replace("WITH n AS", "WITH gaps AS (SELECT * REPLACE (CASE WHEN t % 7 IN (3, 4) THEN 0 ELSE x END AS x) FROM tracks),\nn AS")))
def t4(spark, sf_dir):
    gaps = _tracks(spark, sf_dir).withColumn("x", F.expr("CASE WHEN t % 7 IN (3, 4) THEN 0.0D ELSE x END"))
    return rounded(agents.impute_backward(gaps).select("sid", "track_index", "t", "x", "y", "heading"))


@query("t5_center_objects", with_views(BASE, f"WITH {CENTERS_SQL} SELECT sid, center_index, track_index, {_r('x', 'y', 'z', 'heading', 'vx', 'vy')} FROM centers"))
def t5(spark, sf_dir):
    return rounded(_centers(spark, sf_dir))


@query("t6_to_center_frame", with_views(BASE, f"WITH {SAMPLES_SQL} SELECT sid, center_index, center_track, track_index, t, {_r('x', 'y', 'z', 'heading', 'vx', 'vy')} FROM samples"))
def t6(spark, sf_dir):
    return rounded(_samples(spark, sf_dir).select("sid", "center_index", "center_track", "track_index", "t", "x", "y", "z", "heading", "vx", "vy"))


_V = "CASE WHEN valid THEN {} ELSE 0 END"


@query("t7_agent_features", with_views(BASE, f"""WITH {SAMPLES_SQL},
p AS (SELECT s.*, sdc_track_index, (vx - lag(vx) OVER w) / 0.1 AS rx, (vy - lag(vy) OVER w) / 0.1 AS ry FROM samples s JOIN scenarios USING (sid) WHERE t <= 10 WINDOW w AS (PARTITION BY sid, center_index, track_index ORDER BY t)),
a AS (SELECT *, coalesce(rx, lead(rx) OVER w, 0) AS ax, coalesce(ry, lead(ry) OVER w, 0) AS ay FROM p WINDOW w AS (PARTITION BY sid, center_index, track_index ORDER BY t)),
f AS (SELECT sid, center_index, track_index, t, {', '.join(f"{_V.format(e)} AS {n}" for n, e in (('f0', 'x'), ('f3', 'length'), ('f7', 'CAST(object_type = 2 AS DOUBLE)'), ('f9', 'CAST(track_index = center_track AS DOUBLE)'), ('f10', 'CAST(track_index = sdc_track_index AS DOUBLE)'), ('f13', 'CAST(t = 2 AS DOUBLE)'), ('f22', 'CAST(t AS DOUBLE)'), ('f23', 'sin(heading)'), ('f26', 'vy'), ('f27', 'ax'), ('f28', 'ay')))} FROM a)
SELECT sid, center_index, track_index, t, {_r('f0', 'f3', 'f7', 'f9', 'f10', 'f13', 'f22', 'f23', 'f26', 'f27', 'f28')} FROM f"""))
def t7(spark, sf_dir):
    rows = agents.agent_features(_samples(spark, sf_dir), views.scenarios(spark, sf_dir))
    return rounded(rows.select("sid", "center_index", "track_index", "t", *[F.col("features")[i].alias(f"f{i}") for i in (0, 3, 7, 9, 10, 13, 22, 23, 26, 27, 28)]))


@query("t8_future_labels", with_views(BASE, f"""WITH {SAMPLES_SQL}, o AS (SELECT sid, center_index, t, {', '.join(f"{_V.format(c)} AS {c}" for c in ('x', 'y', 'vx', 'vy'))} FROM samples WHERE t > 10 AND track_index = center_track)
SELECT sid, center_index, t, {_r('x', 'y', 'vx', 'vy')} FROM o"""))
def t8(spark, sf_dir):
    return rounded(agents.future_labels(_samples(spark, sf_dir)))


@query("t9_select_interesting", with_views(BASE, f"""WITH {CENTERS_SQL},
lists AS (SELECT sid, center_index, CASE WHEN center_index = 0 THEN [track_index] ELSE [track_index, track_index + 100000, -5] END AS l FROM centers),
slots AS (SELECT *, unnest(range((SELECT max(len(l)) FROM lists))) AS slot FROM lists)
SELECT s.sid, s.center_index, CAST(s.slot AS INT) AS slot, CASE WHEN EXISTS (SELECT 1 FROM tracks r WHERE r.sid = s.sid AND r.track_index = s.l[s.slot + 1]) THEN s.l[s.slot + 1] ELSE -1 END AS track_index FROM slots s"""))
def t9(spark, sf_dir):
    lists = _centers(spark, sf_dir).selectExpr("sid", "center_index", "CASE WHEN center_index = 0 THEN array(track_index) ELSE array(track_index, track_index + 100000, -5L) END AS track_list")
    return agents.select_interesting(_samples(spark, sf_dir), lists).withColumn("track_index", F.coalesce("track_index", F.lit(-1)))


@query("t10_last_valid", with_views(BASE, f"""WITH {SAMPLES_SQL},
o AS (SELECT sid, center_index, track_index, coalesce(arg_max(x, t) FILTER (t <= 10 AND valid), 0) AS last_x, coalesce(arg_max(y, t) FILTER (t <= 10 AND valid), 0) AS last_y,
  CAST(coalesce(max(t - 11) FILTER (t > 10 AND valid), 0) AS INT) AS last_future FROM samples GROUP BY 1, 2, 3)
SELECT sid, center_index, track_index, {_r('last_x', 'last_y')}, last_future FROM o"""))
def t10(spark, sf_dir):
    return rounded(agents.last_valid(_samples(spark, sf_dir)))


@query("t11_predictions_to_world", with_views(BASE, f"WITH {CENTERS_SQL} SELECT c.sid, center_index, r.t, {', '.join(f'round(r.{c}, 4) + 0.0::DOUBLE AS {c}' for c in 'xy')} FROM centers c JOIN tracks r ON r.sid = c.sid AND r.track_index = c.track_index WHERE r.t > 10"))
def t11(spark, sf_dir):
    own = _samples(spark, sf_dir).where("t > 10 AND track_index = center_track").select("sid", "center_index", "t", "x", "y")
    return rounded(agents.predictions_to_world(own, _centers(spark, sf_dir)).select("sid", "center_index", "t", "x", "y"))


@query("t12_normalize_to", with_views(BASE, f"""WITH {EGO_SQL},
o AS (SELECT sid, track_index, t, CASE WHEN x = 0 THEN 0 ELSE (x - ego_x) * cos(ego_heading) + (y - ego_y) * sin(ego_heading) END AS x,
  CASE WHEN y = 0 THEN 0 ELSE (y - ego_y) * cos(ego_heading) - (x - ego_x) * sin(ego_heading) END AS y,
  CASE WHEN heading = 0 THEN 0 ELSE (heading - ego_heading + pi()) - 2 * pi() * floor((heading - ego_heading + pi()) / (2 * pi())) - pi() END AS heading,
  CASE WHEN vx = 0 THEN 0 ELSE vx * cos(ego_heading) + vy * sin(ego_heading) END AS vx FROM tracks JOIN ego USING (sid))
SELECT sid, track_index, t, {_r('x', 'y', 'heading', 'vx')} FROM o"""))
def t12(spark, sf_dir):
    from scenejobs.operators.polylines import ego_pose

    rows = _tracks(spark, sf_dir).join(ego_pose(_tracks(spark, sf_dir), views.scenarios(spark, sf_dir)), "sid")
    return rounded(agents.normalize_to(rows, F.col("ego_x"), F.col("ego_y"), F.col("ego_heading")).select("sid", "track_index", "t", "x", "y", "heading", "vx"))


def _box_frame(px: str, py: str) -> tuple[str, str]:
    return f"(({px} - o.x) * cos(o.heading) + ({py} - o.y) * sin(o.heading))", f"(({py} - o.y) * cos(o.heading) - ({px} - o.x) * sin(o.heading))"


def _visible_sql() -> str:
    (ax, ay), (bx, by) = _box_frame("p.ex", "p.ey"), _box_frame("p.ax", "p.ay")
    low = lambda a, b, h: f"CASE WHEN abs({b} - {a}) < 1e-12 THEN CASE WHEN abs({a}) > {h} THEN 2.0 ELSE 0.0 END ELSE least((-{h} - {a}) / ({b} - {a}), ({h} - {a}) / ({b} - {a})) END"
    high = lambda a, b, h: f"CASE WHEN abs({b} - {a}) < 1e-12 THEN CASE WHEN abs({a}) > {h} THEN -1.0 ELSE 1.0 END ELSE greatest((-{h} - {a}) / ({b} - {a}), ({h} - {a}) / ({b} - {a})) END"
    return f"""WITH s AS (SELECT r.*, r.track_index = sdc_track_index AS is_ego FROM tracks r JOIN scenarios USING (sid) WHERE valid),
p AS (SELECT e.sid, e.t, e.track_index AS ego, a.track_index AS target, e.x AS ex, e.y AS ey, a.x AS ax, a.y AS ay FROM s e JOIN s a ON a.sid = e.sid AND a.t = e.t
  WHERE e.is_ego AND e.track_index <> a.track_index AND sqrt((a.x - e.x) ** 2 + (a.y - e.y) ** 2) <= 60),
h AS (SELECT DISTINCT p.sid, p.t, ego, target FROM p JOIN s o ON o.sid = p.sid AND o.t = p.t WHERE o.x <> p.ex AND o.y <> p.ey AND o.x <> p.ax AND o.y <> p.ay
  AND greatest({low(ax, bx, '(o.length / 2)')}, {low(ay, by, '(o.width / 2)')}, 0) <= least({high(ax, bx, '(o.length / 2)')}, {high(ay, by, '(o.width / 2)')}, 1))
SELECT sid, t, ego, target FROM p ANTI JOIN h USING (sid, t, ego, target)"""


@query("t13_visible_agents", with_views(BASE, _visible_sql()))
def t13(spark, sf_dir):
    rows = _tracks(spark, sf_dir).where("valid").join(views.scenarios(spark, sf_dir).select("sid", "sdc_track_index"), "sid")
    return agents.visible_agents(rows.withColumn("is_ego", F.expr("track_index = sdc_track_index")), 60.0)
