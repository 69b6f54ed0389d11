"""Queries of the map and polyline operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenejobs.jobs.registry import query, rounded
from scenejobs.operators import maps, polylines
from scenejobs.sources import views
from scenejobs.sources.views import with_views

DIRECTION_SQL = """d AS (SELECT *, coalesce(x - lag(x) OVER w, 0) AS dx, coalesce(y - lag(y) OVER w, 0) AS dy FROM lane_points WINDOW w AS (PARTITION BY sid, fid ORDER BY pt_idx)),
directed AS (SELECT *, dx / greatest(least(sqrt(dx * dx + dy * dy), 1e9), 1e-6) AS dir_x, dy / greatest(least(sqrt(dx * dx + dy * dy), 1e9), 1e-6) AS dir_y FROM d)"""
EGO_SQL = "ego AS (SELECT sid, x AS ego_x, y AS ego_y, heading AS ego_heading FROM tracks JOIN scenarios USING (sid) WHERE t = 10 AND track_index = sdc_track_index)"
SEGMENT_SQL = DIRECTION_SQL + """,
g AS (SELECT *, CASE WHEN sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) > 1.0 THEN 1 ELSE 0 END AS gap FROM directed WINDOW w AS (PARTITION BY sid ORDER BY fid, pt_idx)),
s AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY sid ORDER BY fid, pt_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM g),
segments AS (SELECT sid, seg, CAST(row_number() OVER w - 1 AS INT) AS pos, fid, pt_idx, global_type, x, y,
  CASE WHEN row_number() OVER w = 1 THEN coalesce(lead(dir_x) OVER w, dir_x) ELSE dir_x END AS dir_x, CASE WHEN row_number() OVER w = 1 THEN coalesce(lead(dir_y) OVER w, dir_y) ELSE dir_y END AS dir_y
  FROM s WINDOW w AS (PARTITION BY sid, seg ORDER BY fid, pt_idx))"""


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 4) + 0.0::DOUBLE AS {n}" for n in names)


def _points(spark, sf_dir):
    return views.lane_points(spark, sf_dir)


def _ego(spark, sf_dir):
    return polylines.ego_pose(views.tracks(spark, sf_dir), views.scenarios(spark, sf_dir))


def _segments(spark, sf_dir):
    return polylines.segment_on_gap(maps.polyline_direction(_points(spark, sf_dir)))


@query("m2_polyline_direction", with_views(["lane_points"], f"WITH {DIRECTION_SQL} SELECT sid, fid, pt_idx, {_r('dir_x', 'dir_y')} FROM directed"))
def m2(spark, sf_dir):
    return rounded(maps.polyline_direction(_points(spark, sf_dir)).select("sid", "fid", "pt_idx", "dir_x", "dir_y"))


HEADING_SQL = """h AS (SELECT *, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS ahead FROM lane_points WINDOW w AS (PARTITION BY sid, fid ORDER BY pt_idx)),
headed AS (SELECT *, coalesce(ahead, lag(ahead) OVER (PARTITION BY sid, fid ORDER BY pt_idx), 0) AS raw FROM h)"""


@query("m3_polyline_heading", with_views(["lane_points"], f"""WITH {HEADING_SQL}
SELECT sid, fid, pt_idx, round((raw + pi()) - 2 * pi() * floor((raw + pi()) / (2 * pi())) - pi(), 4) + 0.0::DOUBLE AS theta FROM headed"""))
def m3(spark, sf_dir):
    return rounded(maps.polyline_heading(_points(spark, sf_dir)).select("sid", "fid", "pt_idx", "theta"))


@query("m4_all_polylines", with_views(["lane_points"], f"SELECT sid, fid, pt_idx, global_type, {', '.join(f'round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 4) + 0.0::DOUBLE AS {c}' for c in 'xyz')} FROM lane_points"))
def m4(spark, sf_dir):
    points = _points(spark, sf_dir)
    whole = maps.all_polylines(*[points.where(f"global_type = {k}") for k in (1, 2, 3)])
    return rounded(whole.select("sid", "fid", "pt_idx", "global_type", *[F.col(c).cast("double").alias(c) for c in "xyz"]))


@query("m5_densify_polygon", with_views(["lane_points"], f"""WITH e AS (SELECT sid, fid, pt_idx AS edge, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS tx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ty
  FROM lane_points WINDOW w AS (PARTITION BY sid, fid ORDER BY pt_idx)),
n AS (SELECT *, CAST(ceil(sqrt((tx - x) ** 2 + (ty - y) ** 2)) * 2 + 1 AS INT) AS n FROM e),
k AS (SELECT *, CAST(unnest(range(n)) AS INT) AS step FROM n),
p AS (SELECT sid, fid, edge, step, x + (tx - x) * step / n AS x, y + (ty - y) * step / n AS y FROM k)
SELECT sid, fid, edge, step, {_r('x', 'y')} FROM p"""))
def m5(spark, sf_dir):
    return rounded(maps.densify_polygon(_points(spark, sf_dir)))


@query("p1_ego_pose", with_views(["tracks", "scenarios"], f"WITH {EGO_SQL} SELECT sid, {_r('ego_x', 'ego_y', 'ego_heading')} FROM ego"))
def p1(spark, sf_dir):
    return rounded(_ego(spark, sf_dir))


@query("p2_within_radius", with_views(["lane_points", "tracks", "scenarios"], f"""WITH {EGO_SQL}
SELECT sid, fid, pt_idx, {_r('x', 'y')} FROM lane_points JOIN ego USING (sid) WHERE sqrt((x - ego_x) ** 2 + (y - ego_y) ** 2) <= 40 AND global_type IN (1, 2)"""))
def p2(spark, sf_dir):
    return rounded(polylines.within_radius(_points(spark, sf_dir), _ego(spark, sf_dir), 40.0, [1, 2]).select("sid", "fid", "pt_idx", "x", "y"))


@query("p3_to_ego", with_views(["lane_points", "tracks", "scenarios"], f"""WITH {EGO_SQL}, m AS (SELECT sid, fid, pt_idx, x - ego_x AS x, y - ego_y AS y FROM lane_points JOIN ego USING (sid))
SELECT sid, fid, pt_idx, {_r('x', 'y')} FROM m"""))
def p3(spark, sf_dir):
    return rounded(polylines.to_ego(_points(spark, sf_dir), _ego(spark, sf_dir)).select("sid", "fid", "pt_idx", "x", "y"))


@query("p4_segment_on_gap", with_views(["lane_points"], f"WITH {SEGMENT_SQL} SELECT sid, seg, pos, fid, pt_idx, global_type, {_r('x', 'y', 'dir_x', 'dir_y')} FROM segments"))
def p4(spark, sf_dir):
    return rounded(_segments(spark, sf_dir))


@query("p5_chunk_pad", with_views(["lane_points"], f"""WITH {SEGMENT_SQL},
c AS (SELECT DISTINCT sid, seg, CAST(floor(pos / 20.0) AS BIGINT) AS chunk FROM segments),
s20 AS (SELECT *, CAST(unnest(range(20)) AS INT) AS i FROM c)
SELECT s20.sid, s20.seg, s20.chunk, s20.i, round(coalesce(x, 0), 4) + 0.0::DOUBLE AS x, round(coalesce(dir_y, 0), 4) + 0.0::DOUBLE AS dir_y, x IS NOT NULL AS valid
FROM s20 LEFT JOIN segments g ON g.sid = s20.sid AND g.seg = s20.seg AND g.pos = s20.chunk * 20 + s20.i"""))
def p5(spark, sf_dir):
    rows = polylines.chunk_pad(_segments(spark, sf_dir), 20).select("sid", "seg", "chunk", F.posexplode(F.arrays_zip("points", "valid")).alias("i", "p"))
    return rounded(rows.select("sid", "seg", "chunk", "i", "p.points.x", "p.points.dir_y", "p.valid"))


@query("p6_normalize_direction", with_views(["lane_points"], f"""WITH {DIRECTION_SQL},
r AS (SELECT *, least(min(dir_x) OVER w, 0) AS lx, greatest(max(dir_x) OVER w, 0) AS hx, least(min(dir_y) OVER w, 0) AS ly, greatest(max(dir_y) OVER w, 0) AS hy FROM directed WINDOW w AS (PARTITION BY sid)),
o AS (SELECT sid, fid, pt_idx, CASE WHEN hx = lx THEN 0 ELSE (dir_x - lx) / (hx - lx) * 0.99 END AS dir_x, CASE WHEN hy = ly THEN 0 ELSE (dir_y - ly) / (hy - ly) * 0.99 END AS dir_y FROM r)
SELECT sid, fid, pt_idx, {_r('dir_x', 'dir_y')} FROM o"""))
def p6(spark, sf_dir):
    return rounded(polylines.normalize_direction(maps.polyline_direction(_points(spark, sf_dir))).select("sid", "fid", "pt_idx", "dir_x", "dir_y"))


@query("p7_select_types_in_view", with_views(["lane_points"], f"""WITH {SEGMENT_SQL},
m AS (SELECT *, first_value(global_type) OVER (PARTITION BY sid, seg ORDER BY pos) IN (2) AS wanted FROM segments),
f AS (SELECT sid, NOT bool_or(wanted) AS too_less FROM m GROUP BY 1),
k AS (SELECT * FROM m WHERE wanted AND abs(x) <= 40 AND abs(y) <= 40)
SELECT k.sid, k.seg, k.pos, round(k.x, 4) + 0.0::DOUBLE AS x, round(k.y, 4) + 0.0::DOUBLE AS y, too_less FROM f LEFT JOIN k USING (sid) WHERE too_less OR seg IS NOT NULL"""))
def p7(spark, sf_dir):
    return rounded(polylines.select_types_in_view(_segments(spark, sf_dir), [2], 40.0).select("sid", "seg", "pos", "x", "y", "too_less"))


def _gradient(c: str) -> str:
    return f"CASE WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END"


CURVE_WINDOW = "WINDOW w AS (PARTITION BY sid, fid ORDER BY pt_idx)"


@query("p9_cut_on_curvature", with_views(["lane_points"], f"""WITH {DIRECTION_SQL},
a AS (SELECT *, {_gradient('dir_x')} AS x1, {_gradient('dir_y')} AS y1 FROM directed {CURVE_WINDOW}),
b AS (SELECT *, {_gradient('x1')} AS x2, {_gradient('y1')} AS y2 FROM a {CURVE_WINDOW}),
c AS (SELECT *, CASE WHEN x1 * x1 + y1 * y1 = 0 THEN 0 ELSE abs(x2 * y1 - x1 * y2) / pow(x1 * x1 + y1 * y1, 1.5) END AS k FROM b),
e AS (SELECT *, {_gradient('k')} AS k1 FROM c {CURVE_WINDOW}),
f AS (SELECT *, {_gradient('k1')} AS k2 FROM e {CURVE_WINDOW})
SELECT sid, fid, pt_idx, CAST(sum(CASE WHEN k2 > 0.005 AND pt_idx > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sid, fid ORDER BY pt_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS piece FROM f"""))
def p9(spark, sf_dir):
    lanes = maps.polyline_direction(_points(spark, sf_dir)).withColumnsRenamed({"fid": "seg", "pt_idx": "pos"})
    return polylines.cut_on_curvature(lanes).select("sid", F.col("seg").alias("fid"), F.col("pos").alias("pt_idx"), F.col("piece").cast("long").alias("piece"))


def _along_sql(name: str, measured: list[str], values: list[str]) -> str:
    gap = " + ".join(f"({c} - lag({c}) OVER w) ** 2" for c in measured)
    ahead = ", ".join(f"lead({c}) OVER w AS n_{c}" for c in ("u", *values))
    out = ", ".join(f"{c} + (n_{c} - {c}) * (k / 15.0::DOUBLE - u) / (n_u - u) AS {c}" for c in values)
    return f"""{name}_s AS (SELECT *, coalesce(sqrt({gap}), 0) AS step FROM headed_points WINDOW w AS (PARTITION BY sid, fid ORDER BY pt_idx)),
{name}_t AS (SELECT *, sum(step) OVER (PARTITION BY sid, fid ORDER BY pt_idx ROWS UNBOUNDED PRECEDING) AS s FROM {name}_s),
{name}_u AS (SELECT *, s / max(s) OVER (PARTITION BY sid, fid) AS u FROM {name}_t),
{name}_b AS (SELECT *, {ahead} FROM {name}_u WINDOW w AS (PARTITION BY sid, fid ORDER BY pt_idx)),
{name}_m AS (SELECT *, max(n_u) OVER (PARTITION BY sid, fid) AS top FROM {name}_b WHERE n_u > u),
{name} AS (SELECT sid, fid, k, {out} FROM {name}_m, steps WHERE k >= ceil(u * 15) AND (k < ceil(n_u * 15) OR (n_u = top AND k <= 15)))"""


@query("p12_resample", with_views(["lane_points"], f"""WITH {DIRECTION_SQL}, {HEADING_SQL},
headed_points AS (SELECT d.sid, d.fid, d.pt_idx, CAST(d.pt_idx AS DOUBLE) AS i, d.global_type, d.x, d.y, d.z, dir_x, dir_y, 0.0::DOUBLE AS dir_z, (raw + pi()) - 2 * pi() * floor((raw + pi()) / (2 * pi())) - pi() AS theta
  FROM directed d JOIN headed h ON h.sid = d.sid AND h.fid = d.fid AND h.pt_idx = d.pt_idx),
steps AS (SELECT CAST(unnest(range(16)) AS INT) AS k),
{_along_sql('p', ['x', 'y', 'z'], ['x', 'y', 'z'])}, {_along_sql('q', ['dir_x', 'dir_y', 'dir_z'], ['dir_x', 'dir_y', 'dir_z'])}, {_along_sql('r', ['i', 'theta'], ['theta'])},
o AS (SELECT p.sid, p.fid, p.k, x, y, z, dir_x, dir_y, dir_z, theta FROM p JOIN q ON q.sid = p.sid AND q.fid = p.fid AND q.k = p.k JOIN r ON r.sid = p.sid AND r.fid = p.fid AND r.k = p.k)
SELECT o.sid, o.fid, k, {_r('x', 'y', 'z', 'dir_x', 'dir_y', 'dir_z', 'theta')}, global_type FROM o JOIN (SELECT sid, fid, max(global_type) AS global_type FROM lane_points GROUP BY 1, 2) t ON t.sid = o.sid AND t.fid = o.fid"""))
def p12(spark, sf_dir):
    points = maps.polyline_heading(maps.polyline_direction(_points(spark, sf_dir)))
    return rounded(polylines.resample(points, 16).select("sid", "fid", "k", "x", "y", "z", "dir_x", "dir_y", "dir_z", "theta", "global_type"))


# A further scenario, -1, is listed without any polyline.
@query("p13_pack", with_views(["lane_points"], """WITH l AS (SELECT sid, fid, avg(x) AS mean_x, list(x ORDER BY pt_idx) AS xs FROM lane_points WHERE global_type = 2 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY fid) - 1 AS slot FROM l),
s AS (SELECT *, unnest(range(16)) AS slot FROM (SELECT DISTINCT p.sid, l.sid IS NULL AS empty FROM (SELECT sid FROM lane_points UNION ALL SELECT -1) p LEFT JOIN l ON l.sid = p.sid)),
c AS (SELECT s.sid, s.slot, s.empty, r.fid, mean_x, unnest(coalesce(xs, list_resize(CAST([] AS DOUBLE[]), 32, CASE WHEN s.empty THEN 0.0 ELSE 0.2 END))) AS x, unnest(range(32)) AS i FROM s LEFT JOIN r ON r.sid = s.sid AND r.slot = s.slot)
SELECT sid, CAST(slot AS INT) AS slot, CASE WHEN fid IS NULL THEN 0 ELSE 1 END AS mask, empty, round(coalesce(mean_x, CASE WHEN empty THEN 0 ELSE 0.2 END), 4) + 0.0::DOUBLE AS mean_x, CAST(i AS INT) AS i, round(x, 4) + 0.0::DOUBLE AS x FROM c"""))
def p13(spark, sf_dir):
    points = _points(spark, sf_dir)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pt_idx", "x"))), lambda p: p["x"])
    lanes = points.where("global_type = 2").groupBy("sid", "fid").agg(F.avg("x").alias("mean_x"), ordered.alias("xs"))
    packed = polylines.pack(lanes, 16, ["mean_x", "xs"], scenarios=points.select("sid").union(spark.createDataFrame([(-1,)], "sid long")))
    return rounded(packed.select("sid", "slot", "mask", "empty", "mean_x", F.posexplode("xs").alias("i", "x")))


CENTERS_SQL = """listed AS (SELECT sid, unnest(predict_list) AS track_index, unnest(range(len(predict_list))) AS center_index FROM scenarios),
centers AS (SELECT l.sid, CAST(center_index AS INT) AS center_index, l.track_index, x, y, z, heading, vx, vy FROM listed l JOIN tracks r ON r.sid = l.sid AND r.track_index = l.track_index WHERE t = 10)"""


@query("p14_nearest_polylines", with_views(["lane_points", "tracks", "scenarios"], f"""WITH {DIRECTION_SQL}, {CENTERS_SQL},
v AS (SELECT *, (fid + pt_idx) % 7 <> 0 AS valid FROM directed),
m AS (SELECT sid, fid, avg(x) AS mx, avg(y) AS my FROM v WHERE valid GROUP BY 1, 2),
k AS (SELECT c.sid, center_index, fid, mx, my, c.x AS cx, c.y AS cy, heading, CAST(row_number() OVER (PARTITION BY c.sid, center_index ORDER BY sqrt((mx - c.x - 30 * cos(heading)) ** 2 + (my - c.y - 30 * sin(heading)) ** 2), fid) AS INT) AS rank FROM centers c JOIN m ON m.sid = c.sid),
p AS (SELECT k.sid, center_index, rank, k.fid, pt_idx, valid, CASE WHEN valid THEN (x - cx) * cos(heading) + (y - cy) * sin(heading) ELSE 0 END AS x, CASE WHEN valid THEN (y - cy) * cos(heading) - (x - cx) * sin(heading) ELSE 0 END AS y, 0.0::DOUBLE AS z,
  CASE WHEN valid THEN dir_x * cos(heading) + dir_y * sin(heading) ELSE 0 END AS dir_x, CASE WHEN valid THEN dir_y * cos(heading) - dir_x * sin(heading) ELSE 0 END AS dir_y,
  (mx - cx) * cos(heading) + (my - cy) * sin(heading) AS mean_x, (my - cy) * cos(heading) - (mx - cx) * sin(heading) AS mean_y FROM k JOIN v p ON p.sid = k.sid AND p.fid = k.fid WHERE rank <= 8),
q AS (SELECT *, coalesce(lag(x) OVER w, x) AS prev_x, coalesce(lag(y) OVER w, y) AS prev_y FROM p WINDOW w AS (PARTITION BY sid, center_index, fid ORDER BY pt_idx))
SELECT sid, center_index, rank, fid, pt_idx, valid, {_r('x', 'y', 'z', 'dir_x', 'dir_y', 'mean_x', 'mean_y', 'prev_x', 'prev_y')} FROM q"""))
def p14(spark, sf_dir):
    from scenejobs.operators import agents

    centers = agents.center_objects(views.tracks(spark, sf_dir), views.scenarios(spark, sf_dir))
    points = maps.polyline_direction(_points(spark, sf_dir)).withColumn("valid", F.expr("(fid + pt_idx) % 7 != 0"))
    return rounded(polylines.nearest_polylines(centers, points, 8))


@query("s5_manifest", with_views(["lane_points"], "WITH m AS (SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS idx FROM (SELECT DISTINCT sid FROM lane_points)) SELECT sid, idx FROM m WHERE idx % 3 = 0"))
def s5(spark, sf_dir):
    from scenejobs.sources import scenes

    return scenes.every_nth(scenes.manifest(_points(spark, sf_dir)), 3)


@query("s6_sample_k", None)
def s6(spark, sf_dir):
    from scenejobs.sources import scenes

    return scenes.sample_k(views.graph_edges(spark, sf_dir).select("graph_id").distinct(), "graph_id", 20, 7)


def _lines(spark, sf_dir):
    return _points(spark, sf_dir).select("sid", F.col("fid").alias("seg"), F.col("pt_idx").alias("pos"), "x", "y")


@query("p8_cut_at_endpoints", with_views(["lane_points"], """WITH e AS (SELECT sid, fid AS seg, x, y, pt_idx = 0 AS st FROM lane_points WHERE pt_idx IN (0, 31)),
f AS (SELECT * FROM e WHERE abs(x) < 39 AND abs(y) < 39 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.sid = e.sid AND o.st <> e.st AND sqrt((o.x - e.x) ** 2 + (o.y - e.y) ** 2) < 2)),
h AS (SELECT f.sid, p.fid, p.pt_idx, row_number() OVER (PARTITION BY f.sid, f.seg, f.st, p.fid ORDER BY sqrt((p.x - f.x) ** 2 + (p.y - f.y) ** 2), p.pt_idx) AS rn FROM f JOIN lane_points p ON p.sid = f.sid AND p.fid <> f.seg AND sqrt((p.x - f.x) ** 2 + (p.y - f.y) ** 2) <= 1.5),
c AS (SELECT DISTINCT sid, fid, pt_idx FROM h WHERE rn = 1 AND pt_idx > 3 AND pt_idx < 29),
s AS (SELECT p.sid, p.fid, p.pt_idx, x, y, CAST(sum(CASE WHEN c.fid IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.sid, p.fid ORDER BY p.pt_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS piece
  FROM lane_points p LEFT JOIN c ON c.sid = p.sid AND c.fid = p.fid AND c.pt_idx = p.pt_idx),
z AS (SELECT *, count(*) OVER (PARTITION BY sid, fid, piece) AS size FROM s)
SELECT sid, fid AS seg, piece, pt_idx AS pos FROM z WHERE size >= 3"""))
def p8(spark, sf_dir):
    return polylines.cut_at_endpoints(_lines(spark, sf_dir), 40.0).select("sid", "seg", "piece", "pos")


@query("p10_root_leaf_paths", with_views(["lane_points"], """WITH e AS (SELECT sid, fid AS seg, arg_min(x, pt_idx) AS sx, arg_min(y, pt_idx) AS sy, arg_max(x, pt_idx) AS ex, arg_max(y, pt_idx) AS ey FROM lane_points GROUP BY 1, 2),
m AS (SELECT *, least(abs(abs(sx) - 30), abs(abs(sy) - 30)) <= 2 AS root, least(abs(abs(ex) - 30), abs(abs(ey) - 30)) <= 2 AS leaf FROM e),
paths AS (SELECT sid, [seg] AS path, leaf, ex, ey FROM m WHERE root
  UNION ALL SELECT p.sid, list_append(p.path, n.seg), n.leaf, n.ex, n.ey FROM paths p JOIN m n ON n.sid = p.sid AND sqrt((n.sx - p.ex) ** 2 + (n.sy - p.ey) ** 2) <= 3 WHERE NOT p.leaf AND NOT list_contains(p.path, n.seg))
SELECT sid, array_to_string(path, ',') AS path FROM paths WHERE leaf"""))
def p10(spark, sf_dir):
    ends = _points(spark, sf_dir).groupBy("sid", F.col("fid").alias("seg")).agg(*[f(c, "pt_idx").alias(f"{n}_{c}") for n, f in (("start", F.min_by), ("end", F.max_by)) for c in "xy"])
    return polylines.root_leaf_paths(ends, 30.0, 2.0, 3.0).select("sid", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query("p11_vertices_and_edges", with_views(["lane_points"], """WITH g AS (SELECT sid, fid, pt_idx, round(x) AS x, round(y) AS y FROM lane_points),
k AS (SELECT *, min(fid * 100 + pt_idx) OVER (PARTITION BY sid, x, y) AS key FROM g)
SELECT sid, fid AS path_id, string_agg(CAST(key AS VARCHAR), ',' ORDER BY pt_idx) AS vertices FROM k GROUP BY 1, 2"""))
def p11(spark, sf_dir):
    points = _points(spark, sf_dir).select("sid", F.col("fid").alias("path_id"), F.col("pt_idx").alias("pos"), (F.round("x") + 0.0).alias("x"), (F.round("y") + 0.0).alias("y"))
    found = polylines.vertices_and_edges(points)
    return found.select("sid", "path_id", F.array_join(F.transform("vertices", lambda k: (k["path_id"] * 100 + k["pos"]).cast("string")), ",").alias("vertices"))
