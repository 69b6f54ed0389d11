"""Oracle SQL of routes, junction connections and the lane search, by recursion."""

from __future__ import annotations

from scenejobs.jobs.map_queries import HEADING_SQL
from scenejobs.sources.views import with_views

#: Where a node lies on the grid.
_X, _Y = "(({n}) % 10) * 8.0::DOUBLE", "(({n}) // 10 % 10) * 8.0::DOUBLE"


def _x(n: str) -> str:
    return _X.format(n=n)


def _y(n: str) -> str:
    return _Y.format(n=n)


def _wrapped(a: str) -> str:
    """An angle brought to [-pi, pi), by the remainder that Spark's pmod takes."""
    left = f"(({a}) + pi()) % (2 * pi())"
    return f"(CASE WHEN {left} < 0 THEN ({left} + 2 * pi()) % (2 * pi()) ELSE {left} END - pi())"


# Distances from each inlet; the predecessor on a shortest path is the smallest node that fits; ways are walked back.
ROUTES = f"""near AS MATERIALIZED (SELECT graph_id, n1 AS a, n2 AS b, dist AS step, n1 * 1000 + n2 AS edge_id FROM graph_edges UNION ALL SELECT graph_id, n2, n1, dist, n1 * 1000 + n2 FROM graph_edges),
terminals AS MATERIALIZED (SELECT graph_id, a AS node, a < 100 AS inlet FROM near GROUP BY 1, 2 HAVING count(*) = 1),
far(graph_id, source, node, d) USING KEY (graph_id, source, node) AS (SELECT graph_id, node, node, 0.0::DOUBLE FROM terminals WHERE inlet
  UNION SELECT n.graph_id, n.source, n.node, n.d FROM (SELECT f.graph_id, f.source, e.b AS node, min(f.d + e.step) AS d FROM far f JOIN near e ON e.graph_id = f.graph_id AND e.a = f.node GROUP BY 1, 2, 3) n
  LEFT JOIN recurring.far r ON r.graph_id = n.graph_id AND r.source = n.source AND r.node = n.node WHERE r.d IS NULL OR n.d < r.d),
back AS MATERIALIZED (SELECT f.graph_id, f.source, f.node, min(n.a) AS prev FROM far f JOIN near n ON n.graph_id = f.graph_id AND n.b = f.node JOIN far g ON g.graph_id = f.graph_id AND g.source = f.source AND g.node = n.a WHERE g.d + n.step = f.d GROUP BY 1, 2, 3),
way AS (SELECT f.graph_id, source, t.node AS target, d AS length, [t.node] AS nodes FROM far f JOIN terminals t ON t.graph_id = f.graph_id AND t.node = f.node WHERE NOT inlet AND source <> t.node
  UNION ALL SELECT w.graph_id, w.source, target, length, list_prepend(b.prev, nodes) FROM way w JOIN back b ON b.graph_id = w.graph_id AND b.source = w.source AND b.node = nodes[1]),
found AS MATERIALIZED (SELECT *, list_transform(range(1, len(nodes)), lambda i: least(nodes[i], nodes[i + 1]) * 1000 + greatest(nodes[i], nodes[i + 1])) AS edge_ids,
  flatten(list_transform(range(1, len(nodes)), lambda i: [{{'x': {_x('nodes[i]')}, 'y': {_y('nodes[i]')}}}, {{'x': ({_x('nodes[i]')} + {_x('nodes[i + 1]')}) / 2, 'y': ({_y('nodes[i]')} + {_y('nodes[i + 1]')}) / 2}}, {{'x': {_x('nodes[i + 1]')}, 'y': {_y('nodes[i + 1]')}}}])) AS waypoints
  FROM way WHERE nodes[1] = source),
sides AS MATERIALIZED (SELECT graph_id, a AS node, edge_id, {_x('a')} AS x, {_y('a')} AS y, atan2({_y('b')} - {_y('a')}, {_x('b')} - {_x('a')}) AS yaw FROM near)"""

V17 = with_views(["graph_edges"], f"""WITH {ROUTES},
bends AS (SELECT a.graph_id, a.node, a.edge_id, b.edge_id AS partner, round(abs({_wrapped('a.yaw - b.yaw - pi()')}), 9) AS bend FROM sides a JOIN sides b ON a.graph_id = b.graph_id AND a.node = b.node AND a.edge_id <> b.edge_id),
votes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, node, edge_id ORDER BY bend, partner) AS rn FROM bends) WHERE rn = 1 AND bend < pi() / 4),
smooth AS MATERIALIZED (SELECT graph_id, node, edge_id, partner FROM votes UNION SELECT graph_id, node, partner, edge_id FROM votes),
steps AS (SELECT graph_id, source, target, nodes[i + 1] AS node, edge_ids[i] AS edge_id, edge_ids[i + 1] AS partner FROM (SELECT *, unnest(range(1, len(edge_ids))) AS i FROM found)),
broken AS (SELECT DISTINCT s.graph_id, source, target FROM steps s LEFT JOIN smooth m ON m.graph_id = s.graph_id AND m.node = s.node AND m.edge_id = s.edge_id AND m.partner = s.partner WHERE m.node IS NULL)
SELECT graph_id, source, target, round(length, 4) AS length, array_to_string(nodes, ',') AS nodes, array_to_string(list_transform(waypoints, lambda p: CAST(p.x AS INT) || ':' || CAST(p.y AS INT)), ' ') AS waypoints
FROM found f WHERE NOT EXISTS (SELECT 1 FROM broken b WHERE b.graph_id = f.graph_id AND b.source = f.source AND b.target = f.target)""")

# An inner node has two edges at least, so no route leads over another terminal.
V12 = with_views(["graph_edges"], f"""WITH {ROUTES},
r AS (SELECT f.*, a.x AS x1, a.y AS y1, a.yaw AS yaw1, b.x AS x2, b.y AS y2, b.yaw + pi() AS yaw2 FROM found f JOIN sides a ON a.graph_id = f.graph_id AND a.node = f.source JOIN sides b ON b.graph_id = f.graph_id AND b.node = f.target),
t AS (SELECT *, {_wrapped('atan2(y2 - y1, x2 - x1) - yaw1')} AS first, {_wrapped('yaw2 - yaw1')} AS diff, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 3 AS d FROM r),
g AS (SELECT *, CASE WHEN first < 0 THEN -{_wrapped('diff - first')} ELSE {_wrapped('diff - first')} END AS final, list_transform(range(33), lambda i: i / 32.0::DOUBLE) AS ts FROM t),
c AS (SELECT *, list_transform(ts, lambda t: {{
  'x': x1 * (1 - t) * (1 - t) * (1 - t) + (x1 + d * cos(yaw1)) * 3 * (1 - t) * (1 - t) * t + (x2 - d * cos(yaw2)) * 3 * (1 - t) * t * t + x2 * t * t * t,
  'y': y1 * (1 - t) * (1 - t) * (1 - t) + (y1 + d * sin(yaw1)) * 3 * (1 - t) * (1 - t) * t + (y2 - d * sin(yaw2)) * 3 * (1 - t) * t * t + y2 * t * t * t}}) AS curve FROM g),
n AS (SELECT *, len(list_filter(waypoints, lambda w: len(list_filter(curve, lambda p: sqrt((p.x - w.x) ** 2 + (p.y - w.y) ** 2) <= 3)) > 0)) AS inliers FROM c),
k AS (SELECT *, CASE WHEN len(nodes) <= 3 THEN 'direct' WHEN abs(first) <= radians(10) AND abs(final) <= radians(10) THEN 'straight'
  WHEN abs(diff) <= radians(135) AND final BETWEEN radians(-5) AND radians(95) AND final <> 0 AND abs(first / final) > 0.5 AND abs(first / final) < 2 AND inliers >= 0.5 * len(waypoints) THEN 'turn' END AS kind FROM n)
SELECT graph_id AS image_id, source AS entry, target AS exit, kind, i, round(curve[i + 1].x, 4) + 0.0::DOUBLE AS x, round(curve[i + 1].y, 4) + 0.0::DOUBLE AS y FROM (SELECT *, CAST(unnest(range(33)) AS INT) AS i FROM k WHERE kind IS NOT NULL)""")

# Discovery order is the order of expansion, so one list of found lanes and a place in it are the whole state.
L7 = with_views(["lane_topology"], """WITH beside AS (SELECT sid, fid, lead(fid) OVER (PARTITION BY sid ORDER BY fid) AS next FROM lane_rank),
ahead AS MATERIALIZED (SELECT t.sid, t.fid, flatten(list(CASE WHEN b.next IS NULL THEN [t.exit_fid] ELSE [b.next, t.exit_fid] END ORDER BY t.exit_fid)) AS lanes FROM lane_topology t JOIN beside b ON b.sid = t.sid AND b.fid = t.exit_fid GROUP BY 1, 2),
search AS (SELECT sid, rank AS agent, 1 AS i, [{'lane': fid, 'first': 10, 'last': 32, 'reached': 22, 'open': TRUE}] AS found FROM lane_rank
  UNION ALL SELECT s.sid, agent, i + 1, CASE WHEN found[i].open AND found[i].reached < 120 AND len(found) < 20 AND a.lanes IS NOT NULL THEN found || list_transform(
      list_filter(list_filter(a.lanes, lambda x, k: list_position(a.lanes, x) = k), lambda x: len(list_filter(found, lambda f: f.lane = x)) = 0)[1 : 20 - len(found)],
      lambda x: {'lane': x, 'first': 0, 'last': CASE WHEN found[i].reached + 32 > 120 THEN 120 - found[i].reached ELSE 32 END, 'reached': least(found[i].reached + 32, 120), 'open': found[i].reached + 32 <= 120}) ELSE found END
    FROM search s LEFT JOIN ahead a ON a.sid = s.sid AND a.fid = found[i].lane WHERE i <= len(found)),
done AS (SELECT sid, agent, arg_max(found, i) AS found FROM search GROUP BY 1, 2)
SELECT sid, agent, CAST(pos AS INT) AS pos, found[pos + 1].lane AS lane_id, CAST(found[pos + 1].first AS INT) AS first, CAST(found[pos + 1].last AS INT) AS last, CAST(found[pos + 1].reached AS INT) AS reached FROM (SELECT *, unnest(range(len(found))) AS pos FROM done)""")


def _spline(step: float) -> str:
    """Tables up to line, points at every step of the natural splines through apart (sid, track_index, i, x, y, d: the distance to the point before), by elimination down and up again."""
    return f"""knots AS MATERIALIZED (SELECT *, lead(s) OVER w - s AS h, lag(h0) OVER w AS h_before, (lead(x) OVER w - x) / (lead(s) OVER w - s) AS gx, (lead(y) OVER w - y) / (lead(s) OVER w - s) AS gy, max(i) OVER (PARTITION BY sid, track_index) AS n, max(s) OVER (PARTITION BY sid, track_index) AS whole
  FROM (SELECT *, lead(s) OVER (PARTITION BY sid, track_index ORDER BY i) - s AS h0 FROM (SELECT *, sum(d) OVER (PARTITION BY sid, track_index ORDER BY i) AS s FROM apart)) WINDOW w AS (PARTITION BY sid, track_index ORDER BY i)),
inner_ AS MATERIALIZED (SELECT k.*, 6 * (gx - bx) AS rx, 6 * (gy - byy) AS ry FROM (SELECT *, lag(gx) OVER w AS bx, lag(gy) OVER w AS byy FROM knots WINDOW w AS (PARTITION BY sid, track_index ORDER BY i)) k WHERE i BETWEEN 1 AND n - 1),
down AS (SELECT sid, track_index, i, 2 * (h_before + h) AS m, rx, ry FROM inner_ WHERE i = 1
  UNION ALL SELECT k.sid, k.track_index, k.i, 2 * (h_before + h) - h_before / m * h_before, k.rx - h_before / m * d.rx, k.ry - h_before / m * d.ry FROM down d JOIN inner_ k ON k.sid = d.sid AND k.track_index = d.track_index AND k.i = d.i + 1),
solved AS MATERIALIZED (SELECT d.*, h, n FROM down d JOIN knots k ON k.sid = d.sid AND k.track_index = d.track_index AND k.i = d.i),
up AS (SELECT sid, track_index, n AS i, 0.0::DOUBLE AS mx, 0.0::DOUBLE AS my FROM knots WHERE i = n
  UNION ALL SELECT s.sid, s.track_index, s.i, (rx - s.h * u.mx) / m, (ry - s.h * u.my) / m FROM up u JOIN solved s ON s.sid = u.sid AND s.track_index = u.track_index AND s.i = u.i - 1),
curve AS MATERIALIZED (SELECT k.*, coalesce(u.mx, 0) AS mx, coalesce(u.my, 0) AS my, coalesce(v.mx, 0) AS nx, coalesce(v.my, 0) AS ny FROM knots k LEFT JOIN up u ON u.sid = k.sid AND u.track_index = k.track_index AND u.i = k.i LEFT JOIN up v ON v.sid = k.sid AND v.track_index = k.track_index AND v.i = k.i + 1 WHERE k.n >= 1),
steps AS (SELECT sid, track_index, k, k * {step}::DOUBLE AS far_s FROM (SELECT sid, track_index, unnest(range(CAST(ceil(whole / {step}::DOUBLE) AS INT))) AS k FROM curve WHERE i = n)),
spot AS (SELECT p.sid, p.track_index, p.k, far_s - c.s AS t, c.* EXCLUDE (sid, track_index) FROM steps p ASOF JOIN (SELECT * FROM curve WHERE i < n) c ON c.sid = p.sid AND c.track_index = p.track_index AND p.far_s >= c.s),
slope AS (SELECT *, gx - h * (2 * mx + nx) / 6 AS ax, gy - h * (2 * my + ny) / 6 AS ay, (nx - mx) / h AS jx, (ny - my) / h AS jy FROM spot),
line AS (SELECT sid, track_index, k, x + ax * t + mx / 2 * t ** 2 + jx / 6 * t ** 3 AS x, y + ay * t + my / 2 * t ** 2 + jy / 6 * t ** 3 AS y, ax + mx * t + jx / 2 * t ** 2 AS dx, ay + my * t + jy / 2 * t ** 2 AS dy, mx + jx * t AS ddx, my + jy * t AS ddy FROM slope)"""


# Matches, the lanes before and behind, every fifth of their points, and the natural spline through them.
L8 = with_views(["lane_points", "tracks", "lane_topology"], f"""WITH {HEADING_SQL},
ends AS (SELECT sid, track_index, min(t) AS t0, max(t) AS t1 FROM tracks GROUP BY 1, 2),
asked AS (SELECT r.sid, r.track_index, t, t0, t1, x AS ax, y AS ay, heading FROM tracks r JOIN ends e ON e.sid = r.sid AND e.track_index = r.track_index WHERE t = t1 OR (t - t0) % 10 = 0),
met AS MATERIALIZED (SELECT * FROM (SELECT a.sid, track_index, t, t0, t1, fid, pt_idx AS i, x, y, row_number() OVER (PARTITION BY a.sid, track_index, t ORDER BY sqrt((x - ax) ** 2 + (y - ay) ** 2), fid, pt_idx) AS rn FROM asked a JOIN headed l ON l.sid = a.sid
  WHERE abs((heading - raw + pi()) - 2 * pi() * floor((heading - raw + pi()) / (2 * pi())) - pi()) <= radians(10.0)) WHERE rn = 1 AND fid > 0),
entry AS (SELECT sid, exit_fid AS fid, fid AS lane FROM lane_topology), leave AS (SELECT sid, fid, min(exit_fid) AS lane FROM lane_topology GROUP BY 1, 2),
parts AS (SELECT sid, track_index, 1 AS part, t AS lane, i AS pt_idx, x, y FROM met WHERE (t - t0) % 10 = 0
  UNION ALL SELECT m.sid, track_index, 0, 0, l.pt_idx, l.x, l.y FROM met m JOIN entry e ON e.sid = m.sid AND e.fid = m.fid JOIN lane_points l ON l.sid = m.sid AND l.fid = e.lane WHERE t = t0
  UNION ALL SELECT m.sid, track_index, 0, 1, l.pt_idx, l.x, l.y FROM met m JOIN lane_points l ON l.sid = m.sid AND l.fid = m.fid WHERE t = t0 AND l.pt_idx < i
  UNION ALL SELECT m.sid, track_index, 2, 0, l.pt_idx, l.x, l.y FROM met m JOIN lane_points l ON l.sid = m.sid AND l.fid = m.fid WHERE t = t1 AND l.pt_idx >= i
  UNION ALL SELECT m.sid, track_index, 2, 1, l.pt_idx, l.x, l.y FROM met m JOIN leave e ON e.sid = m.sid AND e.fid = m.fid JOIN lane_points l ON l.sid = m.sid AND l.fid = e.lane WHERE t = t1),
placed AS (SELECT *, row_number() OVER (PARTITION BY sid, track_index, part ORDER BY lane, pt_idx) - 1 AS place FROM parts),
fifth AS (SELECT sid, track_index, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, part, place FROM placed WHERE part = 1 OR place % 5 = 0 WINDOW w AS (PARTITION BY sid, track_index ORDER BY part, place)),
apart AS (SELECT sid, track_index, x, y, row_number() OVER w - 1 AS i, coalesce(sqrt((x - px) ** 2 + (y - py) ** 2), 0) AS d FROM fifth WHERE px IS NULL OR x <> px OR y <> py WINDOW w AS (PARTITION BY sid, track_index ORDER BY part, place)),
{_spline(0.1)},
near AS (SELECT l.*, first_value(k) OVER (PARTITION BY l.sid, l.track_index ORDER BY sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2), k) AS place FROM line l JOIN tracks r ON r.sid = l.sid AND r.track_index = l.track_index AND r.t = 10)
SELECT sid, track_index, CAST(k - greatest(place - 200, 0) AS INT) AS k, round(x, 4) + 0.0::DOUBLE AS x, round(y, 4) + 0.0::DOUBLE AS y, round(atan2(dy, dx), 4) + 0.0::DOUBLE AS yaw, round((dx * ddy - dy * ddx) / greatest(dx ** 2 + dy ** 2, 1e-12) ** 1.5, 4) + 0.0::DOUBLE AS curvature
FROM near WHERE k BETWEEN greatest(place - 200, 0) AND greatest(place - 200, 0) + 1199""")

V13 = with_views(["lane_points"], f"""WITH apart AS (SELECT sid, fid AS track_index, x, y, row_number() OVER w - 1 AS i, coalesce(sqrt((x - px) ** 2 + (y - py) ** 2), 0) AS d FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM lane_points WINDOW w AS (PARTITION BY sid, fid ORDER BY pt_idx)) WHERE px IS NULL OR x <> px OR y <> py WINDOW w AS (PARTITION BY sid, fid ORDER BY pt_idx)),
{_spline(0.5)},
ends AS (SELECT sid, fid AS track_index, arg_min(x, pt_idx) AS x1, arg_min(y, pt_idx) AS y1, arg_max(x, pt_idx) AS x2, arg_max(y, pt_idx) AS y2 FROM lane_points GROUP BY 1, 2),
near AS (SELECT l.*, first_value(k) OVER (PARTITION BY l.sid, l.track_index ORDER BY sqrt((x - x1) ** 2 + (y - y1) ** 2), k) AS a, first_value(k) OVER (PARTITION BY l.sid, l.track_index ORDER BY sqrt((x - x2) ** 2 + (y - y2) ** 2), k) AS b FROM line l JOIN ends e ON e.sid = l.sid AND e.track_index = l.track_index)
SELECT sid AS image_id, track_index AS edge_id, CAST(k - a AS INT) AS k, round(x, 4) + 0.0::DOUBLE AS x, round(y, 4) + 0.0::DOUBLE AS y, round(atan2(dy, dx), 4) + 0.0::DOUBLE AS yaw, round((dx * ddy - dy * ddx) / greatest(dx ** 2 + dy ** 2, 1e-12) ** 1.5, 4) + 0.0::DOUBLE AS curvature, round(k * 0.5::DOUBLE, 4) AS s FROM near WHERE k BETWEEN a AND b""")
