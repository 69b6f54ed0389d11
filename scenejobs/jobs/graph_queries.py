"""Queries of the lane-graph operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenejobs.functions.tables import written
from scenejobs.jobs.registry import query, rounded
from scenejobs.operators import graphs
from scenejobs.sources import views
from scenejobs.sources.views import with_views

STATS_SQL = """ends AS (SELECT graph_id, n1 AS node FROM graph_edges UNION ALL SELECT graph_id, n2 FROM graph_edges),
nodes AS (SELECT graph_id, node, count(*) AS degree FROM ends GROUP BY 1, 2),
stats AS (SELECT * FROM (SELECT graph_id, avg(degree) AS connectivity, CAST(count(*) AS DOUBLE) AS density, avg((node % 63 - 31) / 16.0::DOUBLE) AS orientation FROM nodes GROUP BY 1) a
  JOIN (SELECT graph_id, CAST(count(*) AS DOUBLE) AS reach, avg(dist) AS length, 2 * sum(CASE WHEN n1 <> n2 THEN dist ELSE 0 END) AS spectrum FROM graph_edges GROUP BY 1) b USING (graph_id)),
tall AS (SELECT graph_id, unnest(['connectivity', 'density', 'reach', 'length', 'orientation', 'spectrum']) AS statistic, unnest([connectivity, density, reach, length, orientation, spectrum]) AS value FROM stats),
fits AS (SELECT graph_id % 2 AS side, statistic, avg(value) AS mu, stddev_pop(value) AS sigma FROM tall GROUP BY 1, 2)"""
GRAPH_SQL = """steps AS (SELECT sid, fid, pt_idx, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM lane_points WINDOW w AS (PARTITION BY sid, fid ORDER BY pt_idx)),
lanes AS (SELECT sid, fid, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS dist, arg_min(x, pt_idx) AS n1_x, arg_min(y, pt_idx) AS n1_y, arg_max(x, pt_idx) AS n2_x, arg_max(y, pt_idx) AS n2_y,
  arg_min(atan2(ny - y, nx - x), pt_idx) FILTER (nx IS NOT NULL) AS yaw1, arg_max(atan2(ny - y, nx - x), pt_idx) FILTER (nx IS NOT NULL) AS yaw2 FROM steps GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _edges(spark, sf_dir) -> DataFrame:
    return views.graph_edges(spark, sf_dir)


def _yaws(edges: DataFrame) -> DataFrame:
    """Yaws in sixteenths, so that their sums are exact in any order."""
    return graphs.edge_nodes(edges).select("graph_id", "node", ((F.col("node") % 63 - 31) / 16.0).alias("yaw"))


def _stats(spark, sf_dir) -> DataFrame:
    edges = written(_edges(spark, sf_dir))
    return graphs.graph_stats(edges, _yaws(edges))


@query("g1_lane_graph", with_views(["lane_points"], f"""WITH {GRAPH_SQL}
SELECT sid, fid, round(n1_x, 4) AS n1_x, round(n1_y, 4) AS n1_y, round(n2_x, 4) AS n2_x, round(n2_y, 4) AS n2_y, round(dist, 4) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY sid, least({{'x': n1_x, 'y': n1_y}}, {{'x': n2_x, 'y': n2_y}}), greatest({{'x': n1_x, 'y': n1_y}}, {{'x': n2_x, 'y': n2_y}}) ORDER BY fid DESC) AS rn FROM lanes) WHERE rn = 1"""))
def g1(spark, sf_dir):
    return rounded(graphs.lane_graph(views.lane_points(spark, sf_dir))[0])


@query("g1_lane_graph_nodes", with_views(["lane_points"], f"""WITH {GRAPH_SQL},
ends AS (SELECT sid, fid, 0 AS k, n1_x AS x, n1_y AS y, yaw1 AS yaw FROM lanes UNION ALL SELECT sid, fid, 1, n2_x, n2_y, yaw2 FROM lanes)
SELECT sid, round(x, 4) AS x, round(y, 4) AS y, round(arg_max(yaw, fid * 2 + k), 4) AS yaw FROM ends GROUP BY sid, ends.x, ends.y"""))
def g1_nodes(spark, sf_dir):
    return rounded(graphs.lane_graph(views.lane_points(spark, sf_dir))[1])


@query("g2_graph_stats", with_views(["graph_edges"], f"""WITH {STATS_SQL}
SELECT graph_id, round(connectivity, 4) AS connectivity, round(density, 4) AS density, round(reach, 4) AS reach, round(length, 4) AS length, round(orientation, 4) AS orientation, round(spectrum, 4) AS spectrum FROM stats"""))
def g2(spark, sf_dir):
    return rounded(_stats(spark, sf_dir))


@query("g3_convenience", with_views(["graph_edges"], """WITH near AS MATERIALIZED (SELECT graph_id, a, b, min(dist) AS step FROM (SELECT graph_id, n1 AS a, n2 AS b, dist FROM graph_edges UNION ALL SELECT graph_id, n2, n1, dist FROM graph_edges) WHERE a <> b GROUP BY 1, 2, 3),
far(graph_id, source, node, d) USING KEY (graph_id, source, node) AS (SELECT graph_id, a, b, step FROM near
  UNION SELECT n.graph_id, n.source, n.node, n.d FROM (SELECT f.graph_id, f.source, e.b AS node, min(f.d + e.step) AS d FROM far f JOIN near e ON e.graph_id = f.graph_id AND e.a = f.node WHERE e.b <> f.source GROUP BY 1, 2, 3) n
  LEFT JOIN recurring.far r ON r.graph_id = n.graph_id AND r.source = n.source AND r.node = n.node WHERE r.d IS NULL OR n.d < r.d)
SELECT graph_id, round(avg(d), 4) AS convenience FROM far GROUP BY 1"""))
def g3(spark, sf_dir):
    return rounded(graphs.convenience(_edges(spark, sf_dir)))


@query("g4_fit_normal", with_views(["graph_edges"], f"WITH {STATS_SQL} SELECT side, statistic, round(mu, 4) AS mu, round(sigma, 4) AS sigma FROM fits"))
def g4(spark, sf_dir):
    return rounded(graphs.fit_normal(_stats(spark, sf_dir).withColumn("side", F.col("graph_id") % 2), graphs.STATS, ["side"]))


@query("g5_frechet_1d", with_views(["graph_edges"], f"""WITH {STATS_SQL}
SELECT statistic, round(abs(a.mu - b.mu) + sqrt(a.sigma ** 2 + b.sigma ** 2) - sqrt(2 * a.sigma * b.sigma) * exp(-0.5 * ((a.mu - b.mu) / sqrt(a.sigma ** 2 + b.sigma ** 2)) ** 2), 4) AS frechet
FROM (SELECT * FROM fits WHERE side = 0) a JOIN (SELECT * FROM fits WHERE side = 1) b USING (statistic)"""))
def g5(spark, sf_dir):
    fits = written(graphs.fit_normal(_stats(spark, sf_dir).withColumn("side", F.col("graph_id") % 2), graphs.STATS, ["side"]))  # a row per side and statistic
    return rounded(graphs.frechet_1d(fits.where("side = 0"), fits.where("side = 1")))


def _degrees(spark, sf_dir):
    nodes = graphs.edge_nodes(_edges(spark, sf_dir)).select("graph_id", F.col("degree").cast("double").alias("value"))
    return nodes.where("graph_id % 2 = 0").select("value"), nodes.where("graph_id % 2 = 1").select("value")


DEGREES_SQL = """ends AS (SELECT graph_id, n1 AS node FROM graph_edges UNION ALL SELECT graph_id, n2 FROM graph_edges),
degrees AS (SELECT graph_id % 2 AS side, CAST(count(*) AS DOUBLE) AS v FROM ends GROUP BY graph_id, node),
counted AS (SELECT side, v, count(*) AS n FROM degrees GROUP BY 1, 2)"""


@query("g6_mmd", with_views(["graph_edges"], f"""WITH {DEGREES_SQL},
k AS (SELECT a.side AS s, b.side AS t, sum(a.n * b.n * exp(-(a.v - b.v) * (a.v - b.v) / 2)) / sum(a.n * b.n) AS m FROM counted a, counted b GROUP BY 1, 2)
SELECT round(sum(CASE WHEN s = t THEN m ELSE -m END), 4) AS mmd FROM k"""))
def g6(spark, sf_dir):
    return rounded(graphs.mmd(*_degrees(spark, sf_dir)))


@query("g6_mmd_wasserstein", with_views(["graph_edges"], f"""WITH {DEGREES_SQL},
km AS (SELECT a.side, a.v, a.n, sum(b.n * exp(-(a.v - b.v) * (a.v - b.v) / 2)) / sum(b.n) AS m FROM counted a JOIN counted b ON a.side = b.side GROUP BY 1, 2, 3),
steps AS (SELECT m AS v, sum(CASE WHEN side = 0 THEN n ELSE -n END * 1.0::DOUBLE / t) AS step FROM (SELECT *, sum(n) OVER (PARTITION BY side) AS t FROM km) GROUP BY 1)
SELECT round(sum(area), 4) AS distance FROM (SELECT abs(sum(step) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING)) * (lead(v) OVER (ORDER BY v) - v) AS area FROM steps)"""))
def g6_wasserstein(spark, sf_dir):
    return rounded(graphs.mmd_wasserstein(*_degrees(spark, sf_dir)))


@query("g6_mmd_tvd", with_views(["graph_edges"], f"""WITH {DEGREES_SQL},
km AS (SELECT a.side, a.v, sum(b.n * exp(-(a.v - b.v) * (a.v - b.v) / 2)) / sum(b.n) AS m FROM counted a JOIN counted b ON a.side = b.side GROUP BY 1, 2),
placed AS (SELECT side, row_number() OVER (PARTITION BY side ORDER BY graph_id, node) AS place, v FROM (SELECT graph_id % 2 AS side, graph_id, node, CAST(count(*) AS DOUBLE) AS v FROM ends GROUP BY 1, 2, 3)),
means AS (SELECT p.side, place, m FROM placed p JOIN km ON km.side = p.side AND km.v = p.v)
SELECT round(sum(apart) / 2, 4) AS distance FROM (SELECT place, abs(sum(CASE WHEN side = 0 THEN m ELSE -m END)) AS apart FROM means GROUP BY 1)"""))
def g6_tvd(spark, sf_dir):
    nodes = graphs.edge_nodes(_edges(spark, sf_dir)).select("graph_id", "node", F.col("degree").cast("double").alias("value"))
    return rounded(graphs.mmd_tvd(nodes.where("graph_id % 2 = 0"), nodes.where("graph_id % 2 = 1"), ["graph_id", "node"]))


@query("g7_wasserstein_1d", with_views(["graph_edges"], f"""WITH {DEGREES_SQL},
steps AS (SELECT v, sum(CASE WHEN side = 0 THEN n ELSE -n END * 1.0::DOUBLE / t) AS step FROM (SELECT *, sum(n) OVER (PARTITION BY side) AS t FROM counted) GROUP BY 1)
SELECT round(sum(area), 4) AS distance FROM (SELECT abs(sum(step) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING)) * (lead(v) OVER (ORDER BY v) - v) AS area FROM steps)"""))
def g7(spark, sf_dir):
    return rounded(graphs.wasserstein_1d(*_degrees(spark, sf_dir)))


@query("g8_frechet_gaussian", None)
def g8(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.col("embedding").alias("vector"))
    return rounded(graphs.frechet_gaussian(rows.where("label % 2 = 0"), rows.where("label % 2 = 1")))


MEANS = ", ".join(f"round(avg({c}), 4) AS {c}" for c in graphs.ATTRIBUTES)


@query("g9_agent_means", with_views(["tracks"], f"SELECT sid AS image_id, {MEANS} FROM tracks WHERE t = 10 AND valid GROUP BY sid"))
def g9(spark, sf_dir):
    return rounded(graphs.agent_means(views.tracks(spark, sf_dir).where("t = 10 AND valid").withColumnRenamed("sid", "image_id")))


@query("g10_track_means", with_views(["tracks"], """WITH kept AS (SELECT sid, length, width, height, heading, vx, vy, x - first_value(x) OVER w AS x, y - first_value(y) OVER w AS y, z - first_value(z) OVER w AS z
  FROM tracks WHERE t = 10 AND valid AND object_type <> 0 WINDOW w AS (PARTITION BY sid ORDER BY track_index)) SELECT sid, """ + MEANS + " FROM kept GROUP BY sid"))  # fmt: skip
def g10(spark, sf_dir):
    return rounded(graphs.track_means(views.tracks(spark, sf_dir)))


@query("g11_attribute_histogram", with_views(["tracks"], """WITH tall AS (SELECT unnest(['x', 'y', 'heading', 'vx']) AS attribute, unnest([x, y, heading, vx]) AS value FROM tracks),
ends AS (SELECT attribute, min(value) AS low, max(value) AS high FROM tall GROUP BY 1)
SELECT attribute, CAST(CASE WHEN high = low THEN 0 ELSE least(floor((value - low) / ((high - low) / 21)), 20) END AS INT) AS bin, round(low, 4) AS low, round(high, 4) AS high, count(*) AS n
FROM tall JOIN ends USING (attribute) GROUP BY 1, 2, ends.low, ends.high"""))
def g11(spark, sf_dir):
    return rounded(graphs.attribute_histogram(views.tracks(spark, sf_dir), ["x", "y", "heading", "vx"]))
