"""Scene tables derived from the driver's tables, as DataFrames and as DuckDB views of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lanes and users of a scene. Scenes are blocks of ids, so their number grows with the tables and not their size.
LANES_PER_SCENE, USERS_PER_SCENE = 25, 20
#: Steps of a track; a user's further events make further tracks.
TRACK_STEPS = 91
#: A user's tracks are numbered from the user's id times this.
TRACKS_PER_USER = 100_000
#: Orders whose lines make up one graph.
ORDERS_PER_GRAPH = 20


def lane_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, fid, pt_idx, global_type, x, y, z: lanes of 32 points walked along the embeddings."""
    return _table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding", "explode(sequence(0, 31)) AS i").selectExpr(
        f"vec_id DIV {LANES_PER_SCENE} AS sid", "vec_id AS fid", "i AS pt_idx", "CASE vec_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS global_type",
        *[
            f"CAST((vec_id * {m}) % 81 - 40 AS DOUBLE) + 8 * SUM(CAST(element_at(embedding, 2 * i + {k}) AS DOUBLE)) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}"
            for c, m, k in (("x", 37, 1), ("y", 53, 2))
        ],
        "0.0D AS z",
    )


def tracks(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """sid, track_index, object_type, t, x, y, z, length, width, height, heading, vx, vy, valid: one row per step.

    together: a scene's events move to one task, so that grouping by sid and more moves no steps again.
    """
    rows = _table(spark, sf_dir, "events").selectExpr("*", f"user_id DIV {USERS_PER_SCENE} AS scene")
    rows = rows.repartition("scene") if together else rows
    rows = rows.selectExpr("*", f"row_number() OVER (PARTITION BY {'scene, ' if together else ''}user_id ORDER BY ts, event_id) - 1 AS rn")
    return rows.selectExpr(
        "scene AS sid", f"user_id * {TRACKS_PER_USER} + rn DIV {TRACK_STEPS} AS track_index", "CASE user_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS object_type",
        f"rn % {TRACK_STEPS} AS t", "value / 5.0D - 50.0D AS x", "CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) - 50.0D AS y", "0.0D AS z", "4.0D + user_id % 3 AS length", "1.75D + (user_id % 5) * 0.1D AS width",
        "1.5D AS height", "value / 50.0D - 4.0D AS heading", "value / 25.0D - 10.0D AS vx", "CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / 5.0D - 10.0D AS vy",
        "event_type <> 'error' AS valid",
    )


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, sdc_track_index (smallest track at step 10), predict_list (the three smallest)."""
    at_ten = tracks(spark, sf_dir).where("t = 10")
    return at_ten.groupBy("sid").agg({"track_index": "collect_set"}).selectExpr("sid", "array_min(`collect_set(track_index)`) AS sdc_track_index", "slice(array_sort(`collect_set(track_index)`), 1, 3) AS predict_list")


def graph_edges(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """graph_id, n1, n2, dist; even graphs stand for recorded maps, odd ones for generated maps. together: a graph's lines move to one task before they are summed up."""
    rows = _table(spark, sf_dir, "lineitem")
    rows = rows.selectExpr(f"l_orderkey DIV {ORDERS_PER_GRAPH} AS graph_id", "l_suppkey % 40 AS n1", "100 + l_partkey % 40 AS n2", "CAST(l_quantity AS DOUBLE) AS q")
    rows = rows.repartition("graph_id") if together else rows
    return rows.groupBy("graph_id", "n1", "n2").agg({"q": "max"}).withColumnRenamed("max(q)", "dist")


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, fid, rank, beside: lanes ranked within their scenario, and the next one as left neighbour."""
    of = f"OVER (PARTITION BY vec_id DIV {LANES_PER_SCENE} ORDER BY vec_id)"
    return _table(spark, sf_dir, "embeddings").selectExpr(f"vec_id DIV {LANES_PER_SCENE} AS sid", "vec_id AS fid", f"row_number() {of} AS rank", f"lead(vec_id) {of} AS beside")


def lane_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, fid, rank, exit_fid: lane r of a scenario leads to lanes 2r and 2r + 1."""
    ranked = lanes(spark, sf_dir)
    return ranked.alias("a").join(ranked.alias("b"), F.expr("a.sid = b.sid AND b.rank >= 2 AND a.rank = b.rank DIV 2")).selectExpr("a.sid", "a.fid", "a.rank", "b.fid AS exit_fid")


VIEWS = {
    "lane_points": f"""lane_points AS (
  SELECT vec_id // {LANES_PER_SCENE} AS sid, vec_id AS fid, CAST(i AS INT) AS pt_idx, CAST(CASE vec_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS INT) AS global_type,
    CAST((vec_id * 37) % 81 - 40 AS DOUBLE) + 8 * SUM(CAST(embedding[CAST(2 * i + 1 AS INT)] AS DOUBLE)) OVER w AS x,
    CAST((vec_id * 53) % 81 - 40 AS DOUBLE) + 8 * SUM(CAST(embedding[CAST(2 * i + 2 AS INT)] AS DOUBLE)) OVER w AS y, CAST(0 AS DOUBLE) AS z
  FROM embeddings, (SELECT unnest(range(32)) AS i) WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "tracks": f"""tracks AS (
  SELECT user_id // {USERS_PER_SCENE} AS sid, user_id * {TRACKS_PER_USER} + rn // {TRACK_STEPS} AS track_index, CAST(CASE user_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS INT) AS object_type,
    CAST(rn % {TRACK_STEPS} AS INT) AS t, CAST(value AS DOUBLE) / 5 - 50 AS x,
    CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) - 50 AS y, CAST(0 AS DOUBLE) AS z, CAST(4 + user_id % 3 AS DOUBLE) AS length,
    CAST(1.75 AS DOUBLE) + CAST(user_id % 5 AS DOUBLE) * CAST(0.1 AS DOUBLE) AS width, CAST(1.5 AS DOUBLE) AS height, CAST(value AS DOUBLE) / 50 - 4 AS heading,
    CAST(value AS DOUBLE) / 25 - 10 AS vx, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / 5 - 10 AS vy, event_type <> 'error' AS valid
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events) q)""",
    "scenarios": """scenarios AS (
  SELECT sid, min(track_index) AS sdc_track_index, list_sort(list(track_index))[1:3] AS predict_list FROM tracks WHERE t = 10 GROUP BY sid)""",
    "graph_edges": f"""graph_edges AS (
  SELECT l_orderkey // {ORDERS_PER_GRAPH} AS graph_id, l_suppkey % 40 AS n1, 100 + l_partkey % 40 AS n2, CAST(MAX(l_quantity) AS DOUBLE) AS dist
  FROM lineitem GROUP BY 1, 2, 3)""",
    "lane_topology": f"""lane_rank AS (SELECT vec_id // {LANES_PER_SCENE} AS sid, vec_id AS fid, row_number() OVER (PARTITION BY vec_id // {LANES_PER_SCENE} ORDER BY vec_id) AS rank FROM embeddings),
lane_topology AS (SELECT a.sid, a.fid, a.rank, b.fid AS exit_fid FROM lane_rank a JOIN lane_rank b ON a.sid = b.sid AND b.rank >= 2 AND a.rank = b.rank // 2)""",
}


def with_views(names: list[str], body: str) -> str:
    """DuckDB SQL: the named views as common tables, then the body (further tables, then SELECT)."""
    body = body.strip()
    head = "WITH RECURSIVE " + ",\n".join(VIEWS[n] for n in names)
    return f"{head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"{head}\n{body}"
