"""Queries that SQL can't express, against plain Python on the smallest tables; chains without a bound."""

import collections
import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scenejobs.jobs import helper_queries
from scenejobs.operators import curves, graphs, lanes, polylines, tracing, vectorize
from scenejobs.sources import scenes, views


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: entry.queries()[name](spark, sf_dir).collect()


def test_long_chains_come_out_whole(spark):
    n = 110
    exits = spark.createDataFrame([(0, i, i + 1) for i in range(n)], "sid int, fid long, exit_fid long")
    sizes = spark.createDataFrame([(0, i, 1) for i in range(n + 1)], "sid int, fid long, n long")
    found = lanes.lane_sequences(exits, spark.createDataFrame([(0, 0), (0, n - 3)], "sid int, fid long"), sizes, 300).collect()
    assert sorted(r["path"] for r in found) == [list(range(n + 1)), [n - 3, n - 2, n - 1, n]]


def test_long_root_leaf_paths_come_out_whole(spark):
    n = 45
    ends = spark.createDataFrame([(0, i, i * 1.0 - 22.5, 0.0, i + 1.0 - 22.5, 0.0) for i in range(n)], "sid int, seg long, start_x double, start_y double, end_x double, end_y double")
    found = polylines.root_leaf_paths(ends, 22.5).collect()
    assert [r["path"] for r in found] == [list(range(n))]


def test_sample_is_drawn_by_hash(spark, sf_dir):
    ids = views.graph_edges(spark, sf_dir).select("graph_id").distinct()
    got = [r["graph_id"] for r in scenes.sample_k(ids, "graph_id", 20, 7).collect()]
    ranked = [r["graph_id"] for r in ids.withColumn("h", F.xxhash64(F.lit(7), "graph_id")).orderBy("h", "graph_id").collect()]
    assert got == ranked[:20] and len(set(got)) == 20 and got != [r["graph_id"] for r in scenes.sample_k(ids, "graph_id", 20, 8).collect()]


def test_convenience_equals_shortest_paths(spark, sf_dir, run):
    edges = collections.defaultdict(lambda: collections.defaultdict(dict))
    for e in views.graph_edges(spark, sf_dir).collect():
        for a, b in ((e["n1"], e["n2"]), (e["n2"], e["n1"])):
            edges[e["graph_id"]][a][b] = min(e["dist"], edges[e["graph_id"]][a].get(b, math.inf))

    def lengths(near, start):
        far, queue = {}, [(0.0, start)]
        while queue:
            d, node = heapq.heappop(queue)
            if node not in far:
                far[node] = d
                for other, step in near[node].items():
                    heapq.heappush(queue, (d + step, other))
        return far

    got = {r["graph_id"]: r["convenience"] for r in run("g3_convenience")}
    assert set(got) == set(edges)
    for g, near in edges.items():
        all_ = [d for a in near for b, d in lengths(near, a).items() if a < b]
        assert got[g] == pytest.approx(sum(all_) / len(all_), abs=1e-3)


def test_frechet_distance_equals_numpy(spark, sf_dir, run):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x, y = (np.array([r["embedding"] for r in rows if r["label"] % 2 == k], float) for k in (0, 1))
    a, b = np.cov(x.T), np.cov(y.T)
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * np.sqrt(np.linalg.eigvals(a @ b).astype(complex)).real.sum()
    assert run("g8_frechet_gaussian")[0]["frechet"] == pytest.approx(want, abs=2e-3)


def test_overlapping_sequences_go_in_order(spark):
    rows = [(0, 0, 0, [1, 2, 3]), (0, 0, 1, [2, 3]), (0, 0, 2, [9, 2, 3]), (0, 0, 3, [4, 5]), (0, 1, 0, [2, 3])]
    got = lanes.drop_overlapping(spark.createDataFrame(rows, "sid int, track_index int, pos int, path array<long>")).collect()
    assert sorted((r["track_index"], r["pos"]) for r in got) == [(0, 0), (0, 3), (1, 0)]


def test_kept_sequences_cover_all(spark, sf_dir, run):
    kept = collections.defaultdict(list)
    for r in run("l6_drop_overlapping"):
        kept[r["sid"]].append(r["path"].split(","))
    for r in run("l5_lane_sequences"):
        path = r["path"].split(",")
        assert any(path[1:] == k[1:] or set(path) <= set(k) for k in kept[r["sid"]])


def test_start_lane_may_pass_the_budget_by_one(spark):
    table = spark.createDataFrame([(0, 1, 121, [2], []), (0, 2, 5, [], [])], "sid int, lane_id long, n int, exits array<long>, neighbors array<struct<id:long,first:int,last:int>>")
    start = lambda at: spark.createDataFrame([(0, 7, 0, 1, at)], "sid int, agent int, pos int, lane_id long, start int")
    last = lambda at: [(r["lane_id"], r["last"]) for r in lanes.lane_bfs(start(at), table, 120, 9).orderBy("pos").collect()]
    assert last(0) == [(1, 121)] and last(2) == [(1, 121), (2, 1)]


def test_dense_nodes_of_a_block(spark):
    block = spark.createDataFrame([(0, r, c) for r in range(3) for c in range(3)] + [(0, 20, c) for c in range(9)], "image_id long, row int, col int")
    near = spark.createDataFrame([(0, 1, 1)], "image_id long, row int, col int")
    assert [(r["row"], r["col"]) for r in tracing.dense_nodes(block, near.limit(0)).collect()] == [(0, 0)]
    assert tracing.dense_nodes(block, near).count() == 0


def test_the_spline_equals_a_dense_solve():
    rng = np.random.default_rng(2)
    s = np.r_[0, np.cumsum(rng.uniform(0.5, 2, 40))]
    v, h = rng.normal(size=41), np.diff(s)
    m = np.zeros(41)
    m[1:-1] = np.linalg.solve(np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1), 6 * np.diff(np.diff(v) / h))
    assert np.allclose(curves.natural_spline(s, v, s)[2], m) and np.allclose(curves.natural_spline(s, v, s)[0], v)


def test_polynomial_fits_a_line_by_hand(spark):
    path = spark.createDataFrame([(0, 0, i, i / 9, 2.0) for i in range(10)], "image_id long, edge_id long, pt_idx int, x double, y double")
    rows = curves.fit_polynomials(path, 0.25).orderBy("k").collect()
    assert [r["x"] for r in rows] == pytest.approx([0, 0.25, 0.5, 0.75]) and all(r["y"] == pytest.approx(2) and r["curvature"] == pytest.approx(0, abs=1e-9) for r in rows)


def test_routes_keep_what_goes_on_smoothly(spark, sf_dir):
    edges, terminals, found = helper_queries._routes(spark, sf_dir)
    place = lambda n: (n % 10 * 8.0, n // 10 % 10 * 8.0)
    yaw = lambda n, other: math.atan2(place(other)[1] - place(n)[1], place(other)[0] - place(n)[0])
    near = collections.defaultdict(lambda: collections.defaultdict(list))
    for e in edges.collect():
        near[e["graph_id"]][e["n1"]].append(e["n2"])
        near[e["graph_id"]][e["n2"]].append(e["n1"])
    apart = lambda a, b: abs((a - b - math.pi + math.pi) % (2 * math.pi) - math.pi)

    def smooth(g, nodes):
        for left, n, right in zip(nodes, nodes[1:], nodes[2:]):
            name = lambda other: min(n, other) * 1000 + max(n, other)  # noqa: B023, E731
            votes = {a: min((x for x in near[g][n] if x != a), key=lambda x: (round(apart(yaw(n, a), yaw(n, x)), 9), name(x)), default=None) for a in near[g][n]}  # noqa: B023
            if votes[left] != right and votes[right] != left or apart(yaw(n, left), yaw(n, right)) >= math.pi / 4:
                return False
        return True

    all_ = {(r["graph_id"], r["source"], r["target"]): r["nodes"] for r in found.collect()}
    want = {k for k, nodes in all_.items() if smooth(k[0], nodes)}
    got = helper_queries.v17(spark, sf_dir).collect()
    assert all_ and {(r["graph_id"], r["source"], r["target"]) for r in got} == want
    for r in got:
        nodes = all_[r["graph_id"], r["source"], r["target"]]
        assert r["waypoints"].split(" ")[::3] == [":".join(str(int(c)) for c in place(n)) for n in nodes[:-1]]


def test_intersections_by_hand(spark):
    entries = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 0.0, 10.0, 0.0)], "image_id int, node long, x double, y double, yaw double")
    exits = spark.createDataFrame([(0, 3, 30.0, 0.0, 0.0), (0, 4, 20.0, -20.0, -math.pi / 2), (0, 5, 20.0, 20.0, math.pi / 2), (0, 6, -9.0, 0.0, math.pi)], "image_id int, node long, x double, y double, yaw double")
    line = lambda *p: [{"x": float(a), "y": float(b)} for a, b in p]
    arc = lambda s: line((0, 0), (8, s), (14, 5 * s), (18, 11 * s), (20, 20 * s))
    routes = [
        (0, 1, 3, [1, 10, 11, 3], line((0, 0), (30, 0))), (0, 1, 5, [1, 10, 12, 5], arc(1)), (0, 1, 4, [1, 10, 12, 4], line((0, 0), (-50, 50), (-60, 60))),
        (0, 1, 6, [1, 10, 11, 6], line((0, 0))), (0, 2, 3, [2, 10, 3], line((0, 10), (30, 0))), (0, 2, 5, [2, 10, 1, 11, 5], line((0, 10), (20, 20))),
    ]
    got = vectorize.connect_intersections(entries, exits, spark.createDataFrame(routes, "image_id int, source long, target long, nodes array<long>, waypoints array<struct<x:double,y:double>>")).collect()
    assert sorted((r["entry"], r["exit"], r["kind"]) for r in got) == [(1, 3, "straight"), (1, 5, "turn"), (2, 3, "direct")]
    assert all(len(r["curve"]) == 33 for r in got)


def test_reference_path_follows_its_lanes(spark):
    points = spark.createDataFrame([(0, lane, i, 10.0 * (lane - 1) + i, 0.0, 0.0) for lane in (1, 2, 3, 4) for i in range(10)], "sid int, fid long, pt_idx int, x double, y double, theta double")
    topology = spark.createDataFrame([(0, 1, None, 2), (0, 2, 1, 3), (0, 3, 2, 4), (0, 4, 3, None)], "sid int, fid long, entry long, exit long")
    track = spark.createDataFrame([(0, 5, t, 12.0 + t / 2, 0.1, 0.0) for t in range(21)], "sid int, track_index long, t int, x double, y double, heading double")
    rows = lanes.reference_path(track, points, topology, 10).orderBy("k").collect()
    x = [r["x"] for r in rows]
    assert x[0] == 0 and x[-1] == pytest.approx(37, abs=1) and np.allclose(np.diff(x), 0.1, atol=1e-3) and max(abs(r["y"]) for r in rows) < 1e-9
    assert len(lanes.reference_path(track, points, topology, 10, behind=20, length=50).collect()) == 50
    more = lanes.reference_path(track, points, topology, 10, every=5, length=2400, always_on=True).orderBy("k").collect()
    assert more[-1]["x"] == pytest.approx(37, abs=1)
    lost = lanes.reference_path(track.withColumn("heading", F.lit(2.0)), points, topology, 10)
    assert lost.count() == 0


def test_signal_and_speed_columns(spark):
    path = spark.createDataFrame([(0, 1, 0, 0.0, 0.0), (0, 1, 1, 5.0, 0.0)], "sid int, fid long, pt_idx int, x double, y double")
    signals = spark.createDataFrame([(0, 2, 0.1, 0.1, 4), (0, 1, 0.15, 0.0, 6), (0, 3, 5.3, 0.0, 1)], "sid int, signal_id int, x double, y double, state int")
    limits = spark.createDataFrame([(0, 1, 22.37)], "sid int, fid long, speed_limit_mph double")
    got = lanes.signal_and_speed(path, signals, limits).orderBy("pt_idx").collect()
    assert [(r["signal"], r["speed"]) for r in got] == [(6, pytest.approx(10)), (0, pytest.approx(10))]


def test_boxes_of_upright_rectangles(spark):
    pixels = spark.createDataFrame([(0, r, c, 0.9) for r in range(4, 8) for c in range(10, 20)], "image_id long, row int, col int, b double")
    found = tracing.agent_boxes(pixels, 0.5).collect()
    assert [(r["length"], r["width"], r["row"], r["col"]) for r in found] == [(5.0, 2.0, 5.5, 14.5)]


def test_traced_paths_are_steps(spark, sf_dir):
    rows = tracing.trace_graph(helper_queries._foreground(spark, sf_dir)).collect()
    assert rows and all(r["error"] is None and r["d"] == len(r["path"]) - 1 >= 4 for r in rows)
    for r in rows:
        p = r["path"]
        assert p[0] != p[-1] and all(max(abs(a["row"] - b["row"]), abs(a["col"] - b["col"])) == 1 for a, b in zip(p, p[1:]))


def test_every_graph_is_read(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(f"l_orderkey DIV {views.ORDERS_PER_GRAPH} AS g").distinct().count()
    assert graphs.edge_nodes(views.graph_edges(spark, sf_dir)).select("graph_id").distinct().count() == orders
