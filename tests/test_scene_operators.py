"""Hand-computed cases of the scene operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from scenejobs.operators import agents, graphs, lanes, maps, polylines, raster, vectorize
from scenejobs.sources import scenes

LANE = "sid int, fid long, pt_idx int, global_type int, x double, y double, z double"


def _lane(spark, *polylines_, kind=2):
    return spark.createDataFrame([(0, f, i, kind, float(x), float(y), 0.0) for f, line in enumerate(polylines_) for i, (x, y) in enumerate(line)], LANE)


def test_direction_and_heading(spark):
    points = _lane(spark, [(5, 5)], [(0, 0), (-1, 0)], [(0, 0), (3, 4), (3, 5)])
    rows = {(r["fid"], r["pt_idx"]): r for r in maps.polyline_heading(maps.polyline_direction(points)).collect()}
    assert rows[0, 0]["theta"] == 0 and rows[0, 0]["dir_x"] == 0
    assert rows[1, 0]["theta"] == pytest.approx(-math.pi) and rows[1, 1]["dir_x"] == -1
    assert rows[2, 1]["dir_x"] == pytest.approx(0.6) and rows[2, 2]["theta"] == pytest.approx(math.pi / 2)


def test_unit_square_ring(spark):
    rows = maps.densify_polygon(_lane(spark, [(0, 0), (1, 0), (1, 1), (0, 1)])).collect()
    assert len(rows) == 12 and {r["edge"] for r in rows} == {0, 1, 2, 3}


def test_explode_map(spark):
    pt = lambda x: (float(x), 0.0, 0.0)
    empty = dict.fromkeys(["lane", "road_line", "road_edge", "stop_sign", "crosswalk", "speed_bump", "driveway"])
    feature = lambda i, **k: {"id": i, **empty, **k}
    lane = {"type": 2, "speed_limit_mph": 25.0, "polyline": [pt(0), pt(1)], "entry_lanes": [], "exit_lanes": [], "left_neighbors": [], "right_neighbors": []}
    rows = [("s", 0, 10, [0], [feature(1, lane=lane), feature(2, stop_sign={"position": pt(7)}), feature(3, road_line={"type": 99, "polyline": [pt(3)]})], [])]
    got = maps.explode_map(spark.createDataFrame(rows, scenes.SCENARIO)).collect()
    assert [(r["feature_id"], r["kind"], r["pt_idx"], r["x"], r["global_type"]) for r in got] == [(1, "lane", 0, 0.0, 2), (1, "lane", 1, 1.0, 2), (2, "stop_sign", 0, 7.0, 17), (3, "road_line", 0, 3.0, -1)]
    with pytest.raises(Exception, match="feature without a kind"):
        maps.explode_map(spark.createDataFrame([("s", 0, 10, [0], [feature(4)], [])], scenes.SCENARIO)).collect()


def test_explode_tracks_and_round_trip(spark, tmp_path):
    state = (1.0, 2.0, 0.0, 4.0, 2.0, 1.5, 7.0, 1.0, 0.0, True)
    df = spark.createDataFrame([("s", 0, 10, [0], [], [(5, 1, [state, state])])], scenes.SCENARIO)
    scenes.write_scenarios(df, str(tmp_path / "x"), 3)
    rows = agents.explode_tracks(scenes.read_scenarios(spark, str(tmp_path / "x"))).collect()
    assert len(rows) == 2 and rows[0]["heading"] == pytest.approx(7 - 2 * math.pi) and rows[1]["t"] == 1


def test_gap_of_exactly_one_doesnt_break(spark):
    rows = polylines.segment_on_gap(maps.polyline_direction(_lane(spark, [(0, 0), (1, 0), (2.5, 0)]))).orderBy("pt_idx").collect()
    assert [r["seg"] for r in rows] == [0, 0, 1] and rows[0]["dir_x"] == 1


@pytest.mark.parametrize("n", [20, 21])
def test_chunks(spark, n):
    segments = polylines.segment_on_gap(maps.polyline_direction(_lane(spark, [(i, 0) for i in range(n)])))
    rows = polylines.chunk_pad(segments, 20).orderBy("chunk").collect()
    assert [sum(r["valid"]) for r in rows] == ([20] if n == 20 else [20, 1])


def test_constant_direction_and_resample(spark):
    points = maps.polyline_heading(maps.polyline_direction(_lane(spark, [(0, 0), (1, 0), (2, 0), (4, 0)])))
    assert {r["dir_y"] for r in polylines.normalize_direction(points).collect()} == {0.0}
    rows = polylines.resample(points, 5).orderBy("k").collect()
    assert [r["x"] for r in rows] == pytest.approx([0, 1, 2, 3, 4]) and {r["theta"] for r in rows} == {0.0}
    assert [r["dir_x"] for r in rows] == pytest.approx([0, 0.25, 0.5, 0.75, 1])  # directions turn in the first step only


def test_pack_and_unpack(spark):
    lines = spark.createDataFrame([(0, 5, 1.0), (0, 7, 2.0)], "sid int, fid long, v double")
    packed = polylines.pack(lines, 3, ["v"])
    assert [(r["mask"], r["v"]) for r in packed.orderBy("slot").collect()] == [(1, 1.0), (1, 2.0), (0, 0.2)]
    assert [r["v"] for r in polylines.unpack(packed).orderBy("slot").collect()] == [1.0, 2.0]
    known = spark.createDataFrame([(0,), (3,)], "sid int")
    packed = polylines.pack(lines.withColumn("a", F.array("v", "v")), 2, ["a"], scenarios=known)
    assert [(r["sid"], r["mask"], r["empty"], r["a"]) for r in packed.orderBy("sid", "slot").collect()] == [(0, 1, False, [1, 1]), (0, 1, False, [2, 2]), (3, 0, True, [0, 0]), (3, 0, True, [0, 0])]


TRACK = "sid int, track_index long, object_type int, t int, x double, y double, z double, length double, width double, height double, heading double, vx double, vy double, valid boolean"


def _track(spark, rows):
    return spark.createDataFrame([(0, k, 1, t, float(x), float(y), 0.0, 4.0, 2.0, 1.5, h, vx, vy, True) for k, t, x, y, h, vx, vy in rows], TRACK)


def test_impute_is_idempotent_and_keeps_the_end(spark):
    rows = _track(spark, [(1, 0, 0, 0, 0.0, 0.0, 0.0), (1, 1, 0, 0, 0.0, 0.0, 0.0), (1, 2, 9, 4, 0.5, 10.0, 0.0), (1, 3, 0, 0, 0.0, 0.0, 0.0)])
    once = agents.impute_backward(rows)
    assert [r["x"] for r in once.orderBy("t").collect()] == pytest.approx([7, 8, 9, 0])
    assert once.orderBy("t").collect() == agents.impute_backward(once).orderBy("t").collect()


def test_center_frame_and_back(spark):
    rows = _track(spark, [(1, 10, 3, 4, 1.0, 2.0, 1.0), (1, 11, 4, 6, 1.0, 2.0, 1.0)])
    centers = agents.center_objects(rows, spark.createDataFrame([(0, 1, [1])], "sid int, sdc_track_index long, predict_list array<long>"))
    there = agents.to_center_frame(rows, centers)
    back = agents.predictions_to_world(there.select("sid", "center_index", "t", "x", "y"), centers).orderBy("t").collect()
    assert [(r["x"], r["y"]) for r in back] == [pytest.approx((3, 4)), pytest.approx((4, 6))]
    features = agents.agent_features(there, spark.createDataFrame([(0, 1)], "sid int, sdc_track_index long")).collect()[0]["features"]
    assert len(features) == 29 and features[9] == 1 and features[10] == 1 and features[21] == 1


def test_an_occluder_on_the_line_hides(spark):
    def seen(oy):
        states = spark.createDataFrame([(0, 0, 1, True, 0.0, 0.0, 4.0, 2.0, 0.0), (0, 0, 2, False, 20.0, 1.0, 4.0, 2.0, 0.0), (0, 0, 3, False, 10.0, oy, 4.0, 2.0, 0.0)], "sid int, t int, track_index long, is_ego boolean, x double, y double, length double, width double, heading double")
        return {r["target"] for r in agents.visible_agents(states, 50.0).collect()}

    assert seen(0.5) == {3} and seen(5.0) == {2, 3}


def test_modes_of_one_and_ties(spark):
    rows = [(0, 0, i, 1.0, v, 0.0) for i, v in enumerate([0.1, 0.1, 0.9, 0.9])]
    modes = {r["channel"]: r["mode"] for r in raster.channel_mode(spark.createDataFrame(rows, "image_id int, row int, col int, r double, g double, b double")).collect()}
    assert modes == {"r": 255 / 256, "g": 25 / 256, "b": 0.0}


def test_crossing_numbers(spark):
    line = spark.createDataFrame([(0, 5, c) for c in range(5)] + [(0, 4, 2), (0, 3, 2)], "image_id int, row int, col int")
    got = {(r["row"], r["col"]): r["crossings"] for r in vectorize.skeleton_nodes(line).collect()}
    assert got[5, 0] == 1 and got[3, 2] == 1 and (5, 1) not in got


def test_downsampled_paths(spark):
    path = lambda n: spark.createDataFrame([(0, 0, i) for i in range(n)], "image_id int, edge_id int, pt_idx int")
    kept = lambda n: [r["pt_idx"] for r in vectorize.downsample_path(path(n), 4).orderBy("k").collect()]
    assert kept(3) == [1, 2] and kept(8) == [0, 7] and kept(11) == [0, 4, 8, 10] and kept(9) == [0, 4, 8]


def test_lane_cycles_end(spark):
    exits = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 2, 3)], "sid int, fid long, exit_fid long")
    sizes = spark.createDataFrame([(0, i, 10) for i in (1, 2, 3)], "sid int, fid long, n long")
    starts = spark.createDataFrame([(0, 1)], "sid int, fid long")
    assert [r["path"] for r in lanes.lane_sequences(exits, starts, sizes).collect()] == [[1, 2, 3]]


EDGES = "graph_id int, n1 long, n2 long, dist double"


def test_graph_statistics_by_hand(spark):
    edges = spark.createDataFrame([(0, 1, 2, 3.0), (1, 1, 1, 5.0), (2, 1, 2, 1.0), (2, 3, 4, 2.0), (3, 1, 2, 1.0), (3, 2, 3, 1.0), (3, 1, 3, 5.0)], EDGES)
    stats = {r["graph_id"]: r for r in graphs.graph_stats(edges, graphs.edge_nodes(edges).select("graph_id", "node", F.lit(0.5).alias("yaw"))).collect()}
    assert stats[1]["connectivity"] == 2 and stats[1]["spectrum"] == 0 and stats[2]["connectivity"] == 1
    assert {r["graph_id"]: r["convenience"] for r in graphs.convenience(edges).collect()} == {0: 3.0, 1: 0.0, 2: 1.5, 3: pytest.approx(4 / 3)}


def test_trace_is_the_eigenvalue_sum(spark):
    rng = np.random.default_rng(1)
    rows = [(0, int(a), int(b), float(d)) for (a, b), d in zip({tuple(sorted(rng.choice(9, 2, replace=False))) for _ in range(14)}, rng.random(14))]
    lap = np.zeros((9, 9))
    for _, a, b, d in rows:
        lap[[a, b], [a, b]] += d
        lap[[a, b], [b, a]] -= d
    edges = spark.createDataFrame(rows, EDGES)
    got = graphs.graph_stats(edges, graphs.edge_nodes(edges).select("graph_id", "node", F.lit(None).cast("double").alias("yaw"))).collect()[0]
    assert got["spectrum"] == pytest.approx(np.linalg.eigvalsh(lap).sum()) and got["orientation"] is None


def test_distances_of_equal_samples_are_zero(spark):
    x = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.0, 5.0)], "value double")
    y = spark.createDataFrame([(v,) for v in (0.0, 3.0)], "value double")
    one = lambda df: df.collect()[0][0]
    assert one(graphs.wasserstein_1d(x, x)) == 0 and one(graphs.mmd(x, x)) == pytest.approx(0)
    assert one(graphs.mmd(x, y)) == pytest.approx(one(graphs.mmd(y, x))) and one(graphs.wasserstein_1d(x, y)) == pytest.approx(1.5)
    v = np.random.default_rng(0).normal(size=(50, 2))
    df, far = (spark.createDataFrame([(list(map(float, r + d)),) for r in v], "vector array<double>") for d in (0, 3))
    assert one(graphs.frechet_gaussian(df, df)) == pytest.approx(0, abs=1e-6) and one(graphs.frechet_gaussian(df, far)) == pytest.approx(18, abs=1e-6)
