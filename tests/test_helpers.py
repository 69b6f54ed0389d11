"""The numpy helpers against plain searches."""

import numpy as np
import pytest
from scenejobs.operators import curves, graphs, lanes, tracing


def test_labels_equal_flood_fill():
    rng = np.random.default_rng(4)
    image = rng.random((30, 30)) < 0.35
    row, col = np.nonzero(image)
    number = tracing.label(row, col)
    want, k = np.full(image.shape, -1), 0
    for start in zip(row.tolist(), col.tolist()):
        if want[start] >= 0:
            continue
        stack = [start]
        want[start] = k
        while stack:
            r, c = stack.pop()
            for dr, dc in tracing.AROUND:
                q = (r + dr, c + dc)
                if 0 <= q[0] < 30 and 0 <= q[1] < 30 and image[q] and want[q] < 0:
                    want[q] = k
                    stack.append(q)
        k += 1
    pairs = set(zip(number.tolist(), want[row, col].tolist()))
    assert len(pairs) == k == number.max() + 1


def test_smallest_box_equals_a_fine_search():
    rng = np.random.default_rng(2)
    for _ in range(10):
        p = rng.normal(size=(25, 2)) * (4, 1)
        cx, cy, long, short, angle = tracing.smallest_box(p)
        angles = np.linspace(0, np.pi / 2, 4000)
        areas = [np.prod(np.ptp(p @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]), axis=0)) for a in angles]
        assert long >= short and long * short == pytest.approx(min(areas), rel=2e-3)
        u = (p - (cx, cy)) @ np.array([np.cos(angle), np.sin(angle)])
        assert np.abs(u).max() == pytest.approx(long / 2)


def test_thinning_keeps_the_shape():
    image = np.zeros((20, 30), bool)
    image[8:11, 2:28] = True
    thin = tracing.thinned(image)
    assert thin.sum() <= 28 and (thin <= image).all() and set(np.nonzero(thin)[0].tolist()) == {9}


def test_tracing_a_cross_and_merging():
    skeleton = {(5, c) for c in range(11)} | {(r, 5) for r in range(11)}
    nodes = tracing.crossing_nodes(skeleton)
    assert nodes == {(5, 0), (5, 10), (0, 5), (10, 5), (5, 5)}
    paths = tracing.paths_between(skeleton, nodes)
    ends = {p for path in paths for p in (path[0], path[-1])}
    assert {(5, 0), (5, 10), (0, 5), (10, 5)} <= ends
    joined = tracing.joined_paths(skeleton, nodes, 3)
    assert len([p for p in joined if (5, 5) in p]) == 4 and len({p for path in joined for p in (path[0], path[-1])}) == 5


def test_merged_nodes_leave_no_gap():
    # two crossings two steps apart become one in their middle, and paths run up to it
    skeleton = {(5, c) for c in range(20)} | {(r, 9) for r in range(6)} | {(r, 11) for r in range(5, 11)}
    joined = tracing.joined_paths(skeleton, tracing.crossing_nodes(skeleton), 4)
    assert {p for path in joined for p in (path[0], path[-1])} == {(5, 0), (5, 19), (0, 9), (10, 11), (5, 10)}
    assert all(max(abs(a - c), abs(b - d)) == 1 for path in joined for (a, b), (c, d) in zip(path, path[1:]))


def test_dense_blocks_and_twin_paths():
    assert tracing.block_centres({(r, c) for r in range(3) for c in range(3)}) == [(0, 0)]
    assert tracing.block_centres({(0, c) for c in range(5)}) == []
    ring = {(r, c) for r in range(9) for c in range(9) if r in (0, 8) or c in (0, 8)}
    twins = tracing.paths_between(ring, {(0, 0), (8, 8)})
    assert len(twins) == 2 and set(twins[0][1:-1]).isdisjoint(twins[1][1:-1])
    assert tracing.paths_between(ring, {(0, 0)}) == [] and tracing.paths_between(set(), set()) == []


def test_boxes_and_bad_images(spark):
    cells = [(1, r, c, 1.0) for r in range(4, 8) for c in range(10, 22)] + [(2, 0, 0, 1.0)]
    got = tracing.agent_boxes(spark.createDataFrame(cells, "image_id long, row int, col int, b double"), 0.4).collect()
    assert got == []  # 1.6 m is too narrow
    wide = tracing.agent_boxes(spark.createDataFrame(cells, "image_id long, row int, col int, b double"), 0.5).collect()
    assert [(r["image_id"], r["length"], r["width"], r["height"]) for r in wide] == [(1, 5.0, 2.0, 1.0)]

    def fail(frame):
        raise ValueError("bad")

    rows = tracing.per_image(spark.createDataFrame(cells, "image_id long, row int, col int, b double"), fail, "image_id long, error string").collect()
    assert {r["error"] for r in rows} == {"bad"} and len(rows) == 2


def test_spline_equals_its_definition():
    s, v = np.array([0.0, 1.0, 2.5, 4.0]), np.array([1.0, 3.0, -1.0, 2.0])
    at = np.linspace(0, 4, 401)
    value, first, second = curves.natural_spline(s, v, at)
    assert curves.natural_spline(s, v, s)[0] == pytest.approx(v)
    assert second[0] == pytest.approx(0) and second[-1] == pytest.approx(0)
    assert np.gradient(value, at)[1:-1] == pytest.approx(first[1:-1], abs=5e-3)
    assert np.abs(np.diff(second)).max() < 0.2


@pytest.mark.parametrize("method", ["spline", "polynomial"])
def test_fits_of_a_circle_and_of_a_point(spark, method):
    t = np.linspace(0, 1, 12)
    rows = [(0, 0, i, 20 * np.sin(a), 20 - 20 * np.cos(a)) for i, a in enumerate(t.tolist())] + [(0, 1, i, 3.0, 3.0) for i in range(3)]
    rows = [(a, b, i, float(x), float(y)) for a, b, i, x, y in rows]
    fit = curves.fit_splines if method == "spline" else curves.fit_polynomials
    got = fit(spark.createDataFrame(rows, "image_id long, edge_id long, pt_idx int, x double, y double"), 0.5).collect()
    circle = [r for r in got if r["edge_id"] == 0]
    assert np.hypot([r["x"] for r in circle], [r["y"] - 20 for r in circle]) == pytest.approx(20, abs=0.05)
    assert np.median([r["curvature"] for r in circle]) == pytest.approx(0.05, abs=0.01)
    assert [r["error"] for r in got if r["edge_id"] == 1] == ["fewer than two different points"]


def test_overlapping_sequences(spark):
    rows = [(0, 1, 0, [1, 2, 3]), (0, 1, 1, [9, 2, 3]), (0, 1, 2, [2, 3]), (0, 1, 3, [4, 5]), (0, 2, 0, [2, 3])]
    got = lanes.drop_overlapping(spark.createDataFrame(rows, "sid int, track_index int, pos int, path array<long>")).orderBy("track_index", "pos").collect()
    assert [(r["track_index"], r["pos"]) for r in got] == [(1, 0), (1, 3), (2, 0)]


def test_routes_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    pairs = sorted({tuple(sorted(map(int, rng.choice(12, 2, replace=False)))) for _ in range(22)})
    rows = [(0, i, a, b, float(rng.integers(1, 9))) for i, (a, b) in enumerate(pairs)]
    d = np.full((12, 12), np.inf)
    np.fill_diagonal(d, 0)
    for _, _, a, b, w in rows:
        d[a, b] = d[b, a] = w
    for k in range(12):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    ends = spark.createDataFrame([(0, n, "inlet" if n < 5 else "outlet") for n in range(12)], "graph_id int, node long, kind string")
    got = graphs.routes(spark.createDataFrame(rows, "graph_id int, edge_id long, n1 long, n2 long, dist double"), ends).collect()
    assert {(r["source"], r["target"]): r["length"] for r in got} == {(a, b): d[a, b] for a in range(5) for b in range(5, 12) if np.isfinite(d[a, b])}
    dist = {i: w for _, i, _, _, w in rows}
    assert all(sum(dist[e] for e in r["edge_ids"]) == r["length"] for r in got)


def test_lane_search_by_hand(spark):
    known = [(0, 1, 10, [2, 3], []), (0, 2, 10, [4], [(5, 2, 6)]), (0, 3, 40, [], []), (0, 4, 10, [1], []), (0, 5, 10, [], [])]
    table = spark.createDataFrame(known, "sid int, lane_id long, n int, exits array<long>, neighbors array<struct<id:long,first:int,last:int>>")
    starts = spark.createDataFrame([(0, 7, 0, 1, 4)], "sid int, agent int, pos int, lane_id long, start int")
    got = lanes.lane_bfs(starts, table, 30, 10).orderBy("pos").collect()
    assert [(r["lane_id"], r["first"], r["last"], r["reached"]) for r in got] == [(1, 4, 10, 6), (5, 2, 7, 11), (2, 0, 10, 16), (3, 0, 24, 30), (4, 0, 10, 26)]
    assert [r["lane_id"] for r in lanes.lane_bfs(starts, table, 30, 2).orderBy("pos").collect()] == [1, 5]
    alone = lanes.lane_bfs(starts, table, 3, 9).collect()
    assert [(r["lane_id"], r["first"], r["last"], r["reached"]) for r in alone] == [(1, 4, 7, 3)]
