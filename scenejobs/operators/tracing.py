"""Per-image work on foreground pixels: labels, boxes, thinning and path tracing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenejobs.functions.tables import written
from scenejobs.operators.components import AROUND, TILE, label, labelled, skeleton, thinned  # noqa: F401  thinned is part of this module, too


def per_image(pixels: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work() on each image's pixels; an image that fails gives one row with error set."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        image = frame["image_id"].iloc[0]
        try:
            out = work(frame).assign(image_id=image, error=None)
        except Exception as e:  # noqa: BLE001  one bad image doesn't end the job
            out = pd.DataFrame([dict.fromkeys(names) | {"image_id": image, "error": str(e)}])
        return out.reindex(columns=names)

    return pixels.groupBy("image_id").applyInPandas(run, schema)


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    """Twice the signed area of a triangle: positive where a, b, c turn counter-clockwise."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def smallest_box(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """cx, cy, long side, short side and angle of the least-area rectangle around points.

    One side lies along an edge of the hull, so each hull edge is tried.
    """
    p = np.unique(points, axis=0)

    def chain(order: np.ndarray) -> list:
        out: list = []
        for q in order:
            while len(out) > 1 and _turn(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    hull = np.array(chain(p) + chain(p[::-1])) if len(p) > 2 else p
    edges = np.roll(hull, -1, axis=0) - hull
    best = None
    for angle in np.unique(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2)) if len(hull) > 1 else [0.0]:
        c, s = np.cos(angle), np.sin(angle)
        turned = hull @ np.array([[c, -s], [s, c]])
        low, high = turned.min(axis=0), turned.max(axis=0)
        size, middle = high - low, (low + high) / 2 @ np.array([[c, s], [-s, c]])
        if best is None or size.prod() < best[0] - 1e-9:
            best = size.prod(), middle, size, angle
    _, middle, size, angle = best
    return (*middle, size[0], size[1], angle) if size[0] >= size[1] else (*middle, size[1], size[0], angle + np.pi / 2)


def agent_boxes(pixels: DataFrame, scale: float, least: tuple[float, float] = (4.0, 1.75), most: tuple[float, float] = (5.0, 2.2), tile: int = TILE) -> DataFrame:
    """image_id, agent_idx, row, col, length, width, height, yaw, error of the blue components.

    A pixel is blue above 100 / 255; boxes count pixels' extents, scale metres each; small boxes
    are dropped and sizes clamped, height is 1. Components are numbered by their least pixel. A
    component is a group of its own, of the outer pixels of its rows; one that fails gives a
    row with error set.
    """
    parts = labelled(pixels.where("b * 255 > 100").select("image_id", "row", "col"), tile)
    numbers = parts.select("image_id", "first").distinct().withColumn("agent_idx", (F.row_number().over(W.partitionBy("image_id").orderBy("first")) - 1).cast("int"))
    outline = parts.groupBy("image_id", "first", "row").agg(F.min("col").alias("left"), F.max("col").alias("right"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        keys = {"image_id": frame["image_id"].iloc[0], "first": frame["first"].iloc[0]}
        try:
            row, left, right = (frame[c].to_numpy(dtype=float) for c in ("row", "left", "right"))
            corners = np.concatenate([np.column_stack([side + dc, row + dr]) for side, dc in ((left, -0.5), (right, 0.5)) for dr in (-0.5, 0.5)])
            col, row, length, width, yaw = smallest_box(corners)
            return pd.DataFrame([keys | {"row": row, "col": col, "length": length * scale, "width": width * scale, "yaw": yaw, "error": None}])
        except Exception as e:  # noqa: BLE001  one bad component doesn't end the job
            return pd.DataFrame([keys | dict.fromkeys(["row", "col", "length", "width", "yaw"]) | {"error": str(e)}])

    kind = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}["image_id"]
    found = outline.groupBy("image_id", "first").applyInPandas(work, f"image_id {kind}, first long, row double, col double, length double, width double, yaw double, error string")
    kept = found.where((F.col("error").isNotNull()) | (F.col("length") >= least[0]) & (F.col("width") >= least[1]))
    kept = kept.join(numbers, ["image_id", "first"]).withColumns({"length": F.least("length", F.lit(most[0])), "width": F.least("width", F.lit(most[1])), "height": F.lit(1.0)})
    return kept.select("image_id", "agent_idx", "row", "col", "length", "width", "yaw", "error", "height")


def dense_centres(thin: DataFrame, nodes: DataFrame, apart: float = 5.0, tile: int = TILE) -> DataFrame:
    """image_id, row, col, size, kept: truncated centres of the 2 x 2-eroded skeleton's components, and whether they are apart from every node."""
    eroded = thin
    for dr, dc in ((0, 1), (1, 0), (1, 1)):
        shifted = thin.select("image_id", (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"))
        eroded = eroded.join(shifted, ["image_id", "row", "col"], "left_semi")
    parts = labelled(eroded.select("image_id", "row", "col"), tile).groupBy("image_id", "first")
    mean = lambda c: F.expr(f"CAST(sum({c}) DIV count(1) AS INT)").alias(c)
    centres = written(parts.agg(mean("row"), mean("col"), F.count(F.lit(1)).alias("size")))
    cell = lambda c: F.floor(F.col(c) / apart)
    around = F.explode(F.array(*[F.struct((cell("row") + i).alias("gr"), (cell("col") + j).alias("gc")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spots = nodes.select("image_id", F.col("row").alias("r"), F.col("col").alias("c"), around.alias("g")).select("image_id", "r", "c", "g.gr", "g.gc")
    met = centres.withColumns({"gr": cell("row"), "gc": cell("col")}).join(spots, ["image_id", "gr", "gc"]).where(F.hypot(F.col("row") - F.col("r"), F.col("col") - F.col("c")) < apart)
    met = met.select("image_id", "first").distinct().withColumn("met", F.lit(True))
    return centres.join(met, ["image_id", "first"], "left").select("image_id", "row", "col", "size", F.isnull("met").alias("kept"))


def dense_nodes(thin: DataFrame, nodes: DataFrame, apart: float = 5.0, tile: int = TILE) -> DataFrame:
    """image_id, row, col: the dense centres that are apart from every node."""
    return dense_centres(thin, nodes, apart, tile).where("kept").select("image_id", "row", "col")


Pixel = tuple[int, int]


def crossing_nodes(skeleton: set[Pixel]) -> set[Pixel]:
    """Pixels whose crossing number is 1 or at least 3, as vectorize.skeleton_nodes has them."""
    ring = {(r, c): [(r + dr, c + dc) in skeleton for dr, dc in AROUND] for r, c in skeleton}
    count = {p: sum(not on[i - 1] and on[i] for i in range(8)) for p, on in ring.items()}
    return {p for p, n in count.items() if n == 1 or n >= 3}


def block_centres(skeleton: set[Pixel]) -> list[Pixel]:
    """Truncated centres of the components that a 2 x 2 erosion leaves, as in dense_nodes()."""
    left = sorted((r, c) for r, c in skeleton if {(r + 1, c), (r, c + 1), (r + 1, c + 1)} <= skeleton)
    if not left:
        return []
    at = np.array(left)
    number = label(at[:, 0], at[:, 1])
    return [tuple(at[number == k].mean(axis=0).astype(int).tolist()) for k in range(number.max() + 1)]


def paths_between(skeleton: set[Pixel], nodes: set[Pixel]) -> list[list[Pixel]]:
    """Paths over the skeleton between different nodes, shortest first.

    All nodes flood the skeleton at once, so each pixel belongs to a node that is nearest in
    steps. Where two nodes' pixels touch, the ways back to both make a path; it stays if no
    shorter one between the same nodes shares a pixel of its inside.
    """
    near = {p: [q for dr, dc in AROUND if (q := (p[0] + dr, p[1] + dc)) in skeleton or q in nodes] for p in skeleton | nodes}
    root, steps, came = {p: p for p in nodes}, dict.fromkeys(nodes, 0), {}
    wave = sorted(nodes)
    while wave:
        reached = []
        for p in wave:
            for q in near[p]:
                if q not in root:
                    root[q], steps[q], came[q] = root[p], steps[p] + 1, p
                    reached.append(q)
        wave = reached

    def way(p: Pixel) -> list[Pixel]:
        """From p back to its node."""
        out = [p]
        while out[-1] in came:
            out.append(came[out[-1]])
        return out

    meetings = [(steps[p] + steps[q], p, q) for p in root for q in near[p] if root[p] < root[q]]
    taken: dict[tuple[Pixel, Pixel], set[Pixel]] = {}
    out = []
    for _, p, q in sorted(meetings):
        path = [*way(p)[::-1], *way(q)]
        inside, before = set(path[1:-1]), taken.setdefault((path[0], path[-1]), set())
        if inside.isdisjoint(before):
            before |= inside
            out.append(path)
    return out


def joined_paths(skeleton: set[Pixel], nodes: set[Pixel], min_distance: int) -> list[list[Pixel]]:
    """paths_between() once no path has under min_distance steps: the middle of the shortest one replaces its two nodes, and paths are found anew."""
    nodes = set(nodes)
    while (paths := paths_between(skeleton, nodes)) and len(short := paths[0]) - 1 < min_distance:
        nodes = nodes - {short[0], short[-1]} | {short[len(short) // 2]}
    return paths


def trace_graph(foreground: DataFrame, min_distance: int = 4, apart: float = 5.0, tile: int = TILE) -> DataFrame:
    """image_id, edge_id, d, path, error: edges of each image's thinned foreground; d is the number of steps.

    The foreground is thinned tile by tile; then one image's skeleton is one group. Nodes are the
    pixels with a crossing number of 1 or at least 3, and the centres of dense blocks that are
    apart from all of these; nodes that under min_distance steps join become one.
    """

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        thin = set(zip(frame["row"].tolist(), frame["col"].tolist()))
        nodes = crossing_nodes(thin)
        dense = {p for p in block_centres(thin) if all(np.hypot(p[0] - r, p[1] - c) >= apart for r, c in nodes)}
        rows = [(i, len(p) - 1, [{"row": int(r), "col": int(c)} for r, c in p]) for i, p in enumerate(joined_paths(thin, nodes | dense, min_distance))]
        return pd.DataFrame(rows, columns=["edge_id", "d", "path"])

    return per_image(skeleton(foreground, tile), work, "image_id long, edge_id int, d int, path array<struct<row:int,col:int>>, error string")
