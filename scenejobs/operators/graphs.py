"""Lane graphs, their statistics and the distances between sets of maps."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenejobs.functions.ranges import running
from scenejobs.functions.tables import written

STATS = ["connectivity", "density", "reach", "length", "orientation", "spectrum"]


def lane_graph(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (sid, fid, n1_x, n1_y, n2_x, n2_y, dist) and nodes (sid, x, y, yaw) of lanes.

    A lane of two or more points is an undirected edge between its ends; of lanes between the
    same ends the last one counts. A node's yaw comes from the last lane that writes it.
    """
    w = W.partitionBy("sid", "fid").orderBy("pt_idx")
    steps = points.select("sid", "fid", "pt_idx", "x", "y", F.lead("x").over(w).alias("nx"), F.lead("y").over(w).alias("ny"))
    steps = steps.withColumn("step", F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))
    yaw = F.atan2(F.col("ny") - F.col("y"), F.col("nx") - F.col("x"))
    end = F.when(F.col("nx").isNotNull(), F.col("pt_idx"))
    lanes = steps.groupBy("sid", "fid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("step").alias("dist"), F.min_by(F.struct("x", "y"), "pt_idx").alias("n1"), F.max_by(F.struct("x", "y"), "pt_idx").alias("n2"),
        F.min_by(yaw, end).alias("yaw1"), F.max_by(yaw, end).alias("yaw2"),
    ).where("n >= 2")
    pair = W.partitionBy("sid", F.least("n1", "n2"), F.greatest("n1", "n2")).orderBy(F.desc("fid"))
    edges = lanes.withColumn("rn", F.row_number().over(pair)).where("rn = 1")
    edges = edges.select("sid", "fid", F.col("n1.x").alias("n1_x"), F.col("n1.y").alias("n1_y"), F.col("n2.x").alias("n2_x"), F.col("n2.y").alias("n2_y"), "dist")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("n1").alias("n"), F.col("yaw1").alias("yaw")), F.struct(F.lit(1).alias("k"), F.col("n2").alias("n"), F.col("yaw2").alias("yaw"))))
    nodes = lanes.select("sid", "fid", ends.alias("e")).groupBy("sid", F.col("e.n.x").alias("x"), F.col("e.n.y").alias("y")).agg(F.max_by("e.yaw", F.struct("fid", "e.k")).alias("yaw"))
    return edges, nodes


def edge_nodes(edges: DataFrame) -> DataFrame:
    """graph_id, node, degree; a self-loop adds 2."""
    ends = edges.select("graph_id", F.explode(F.array("n1", "n2")).alias("node"))
    return ends.groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("degree"))


def graph_stats(edges: DataFrame, yaws: DataFrame) -> DataFrame:
    """graph_id and the six statistics; the spectrum's sum is the trace of the weighted Laplacian.

    yaws has graph_id, node, yaw; nodes without one don't enter the orientation.
    """
    nodes = edge_nodes(edges).join(yaws, ["graph_id", "node"], "left")
    per_node = nodes.groupBy("graph_id").agg(F.avg("degree").alias("connectivity"), F.count(F.lit(1)).cast("double").alias("density"), F.avg("yaw").alias("orientation"))
    per_edge = edges.groupBy("graph_id").agg(
        F.count(F.lit(1)).cast("double").alias("reach"), F.avg("dist").alias("length"), (2 * F.sum(F.when(F.col("n1") != F.col("n2"), F.col("dist")).otherwise(0.0))).alias("spectrum")
    )
    return per_node.join(per_edge, "graph_id").select("graph_id", *STATS)


#: Graphs of more nodes than this are spread over tasks.
NODES_PER_WORKER = 1_000


def shortest_distances(edges: DataFrame) -> DataFrame:
    """graph_id, source, node, dist: weighted shortest distances between all connected pairs of different nodes, both ways.

    All sources relax their edges at once; only distances that became shorter in a round go on
    to the next. Rows are spread by graph, source and node, so a graph of any size is worked
    on by all tasks. dist must not be negative.
    """
    key = ["graph_id", "source", "node"]
    near = edges.select("graph_id", F.explode(F.array(F.struct(F.col("n1").alias("node"), F.col("n2").alias("next")), F.struct(F.col("n2").alias("node"), F.col("n1").alias("next")))).alias("e"), "dist")
    near = written(near.where("e.node != e.next").groupBy("graph_id", "e.node", "e.next").agg(F.min("dist").alias("step")))
    best = written(near.select("graph_id", F.col("node").alias("source"), F.col("next").alias("node"), F.col("step").alias("dist"), F.lit(True).alias("fresh")))
    while not (wave := best.where("fresh")).isEmpty():
        reached = wave.join(near, ["graph_id", "node"]).where("next != source").select("graph_id", "source", F.col("next").alias("node"), (F.col("dist") + F.col("step")).alias("dist"))
        both = best.select(*key, "dist", F.lit(True).alias("known")).unionAll(reached.select(*key, "dist", F.lit(False)))
        best = both.groupBy(*key).agg(F.min("dist").alias("dist"), F.min(F.when(F.col("known"), F.col("dist"))).alias("before"))
        best = written(best.select(*key, "dist", (F.col("before").isNull() | (F.col("dist") < F.col("before"))).alias("fresh")))
    return best.select(*key, "dist")


def convenience(edges: DataFrame) -> DataFrame:
    """graph_id, convenience: mean weighted shortest path over connected node pairs.

    0 below two nodes, null where no pair is connected. Graphs of up to NODES_PER_WORKER nodes
    are groups of numpy min-plus steps; larger ones go through shortest_distances().
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(frame[["n1", "n2"]].to_numpy(), return_inverse=True)
        codes = codes.reshape(-1, 2)
        d = np.full((len(names), len(names)), np.inf)
        np.minimum.at(d, (codes[:, 0], codes[:, 1]), frame["dist"].to_numpy())
        d = np.minimum(d, d.T)
        np.fill_diagonal(d, 0)
        for k in range(len(names)):
            np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
        pairs = d[np.triu_indices(len(names), 1)]
        pairs = pairs[np.isfinite(pairs)]
        value = 0.0 if len(names) < 2 else pairs.mean() if len(pairs) else None
        return pd.DataFrame({"graph_id": [frame["graph_id"].iloc[0]], "convenience": [value]})

    kind = edges.schema["graph_id"].dataType.simpleString()
    sizes = edge_nodes(edges).groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
    large = written(sizes.where(F.col("nodes") > NODES_PER_WORKER).select("graph_id"))
    if large.isEmpty():
        return edges.groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, convenience double")
    small = edges.join(large, "graph_id", "left_anti").groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, convenience double")
    far = shortest_distances(edges.join(large, "graph_id", "left_semi")).groupBy("graph_id").agg(F.avg("dist").alias("convenience"))
    return small.unionAll(large.join(far, "graph_id", "left"))


def fit_normal(stats: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """by, statistic, mu, sigma (population) over graphs; missing values don't count."""
    tall = stats.unpivot(by or [], names, "statistic", "value")
    return tall.groupBy(*(by or []), "statistic").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma"))


def frechet_1d(gt: DataFrame, gen: DataFrame) -> DataFrame:
    """statistic, frechet from two fits, by the reference formula of one-dimensional normals."""
    both = gt.select("statistic", F.col("mu").alias("a"), F.col("sigma").alias("s")).join(gen.select("statistic", F.col("mu").alias("b"), F.col("sigma").alias("r")), "statistic")
    gap, both_sigma = F.col("a") - F.col("b"), F.sqrt(F.col("s") ** 2 + F.col("r") ** 2)
    overlap = F.when(both_sigma == 0, 0.0).otherwise(F.sqrt(2 * F.col("s") * F.col("r")) * F.exp(-0.5 * (gap / both_sigma) ** 2))
    return both.select("statistic", (F.abs(gap) + both_sigma - overlap).alias("frechet"))


def _counted(values: DataFrame, name: str) -> DataFrame:
    return values.groupBy(F.col("value").alias(name)).agg(F.count(F.lit(1)).cast("double").alias(f"{name}_n"))


#: The kernel is left out beyond so many sigmas, where it is below 3e-18.
REACH = 9


def kernel_means(x: DataFrame, y: DataFrame, sigma: float = 1.0) -> DataFrame:
    """value, n, mean: mean Gaussian kernel of each distinct x value with all y values.

    Values repeat heavily, so both sides shrink to (value, count) before they meet, and they
    meet in cells of REACH sigmas and their neighbours only; a mean is less than 3e-18 short.
    """
    cell = lambda c: F.floor(F.col(c) / (REACH * sigma))
    near = F.explode(F.sequence(cell("y") - 1, cell("y") + 1)).alias("cell")
    whole = F.broadcast(y.agg(F.count(F.lit(1)).alias("whole")))  # one row
    left, right = _counted(x, "x").withColumn("cell", cell("x")), _counted(y, "y").select("y", "y_n", near)
    kernel = F.exp(-((F.col("x") - F.col("y")) ** 2) / (2 * sigma**2))
    sums = left.join(right, "cell", "left").groupBy(F.col("x").alias("value"), F.col("x_n").alias("n")).agg(F.coalesce(F.sum(kernel * F.col("y_n")), F.lit(0.0)).alias("sum"))
    return sums.crossJoin(whole).select("value", "n", (F.col("sum") / F.col("whole")).alias("mean"))


def mmd(x: DataFrame, y: DataFrame, sigma: float = 1.0) -> DataFrame:
    """One row, mmd: maximum mean discrepancy of two samples (column value) with a Gaussian kernel."""
    mean = lambda a, b, name: kernel_means(a, b, sigma).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias(name))
    return mean(x, x, "xx").crossJoin(mean(y, y, "yy")).crossJoin(mean(x, y, "xy")).select((F.col("xx") + F.col("yy") - 2 * F.col("xy")).alias("mmd"))


def mmd_wasserstein(x: DataFrame, y: DataFrame, sigma: float = 1.0) -> DataFrame:
    """One row, distance: Wasserstein distance of the two samples of kernel means."""
    return _wasserstein(kernel_means(x, x, sigma).select(F.col("mean").alias("value"), "n"), kernel_means(y, y, sigma).select(F.col("mean").alias("value"), "n"))


def mmd_tvd(x: DataFrame, y: DataFrame, order: list[str], sigma: float = 1.0) -> DataFrame:
    """One row, distance: half the sum of differences between the kernel means at equal places of two samples.

    x and y have value and the columns of order, by which no two rows are equal; a row's place
    is its number in that order, counted over ranges. Where one sample is longer, its further
    means count in full. 0 for two empty samples.
    """

    def placed(df: DataFrame, name: str) -> DataFrame:
        means = kernel_means(df, df, sigma).select("value", F.col("mean").alias(name))
        rows = df.select("value", F.struct(*order).alias("order")).join(means, "value")
        return running(rows, "order", F.lit(1).cast("long"), "place").select("place", name)

    apart = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return placed(x, "a").join(placed(y, "b"), "place", "full").agg((F.coalesce(F.sum(apart), F.lit(0.0)) / 2).alias("distance"))


def wasserstein_1d(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row, distance: area between the distribution functions of two samples (column value)."""
    return _wasserstein(_counted(x, "value").withColumnRenamed("value_n", "n"), _counted(y, "value").withColumnRenamed("value_n", "n"))


def _wasserstein(x: DataFrame, y: DataFrame) -> DataFrame:
    share = lambda df, sign: df.crossJoin(F.broadcast(df.agg(F.sum("n").alias("whole")))).select("value", (F.col("n") * sign / F.col("whole")).alias("step"))
    steps = share(x, 1).unionAll(share(y, -1)).groupBy("value").agg(F.sum("step").alias("step"))
    summed = running(steps, "value", F.col("step"), "apart")
    return summed.agg(F.coalesce(F.sum(F.abs("apart") * (F.col("after") - F.col("value"))), F.lit(0.0)).alias("distance"))


def frechet_gaussian(x: DataFrame, y: DataFrame, column: str = "vector") -> DataFrame:
    """One row, frechet: distance of the Gaussians fitted to two tables of vectors (arrays of one length).

    Tasks add up moments and products of their rows; these meet by place in the matrix, so what
    comes together for the eigenvalues is one d x d matrix per side, whatever the rows.
    """

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            v = np.stack(frame["v"].to_numpy()).astype(float) if len(frame) else np.empty((0, 0))
            v = np.column_stack([v, np.ones(len(v))])
            total = v.T @ v if total is None or not total.size else total + v.T @ v if v.size else total
        if total is not None and total.size:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    def distance(frame: pd.DataFrame) -> pd.DataFrame:
        mu, cov = {}, {}
        for side, part in frame.groupby("side"):
            m = part.pivot(index="i", columns="j", values="s").to_numpy()
            n = m[-1, -1]
            mu[side] = m[-1, :-1] / n
            cov[side] = (m[:-1, :-1] - n * np.outer(mu[side], mu[side])) / (n - 1)
        root = np.sqrt(np.linalg.eigvals(cov["x"] @ cov["y"]).astype(complex)).real.sum()
        return pd.DataFrame({"frechet": [((mu["x"] - mu["y"]) ** 2).sum() + np.trace(cov["x"]) + np.trace(cov["y"]) - 2 * root]})

    sums = [df.select(F.col(column).alias("v")).mapInPandas(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).withColumns({"side": F.lit(side), "one": F.lit(1)}) for df, side in ((x, "x"), (y, "y"))]
    return sums[0].unionAll(sums[1]).groupBy("one").applyInPandas(distance, "frechet double")


ATTRIBUTES = ["x", "y", "z", "length", "width", "height", "heading", "vx", "vy"]


def agent_means(agents: DataFrame) -> DataFrame:
    """image_id and the mean of the nine attributes; images without agents don't appear."""
    return agents.groupBy("image_id").agg(*[F.avg(c).alias(c) for c in ATTRIBUTES])


def track_means(tracks: DataFrame, now: int = 10) -> DataFrame:
    """sid and mean attributes of rows valid at now with a type, x and y relative to the first kept track."""
    kept = tracks.where((F.col("t") == now) & F.col("valid") & (F.col("object_type") != 0))
    first = W.partitionBy("sid").orderBy("track_index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    kept = kept.withColumns({c: F.col(c) - F.first(c).over(first) for c in ("x", "y", "z")})
    return kept.groupBy("sid").agg(*[F.avg(c).alias(c) for c in ATTRIBUTES])


def attribute_histogram(df: DataFrame, columns: list[str], bins: int = 21) -> DataFrame:
    """attribute, bin, low, high, n: equal-width counts between least and greatest value; the last bin is closed."""
    tall = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "attribute", "value").where("value IS NOT NULL")
    ends = tall.groupBy("attribute").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place: Column = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("value") - F.col("low")) / width), F.lit(bins - 1)))
    return tall.join(F.broadcast(ends), "attribute").groupBy("attribute", place.cast("int").alias("bin"), "low", "high").agg(F.count(F.lit(1)).alias("n"))


def routes(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """graph_id, source, target, length, edge_ids, nodes: shortest paths from every inlet to every outlet that it reaches.

    edges has graph_id, edge_id, n1, n2, dist; terminals has graph_id, node, kind ("inlet" or
    "outlet"). Each graph is one group; ties fall to the smaller predecessor.
    """
    kind = edges.schema["graph_id"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        real, near = frame[frame["kind"].isna()], {}
        for e in real.itertuples():
            near.setdefault(e.n1, []).append((e.n2, e.dist, e.edge_id))
            near.setdefault(e.n2, []).append((e.n1, e.dist, e.edge_id))
        rows = []
        for source in sorted(frame.loc[frame["kind"] == "inlet", "n1"]):
            far, back, queue, done = {source: 0.0}, {}, [(0.0, source)], set()
            while queue:
                d, node = heapq.heappop(queue)
                if node in done:
                    continue
                done.add(node)
                for other, step, edge in near.get(node, []):
                    if d + step < far.get(other, np.inf) or d + step == far.get(other) and other not in done and node < back[other][0]:
                        far[other], back[other] = d + step, (node, edge)
                        heapq.heappush(queue, (d + step, other))
            for target in sorted(frame.loc[frame["kind"] == "outlet", "n1"]):
                if target != source and target in far:
                    nodes, used = [target], []
                    while nodes[-1] != source:
                        node, edge = back[nodes[-1]]
                        nodes.append(node)
                        used.append(edge)
                    rows.append((frame["graph_id"].iloc[0], source, target, far[target], used[::-1], nodes[::-1]))
        return pd.DataFrame(rows, columns=["graph_id", "source", "target", "length", "edge_ids", "nodes"])

    both = edges.select("graph_id", "edge_id", "n1", "n2", "dist", F.lit(None).cast("string").alias("kind"))
    both = both.unionAll(terminals.select("graph_id", F.lit(0).cast("long"), F.col("node"), F.col("node"), F.lit(0.0), "kind"))
    return both.groupBy("graph_id").applyInPandas(run, f"graph_id {kind}, source long, target long, length double, edge_ids array<long>, nodes array<long>")


def smooth_routes(found: DataFrame, pairs: DataFrame, bend: float = math.pi / 4) -> DataFrame:
    """The routes whose edges go on in each other at every inner node.

    found comes from routes(); pairs has graph_id, node, end, partner, bend of the edge ends that are
    matched at a node, in both directions (see pair_edges_at_node(); end and partner are edge
    ids). A route stays if its edges are matched wherever they meet and bend by less than
    `bend` there; a route of one edge always stays.
    """
    key = ["graph_id", "source", "target"]
    steps = found.select(*key, F.explode(F.expr("transform(sequence(1, greatest(size(edge_ids) - 1, 1)), i -> named_struct('node', get(nodes, i), 'end', get(edge_ids, i - 1), 'partner', get(edge_ids, i)))")).alias("s"))
    steps = steps.select(*key, "s.*").where("partner IS NOT NULL")
    good = pairs.where(F.col("bend") < bend).select("graph_id", "node", "end", "partner")
    broken = steps.join(good, ["graph_id", "node", "end", "partner"], "left_anti").select(*key).distinct()
    return found.join(broken, key, "left_anti")


def with_waypoints(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds waypoints: the paths of a route's edges (graph_id, edge_id, n1, path) joined in the direction of travel."""
    key = ["graph_id", "source", "target"]
    parts = found.select(*key, F.posexplode("edge_ids").alias("pos", "edge_id"), "nodes").join(edges.select("graph_id", "edge_id", "n1", "path"), ["graph_id", "edge_id"])
    travelled = F.when(F.get("nodes", F.col("pos")) == F.col("n1"), F.col("path")).otherwise(F.reverse("path"))
    joined = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", travelled.alias("path")))).alias("p"))
    return found.join(joined.select(*key, F.flatten(F.col("p.path")).alias("waypoints")), key)
