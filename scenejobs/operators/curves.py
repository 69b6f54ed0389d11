"""Curves fitted to paths: straight lines, Bezier curves, cubic polynomials and splines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CURVE = "image_id long, edge_id long, k int, x double, y double, yaw double, curvature double, s double, error string"


def straight_line(ends: DataFrame, step: float) -> DataFrame:
    """image_id, edge_id, k, x, y, yaw, curvature, s: even points from (x1, y1) to (x2, y2), about step apart."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    rows = ends.withColumns({"length": length, "yaw": F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))}).withColumn("n", F.greatest(F.ceil(F.col("length") / step), F.lit(1)).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    share = F.col("k") / F.col("n")
    return rows.select("image_id", "edge_id", "k", *[(F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * share).alias(c) for c in "xy"], "yaw", F.lit(0.0).alias("curvature"), (F.col("length") * share).alias("s"))


def bezier(ends: DataFrame, n: int, reach: float = 3.0) -> DataFrame:
    """image_id, edge_id, k, x, y: cubic Bezier curves between ends with yaws yaw1 and yaw2; handles have length distance / reach."""
    d = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / reach
    rows = ends.withColumn("d", d).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).withColumn("t", F.col("k") / (n - 1))
    t, u = F.col("t"), 1 - F.col("t")

    def at(c: str, turn) -> Column:
        p0, p3 = F.col(f"{c}1"), F.col(f"{c}2")
        p1, p2 = p0 + F.col("d") * turn("yaw1"), p3 - F.col("d") * turn("yaw2")
        return p0 * u * u * u + p1 * 3 * u * u * t + p2 * 3 * u * t * t + p3 * t * t * t

    return rows.select("image_id", "edge_id", "k", at("x", F.cos).alias("x"), at("y", F.sin).alias("y"))


def _tridiagonal(side: np.ndarray, middle: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves a symmetric system with one diagonal on either side, by elimination down and up again."""
    side, middle, right = side.tolist(), middle.tolist(), right.tolist()
    for i in range(1, len(middle)):
        share = side[i - 1] / middle[i - 1]
        middle[i] -= share * side[i - 1]
        right[i] -= share * right[i - 1]
    out = [right[-1] / middle[-1]]
    for i in range(len(middle) - 2, -1, -1):
        out.append((right[i] - side[i] * out[-1]) / middle[i])
    return np.array(out[::-1])


def natural_spline(s: np.ndarray, v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, first and second derivative of the natural cubic spline through (s, v) at the places at."""
    h, n = np.diff(s), len(s)
    m = np.zeros(n)
    if n > 2:
        m[1:-1] = _tridiagonal(h[1:-1], 2 * (h[:-1] + h[1:]), 6 * np.diff(np.diff(v) / h))
    i = np.clip(np.searchsorted(s, at, side="right") - 1, 0, n - 2)
    t, w = at - s[i], h[i]
    slope = (v[i + 1] - v[i]) / w - w * (2 * m[i] + m[i + 1]) / 6
    bend = (m[i + 1] - m[i]) / w
    return v[i] + slope * t + m[i] / 2 * t**2 + bend / 6 * t**3, slope + m[i] * t + bend / 2 * t**2, m[i] + bend * t


def fit_path(x: np.ndarray, y: np.ndarray, step: float) -> np.ndarray:
    """Rows x, y, yaw, curvature, s of the natural spline at even steps of arc length, before the path's whole length."""
    keep = np.r_[True, np.hypot(np.diff(x), np.diff(y)) > 0]
    x, y = x[keep], y[keep]
    if len(x) < 2:
        raise ValueError("fewer than two different points")
    s = np.r_[0, np.cumsum(np.hypot(np.diff(x), np.diff(y)))]
    at = np.arange(0, s[-1], step)
    (px, dx, ddx), (py, dy, ddy) = natural_spline(s, x, at), natural_spline(s, y, at)
    speed = np.maximum(dx**2 + dy**2, 1e-12)
    return np.column_stack([px, py, np.arctan2(dy, dx), (dx * ddy - dy * ddx) / speed**1.5, at])


def trimmed(rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rows of a curve from the one nearest the path's first point to the one nearest its last, the first on ties."""
    first, last = (int(np.hypot(rows[:, 0] - x[i], rows[:, 1] - y[i]).argmin()) for i in (0, -1))
    return rows[first : last + 1]


def fit_splines(paths: DataFrame, step: float) -> DataFrame:
    """CURVE rows of the natural spline through every path (image_id, edge_id, pt_idx, x, y), trimmed to the points nearest its ends.

    Edges are independent groups. A path that can't be fitted gives one row with error set,
    and the job goes on.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pt_idx")
        x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
        keys = {"image_id": frame["image_id"].iloc[0], "edge_id": frame["edge_id"].iloc[0]}
        try:
            rows = trimmed(fit_path(x, y, step), x, y)
        except (ValueError, np.linalg.LinAlgError) as e:
            return pd.DataFrame([keys | dict.fromkeys(["k", "x", "y", "yaw", "curvature", "s"]) | {"error": str(e)}])
        out = pd.DataFrame(rows, columns=["x", "y", "yaw", "curvature", "s"])
        return out.assign(**keys, k=np.arange(len(out)), error=None)[["image_id", "edge_id", "k", "x", "y", "yaw", "curvature", "s", "error"]]

    return paths.groupBy("image_id", "edge_id").applyInPandas(run, CURVE)


#: A pivot below this share of the number of points counts as zero: too few different points for the degree.
LEAST_PIVOT = 1e-9


def _solved(sums: DataFrame) -> DataFrame:
    """Adds cx0 to cx3 and cy0 to cy3 that solve the normal equations of m0 to m6, x0 to x3 and y0 to y3.

    Elimination column by column; a power for which there are too few points gets 0.
    """
    at = lambda i, j: f"a{i}{j}"
    sums = sums.withColumns({at(i, j): F.col(f"m{i + j}") for i in range(4) for j in range(4)})
    usable = lambda k: F.abs(at(k, k)) > LEAST_PIVOT * F.col("m0")
    for k in range(3):
        share = {i: F.when(usable(k), F.col(at(i, k)) / F.col(at(k, k))).otherwise(0.0) for i in range(k + 1, 4)}
        less = {at(i, j): F.col(at(i, j)) - share[i] * F.col(at(k, j)) for i in share for j in range(k + 1, 4)}
        sums = sums.withColumns(less | {f"{c}{i}": F.col(f"{c}{i}") - share[i] * F.col(f"{c}{k}") for i in share for c in "xy"})
    for k in (3, 2, 1, 0):
        rest = {c: sum((F.col(at(k, j)) * F.col(f"c{c}{j}") for j in range(k + 1, 4)), F.lit(0.0)) for c in "xy"}
        sums = sums.withColumns({f"c{c}{k}": F.when(usable(k), (F.col(f"{c}{k}") - rest[c]) / F.col(at(k, k))).otherwise(0.0) for c in "xy"})
    return sums


def fit_polynomials(paths: DataFrame, step: float) -> DataFrame:
    """CURVE rows of the least-squares cubics x(s) and y(s) of every path (image_id, edge_id, pt_idx, x, y), trimmed to the points nearest its ends.

    s is the arc length up to a point; sums of its powers, and of these times x and y, are all
    that the fit needs, so paths of any length are summed up in parts. Powers are taken
    of s brought to [-1, 1]. A path of less than four different points gets a lower degree; one without
    two gives one row with error set. Points lie at every step before the whole length.
    """
    key = ["image_id", "edge_id"]
    w = W.partitionBy(*key).orderBy("pt_idx")
    step_to = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    along = paths.select(*key, "pt_idx", "x", "y", step_to.alias("d")).withColumn("s", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)))
    along = along.withColumn("whole", F.max("s").over(W.partitionBy(*key))).withColumn("t", F.when(F.col("whole") > 0, 2 * F.col("s") / F.col("whole") - 1).otherwise(0.0))
    power = lambda k: F.pow("t", F.lit(float(k))) if k else F.lit(1.0)
    end = F.struct("x", "y")
    sums = along.groupBy(*key, "whole").agg(*[F.sum(power(k)).alias(f"m{k}") for k in range(7)], *[F.sum(power(k) * F.col(c)).alias(f"{c}{k}") for c in "xy" for k in range(4)], F.min_by(end, "pt_idx").alias("first"), F.max_by(end, "pt_idx").alias("last"))
    fits = _solved(sums).select(*key, "whole", "first", "last", *[f"c{c}{k}" for c in "xy" for k in range(4)])
    rows = fits.where("whole > 0").select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("whole") / step).cast("int") - 1)).alias("i")).withColumn("s", F.col("i") * step).where("s < whole")
    rows = rows.withColumn("t", 2 * F.col("s") / F.col("whole") - 1)
    t, scale = F.col("t"), 2 / F.col("whole")
    c = lambda name, k: F.col(f"c{name}{k}")
    rows = rows.withColumns({n: ((c(n, 3) * t + c(n, 2)) * t + c(n, 1)) * t + c(n, 0) for n in "xy"} | {f"d{n}": ((3 * c(n, 3) * t + 2 * c(n, 2)) * t + c(n, 1)) * scale for n in "xy"} | {f"dd{n}": (6 * c(n, 3) * t + 2 * c(n, 2)) * scale * scale for n in "xy"})
    speed = F.greatest(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), F.lit(1e-12))
    near = lambda place: F.min(F.struct(F.hypot(F.col("x") - F.col(f"{place}.x"), F.col("y") - F.col(f"{place}.y")), "i")).over(W.partitionBy(*key))["i"]
    rows = rows.withColumns({"from": near("first"), "to": near("last")}).where("i BETWEEN from AND to")
    bend = (F.col("dx") * F.col("ddy") - F.col("dy") * F.col("ddx")) / F.pow(speed, F.lit(1.5))
    good = rows.select(*key, (F.col("i") - F.col("from")).alias("k"), "x", "y", F.atan2("dy", "dx").alias("yaw"), bend.alias("curvature"), "s", F.lit(None).cast("string").alias("error"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("k", "int"), *((c, "double") for c in ("x", "y", "yaw", "curvature", "s")))]
    return good.unionByName(fits.where("NOT coalesce(whole > 0, false)").select(*key, *none, F.lit("fewer than two different points").alias("error")))
