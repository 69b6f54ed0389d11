"""Points nearest to positions, found through grid cells that grow until they reach far enough."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenejobs.functions.tables import together, written

#: Side in metres of the first round's cells, and how much larger each round's are.
FIRST_CELL, GROWTH = 8.0, 4.0


def within_reach(positions: DataFrame, points: DataFrame, keys: tuple[str, ...], scene: str, pick: Callable[[DataFrame], DataFrame], alike: Column | None = None, cell: float = FIRST_CELL) -> DataFrame:
    """pick() of the points around each position, without comparing it with all of its scene.

    positions has the keys, the scene's id among them, and ax, ay; points has the scene, x, y
    and what pick() needs. pick() gets pairs with their distance d and returns the keys, its
    answer, and reach: how far in metres the answer depends on points. A position meets the
    points in its own and the eight cells around, which hold all within a cell's side; an
    answer whose reach is no longer stands, the other positions go on with larger cells.
    A position whose cell reaches all points of its scene is done, with or without an answer.
    alike is a further condition on pairs. Positions and points without a finite place meet none.
    """
    finite = lambda *names: [F.abs(c) < float("inf") for c in names]
    for known in finite("x", "y"):
        points = points.where(known)
    for known in finite("ax", "ay"):
        positions = positions.where(known)
    box = points.groupBy(scene).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)])
    span = lambda c: F.greatest(F.col(f"max_{c}") - F.col(f"a{c}"), F.col(f"a{c}") - F.col(f"min_{c}"))
    open_ = positions.join(box, scene).withColumn("limit", F.hypot(span("x"), span("y"))).select(*positions.columns, "limit")
    points, answers = written(points), []
    open_ = written(open_)
    while True:
        at = lambda x, y: {"gx": F.floor(F.col(x) / cell), "gy": F.floor(F.col(y) / cell)}  # noqa: E731, B023
        around = F.explode(F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        asked = open_.withColumns(at("ax", "ay")).withColumn("g", around).select(*open_.columns, "g.gx", "g.gy")
        pairs = asked.join(points.withColumns(at("x", "y")), [scene, "gx", "gy"]).withColumn("d", F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay")))
        found = pick(pairs.where(alike) if alike is not None else pairs).join(open_.select(*keys, "limit"), list(keys))
        found = written(found.where((F.col("reach") <= cell) | (F.col("limit") <= cell)))
        answers.append(found)
        open_ = open_.where(F.col("limit") > cell).join(found.select(*keys), list(keys), "left_anti")
        if open_.isEmpty():
            return together(answers).drop("reach", "limit")
        cell *= GROWTH
