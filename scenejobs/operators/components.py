"""Connected pixels and thinning, image tile by image tile."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenejobs.functions.tables import written

AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
#: Rows and columns of a tile, the largest part of an image that one task holds.
TILE = 512
#: Thinning rounds between two exchanges of borders.
ROUNDS = 8


def label(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Component number of each pixel, with eight neighbours: least labels spread until nothing changes."""
    place = {p: i for i, p in enumerate(zip(row.tolist(), col.tolist()))}
    pairs = [(i, j) for (r, c), i in place.items() for dr, dc in AROUND[:4] if (j := place.get((r + dr, c + dc))) is not None]
    number = np.arange(len(row))
    if pairs:
        a, b = np.array(pairs).T
        while True:
            before = number.copy()
            low = np.minimum(number[a], number[b])
            np.minimum.at(number, a, low)
            np.minimum.at(number, b, low)
            number = number[number]
            if (number == before).all():
                break
    return np.unique(number, return_inverse=True)[1]


def _merged(links: DataFrame) -> DataFrame:
    """image_id, node, root: the least node that links (image_id, a, b) connect each node to.

    In each round the larger of two linked roots hangs itself under the least root next to it,
    and every node moves up to its root's root, until no link joins two roots.
    """
    nodes = links.select("image_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    state = written(nodes.withColumn("root", F.col("node")))
    while True:
        of = lambda c: state.select("image_id", F.col("node").alias(c), F.col("root").alias(f"root_{c}"))  # noqa: E731, B023
        apart = links.join(of("a"), ["image_id", "a"]).join(of("b"), ["image_id", "b"]).where("root_a != root_b")
        hooks = written(apart.groupBy("image_id", F.greatest("root_a", "root_b").alias("root")).agg(F.min(F.least("root_a", "root_b")).alias("under")))
        if hooks.isEmpty():
            return state
        moved = written(state.join(hooks, ["image_id", "root"], "left").select("image_id", "node", F.coalesce("under", "root").alias("root")))
        up = moved.select("image_id", F.col("node").alias("root"), F.col("root").alias("above"))
        state = written(moved.join(up, ["image_id", "root"], "left").select("image_id", "node", F.coalesce("above", "root").alias("root")))


def labelled(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """image_id, row, col, first: the component of each pixel, named by its least pixel as row * 2**32 + col.

    pixels has image_id, row, col, each pixel once and from row and column 0 on. Tiles are
    labelled by themselves; pixels that touch across their borders link the labels, and linked
    labels are merged. The result doesn't depend on the tiles' size.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        code = frame["row"].astype(np.int64) * (1 << 32) + frame["col"]
        return frame[["image_id", "row", "col"]].assign(local=code.groupby(label(frame["row"].to_numpy(), frame["col"].to_numpy())).transform("min"))

    tiles = pixels.select("image_id", "row", "col", F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"))
    local = written(tiles.groupBy("image_id", "tr", "tc").applyInPandas(work, f"image_id {kinds['image_id']}, row {kinds['row']}, col {kinds['col']}, local long"))
    border = local.where(f"row % {tile} IN (0, {tile - 1}) OR col % {tile} IN (0, {tile - 1})")
    spots = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in AROUND[:4]]))
    beside = border.select("image_id", F.col("local").alias("a"), "row", "col", spots.alias("o")).select("image_id", "a", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
    links = written(beside.join(border.withColumnRenamed("local", "b"), ["image_id", "row", "col"]).where("a != b").select("image_id", "a", "b").distinct())
    if links.isEmpty():
        return local.withColumnRenamed("local", "first")
    roots = _merged(links).withColumnRenamed("node", "local")
    return local.join(roots, ["image_id", "local"], "left").select("image_id", "row", "col", F.coalesce("root", "local").alias("first"))


def thinned(image: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """One-pixel-wide skeleton of a boolean image: border pixels go in two alternating passes (Zhang and Suen), up to so many rounds."""
    image, done = np.pad(image.astype(bool), 1), 0
    while True:
        changed, done = False, done + 1
        for side in (0, 1):
            p = [np.roll(image, (-dr, -dc), (0, 1)) for dr, dc in AROUND]
            count = sum(x.astype(int) for x in p)
            turns = sum((~p[i] & p[(i + 1) % 8]).astype(int) for i in range(8))
            a, b = ((p[0] & p[2] & p[4]), (p[2] & p[4] & p[6])) if side == 0 else ((p[0] & p[2] & p[6]), (p[0] & p[4] & p[6]))
            gone = image & (count >= 2) & (count <= 6) & (turns == 1) & ~a & ~b
            if gone.any():
                image, changed = image & ~gone, True
        if not changed or done == rounds:
            return image[1:-1, 1:-1]


def skeleton(pixels: DataFrame, tile: int = TILE, rounds: int = ROUNDS) -> DataFrame:
    """image_id, row, col of the thinned images that pixels (each once) show.

    Whether a pixel stays in a round depends on those at most two away, so a tile with a border
    of 2 * rounds pixels is right inside after so many rounds. Then borders are exchanged,
    until a whole exchange removes nothing. The result doesn't depend on the tiles' size.
    """
    halo = 2 * rounds
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        top, left = int(frame["tr"].iloc[0]) * tile - halo, int(frame["tc"].iloc[0]) * tile - halo
        image = np.zeros((tile + 2 * halo, tile + 2 * halo), bool)
        image[frame["row"] - top, frame["col"] - left] = True
        row, col = np.nonzero(thinned(image, rounds)[halo:-halo, halo:-halo])
        return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "row": row + top + halo, "col": col + left + halo})

    now = written(pixels.select("image_id", "row", "col"))
    size = now.count()
    while True:
        dealt = now.withColumn("tr", reach("row")).withColumn("tc", reach("col"))
        now = written(dealt.groupBy("image_id", "tr", "tc").applyInPandas(work, f"image_id {kinds['image_id']}, row {kinds['row']}, col {kinds['col']}"))
        before, size = size, now.count()
        if size == before:
            return now
