"""Reading and writing scenario tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scenejobs.functions.ranges import running

_PT = "struct<x:double,y:double,z:double>"
NEIGHBORS = "array<struct<feature_id:bigint,self_start_index:int,self_end_index:int,neighbor_start_index:int,neighbor_end_index:int>>"
_POLYLINE = f"struct<type:int,polyline:array<{_PT}>>"
_POLYGON = f"struct<polygon:array<{_PT}>>"
_STATE = "struct<center_x:double,center_y:double,center_z:double,length:double,width:double,height:double,heading:double,velocity_x:double,velocity_y:double,valid:boolean>"
#: Members of a track's state.
STATES = [m.split(":")[0] for m in _STATE[len("struct<") : -1].split(",")]
#: Schema of decoded scenario records.
SCENARIO = (
    "sid string, sdc_track_index int, current_time_index int, predict_list array<int>, map_features array<struct<id:bigint,"
    f"lane:struct<type:int,speed_limit_mph:double,polyline:array<{_PT}>,entry_lanes:array<bigint>,exit_lanes:array<bigint>,left_neighbors:{NEIGHBORS},right_neighbors:{NEIGHBORS}>,"
    f"road_line:{_POLYLINE},road_edge:{_POLYLINE},stop_sign:struct<position:{_PT}>,crosswalk:{_POLYGON},speed_bump:{_POLYGON},driveway:{_POLYGON}>>,"
    f"tracks array<struct<id:bigint,object_type:int,states:array<{_STATE}>>>"
)


def schema_of(name: str) -> StructType:
    """Members of the structs in an array column of SCENARIO."""
    return StructType.fromDDL(SCENARIO)[name].dataType.elementType


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Decoded scenario records, nested."""
    return spark.read.schema(SCENARIO).parquet(path)


def write_scenarios(df: DataFrame, path: str, shards: int) -> None:
    """One table in place of a file per scenario, partitioned by a hash of the scenario id."""
    dealt = df.withColumn("shard", F.pmod(F.xxhash64("sid"), F.lit(shards)))
    dealt.repartition(shards, "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """image_id, row, col, r, g, b in [0, 1] of image files; Spark's image source holds BGR bytes.

    image_id is the number that the file is named with; files of other names are left out,
    as the source leaves out those that hold no image.
    """
    number = F.regexp_extract("image.origin", r"/(\d+)\.\w+$", 1)
    images = spark.read.format("image").load(path).where(number != "").select(number.cast("long").alias("image_id"), "image.height", "image.width", "image.nChannels", "image.data")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for image in frame.itertuples():
                values = np.frombuffer(image.data, np.uint8).reshape(image.height, image.width, image.nChannels) / 255.0
                values = np.repeat(values, 3, axis=2) if image.nChannels == 1 else values[:, :, 2::-1]
                row, col = np.divmod(np.arange(image.height * image.width), image.width)
                flat = values.reshape(-1, 3)
                yield pd.DataFrame({"image_id": image.image_id, "row": row.astype(np.int32), "col": col.astype(np.int32), "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})

    return images.mapInPandas(unpack, "image_id long, row int, col int, r double, g double, b double")


def write_vectors(lanes: DataFrame, agents: DataFrame, edges: DataFrame, path: str) -> None:
    """Lanes, agents and graph edges of images as tables; agents carry the scene's self index and a type."""
    lanes.write.mode("overwrite").parquet(f"{path}/lanes")
    agents.withColumns({"sdc_track_index": F.lit(0), "object_type": F.lit(1)}).write.mode("overwrite").parquet(f"{path}/agents")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def manifest(df: DataFrame) -> DataFrame:
    """sid, idx: scenario ids in order, numbered from 0."""
    numbered = running(df.select("sid").distinct(), "sid", F.lit(1).cast("long"), "idx")
    return numbered.select("sid", (F.col("idx") - 1).alias("idx"))


def every_nth(listed: DataFrame, n: int) -> DataFrame:
    """Rows 0, n, 2n and so on of a manifest."""
    return listed.where(F.col("idx") % n == 0)


def sample_k(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement: the least hashes of seed and id; each task keeps k rows at most."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(k)
