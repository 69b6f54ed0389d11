"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths written inside each open temporary_tables() block.
_OPEN: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, local sessions, as in tests, get one of their own; a cluster is refused, as its executors share no local disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = made.get() if made.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it again, which cuts the lineage and survives lost executors.

    The table goes with temporary_tables() or, as results are lazy, at the latest with the driver.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    for made in _OPEN:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def together(tables: list[DataFrame]) -> DataFrame:
    """Tables of one schema that written() has made, as one scan, however many they are."""
    first = tables[0]
    paths = sorted({name.rsplit("/", 1)[0] for table in tables for name in table.inputFiles()})
    return first.sparkSession.read.schema(first.schema).parquet(*paths) if paths else first


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that written() has made."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Lists the tables written inside and deletes them at the end; those taken off the list stay."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        delete(spark, made)
