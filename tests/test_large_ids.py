"""Scenes whose users and lanes have ids beyond 32 bits in tracks and features."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_oracles import _plain


@pytest.fixture(scope="module")
def shifted(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shifted"))
    for table, key, step in (("events", "user_id", 60_000), ("embeddings", "vec_id", 3_000_000_000)):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        rows.unionAll(rows.withColumn(key, F.col(key) + step)).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return folder


@pytest.mark.parametrize("name", ["t1_explode_tracks", "s1_s2_scenarios", "m1_explode_map"])
def test_scenes_of_large_ids_equal_sql(spark, shifted, name):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{shifted}/{t}.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, shifted), con.sql(entry.oracle_sql()[name])
    assert _plain(got.collect(), got.columns) == _plain(want.fetchall(), want.columns)
