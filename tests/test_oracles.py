"""Every registered query with oracle SQL gives DuckDB's rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


SF_DIR = "/root/testdata/sf0.01"  # as the correctness check reads


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF_DIR}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else f"{v + 0.0:.4f}".replace("-0.0000", "0.0000") if isinstance(v, float) else str(v).lower()
    return [names[i] for i in order], sorted((tuple(show(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR)
    want = duck.sql(entry.oracle_sql()[name])
    assert _plain(got.collect(), got.columns) == _plain(want.fetchall(), want.columns)


def test_flagship(spark):
    assert entry.entry(spark).count() == 6
