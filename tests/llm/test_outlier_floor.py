"""Determinants, floors and small groups of op8, held against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from scenejobs.llm import outliers

P, FLOOR = len(outliers.VECTOR), np.array(outliers.LEAST_SPREAD)
VECTORS = "grp string, " + ", ".join(f"{n} long" for n in outliers.VECTOR)


def _factor(x, share=None):
    """Mean, factor of the floored covariance and log determinant of rows x."""
    mean, cov = x.mean(axis=0), np.cov(x.T, bias=True)
    np.fill_diagonal(cov, np.maximum(cov.diagonal(), FLOOR**2))
    factor = np.zeros((P, P))
    for i in range(P):
        for j in range(i + 1):
            left = cov[i, j] - factor[i, :j] @ factor[j, :j]
            factor[i, j] = np.sqrt(max(left, FLOOR[i] ** 2 / 4)) if i == j else left / factor[j, j]
    return mean, factor, 2 * np.log(factor.diagonal()).sum()


def _bins(x, mean, factor):
    z = np.linalg.solve(factor, (x - mean).T)
    return np.minimum(np.floor(np.sqrt((z**2).sum(axis=0)) * outliers.DISTANCE_BINS), outliers.FARTHEST * outliers.DISTANCE_BINS)


def _step(x, mean, factor, share):
    bins = _bins(x, mean, factor)
    return x[bins <= np.sort(bins)[int(np.ceil(len(x) * share)) - 1]]


def _concentrated(x):
    width = outliers.UNIT // outliers.VALUE_BINS
    b = np.floor(x * outliers.UNIT / width)
    middle = lambda v: np.sort(v, axis=0)[int(np.ceil(len(v) * 0.5)) - 1]
    median = middle(b)
    spread = np.maximum(1.4826 * middle(np.abs(b - median)) / outliers.VALUE_BINS, FLOOR)
    medians = (median + 0.5) / outliers.VALUE_BINS, np.diag(spread)
    best = []
    for start, share in zip((medians, medians, _factor(x)[:2]), outliers.FIRST_SHARES):
        core = _step(x, *start, share)
        logdet = np.inf
        while True:
            found = _step(x, *_factor(core)[:2], outliers.CORE_SHARE)
            now = _factor(found)[2]
            if not now < logdet - outliers.LEAST_FALL:
                break
            core, logdet = found, now
        best.append((logdet, len(core)))
    return min(best)


def _rows(spark, groups):
    return spark.createDataFrame([(g, *map(int, r)) for g, x in groups.items() for r in x], VECTORS)


def test_spreads_above_the_floor_stay(spark):
    rng = np.random.default_rng(4)
    for times in (0.1, 1.5, 4.0):
        x = np.round(rng.normal(0, 1, (400, P)) * FLOOR * times * outliers.UNIT).astype(int)
        got = outliers._factored(outliers._means(_rows(spark, {"g": x}).groupBy("grp").agg(*outliers._exprs(outliers._SUMS)), "grp")).collect()[0]
        _, want, logdet = _factor(x / outliers.UNIT)
        assert np.allclose([[got[f"l{i}_{j}"] if j <= i else 0.0 for j in range(P)] for i in range(P)], want) and got["logdet"] == pytest.approx(logdet)


def test_the_least_determinant_equals_plain_concentration(spark):
    rng = np.random.default_rng(9)
    clean, far = rng.normal(0, 1, (300, P)) * 3 * FLOOR, rng.normal(0, 1, (60, P)) * FLOOR + 25 * FLOOR
    groups = {"clean": clean, "mixed": np.r_[clean, far], "equal": np.ones((7, P)), "one": np.ones((1, P)), "two": np.r_[clean[:1], far[:1]]}
    groups = {g: np.round(x * outliers.UNIT).astype(int) for g, x in groups.items()}
    got = {r["grp"]: r for r in outliers.least_determinants(_rows(spark, groups)).collect()}
    for g in ("clean", "mixed"):
        logdet, n = _concentrated(groups[g] / outliers.UNIT)
        assert got[g]["logdet"] == pytest.approx(logdet, abs=1e-6) and got[g]["n"] == n
    assert max(abs(got["mixed"][f"a{i}"]) / FLOOR[i] for i in range(P)) < 1.5  # far rows stay out of the core
    assert set(got) == set(groups)


def test_repeated_rows_and_groups_of_one_value(make_docs, spark):
    text = " ".join(f"w{i}" for i in range(60))
    strange = " ".join(f"#{i}$$$" for i in range(60))
    docs = make_docs([(i % 50, text) for i in range(150)] + [(900, strange)]).withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    rows = outliers.robust_outliers(docs).collect()
    assert len(rows) == 151 and all(r["kept"] == (r["doc_id"] != 900) for r in rows)
    alone = outliers.robust_outliers(docs.withColumn("source", F.when(F.col("doc_id") == 900, "other").otherwise("s"))).where("doc_id = 900").collect()
    assert not alone[0]["kept"]  # a lone document of a source is judged by its language
