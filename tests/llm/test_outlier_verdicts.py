"""Distances and verdicts of op8 from end to end: equal to a plain copy of its steps, and close to the method without bins."""

import collections

import numpy as np
import pytest
from scenejobs.llm import outliers
from tests.llm.test_outlier_floor import P, _bins, _factor

SHARE = 0.5


def _middle(values):
    """The lower median, as a least bin up to which half of all lie."""
    return np.sort(values, axis=0)[int(np.ceil(len(values) * SHARE)) - 1]


def _medians(x, exact):
    width = 1 if exact else outliers.UNIT // outliers.VALUE_BINS
    bins = np.floor(x * outliers.UNIT / width)
    median = _middle(bins)
    mad = _middle(np.abs(bins - median))
    unit = width / outliers.UNIT
    return (median + (0 if exact else 0.5)) * unit, np.diag(np.maximum(1.4826 * mad * unit, outliers.LEAST_SPREAD))


def _distance(x, mean, factor):
    return np.sqrt((np.linalg.solve(factor, (x - mean).T) ** 2).sum(axis=0))


def _nearest(x, mean, factor, share, exact):
    n = int(np.ceil(len(x) * share))
    d = _distance(x, mean, factor) if exact else _bins(x, mean, factor)
    return x[np.argsort(d, kind="stable")[:n]] if exact else x[d <= np.sort(d)[n - 1]]


def _core(x, exact):
    """The core of the least determinant over all starts."""
    best = None
    for k, (start, share) in enumerate(zip((_medians(x, exact), _medians(x, exact), _factor(x)[:2]), outliers.FIRST_SHARES)):
        core, logdet = _nearest(x, *start, share, exact), np.inf
        while True:
            found = _nearest(x, *_factor(core)[:2], outliers.CORE_SHARE, exact)
            now = _factor(found)[2]
            if not now < logdet - (1e-12 if exact else outliers.LEAST_FALL):
                break
            core, logdet = found, now
        if best is None or (logdet, k) < best[:2]:
            best = logdet, k, core
    return best[2]


def _moments(x):
    return len(x), x.mean(axis=0), x.T @ x / len(x)


def _mixed(parts):
    n = sum(p[0] for p in parts)
    return n, sum(p[0] * p[1] for p in parts) / n, sum(p[0] * p[2] for p in parts) / n


def _towards(a, b):
    w = a[0] + outliers.PRIOR
    return a[0], (a[0] * a[1] + outliers.PRIOR * b[1]) / w, (a[0] * a[2] + outliers.PRIOR * b[2]) / w


def _cholesky(mean, second):
    cov = second - np.outer(mean, mean)
    np.fill_diagonal(cov, np.maximum(cov.diagonal(), np.square(outliers.LEAST_SPREAD)))
    factor = np.zeros((P, P))
    for i in range(P):
        for j in range(i + 1):
            left = cov[i, j] - factor[i, :j] @ factor[j, :j]
            factor[i, j] = np.sqrt(max(left, outliers.LEAST_SPREAD[i] ** 2 / 4)) if i == j else left / factor[j, j]
    return mean, factor


def judged(groups, exact):
    """Distance of every row of {(lang, source): rows}, shrunk by the median as the operator does."""
    own = {g: _moments(_core(x, exact)) for g, x in groups.items()}
    whole = _mixed(list(own.values()))
    lang = {k: _towards(_mixed([m for g, m in own.items() if g[0] == k]), whole) for k in {g[0] for g in groups}}
    raw, unit = {}, 1 if exact else outliers.DISTANCE_BINS
    for g, x in groups.items():
        _, mean, second = _towards(own[g], lang[g[0]])
        raw[g] = _distance(x, *_cholesky(mean, second))
    binned = {g: d if exact else np.minimum(np.floor(d * unit), outliers.FARTHEST * unit) for g, d in raw.items()}
    of_lang = {k: _middle(np.concatenate([b for g, b in binned.items() if g[0] == k])) for k in lang}
    out = {}
    for g, d in raw.items():
        middle = (len(d) * _middle(binned[g]) + outliers.PRIOR * of_lang[g[0]]) / (len(d) + outliers.PRIOR)
        out[g] = d * min(1.0, outliers.chi_square(P, 0.5) ** 0.5 / (middle if exact else (middle + 0.5) / unit))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = {r["doc_id"]: r for r in outliers.robust_outliers(docs).collect()}
    stats = outliers.transformed(docs.select("doc_id", "lang", "source", outliers.statistics_of(docs["text"]).alias("s")).select("doc_id", "lang", "source", "s.*"))
    groups, ids = collections.defaultdict(list), collections.defaultdict(list)
    for r in stats.collect():
        if not found[r["doc_id"]]["base_failed"]:
            groups[r["lang"], r["source"]].append([r[c] / outliers.UNIT for c in outliers.VECTOR])
            ids[r["lang"], r["source"]].append(r["doc_id"])
    return found, {g: np.array(x) for g, x in groups.items()}, ids


def test_verdicts_equal_a_plain_copy(corpus):
    found, groups, ids = corpus
    cut = outliers.chi_square(P, outliers.QUANTILE) ** 0.5
    for g, distances in judged(groups, exact=False).items():
        for i, d in zip(ids[g], distances):
            assert found[i]["distance"] == pytest.approx(d, rel=1e-6, abs=1e-9) and (found[i]["kept"] == (d <= cut) or abs(d - cut) < 1e-6)


def test_bins_hardly_change_a_verdict(corpus):
    """Against exact medians, exact order and steps to the end."""
    found, groups, ids = corpus
    cut, different, total = outliers.chi_square(P, outliers.QUANTILE) ** 0.5, 0, 0
    for g, distances in judged(groups, exact=True).items():
        different += sum(found[i]["kept"] != bool(d <= cut) for i, d in zip(ids[g], distances))
        total += len(distances)
    print(f"{different} of {total} verdicts differ")
    assert different <= total * 0.002
