import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from scenejobs.llm import fingerprints, outliers, queries
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _edit(text, following):
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def test_edits_and_equal_texts(make_docs):
    texts = [t or "" for t in ODD] + ["alpha beta " * 30, "alpha beta " * 30]
    rows = fingerprints.fingerprint_edits(make_docs([None if not t else t for t in texts])).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        assert got[i]["n_chars"] == len(t) and got[i]["edited"] == _edit(t, following)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert got[i]["near_next"] == 1 or t != following
        assert bool(got[i]["sketch"]) == bool(WORD.search(t))
    assert got[len(texts) - 1]["sketch"] == got[len(texts) - 2]["sketch"]


def test_sketches_estimate_jaccard(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(docs)
    rows = {r["doc_id"]: r for r in queries.op1_fingerprints(spark, sf_dir).collect()}

    def shingles(text):
        w = WORD.findall(text.lower() if text.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    errors, short = [], []
    for k, i in enumerate(ids):
        edited = _edit(docs[i], docs[ids[(k + 1) % len(ids)]])
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(docs[i]), shingles(edited)
        if a | b:
            (errors if len(a) > 150 else short).append(abs(rows[i]["near_edited"] - len(a & b) / len(a | b)))
    assert sum(errors) / len(errors) < 0.05 and max(errors) < 0.25
    assert sum(short) / len(short) < 0.12


def test_sketches_merge_and_stand_ins_are_unknown(spark):
    draw = random.Random(1)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(n)) for n in (0, 1, 4, 5, 6, 9, 40, 700)]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    limit = -(2**63) + 2**64 // fingerprints.SCALE
    made = pairs.select(*[fingerprints.sketch(F.col(c)).alias(c) for c in "ab"])
    for r in made.select("a", "b", fingerprints.merge(F.col("a"), F.col("b")).alias("m"), fingerprints.containment(F.col("a"), F.col("b")).alias("c")).collect():
        below = sorted(x for x in {*r["a"], *r["b"]} if x < limit)
        assert r["m"] == (below or sorted({*r["a"], *r["b"]})[:1])
        if r["a"] and r["a"][0] >= limit and r["a"] != r["b"]:
            assert r["c"] is None
        else:
            assert r["c"] == (len({*r["a"]} & {*r["b"]}) / len(r["a"]) if r["a"] else 1)


def test_fingerprint_edge_tables(make_docs):
    assert fingerprints.fingerprint_edits(make_docs([])).count() == 0
    alone = fingerprints.fingerprint_edits(make_docs([(3, "a b c d e f g h")])).collect()[0]
    assert alone["near_next"] == 1 and alone["edited"] == _edit("a b c d e f g h", "a b c d e f g h")
    rows = fingerprints.fingerprint_edits(make_docs([(None, "abcd"), (4, "x y z w"), (4, "x y z w"), (9, "q" * 40)])).collect()
    assert sorted((str(r["doc_id"]), r["edited"]) for r in rows) == sorted([("None", "abc"), ("4", "x y z q"), ("4", "x y z q"), ("9", "q" * 30 + "x y z w")])


def _statistics(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = collections.Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_statistics_equal_brute_force(spark, sf_dir, make_docs):
    texts = ODD + ["a b c a b c a b c", "a a a a a", "x y z x y z", "q\nq\n\nq", "# * |<>"] + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rows = outliers.robust_outliers(make_docs(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = _statistics(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, texts[r["doc_id"]][:80]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])


def test_outliers_go_and_clean_documents_stay(spark, sf_dir):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries.op8_quality_outliers(spark, "/root/testdata/sf0.01").where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in rows}
    assert kept[1] >= 0.99 and kept[0] <= 0.6


def test_outlier_edge_tables(make_docs):
    assert outliers.robust_outliers(make_docs([])).count() == 0
    assert outliers.robust_outliers(make_docs([(None, "w " * 60), (1, None)])).count() == 2


def test_chi_square_quantiles():
    assert outliers.chi_square(5, 0.5) == pytest.approx(4.351, abs=0.02)
    assert outliers.chi_square(5, 0.99) == pytest.approx(15.086, abs=0.05)
