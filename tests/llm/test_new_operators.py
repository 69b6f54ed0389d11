"""Spelling variants, hard negatives and quality scores against brute force, held-out labels and odd tables."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenejobs.llm import hard_negatives, quality, queries, spelling
from tests.llm.conftest import ODD


def one_error(a, b):
    """Whether two strings differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_variants(rows, least_length, least_count):
    """Word, form, root, n, near words and form's n by comparing each word with all others."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(spelling.RUN, text or ""):
            word = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    n = {w: k for w, k in counts.items() if len(w) >= least_length and k >= least_count}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size.get(size, []) if one_error(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(v is None, v) for v in r])


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute_variants([tuple(r) for r in docs], 6, 5)
    assert len(want) > 100 and any(r[1] for r in want)
    assert rows_of(queries.op11_spelling_variants(spark, sf_dir), *COLUMNS) == want


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), max_size=40), st.text("abc", min_size=1, max_size=6), st.integers(0, 3))
def test_automaton_finds_all_words_at_one_error(words, word, fixed):
    known = sorted(words)
    found = spelling.Automaton(known).near(word, min(fixed, len(word)))
    begin = word[:fixed]
    later = lambda v: any(v[:i] == word[:i] and v[i + 1 :] in (word[i:], word[i + 1 :]) for i in range(len(begin), len(word) + 1))
    assert {known[i] for i in found} == {v for v in known if one_error(word, v) and len(v) >= len(word) and v[: len(begin)] == begin and later(v)}


def test_automaton_shares_endings():
    states, todo = set(), [spelling.Automaton(["abcxyz", "bcdxyz", "cdexyz"]).top]
    while todo:
        state = todo.pop()
        if id(state) not in states:
            states.add(id(state))
            todo += [after for after, _ in state[1].values()]
    assert len(states) == 7 + 4  # the beginnings apart, then one tail of the three words


def test_slices_of_a_heavy_half_change_nothing(spark, monkeypatch):
    words = spark.createDataFrame([(f"stem{a}{b}", 1 + 7 * ((ord(a) * ord(b)) % 5)) for a in "abcdefghij" for b in "abcdefghijklm"], "word string, n long")
    whole = rows_of(spelling.variants(words), *COLUMNS)
    monkeypatch.setattr(spelling, "ENTRIES_PER_SLICE", 7)
    monkeypatch.setattr(spelling, "ENTRIES_PER_TASK", 5)
    assert rows_of(spelling.variants(words), *COLUMNS) == whole
    assert sum(r[4] for r in whole) == 130 * (9 + 12)


def test_forms_follow_each_other_to_the_root(spark):
    chain = [("letter", 5), ("lettera", 25), ("letteraa", 125), ("letteraab", 625), ("letteraabb", 3125), ("letteraabbc", 15625)]
    found = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert found["letter"] == ("lettera", "letteraabbc") and found["letteraabbc"] == (None, "letteraabbc")


def test_spelling_of_odd_tables(spark, make_docs):
    docs = [*ODD, (None, "correct corect correct"), (3, "correct correct Correct"), (3, "correct"), "ÀÉÎÕÜ× ÿÿÿÿÿÿ"]
    frame = make_docs(docs)
    want = brute_variants([(r["doc_id"], r["text"]) for r in frame.collect()], 2, 1)
    got = spelling.variants(spelling.word_counts(spelling.mistyped(spelling.runs(frame)), 2, 1))
    assert rows_of(got, *COLUMNS) == want
    assert spelling.variants(spelling.word_counts(spelling.mistyped(spelling.runs(make_docs([]))))).count() == 0


SHAPE = "vec_id long, embedding array<float>, label int, row string, far int, block int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "clash", 1, 2) for i, v, k in rows], SHAPE)


def mined(rows):
    found = hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)
    return rows_of(found, "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute_mined(rows):
    """Every anchor with every row, in plain Python."""
    used = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], k) for i, v, k in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    last = lambda i: (i is None, i)
    for a, (ai, av, ak) in enumerate(used):
        if ai is None or ai % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), last(i), i, k) for b, (i, v, k) in enumerate(used) if b != a]
        for score, _, pi, _ in sorted(r for r in scored if r[3] == ak)[:5]:
            fit = sorted((s, o, i) for s, o, i, k in scored if k != ak and 50 * -score <= 100 * -s <= 95 * -score)[:3]
            out += [(ai, pi, n + 1, i, -score, -s) for n, (s, _, i) in enumerate(fit)]
    return sorted(out, key=lambda r: [(v is None, v) for v in r])


def random_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8)) * 0.4
    return [(i, (centres[rng.integers(6)] + rng.normal(size=8) * 0.15).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 3)
    rows = random_rows(500)
    want = brute_mined(rows)
    assert len(want) > 50
    assert mined(vectors(spark, rows)) == want


def test_hard_negatives_of_ties_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    rows = random_rows(60, 1)
    rows += [(100 + i, rows[0][1], i % 2) for i in range(60)]  # one vector many times: ties by vec_id
    rows += [(400, None, 1), (401, [0.5] * 8, None), (402, [float("nan")] * 8, 1), (403, [None] * 8, 1), (404, [float("inf")] * 8, 1), (None, [0.4] * 8, 1), (450, [], 0), (500, [0.9, 0.1], 2)]
    assert mined(vectors(spark, rows)) == brute_mined(rows)


def test_hard_negatives_of_small_tables(spark):
    assert mined(vectors(spark, [])) == []
    assert mined(vectors(spark, [(0, [0.1], None)])) == []
    assert mined(vectors(spark, [(0, [0.5, 0.5], 1)])) == []
    assert mined(vectors(spark, [(0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.25, 0.25], 2)])) == [(0, 1, 1, 2, 32768, 16384)]


def test_repeated_anchor_ids_are_anchors_each(spark):
    rows = [(0, [0.5], 1), (0, [0.5], 1), (1, [0.4], 2)]
    assert mined(vectors(spark, rows)) == [(0, 0, 1, 1, 16384, 128 * 102)] * 2


def test_brackets_rule_out_far_rows_and_no_near_one():
    """Rows of another cluster are not multiplied out, and every row within reach is."""
    rng = np.random.default_rng(3)
    v = np.rint(256 * (np.eye(4)[np.arange(400) % 4] * 2 + rng.normal(size=(400, 4)) * 0.05)).astype(np.int64)
    pivots = v[:4].astype(float)
    far = list(np.sqrt(((v[:, None, :] - pivots) ** 2).sum(axis=2)))
    held = pd.DataFrame({"v": list(v), "far": far, "label": 1, "row": np.arange(400)})
    asking = held[:8].assign(nearest=0.0, farthest=100.0)
    for i, at, scores in hard_negatives._stripes(asking, held, 4, 1e-6, True):
        within = {j for j in range(400) if j != i and np.sqrt(((v[i] - v[j]) ** 2).sum()) <= 100}
        assert within <= set(at.tolist()) and len(at) < 120
        assert (scores == v[at] @ v[i]).all()


def test_scores_under_half_of_the_positive_are_no_negatives(spark):
    """Half of an odd score is rounded up; and shares of scores near 2**62 fit."""
    rows = [(0, [1 / 256], 1), (1, [3 / 256], 1), (2, [1 / 256], 2), (3, [2 / 256], 3)]
    assert mined(vectors(spark, rows)) == brute_mined(rows) == [(0, 1, 1, 3, 3, 2)]
    rows = [(0, [1e6] * 64, 1), (1, [1e6] * 64, 1), (2, [9e5] * 64, 2)]
    assert mined(vectors(spark, rows)) == brute_mined(rows) == [(0, 1, 1, 2, 64 * 256_000_000**2, 64 * 256_000_000 * 230_400_000)]


def test_two_blocks_make_one_frame(spark, monkeypatch):
    """However many anchors and positives meet the rows of a block."""
    calls, compared = [], hard_negatives._compared

    def spy(anchors, rows, pairs, work, schema):
        calls.append((anchors.toPandas(), rows.toPandas(), work))
        return compared(anchors, rows, pairs, work, schema)

    monkeypatch.setattr(hard_negatives, "_compared", spy)
    hard_negatives.mine(vectors(spark, random_rows(1000, 4)), F.col("vec_id") % 5 == 0)
    frames, frame = [], pd.DataFrame
    monkeypatch.setattr(pd, "DataFrame", lambda *a, **k: frames.append(1) or frame(*a, **k))
    for anchors, held, work in calls:
        frames.clear()
        assert len(work(anchors, held)) > 500 and len(frames) == 1
    assert len(calls) == 2


def test_blocks_grow_with_the_table_up_to_a_bound(spark, monkeypatch):
    """So that rows meet few blocks of anchors and anchors few blocks of rows, which is what they are moved for."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 100)
    monkeypatch.setattr(hard_negatives, "BLOCKS", 4)
    asked, compared = [], hard_negatives._compared

    def spy(anchors, rows, pairs, work, schema):
        asked.append((rows.groupBy("block").count().toPandas()["count"], anchors.select("block").distinct().count()))
        return compared(anchors, rows, pairs, work, schema)

    monkeypatch.setattr(hard_negatives, "_compared", spy)
    for n, largest in ((60, 16), (200, 50), (500, 100)):
        asked.clear()
        rows = random_rows(n, 5)
        assert mined(vectors(spark, rows)) == brute_mined(rows)
        assert all(counts.max() == largest and blocks == 1 for counts, blocks in asked) and len(asked) == 2


def test_quality_learns_from_labels_and_holds_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op13_quality_scores(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    bad, good = [r for r in held if labels[r["doc_id"]] == 0], [r for r in held if labels[r["doc_id"]] == 1]
    assert np.mean([r["predicted"] == 0 for r in bad]) > 0.95 and np.mean([r["predicted"] == 1 for r in good]) > 0.98
    again = {r["doc_id"]: r["score"] for r in queries.op13_quality_scores(spark, sf_dir).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)


def test_pairwise_fit_recovers_a_utility():
    rng = np.random.default_rng(0)
    true, rows = np.array([1.5, -0.5, 0.0]), rng.normal(size=(2, 20_000, 3))
    better = rng.random(20_000) < 1 / (1 + np.exp(-(rows[0] - rows[1]) @ true))
    fitted = quality.fit_pairs(np.where(better[:, None], rows[0], rows[1]), np.where(better[:, None], rows[1], rows[0]))
    assert np.abs(fitted - true).max() < 0.1


def test_quality_of_odd_tables(spark, make_docs):
    docs = make_docs([*ODD, (None, "a text without an id"), *["plain words in a row here"] * 3, *["### $$$ &&& %%%"] * 3])
    n = len(ODD)
    labels = spark.createDataFrame([(n + i, int(i < 4)) for i in range(1, 7)] + [(None, 1), (3, None), (4, 7), (n + 1, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == n + 7 and all(0 <= r["score"] <= 1 for r in rows) and "text" not in rows[0] and rows[0]["size"] == -1
    found = {r["doc_id"]: r["predicted"] for r in rows}
    assert [found[n + i] for i in range(1, 7)] == [1, 1, 1, 0, 0, 0]
    for none in (labels.where("quality = 1"), labels.where("false")):
        plain = quality.score_quality(docs, quality.fit_quality(docs, none)).collect()
        assert {(round(r["score"], 9), r["predicted"]) for r in plain} == {(0.5, 1)}
    assert quality.score_quality(make_docs([]), model).count() == 0
    assert quality.score_quality(docs, quality.fit_quality(make_docs([]), labels)).count() == n + 7


def _labelled(n_bad, n_good):
    """Documents of random letters and signs, more signs in those of label 0, and their labels."""
    rng = np.random.default_rng(3)
    kinds = [0] * n_bad + [1] * n_good
    texts = ["".join(rng.choice(list("abcdE 1#.\n"), 60, p=[x / 10 for x in (([1] * 10) if k else [1, 1, 1, 1, 1, 1, 1, 2, 0.5, 0.5])])) for k in kinds]
    return list(enumerate(texts)), list(enumerate(kinds)), np.array([quality.features(t) for t in texts]), np.array(kinds)


def test_quality_is_fitted_on_all_labelled_documents(spark):
    docs, labels, rows, kinds = _labelled(2_300, 2_900)
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert np.abs(model.mean - rows.mean(axis=0)).max() < 1e-9 and np.abs(model.spread - rows.std(axis=0) - 1e-3).max() < 1e-6
    assert np.sum(model.utilities(rows) < model.cut) == 2_300
    again = quality.fit_quality(docs.repartition(7), labels.repartition(3))
    assert (again.slope == model.slope).all() and again.cut == model.cut


def test_quality_compares_all_pairs_of_a_block(spark, monkeypatch):
    docs, labels, rows, kinds = _labelled(20, 90)
    once = docs
    docs = spark.createDataFrame([*docs, *docs[15:30]], "doc_id long, text string")  # rows that come twice count twice
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    at = np.r_[np.arange(len(once)), 15:30]
    worse, better = rows[at[kinds[at] == 0]], rows[at[kinds[at] == 1]]
    mean, spread = rows[at].mean(axis=0), rows[at].std(axis=0) + 1e-3
    want = quality.fit_pairs(np.tile((better - mean) / spread, (len(worse), 1)), np.repeat((worse - mean) / spread, len(better), axis=0))
    assert np.abs(quality.fit_quality(docs, labels).slope - want).max() < 1e-3
    monkeypatch.setattr(quality, "BLOCK_MANY", 30)  # three blocks, each with a copy of the few
    model = quality.fit_quality(docs, labels)
    assert np.abs(model.slope - want).max() < 1e-3 and np.abs(model.mean - mean).max() < 1e-9


def test_hard_negatives_sql_on_larger_tables(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    want = con.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({queries.OP12_SQL}) ORDER BY ALL").fetchall()
    assert rows_of(queries.op12_hard_negatives(spark, "/root/testdata/sf0.1"), "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score") == want


@pytest.mark.parametrize("kind", ["é", "ß", "ÿ"])
def test_letters_beyond_ascii_stay_as_they_are(spark, kind):
    found = spelling.runs(spark.createDataFrame([(1, f"AB{kind}C9x")], "doc_id long, text string")).collect()
    assert [r["word"] for r in found] == [f"ab{kind}c", "x"]
