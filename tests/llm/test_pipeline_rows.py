"""The pipeline's stages on rows with null ids, repeated ids and equal rows."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _words(k, n):
    return " ".join(f"w{k}x{i}" for i in range(n))


def _table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], COLUMNS).repartition(3)


def _kept(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_near_duplicates_judge_rows(spark):
    a, b, c, near = _words(1, 60), _words(2, 60), _words(3, 60), _words(1, 59) + " other"
    rows = [(None, a), (None, b), (None, a), (2, a), (4, near), (4, b), (4, b), (4, c), (7, c), (9, ""), (9, ""), (9, None), (10, "")]
    got = _kept(corpus_pipeline.drop_near_duplicates(spark, _table(spark, rows), ""))
    assert got == collections.Counter([(None, a), (None, a), (None, b), (2, a), (4, b), (4, c), (9, ""), (9, None), (10, "")])


def test_near_duplicates_of_one_id(spark):
    rows = [(5, _words(k, 40)) for k in range(6) for _ in range(3)] + [(None, _words(k, 40)) for k in range(6)]
    got = _kept(corpus_pipeline.drop_near_duplicates(spark, _table(spark, rows), ""))
    assert got == collections.Counter((i, _words(k, 40)) for k in range(6) for i in (5, None))


def test_mix_takes_rows(spark):
    rows = [(None, _words(0, 30)), (None, _words(1, 50)), (4, _words(2, 20)), (4, _words(2, 20)), (4, _words(3, 70)), (6, ""), (None, None)]
    got = corpus_pipeline.mix_sources(spark, _table(spark, rows), "")
    assert _kept(got) == collections.Counter(r for r in rows if r[1])
    assert got.columns == [x.split(" ")[0] for x in COLUMNS.split(", ")]


def test_mix_meets_its_budget(spark):
    rows = [([None, 3, k][k % 3], _words(k, 10 + k)) for k in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "ab"[k % 2], len(t)) for k, (i, t) in enumerate(rows)], COLUMNS)
    size = collections.Counter()
    for r in docs.collect():
        size[r["source"]] += len(r["text"].split())
    taken = collections.Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        assert any(t.startswith(r["text"]) for _, t in rows)
        taken[r["source"]] += len(r["text"].split())
    assert abs(taken["a"] - sum(size.values()) / 3) <= 1 and abs(taken["b"] - sum(size.values()) * 2 / 3) <= 1


CLASHING = ["size", "taken", "part", "first", "row", "rest", "n_gone", "lang_pred", "score", "component_id", "n_shingles", "__row", "__same", "key", "target", "id", "slice", "hash"]


def test_stages_keep_columns_whose_names_clash(spark):
    rows = [(1, _words(1, 60)), (2, _words(2, 60) + "\n" + _words(3, 30)), (None, _words(4, 60)), (3, _words(3, 30)), (5, None), (5, "")]
    plain = _table(spark, rows)
    wide = plain.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want, got = stage(spark, plain, ""), stage(spark, wide, "")
        assert got.columns == wide.columns, name
        found = got.collect()
        assert collections.Counter((r["doc_id"], r["text"]) for r in found) == _kept(want), name
        assert all(r[c] == (None if r["doc_id"] is None else f"{c} of {r['doc_id']}") for r in found for c in CLASHING), name
    assert corpus_pipeline.pack_sequences(spark, wide, "").count() == 6


def test_stages_take_an_empty_table(spark):
    docs = _table(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, ""))
        assert docs.columns == [x.split(" ")[0] for x in COLUMNS.split(", ")] and docs.count() == 0
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() == 0


def test_lines_of_null_and_repeated_ids(spark):
    text = "a b c\nd e f\ng h i"
    rows = [(None, text), (None, text), (1, text), (2, text), (2, "j k\n" + text), (2, "j k\n" + text), (3, None), (3, "")]
    got = _kept(corpus_pipeline.drop_repeated_lines(spark, _table(spark, rows), ""))
    assert got == collections.Counter([(None, text), (None, text), (1, text), (2, "j k"), (2, "j k"), (3, None), (3, "")])
