"""The pipeline against plain Python, stage by stage, on a small table."""

import hashlib
import re

import corpus_pipeline
import pytest
from tests.llm.test_duplicates import _components, _without_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = corpus_pipeline.written(docs)
        if name != "packing":
            assert docs.columns == columns
        out.append(docs)
    return [spark.read.parquet(f"{sf_dir}/documents.parquet"), *out]


def _rows(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"], r["text"]))


def test_languages(stages):
    before, after = {r["doc_id"]: r for r in stages[0].collect()}, _rows(stages[1])
    assert all(r == before[r["doc_id"]] for r in after) and len(after) >= 0.95 * len(before)
    assert all(any(c.isalpha() for c in r["text"]) for r in after)


def test_lines(stages):
    before = _rows(stages[1])
    want = {before[d]["doc_id"]: t for d, t, n in _without_lines([r["text"] for r in before]) if not n or WORD.search(t)}
    got = _rows(stages[2])
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_near_duplicates(stages):
    before = _rows(stages[2])
    want = [before[i]["doc_id"] for i, _, c in _components([r["text"] for r in before]) if i == c]
    assert [r["doc_id"] for r in _rows(stages[3])] == want


def test_mix(stages):
    sizes = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"]))) for r in stages[3].collect()}
    total, per, taken = sum(n for _, n in sizes.values()), {}, {}
    for source, n in sizes.values():
        per[source] = per.get(source, 0) + n
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(per))}
    target = {s: 3 * n for s, n in per.items()}
    capped = set()
    while len(capped) < len(per):
        level = (total - sum(target[s] for s in capped)) / sum(weight[s] for s in per if s not in capped)
        over = {s for s in per if s not in capped and level * weight[s] > 3 * per[s]}
        if not over:
            target |= {s: level * weight[s] for s in per if s not in capped}
            break
        capped |= over
    for r in stages[4].collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    for s in per:
        assert abs(taken.get(s, 0) - target[s]) <= 1


def test_packing(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    rows = stages[5].collect()
    assert sum(r["length"] for r in rows) == want
    ends = {}
    for r in rows:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in ends.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= corpus_pipeline.SEQUENCE_TOKENS
    assert len(ends) <= want / corpus_pipeline.SEQUENCE_TOKENS * 1.05 + 1


def test_run_is_the_stages(spark, sf_dir, stages):
    digest = lambda df: hashlib.sha256("\n".join(sorted(map(str, df.select(sorted(df.columns)).collect()))).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, sf_dir)) == digest(stages[5])
