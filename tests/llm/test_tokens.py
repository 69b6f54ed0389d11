import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.conftest import ODD
from scenejobs.llm import packing, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return ODD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


def test_counts_equal_the_library(make_docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(make_docs(texts), WORD, limit=50).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 50)


def test_pieces_equal_the_library_and_fill_sequences(make_docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    rows = packing.pack(packing.cut_pieces(make_docs(texts), BYTE, limit=256), 256).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert k == 0 or r["length"] == 256
            at += r["length"]
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // 256) * 1.02 + 1


def test_ids_of_many_documents_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {(r["doc_id"], r["piece"]): (r["length"], r["ids_crc32"]) for r in packing.cut_pieces(docs, BYTE).collect()}
    rows = docs.collect()
    for r, found in zip(rows, library.encode_batch_fast([r["text"] or "" for r in rows], add_special_tokens=False)):
        ids, at = np.array([*found.ids, 0], "<u4"), 0
        for k in range(-(-len(ids) // 2048)):
            n, crc = got.pop((r["doc_id"], k))
            assert crc == zlib.crc32(ids[at : at + n].tobytes())
            at += n
        assert at == len(ids)
    assert not got


def test_many_shards_cost_about_a_sequence_each(spark):
    rng = np.random.default_rng(3)
    sizes = np.minimum(2048, rng.lognormal(5.5, 1.2, 6000).astype(int) + 1).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, n, 7) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    for shard in (10_000, 600, 100):
        n = packing.pack(pieces, 2048, pieces_per_shard=shard).select("sequence_id").distinct().count()
        assert n <= -(-sum(sizes) // 2048) + 1.5 * -(-len(sizes) // shard)


def test_best_fit_equals_a_linear_search():
    sizes = np.sort(np.random.default_rng(1).integers(1, 101, 400))[::-1]
    bins, offsets = packing.best_fit(sizes, 100)
    left: list[int] = []
    for size, b, at in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        fits = [x for x in left if x >= size]
        if fits:
            assert left[b] == min(fits) and at == 100 - left[b]
        else:
            assert b == len(left) and at == 0
            left.append(100)
        left[b] -= size


def test_empty_table(make_docs):
    assert token_counts.count_tokens(make_docs([]), WORD).count() == 0
    assert packing.pack(packing.cut_pieces(make_docs([]), BYTE)).count() == 0


def test_null_ids_and_repeated_rows(make_docs):
    docs = make_docs([(None, "a b"), (5, "a b"), (5, "a b")])
    assert token_counts.count_tokens(docs, WORD).count() == 3
    assert packing.pack(packing.cut_pieces(docs, BYTE)).count() == 3
