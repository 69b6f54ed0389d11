import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from scenejobs.llm import jaccard_join, line_dedup, repeats
from scenejobs.llm.shared import HashedTexts, hash_words
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _corpus(seed=3):
    """Random texts with exact copies, near copies of every degree, shared passages and repeated lines."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage, common = line(40), line(9)
    texts = ["\n".join(line(draw.randint(3, 14)) for _ in range(draw.randint(1, 12))) for _ in range(60)]
    base = texts[0] + " " + line(60)
    for k in range(40):
        words = base.split(" ")
        for _ in range(k // 4):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [texts[5], texts[5].upper(), texts[7] + "\n" + passage, passage, passage + " " + texts[9], "a b c d e f", "a b c d e", "a b c d e f g"]
    texts += [common + "\n" + t for t in texts[10:30]] + [texts[11] + "\n" + texts[12]]
    draw.shuffle(texts)
    return texts


TEXTS = ODD + _corpus()


def _shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _components(texts):
    sets, label = [_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [(i, len(s), x) for i, (s, x) in enumerate(zip(sets, label))]


@pytest.mark.parametrize("cell", [64, 3])
def test_components_equal_brute_force(make_docs, monkeypatch, cell):
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", cell)
    got = jaccard_join.jaccard_components(make_docs(TEXTS)).collect()
    assert sorted(map(tuple, got)) == _components(TEXTS)


def test_pairs_across_components_are_found_without_stars(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_stars", lambda b: b.select(F.col("cls").alias("a"), F.col("cls").alias("b"), "g").limit(0))
    got = jaccard_join.jaccard_components(make_docs(TEXTS)).collect()
    assert sorted(map(tuple, got)) == _components(TEXTS)


def test_sketches_bound_the_symmetric_difference():
    rng = np.random.default_rng(0)
    for n in (6, 9, 40, 300, 2500):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for share in (0.0, 0.02, 0.1, 0.2):
            d = int(len(a) * share)
            b = np.unique(np.r_[a[d // 2 :], rng.integers(0, 2**63, d - d // 2).astype(np.uint64)])
            far, sets = len(np.setxor1d(a, b)), jaccard_join.ShingleSets(np.r_[a, b], np.array([len(a), len(a) + len(b)]))
            chosen, band = jaccard_join.bands_of(sets)
            assert [band[chosen == i].tolist() for i in (0, 1)] == [jaccard_join.groups_of(len(x)) for x in (a, b)]
            bits, end = jaccard_join.bit_sketches(sets, chosen, band)
            keys, place, empty = jaccard_join.symbols(sets, chosen, band)
            for g in set(band[chosen == 0]) & set(band[chosen == 1]):
                i, j = (int(np.flatnonzero((chosen == x) & (band == g))[0]) for x in (0, 1))
                words = [bits[end[k] - jaccard_join.BIT_WORDS[g] : end[k]] for k in (i, j)]
                assert np.bitwise_count(words[0] ^ words[1]).sum() <= far
                assert min(np.count_nonzero(place == k) for k in (i, j)) > jaccard_join.FAR[g]
                if not empty[np.isin(place, (i, j))].any():
                    x, y = keys[place == i], keys[place == j]
                    assert max(len(x), len(y)) - len(np.intersect1d(x, y)) <= far


def test_every_size_meets_its_partners():
    for a in range(1, 400):
        for b in range(a, a * 5 // 4 + 1):
            if a + b >= 9 and (a, b) != (a, a) or a + b >= 9:
                shared = set(jaccard_join.groups_of(a)) & set(jaccard_join.groups_of(b))
                assert any((a + b) // 9 <= jaccard_join.FAR[g] for g in shared)


def test_jaccard_edge_tables(make_docs):
    assert jaccard_join.jaccard_components(make_docs([])).count() == 0
    rows = jaccard_join.jaccard_components(make_docs([(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "a b c"), (10, None)])).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(None, 1, None), (4, 1, 4), (4, 1, 4), (9, 1, 4), (10, 0, 10)], key=str)


def _without_repeats(texts):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d, w in enumerate(words):
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for k in range(13)}
        yield d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("size", [None, 300])
def test_repeats_equal_brute_force(make_docs, monkeypatch, size):
    if size:  # many slices and buckets
        monkeypatch.setattr(repeats, "DOCUMENT_SLICE", size)
        monkeypatch.setattr(repeats, "BUCKET_BYTES", size)
    texts = TEXTS + [" ".join(f"v{i}" for i in range(k, k + 13 + k)) for k in range(9)] + ["v1\x0bv2\x0cv3\rv4 v5 v6 v7 v8 v9 v10 v11 v12 v13 \xa0 v14"]
    got = repeats.drop_repeats(make_docs(texts)).collect()
    assert sorted(map(tuple, got)) == list(_without_repeats(texts))


def test_packed_numbers_come_back():
    rng = np.random.default_rng(5)
    for values in ([], [0], [2**48 - 1], [0, 1, 2**32 - 2, 2**32 - 1, 2**33, 2**47], np.unique(rng.integers(0, 2**48, 3000))):
        values = np.array(values, np.uint64)
        assert (repeats.unpack_sorted(repeats.pack_sorted(values)) == values).all()


def test_every_window_holds_a_block_that_a_rolling_probe_hits():
    window = [b"x%d" % i for i in range(repeats.WINDOW)]
    ids, none = pa.array([1]), pa.table({"id": pa.array([1])})
    for p in range(8):
        for q in range(8):
            pad = lambda n, c: [b"%s%d" % (c, x) for x in range(n)]
            one, two = (repeats.Slice(pa.table({"id": ids, "text": [b" ".join(w).decode()]}), none) for w in (pad(p, b"a") + window + pad(3, b"b"), pad(q, b"c") + window + pad(2, b"d")))
            keys, at = one.probes()
            assert len(np.intersect1d(keys[one.is_block(at)], two.probes()[0])) > 0


def test_repeats_edge_tables(make_docs):
    assert repeats.drop_repeats(make_docs([])).count() == 0
    long = " ".join(f"q{i}" for i in range(20))
    rows = repeats.drop_repeats(make_docs([(None, long), (4, long), (4, long), (6, long), (7, "q0 q1")])).collect()
    assert sorted(((r["doc_id"], r["n_removed"]) for r in rows), key=str) == sorted([(None, 0), (4, 0), (4, 0), (6, 20), (7, 0)], key=str)


def _without_lines(texts, run=3, least=20):
    numbered = [[x for x in (t or "").split("\n") if WORD.search(x)] for t in texts]
    seen, gone = set(), []
    for lines in numbered:
        drop = set()
        for i in range(len(lines)):
            for k in range(1, run + 1):
                key = tuple(lines[i : i + k])
                if len(key) == k and (k == run or sum(len(WORD.findall(x)) for x in key) >= least):
                    drop |= set(range(i, i + k)) if key in seen else set()
                    seen.add(key)
        gone.append(drop)
    return [(d, None if t is None else line_dedup.without_lines(t.encode(), g).decode(), len(g)) for d, (t, g) in enumerate(zip(texts, gone))]


LINES = ["k\nl\nm\nn\no", "x\nl\nm\nn\n\no\np", "k\nl\nm", "k\nl\nm\nk\nl\nm\nk\nl\nm", "1 " * 25, "a\n" + "1 " * 25 + "\nb", "c " * 12 + "\n" + "d " * 9, "e\n" + "c " * 12 + "\n" + "d " * 9 + "\nf", "c " * 12 + "\ng"]


@pytest.mark.parametrize("size", [None, 5])
def test_line_runs_equal_brute_force(make_docs, monkeypatch, size):
    if size:
        monkeypatch.setattr(line_dedup, "SLICE_LINES", size)
    texts = TEXTS + LINES
    got = line_dedup.dedup_lines(make_docs(texts)).select("doc_id", "text", "n_gone").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == _without_lines(texts)


def test_runs_are_maximal_and_equal_their_sources(make_docs):
    texts = TEXTS + LINES
    numbered = [[x for x in (t or "").split("\n") if WORD.search(x)] for t in texts]
    rows = line_dedup.repeated_runs(make_docs(texts)).collect()
    assert rows
    for row in rows:
        own = numbered[row["doc_id"]]
        for r in row["runs"]:
            source = numbered[r["source_id"]]
            assert (r["source_id"], r["source_start"]) < (row["doc_id"], r["start"])
            assert own[r["start"] : r["start"] + r["length"]] == source[r["source_start"] : r["source_start"] + r["length"]]
    long = next(row["runs"] for row in rows if row["doc_id"] == len(TEXTS) + 1)
    assert [(r["start"], r["length"], r["source_id"]) for r in long if r["source_id"] == len(TEXTS)] == [(1, 4, len(TEXTS))]


def test_winnowing_selects_alike():
    rng = np.random.default_rng(2)
    for _ in range(50):
        run = rng.integers(0, 4, 6).astype(np.uint64)
        a, b = np.r_[rng.integers(0, 4, 5).astype(np.uint64), run], np.r_[rng.integers(0, 4, 2).astype(np.uint64), run, run]
        inside = lambda h, at: {int(x) - at for x in line_dedup.winnow(h, 3) if at <= x < at + 6}
        for k in range(4):  # every window of the run has a common selected place
            assert {x for x in inside(a, 5) & inside(b, 2) if k <= x < k + 3}


def test_line_edge_tables(make_docs):
    assert line_dedup.dedup_lines(make_docs([])).count() == 0
    rows = line_dedup.dedup_lines(make_docs([(None, "a\nb\nc"), (3, "a\nb\nc"), (5, "a\nb\nc")])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == sorted([(None, "a\nb\nc"), (3, "a\nb\nc"), (5, "")], key=str)
    assert rows[0]["id"] == "clash"


def test_lines_send_only_changed_texts_through_python(make_docs):
    docs = make_docs([(1, "a\nb\nc"), (2, "a\nb\nc\nd"), (3, None)]).selectExpr("*", "make_interval(0, CAST(doc_id AS INT)) AS span")  # Arrow has no such type
    found = line_dedup.dedup_lines(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    assert sorted((r["doc_id"], r["text"], r["n_gone"], r["span"]) for r in found.selectExpr("doc_id", "text", "n_gone", "CAST(span AS STRING) AS span").collect()) == [(1, "a\nb\nc", 0, "1 months"), (2, "d", 3, "2 months"), (3, None, 0, "3 months")]


def test_lines_of_rows_with_an_equal_id(make_docs):
    docs = make_docs([(3, "a\nb\nc"), (4, "x\na\nb\nc"), (4, "x\na\nb\nc"), (4, "a\nb\nc\ny"), (4, "q\nr\ns"), (4, None)]).withColumn("n_gone", F.lit("old"))
    rows = line_dedup.dedup_lines(docs).collect()
    assert sorted(((r["doc_id"], r["text"], r["n_gone"]) for r in rows), key=str) == sorted([(3, "a\nb\nc", 0), (4, "x", 3), (4, "x", 3), (4, "y", 3), (4, "q\nr\ns", 0), (4, None, 0)], key=str)


def test_word_hashes_depend_on_the_word_alone(monkeypatch):
    from scenejobs.llm import shared

    texts = [(t or "").encode() for t in TEXTS]
    known = {}
    for block in (1 << 20, 7):
        monkeypatch.setattr(shared, "HASH_BLOCK", block)
        hashed = HashedTexts(texts)
        assert hashed.counts.tolist() == [len(t.split()) for t in texts]
        for t, a, b in zip(texts, hashed.begin, hashed.end):
            for word, h in zip(t.split(), hashed.hashes[a:b].tolist()):
                assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)
    pairs = np.array([f"{a:c}{b:c}{c:c}" for a in range(97, 123) for b in range(97, 123) for c in range(97, 123)])
    assert len(np.unique(hash_words(np.frombuffer(" ".join(pairs).encode(), np.uint8))[0])) == len(pairs)
