"""A third of all rows on one id, and a third equal: tasks stay even and results the same."""

import collections
import random
import statistics

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from scenejobs.llm import fingerprints, line_dedup, mixing, packing, repeats, token_counts
from tests.llm.test_duplicates import WORD

N = 240


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text): one id with N different texts, N equal rows, N rows of their own, that share lines and passages."""
    draw = random.Random(11)
    line = lambda n: " ".join(draw.choice("abcdefghijklmnopqrstuvw") + draw.choice("xyz") for _ in range(n))
    passages, lines = [line(30) for _ in range(4)], [line(22) for _ in range(4)]
    text = lambda: "\n".join(draw.choice([line(8), draw.choice(lines), draw.choice(passages) + " " + line(3)]) for _ in range(4))
    equal = text()
    found = [(50, text()) for _ in range(N)] + [(70, equal) for _ in range(N)] + [(i if i % 9 else None, text()) for i in range(1000, 1000 + N)]
    draw.shuffle(found)
    return found


def test_repeats_of_a_hot_id(make_docs, rows, monkeypatch):
    monkeypatch.setattr(repeats, "DOCUMENT_SLICE", 4_000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 9_000)
    first = {}
    for i, t in rows:
        w = WORD.findall(t)
        for k in range(len(w) - 12 if i is not None else 0):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = []
    for i, t in rows:
        w = WORD.findall(t)
        gone = {k + j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(13)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [tuple(r) for r in repeats.drop_repeats(make_docs(rows)).collect()]
    assert collections.Counter(got) == collections.Counter(want)


def test_line_runs_of_a_hot_id(make_docs, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "SLICE_LINES", 60)
    runs = lambda x: [(k, tuple(x[k : k + n])) for n in (1, 2, 3) for k in range(len(x) - n + 1) if n == 3 or sum(len(WORD.findall(y)) for y in x[k : k + n]) >= 20]
    first = {}
    for i, t in rows:
        for k, run in runs(t.split("\n")) if i is not None else []:
            first[run] = min((i, k), first.get(run, (i, k)))
    want = []
    for i, t in rows:
        lines = t.split("\n")
        gone = {k + j for k, run in runs(lines) if i is not None and first[run] != (i, k) for j in range(len(run))}
        want.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    got = [tuple(r) for r in line_dedup.dedup_lines(make_docs(rows)).select("doc_id", "text", "n_gone").collect()]
    assert collections.Counter(got) == collections.Counter(want)


def test_shards_of_equal_pieces_are_even(make_docs, rows):
    pieces = packing.cut_pieces(make_docs(rows), public_tokenizers.path("byte_bpe_50k.json"), limit=512)
    packed = packing.pack(pieces, 512, pieces_per_shard=60).collect()
    sizes = collections.Counter(r["sequence_id"] >> 32 for r in packed).values()
    assert len(packed) >= 3 * N and len(sizes) > 8 and max(sizes) <= 3 * statistics.median(sizes)
    used = collections.defaultdict(int)
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 512


def test_ranges_of_a_hot_id_are_even_and_meet_the_budget(make_docs, rows, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    docs = make_docs(rows).withColumn("source", F.lit("one"))
    keyed = docs.select("source", F.md5(F.col("doc_id").cast("string")).alias("key"), F.md5(F.monotonically_increasing_id().cast("string")).alias("tie")).where("key IS NOT NULL")
    parts = [r["count"] for r in mixing._in_ranges(keyed, 2).groupBy("source", "part").count().collect()]
    assert max(parts) <= 20 and sum(parts) == keyed.count()
    order = [(r["part"], r["key"], r["tie"]) for r in mixing._in_ranges(keyed, 2).collect()]
    assert sorted(order) == sorted(order, key=lambda r: r[1:])  # parts sort as their rows
    more = docs.union(make_docs([(9, "w " * 40), (50, "v " * 50)]).withColumn("source", F.lit("two")))
    taken = more.sparkSession.createDataFrame(mixing.mix(more).collect())
    for r in taken.groupBy("source", "target", "source_size").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).collect():
        assert r["taken"] == int(r["target"]) and r["size"] == r["source_size"]
    assert taken.where("taken > 3 * size").count() == 0


@pytest.mark.parametrize("tasks", [1, 2])
def test_counts_over_blocks_of_tasks(make_docs, rows, monkeypatch, tasks):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "TASKS_PER_BLOCK", tasks)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = collections.Counter((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in rows)
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(make_docs(rows).repartition(7), path).collect())
    assert got == want


def test_tokenizers_of_another_kind_are_refused(make_docs):
    with pytest.raises(ValueError, match="lower-cases"):
        token_counts.count_tokens(make_docs(["it's"]), public_tokenizers.path("byte_bpe_50k.json"))


def test_fingerprints_of_a_hot_id_are_split(spark, make_docs, rows):
    confs = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in confs}
    plain = collections.Counter(map(str, fingerprints.fingerprint_edits(make_docs(rows)).collect()))
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        found = fingerprints.fingerprint_edits(make_docs(rows).repartition(8))
        assert collections.Counter(map(str, found.collect())) == plain
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_chat_of_an_empty_table(spark):
    from scenejobs.llm import chat

    part = "array<struct<kind:string,text:string,ref:string,n_tokens:int>>"
    empty = spark.createDataFrame([], f"conv_id long, turn int, role string, text string, parts {part}")
    assert chat.read_back(chat.format_chats(empty)).count() == 0


def test_a_conversation_of_very_many_turns(spark):
    from scenejobs.llm import chat

    role, text = F.element_at(F.array(*map(F.lit, ("user", "assistant"))), (F.col("turn") % 2 + 1).cast("int")), F.concat(F.lit("turn <|im_end|> \u00e9 "), F.col("turn").cast("string"))
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("n_tokens"))
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("int").alias("turn")).select(F.lit(1).alias("conv_id"), "turn", role.alias("role"), F.array(part).alias("parts"))
    got = chat.read_back(chat.format_chats(rows)).select("loss_text", "turns.text").collect()
    want = [f"turn <|im_end|> \u00e9 {i}" for i in range(20_000)]
    assert got == [("".join(want[1::2]), want)]
