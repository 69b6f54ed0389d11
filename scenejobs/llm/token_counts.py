"""Token counts: pieces once per distinct pre-token, joined to the documents' frequencies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenejobs.llm.shared import SLICE_TEXTS, TABLE_ENTRIES, groups, make_room, slices

_TOKENIZERS: dict[str, object] = {}
_PRE_TOKENS: dict[str, dict[bytes, tuple[str, ...]]] = {}
#: The first letter of a pre-token says whether it is ordinary or a special string of the tokenizer; documents' own rows have another.
ORDINARY, SPECIAL, DOCUMENT = "p", "s", "d"
#: An entry of a posting: a text's place in its slice, and how often it holds the pre-token.
ENTRY = np.dtype([("place", "<u2"), ("times", "u1")])
#: Bytes of text of a slice.
SLICE = 8_000_000
#: Reading tasks whose postings of one pre-token may meet in one task.
TASKS_PER_BLOCK = 256
#: Largest frequency of one entry of a posting; a larger one is split into several entries.
MOST = 255


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per process."""
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _TOKENIZERS[path] = loaded
    return _TOKENIZERS[path]


def check_tokenizer(path: str) -> None:
    """Refuses a file whose tokenizer doesn't put words in lower case and drop white space, or that has added tokens which take in what is around them."""
    library = tokenizer(path)
    cut = library.normalizer and library.pre_tokenizer and [x for x, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str("Ab \n cD"))]
    if cut != ["ab", "cd"]:
        raise ValueError(f"{path}: counts need a tokenizer that lower-cases words and drops white space, this one cuts 'Ab \\n cD' into {cut}")
    wide = [t.content for t in library.get_added_tokens_decoder().values() if t.lstrip or t.rstrip or t.single_word or t.normalized]
    if wide:
        raise ValueError(f"{path}: added tokens {wide} depend on what is around them")


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter of each byte: printable Latin-1 stays, the rest follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def pre_tokens(path: str, words: list[bytes]) -> list[tuple[str, ...]]:
    """The pre-tokens of each word between white space, which a tokenizer that drops white space never joins.

    The library takes special strings out, normalises what is left and cuts it. A word of
    plain letters alone is one pre-token, in lower case as the normaliser gives it. The
    process remembers the words that it has cut, in a table of bounded size.
    """
    table, library = _PRE_TOKENS.setdefault(path, {}), tokenizer(path)
    make_room(table, set(words))
    special = sorted((t.content for t in library.get_added_tokens_decoder().values()), key=len, reverse=True)
    cut_at = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    out = []
    for word in words:
        found = table.get(word)
        if found is None:
            text = word.decode("utf-8", "replace")
            if text.isascii() and text.isalpha():
                found = (ORDINARY + text.lower(),)
            else:
                parts = cut_at.split(text) if cut_at else [text]
                ordinary = ([ORDINARY + x for x, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(p))] for p in parts[::2])
                strange = [[SPECIAL + p] for p in parts[1::2]]
                found = tuple(chain.from_iterable(x for pair in zip(ordinary, [*strange, []]) for x in pair))
            table[word] = found
        out.append(found)
    return out


def frequencies(path: str, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of several texts, where each one's entries end, and per entry the text's place and its frequency there."""
    split = [t.split() if t else [] for t in texts]
    coded = pa.array(chain.from_iterable(split), pa.binary()).dictionary_encode()
    found = pre_tokens(path, coded.dictionary.to_pylist())
    number: dict[str, int] = {}
    flat = np.fromiter((number.setdefault(x, len(number)) for x in chain.from_iterable(found)), np.int64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    if not len(flat):
        return [], *(np.empty(0, np.int64) for _ in range(3))
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    pairs, times = np.unique(owner * len(sizes) + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    owner, word = np.divmod(pairs, len(sizes))
    n = sizes[word]
    begin = np.cumsum(sizes) - sizes
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[word], n)
    keys = flat[at] * len(texts) + np.repeat(owner, n)
    order = np.argsort(keys, kind="stable")
    first, _ = groups(keys[order])
    total = np.add.reduceat(np.repeat(times, n)[order], first)
    again = -(-total // MOST)
    token, place = np.divmod(np.repeat(keys[order][first], again), len(texts))
    each = np.full(len(token), MOST)
    each[np.cumsum(again) - 1] = total - MOST * (again - 1)
    return list(number), np.searchsorted(token, np.arange(len(number)), side="right"), place, each


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of values as binary cells."""
    offsets = np.r_[0, ends * values.itemsize].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Returns id, n_bytes, n_tokens, over_limit for every row, for a tokenizer that drops white space.

    1. A task cuts slices of documents into pre-tokens and gives a posting for each distinct
       one: the documents of the slice that hold it, and how often. Postings are dealt by
       pre-token, once.
    2. The distinct pre-tokens of all postings make one table, and each is tokenised once.
    3. Postings are joined to that table by pre-token. A task adds up frequency times pieces
       for the documents of each slice that it meets, and slices add up these sums. No ids
       are kept.

    A pre-token that all documents share has one posting per slice, and postings are dealt by
    pre-token and block of TASKS_PER_BLOCK reading tasks, so one key never has more postings
    than such a block has slices; a pre-token is tokenised once a block. A slice holds a
    few megabytes of text. Null and empty texts have 0 bytes and 0 tokens. Repeated rows are
    counted each. Other columns are ignored; an id may be null. A tokenizer file that
    check_tokenizer() doesn't know to handle is refused.
    """
    check_tokenizer(path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in slices(texts, SLICE):
                n = b - a
                size = pa.array([len(t or b"") for t in texts[a:b]], pa.int64())
                names = pa.array([f"{DOCUMENT}{number + i}" for i in range(n)])
                own = np.zeros(n, ENTRY)
                own["place"] = np.arange(n)
                yield _batch(names, number, ids.slice(a, n), size, _packed(own, np.arange(1, n + 1)))
                tokens, ends, place, times = frequencies(path, texts[a:b])
                n = len(tokens)
                if n:
                    entries = np.empty(len(place), ENTRY)
                    entries["place"], entries["times"] = place, times
                    yield _batch(pa.array(tokens, pa.string()), number, pa.nulls(n, ids.type), pa.nulls(n, pa.int64()), _packed(entries, ends))
                number += SLICE_TEXTS

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = tokenizer(path).model.tokenize
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            at = [i for i, t in enumerate(tokens) if t[0] != DOCUMENT]
            counts = [len(tokenize(tokens[i][1:])) if tokens[i][0] == ORDINARY else 1 for i in at]
            chosen = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(counts, pa.int64())], ["token", "block", "pieces"])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for number, total in sums.items():
                at = np.flatnonzero(total)
                yield _sums([number], pa.nulls(1, id_type), pa.nulls(1, pa.int64()), [at.astype("<u2").tobytes()], [total[at].astype("<i8").tobytes()])
            sums.clear()

        for batch in batches:
            payload, n = batch.column(0), batch.column(1)
            number, ids, size, entries = (payload.field(k) for k in range(4))
            id_type = ids.type
            isdoc = n.is_null().to_numpy(zero_copy_only=False)
            if isdoc.any():
                chosen = pa.array(np.flatnonzero(isdoc))
                places = [np.frombuffer(e, ENTRY)["place"].tobytes() for e in entries.take(chosen).to_pylist()]
                yield _sums(number.take(chosen), ids.take(chosen), size.take(chosen), places, [None] * len(places))
            chosen = np.flatnonzero(~isdoc)
            if len(chosen):
                number, n, cells = (c.take(pa.array(chosen)) for c in (number, n, entries))
                cells = cells.to_pylist()
                flat = np.frombuffer(b"".join(cells), ENTRY)
                counts = np.fromiter(map(len, cells), np.int64, len(cells)) // ENTRY.itemsize
                each, owner = np.repeat(n.to_numpy(), counts) * flat["times"], np.repeat(number.to_numpy(), counts)
                order = np.argsort(owner, kind="stable")
                first, count = groups(owner[order])
                for k, a in zip(owner[order[first]].tolist(), range(len(first))):
                    part = order[first[a] : first[a] + count[a]]
                    total = np.bincount(flat["place"][part], weights=each[part]).astype(np.int64)
                    if len(total) > len(sums.setdefault(k, total * 0)):
                        sums[k], total = total, sums[k]
                    sums[k][: len(total)] += total
                if sum(map(len, sums.values())) > TABLE_ENTRIES:
                    yield from flush()
        yield from flush()

    def added(table: pa.Table) -> pa.Table:
        own = pc.is_null(table["sums"])
        known, parts = table.filter(own), table.filter(pc.invert(own))
        total = np.zeros(SLICE_TEXTS, np.int64)
        for place, n in zip(parts["places"].to_pylist(), parts["sums"].to_pylist()):
            np.add.at(total, np.frombuffer(place, "<u2"), np.frombuffer(n, "<i8"))
        place = np.frombuffer(b"".join(known["places"].to_pylist()), "<u2")
        return pa.table({"id": known["id"], "n_bytes": known["n_bytes"], "n_tokens": pa.array(total[place])})

    dealt = rows.mapInArrow(posted, f"token string, payload struct<slice:long,id:{kind},n_bytes:long,entries:binary>")
    block = (F.shiftright("payload.slice", 32) / TASKS_PER_BLOCK).cast("int")  # a slice's number begins with its reading task
    dealt = dealt.select("token", block.alias("block"), "payload").repartition("token", "block")  # one exchange, which both sides read
    vocabulary = dealt.groupBy("token", "block").agg(F.count("payload").alias("n_postings")).mapInArrow(pieces, "token string, block int, pieces long")
    joined = dealt.join(vocabulary, ["token", "block"], "left").select("payload", "pieces")
    parts = joined.mapInArrow(combined, f"slice long, id {kind}, n_bytes long, places binary, sums binary")
    out = parts.groupBy("slice").applyInArrow(added, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _batch(tokens: pa.Array, number: int, ids: pa.Array, size: pa.Array, entries: pa.Array) -> pa.RecordBatch:
    payload = pa.StructArray.from_arrays([pa.array(np.full(len(tokens), number)), ids, size, entries], ["slice", "id", "n_bytes", "entries"])
    return pa.RecordBatch.from_arrays([tokens, payload], ["token", "payload"])


def _sums(number, ids: pa.Array, size: pa.Array, places: list[bytes], sums: list[bytes | None]) -> pa.RecordBatch:
    number = number if isinstance(number, pa.Array) else pa.array(number, pa.int64())
    return pa.RecordBatch.from_arrays([number, ids, size, pa.array(places, pa.binary()), pa.array(sums, pa.binary())], ["slice", "id", "n_bytes", "places", "sums"])
