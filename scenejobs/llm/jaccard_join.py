"""N-gram Jaccard join: parity sketches joined by pigeonhole per size band, then verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenejobs.llm.shared import U64, HashedTexts, gram_hashes, mixed, signed, slices, written

#: Words of a shingle.
SHINGLE_WORDS = 5
#: About so many rows of a bucket are compared with as many others at a time.
CELL_ROWS = 1024
#: A class with more than one in so many of all rows is labelled without moving its rows; there are fewer such classes than this.
HEAVY = 1000
#: About so many rows of cells go to one task.
ROWS_PER_TASK = 100_000


def _bands(largest: int = 1 << 40) -> list[int]:
    """Least set size of each band; bands grow by half."""
    out = [1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, -(-3 * out[-1] // 2)))
    return out


#: A band holds sets of LEAST[g] to LEAST[g + 1] - 1 shingles.
LEAST = _bands()
#: With 100 |A and B| >= 80 |A or B|, the larger set has at most 5/4 of the smaller one's size,
#: and the symmetric difference has at most (|A| + |B|) / 9 shingles. LARGEST is the size of the
#: largest partner of a set in band g, FAR[g] the largest symmetric difference.
LARGEST = [(b - 1) * 5 // 4 for b in LEAST[1:]]
FAR = [(b - 1 + c) // 9 for b, c in zip(LEAST[1:], LARGEST)]
#: Symbols of a sketch: more than FAR, so that equal ones are left over and common ones can be passed by.
SYMBOLS = [-(-5 * (d + 1) // 4) for d in FAR]
#: 64-bit words of the bit sketch that screens pairs, about two bits for a shingle.
BIT_WORDS = [max(1, (1 << (2 * a - 1).bit_length()) // 64) for a in LEAST[:-1]]


def groups_of(n: int) -> list[int]:
    """Bands in which a set of n shingles can meet partners: its own, and the one below if near enough."""
    g = int(np.searchsorted(LEAST, n, side="right")) - 1
    return [x for x in (g - 1, g) if x >= 0 and FAR[x] > 0 and (x == g or n <= LARGEST[x])]


@dataclass
class ShingleSets:
    """Distinct shingle hashes of several texts, ascending within each; text i has items begin[i] to end[i]."""

    items: np.ndarray
    end: np.ndarray

    def __post_init__(self) -> None:
        self.sizes = np.diff(self.end, prepend=0)
        self.begin = self.end - self.sizes

    def __getitem__(self, i: int) -> np.ndarray:
        return self.items[self.begin[i] : self.end[i]]

    def digests(self) -> np.ndarray:
        """Hash of each set, as Spark longs."""
        sums = np.concatenate([[U64(0)], np.cumsum(mixed(self.items), dtype=U64)])
        return signed(mixed(sums[self.end] - sums[self.begin] + self.sizes.astype(U64)))

    def expand(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of the chosen sets one after another, and the place in chosen of each."""
        sizes = self.sizes[chosen]
        place = np.repeat(np.arange(len(chosen)), sizes)
        return self.items[np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.begin[chosen], sizes)], place


def shingle_sets(texts: list[bytes | None]) -> ShingleSets:
    """Runs of five words with A-Z in lower case; fewer words are one shingle, none give an empty set."""
    hashed = HashedTexts([t.lower() if t else t for t in texts])
    grams, at = hashed.grams(SHINGLE_WORDS)
    owner = hashed.owner[at]
    short = np.flatnonzero((hashed.counts > 0) & (hashed.counts < SHINGLE_WORDS))
    whole = [gram_hashes(hashed.hashes[hashed.begin[i] : hashed.end[i]], int(hashed.counts[i])) for i in short]
    items, owner = np.concatenate([grams, *whole]), np.concatenate([owner, short])
    order = np.lexsort((items, owner))
    items, owner = items[order], owner[order]
    new = np.r_[True, (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])] if len(items) else np.empty(0, bool)
    return ShingleSets(items[new], np.cumsum(np.bincount(owner[new], minlength=len(texts))))


def bands_of(sets: ShingleSets) -> tuple[np.ndarray, np.ndarray]:
    """Sets and the bands in which they can meet partners, see groups_of(); in order of sets."""
    own = np.searchsorted(LEAST, sets.sizes, side="right") - 1
    far, largest = np.array(FAR), np.array(LARGEST)
    here = (own >= 0) & (far[own] > 0)
    below = (own >= 1) & (far[own - 1] > 0) & (sets.sizes <= largest[own - 1])
    chosen, band = np.r_[np.flatnonzero(below), np.flatnonzero(here)], np.r_[own[below] - 1, own[here]]
    order = np.lexsort((band, chosen))
    return chosen[order], band[order]


def symbols(sets: ShingleSets, chosen: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the parity sketches of the chosen sets in their bands: key, place in chosen, is it empty.

    Every shingle falls into one slot, and a slot's symbol is the XOR of its shingles' hashes.
    A shingle that only one of two sets has changes one symbol, so the symbols that differ
    are at most as many as the symmetric difference. Empty slots are left out where the others
    give at least FAR + 1 symbols; else the first empty ones make up the number.
    """
    s, place = sets.expand(chosen)
    slots, g = np.array(SYMBOLS, U64)[band], band.astype(U64)
    slot = ((mixed(s + U64(2) * g[place] + U64(1)) >> U64(32)) * slots[place]) >> U64(32)
    order = np.lexsort((slot, place))
    slot, place, values = slot[order], place[order], mixed(s[order] ^ U64(0xA5A5A5A5A5A5A5A5))
    first = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (place[1:] != place[:-1])]) if len(slot) else np.empty(0, np.int64)
    at = place[first]
    keys = mixed(np.bitwise_xor.reduceat(values, first) ^ _named(g[at], slot[first])) if len(first) else np.empty(0, U64)
    full = np.bincount(at, minlength=len(chosen))
    lacking = np.flatnonzero(full < np.array(FAR)[band] + 1)
    fill, owner, end = [], [], np.cumsum(full)
    for i in lacking:
        taken = slot[first[end[i] - full[i] : end[i]]]
        empty = np.setdiff1d(np.arange(slots[i], dtype=U64), taken)
        fill.append(np.sort(mixed(_named(g[i], empty)))[: FAR[band[i]] + 1 - full[i]])
        owner.append(np.full(len(fill[-1]), i))
    out, owner = np.concatenate([keys, *fill]), np.concatenate([at, *owner]).astype(np.int64)
    empty = np.arange(len(out)) >= len(keys)
    order = np.argsort(owner, kind="stable")
    return out[order], owner[order], empty[order]


def _named(g: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return mixed(((g + U64(1)) << U64(40)) + slot)


def bit_sketches(sets: ShingleSets, chosen: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of the shingles that hash to each bit, as 64-bit words, and where each sketch ends.

    The Hamming distance of two sketches bounds the symmetric difference from below.
    """
    s, place = sets.expand(chosen)
    size = np.array(BIT_WORDS)[band]
    end = np.cumsum(size)
    bit = mixed(s ^ U64(0x5BD1E995)) & (U64(64) * size.astype(U64) - U64(1))[place]
    odd = np.bincount(bit.astype(np.int64) + 64 * (end - size)[place], minlength=64 * int(end[-1]) if len(end) else 0) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64), end


def _by_band(values: list[int], g: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), g + 1)


def _sets(texts: DataFrame, kind: str) -> DataFrame:
    """Returns id, n, cls (digest of the set) and sketches (band, bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b])
                chosen, band = bands_of(sets)
                bits, end = bit_sketches(sets, chosen, band)
                words = pa.ListArray.from_arrays(pa.array(np.r_[0, end], pa.int32()), pa.array(signed(bits), pa.int64()))
                pairs = pa.StructArray.from_arrays([pa.array(band, pa.int32()), words], ["g", "bits"])
                sketches = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(chosen, minlength=b - a))], pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets.sizes, pa.int64()), pa.array(sets.digests(), pa.int64()), sketches], ["id", "n", "cls", "sketches"])

    return texts.mapInArrow(run, f"id {kind}, n long, cls long, sketches array<struct<g:int,bits:array<long>>>")


def _symbol_rows(texts: DataFrame) -> DataFrame:
    """Returns key, cls, info: a row per symbol, set and band. info packs the number of symbols, the band and whether the slot is empty.

    A task gives the symbols of equal sets once while it remembers them, so copies are pooled before they move.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b])
                digests, chosen = sets.digests(), []
                for i, digest in enumerate(digests.tolist()):
                    if digest not in seen:
                        chosen.append(i)
                        seen.add(digest)
                if len(seen) > 1_000_000:
                    seen.clear()
                fresh, (owner, band) = np.zeros(b - a, bool), bands_of(sets)
                fresh[chosen] = True
                owner, band = owner[fresh[owner]], band[fresh[owner]]
                keys, place, empty = symbols(sets, owner, band)
                given = np.bincount(place, minlength=len(owner))
                info = (given[place] << 16 | band[place] << 1) + empty
                columns = [signed(keys), digests[owner[place]], info.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "cls", "info"])

    return texts.mapInArrow(run, "key long, cls long, info long")


def _buckets(rows: DataFrame) -> DataFrame:
    """Returns key, cls, g, alone: the symbols that sets must be looked up by.

    Two sets that link share at least SYMBOLS - FAR symbols. With the symbols of all sets in one
    order, rarest first, each needs only its first FAR + 1 for the two to meet, so the symbols
    that common lines and passages leave everywhere are passed by. Symbols that no other set
    has are counted (alone) but needn't move on; empty slots come last.
    """
    of_key = W.partitionBy("key")
    rows = rows.withColumn("again", F.coalesce(F.lag("cls").over(of_key.orderBy("cls")) == F.col("cls"), F.lit(False)))
    rows = rows.withColumn("n_sets", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(of_key)).where("NOT again AND n_sets > 1")
    rows = rows.select("key", "cls", "n_sets", F.expr("CAST((info >> 1) & 32767 AS int)").alias("g"), F.expr("info >> 16").alias("given"), F.expr("info & 1").alias("empty"))
    of_set = W.partitionBy("cls", "g")
    rows = rows.withColumn("rank", F.row_number().over(of_set.orderBy("empty", "n_sets", "key"))).withColumn("alone", F.col("given") - F.count(F.lit(1)).over(of_set))
    return rows.where(F.col("rank") <= _by_band(FAR, F.col("g")) + 1 - F.col("alone")).select("key", "cls", "g", "alone")


def _stars(buckets: DataFrame) -> DataFrame:
    """Pairs of each bucket's most central set (fewest symbols of its own) with the others."""
    centres = buckets.groupBy("key").agg(F.min(F.struct("alone", "cls")).alias("first")).select("key", F.col("first.cls").alias("centre"))
    pairs = buckets.join(centres, "key").where("centre != cls")
    return pairs.select(F.least("centre", "cls").alias("a"), F.greatest("centre", "cls").alias("b"), "g").distinct()


def _screened(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sizes and Hamming distance allow a link."""
    sides = [sketches.select(F.col("cls").alias(x), "g", F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in ("a", "b")]
    both = pairs.join(sides[0], ["a", "g"]).join(sides[1], ["b", "g"])
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = (F.col("n_a") * 4 <= F.col("n_b") * 5) & (F.col("n_b") * 4 <= F.col("n_a") * 5)
    return both.where(fits & (9 * apart <= F.col("n_a") + F.col("n_b"))).select("a", "b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with 100 * intersection >= 80 * union."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("cls").alias("b"), F.col("items").alias("items_b")), "b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return both.where(180 * common >= 80 * (F.size("items_a") + F.size("items_b"))).select("a", "b")


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Returns cls, label: the least label of all nodes that links reach; nodes has cls and label.

    Every round takes the least label around each node and then the label of that label's own
    node, so long chains close in few rounds. Only nodes with a link move.
    """
    both = links.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    both = written(both)
    labels = written(nodes.join(both.select("cls").distinct(), "cls", "left_semi").select("cls", "label", F.col("label").alias("own")))
    while True:
        near = both.join(labels.select(F.col("cls").alias("other"), F.col("label").alias("near")), "other").groupBy("cls").agg(F.min("near").alias("near"))
        found = labels.join(near, "cls").select("cls", "own", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jumps = found.select(F.col("own").alias("label"), F.col("label").alias("jump"))
        moved = written(found.join(jumps, "label", "left").select("cls", "own", "before", F.least("label", F.coalesce("jump", "label")).alias("label")))
        labels = moved.select("cls", "label", "own")
        if moved.where("label != before").isEmpty():
            return labels.select("cls", "label")


def _across(buckets: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """Screened pairs of sets that share a bucket but no component yet.

    Buckets that one component fills are done. The rows of the others are dealt by hash in cells
    of about CELL_ROWS, and every cell meets every other, many to a task, where numpy compares
    the bit sketches; only pairs that may link leave it.
    """
    named = buckets.select("key", "cls", "g").join(labels, "cls", "left").withColumn("comp", F.coalesce("label", "cls")).withColumn("labelled", F.col("label").isNotNull()).drop("label")
    name = F.struct("labelled", "comp")
    spread = named.groupBy("key").agg(F.min(name).alias("least"), F.max(name).alias("most"), F.count(F.lit(1)).alias("sets"))
    spread = spread.where("least != most").select("key", F.ceil(F.col("sets") / CELL_ROWS).alias("cells"))
    open_rows = written(named.join(spread, "key").withColumn("cell", F.pmod(F.xxhash64("cls"), F.col("cells"))))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("other")
    rows = open_rows.select("*", other).withColumn("low", F.least("cell", "other")).withColumn("high", F.greatest("cell", "other"))
    rows = rows.join(sketches, ["cls", "g"])
    tasks = open_rows.agg(F.coalesce(F.sum("cells"), F.lit(1))).first()[0] // ROWS_PER_TASK + 8
    rows = rows.withColumn("task", F.pmod(F.xxhash64("key", "low", "high"), F.lit(tasks)))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("low", "ascending"), ("high", "ascending")]).combine_chunks()
        key, low, high, cls, comp, labelled, n, cell = (table[c].to_numpy() for c in ("key", "low", "high", "cls", "comp", "labelled", "n", "cell"))
        bits = table["bits"].combine_chunks()
        flat, ends = bits.values.to_numpy().view(U64), bits.offsets.to_numpy()
        change = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        bounds = np.r_[0, np.flatnonzero(change) + 1, len(key)]
        a, b = [], []
        for i, j in zip(bounds[:-1], bounds[1:]):
            sketch = flat[ends[i] : ends[j]].reshape(j - i, -1)
            at = np.arange(i, j)
            left, right = (at, at) if low[i] == high[i] else (at[cell[at] == low[i]], at[cell[at] == high[i]])
            for x in left:
                y = right[(comp[right] != comp[x]) | (labelled[right] != labelled[x])]
                y = y[cls[y] > cls[x]] if low[i] == high[i] else y
                far = np.bitwise_count(sketch[y - i] ^ sketch[x - i]).sum(axis=1, dtype=np.int64)
                y = y[(9 * far <= n[y] + n[x]) & (4 * n[y] <= 5 * n[x]) & (4 * n[x] <= 5 * n[y])]
                a.append(np.minimum(cls[x], cls[y]))
                b.append(np.maximum(cls[x], cls[y]))
        pairs = np.unique(np.array([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.empty((2, 0), np.int64)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return rows.groupBy("task").applyInArrow(compare, "a long, b long").distinct()


def _labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Returns id, n, component: rows (id, n, cls) with the component of their class, else their own id.

    Rows without a class don't move. A class with many copies is one of fewer than HEAVY, so
    their labels go to the rows; all other rows meet theirs by class.
    """
    classed, total = rows.where("cls IS NOT NULL"), rows.count()
    heavy = known.where(F.col("copies") * HEAVY > total)
    large = classed.join(F.broadcast(heavy), "cls")
    small = classed.join(F.broadcast(heavy), "cls", "left_anti").join(known, "cls", "left")
    alone = rows.where("cls IS NULL").select("id", "n", F.col("id").alias("component"))
    return large.unionByName(small).select("id", "n", F.coalesce("component", "id").alias("component")).unionByName(alone)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_shingles, component_id for every row.

    A document's set holds its distinct runs of five words, A-Z in lower case; fewer words are
    one run, none give an empty set. Documents link when 100 * intersection >= 80 * union;
    component_id is the smallest id that links reach. Every link between different sets counts:

    1. equal sets become one class, by digest, and only classes go on;
    2. classes meet where their parity sketches share a symbol (see symbols() and _buckets());
    3. each bucket's most central class is paired with the others, pairs are screened by bit
       sketches and verified on whole sets, and components are formed;
    4. in buckets that hold several components still, all pairs across them are screened and
       verified, in cells of bounded size.

    Null, empty and blank texts have 0 shingles and their own id, repeated ids are one document
    for its component; a row with a null id links with nothing and has no component.
    Sets are told apart by 64-bit hashes.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    found = written(_sets(texts, kind))
    linking = found.where("n > 0 AND id IS NOT NULL")
    classes = linking.groupBy("cls").agg(F.min("id").alias("label"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    buckets = written(_buckets(_symbol_rows(texts.where("id IS NOT NULL").select("text"))))
    meeting = buckets.select("cls").distinct()
    classes = written(classes.join(meeting, "cls", "left_semi"))
    sketches = classes.select("cls", "n", F.inline("sketches"))

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b])
                items = pa.ListArray.from_arrays(pa.array(np.r_[0, sets.end], pa.int32()), pa.array(signed(sets.items), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets.digests(), pa.int64()), items], ["cls", "digest", "items"])

    owners = classes.select("cls", F.col("label").alias("id"))
    sets = texts.join(owners, "id").select("cls", "text").mapInArrow(items, "cls long, digest long, items array<long>")
    sets = written(sets.where("cls = digest").select("cls", "items"))
    nodes = classes.select("cls", "label")
    links = written(_verified(_screened(_stars(buckets), sketches), sets))
    labels = components(links, nodes)
    more = _verified(_across(buckets, labels, sketches), sets)
    labels = components(links.unionByName(more), nodes)
    firsts = linking.groupBy("cls").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    known = firsts.join(labels, "cls", "left").where("copies > 1 OR label IS NOT NULL")
    known = written(known.select("cls", "copies", F.coalesce("label", "least").alias("component")))
    rows = found.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("cls")).alias("cls"))
    return _labelled(rows, known).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
