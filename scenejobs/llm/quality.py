"""Quality classifier: Bradley-Terry utilities learnt from preference pairs, cut at a quantile of the scores."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenejobs.functions.ranges import running
from scenejobs.llm.shared import written

#: About so many documents of the rarer label, and so many of the other, make up a block, whose pairs are all compared.
BLOCK_FEW, BLOCK_MANY = 128, 1_024
#: Weight of the squared utilities' slopes beside the mean loss of a pair.
PENALTY = 1e-4
#: Newton's steps end when no slope moves by more than this.
LEAST_MOVE = 1e-6
#: Score at the quantile that parts the labels.
CUT_SCORE = 0.3
#: Characters by kind: the kinds' shares of a text are features.
KINDS = ("lower", "upper", "letter", "digit", "space", "stop", "dash", "quote", "symbol", "odd")
NAMES = (
    "words", "letters_per_word", "words_per_line", *KINDS, "kinds_in_words", "distinct_words", "top_word", "distinct_triples", "distinct_lines", "short_words", "capital_words",
    "ended_words", "same_end", "longest_run",
)


def _kind(c: str) -> int:
    """The kind of a character."""
    category = unicodedata.category(c)
    name = (
        "lower" if category == "Ll" else "upper" if category in ("Lu", "Lt") else "letter" if category[0] in "LM" else "digit" if category[0] == "N" else "space" if c.isspace() else "stop" if c in ".,;:?!…" else
        "dash" if category in ("Pd", "Ps", "Pe") else "quote" if c in "'\"’‘“”«»" else "symbol" if category[0] in "PS" else "odd"
    )
    return KINDS.index(name)


_KIND_OF = np.fromiter((_kind(chr(c)) for c in range(1 << 16)), np.uint8, 1 << 16)


def features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of NAMES; null counts as empty."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.bincount(_KIND_OF[np.minimum(codes, 0xFFFF)], minlength=len(KINDS)) / max(len(codes), 1)
    words, lines = text.split(), [s for line in text.split("\n") if (s := line.strip())]
    n = max(len(words), 1)
    counts, ends = Counter(words), Counter(w[-1] for w in words)
    triples = len(set(zip(words, words[1:], words[2:]))) / max(len(words) - 2, 1) if len(words) > 2 else 1.0
    plain = sum(k for w, k in counts.items() if not w.isalpha())
    same = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True]) if len(codes) else np.array([0, 0])
    return [
        np.log1p(len(words)), np.log1p(sum(len(w) * k for w, k in counts.items()) / n), np.log1p(len(words) / max(len(lines), 1)), *kinds, plain / n, np.log1p(len(counts)) - 0.8 * np.log1p(len(words)),
        max(counts.values(), default=0) / n, triples, len(set(lines)) / max(len(lines), 1), sum(k for w, k in counts.items() if len(w) < 4) / n, sum(k for w, k in counts.items() if w[0].isupper()) / n,
        sum(k for c, k in ends.items() if not c.isalnum()) / n, max((k for c, k in ends.items() if not c.isalnum()), default=0) / n, np.log1p(np.diff(same).max()),
    ]


@dataclass
class QualityModel:
    """Means and spreads of the features, the slopes of the utility, and the utility at the cut."""

    mean: np.ndarray
    spread: np.ndarray
    slope: np.ndarray
    cut: float

    def utilities(self, rows: np.ndarray) -> np.ndarray:
        """Utilities of rows of features, each summed up by itself, so that the rows beside it don't change its last digit."""
        return ((rows - self.mean) / self.spread * self.slope).sum(axis=1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Scores in [0, 1] of rows of features; CUT_SCORE at the cut."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.cut - self.utilities(rows)) * (1 / CUT_SCORE - 1))


def held_out(doc_id: Column) -> Column:
    """Documents that the fit must not see: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _replaced(docs: DataFrame, column: str, added: str, work: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """docs with columns added in place of one; work makes their arrays from that of a batch. Columns of the same names are replaced."""
    names = [x.split()[0] for x in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *work(batch.column(batch.num_columns - 1))], [*batch.schema.names[:-1], *names])

    kept = [f for f in docs.schema.fields if f.name not in (*names, column)]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], added])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(column).alias("__text")).mapInArrow(run, schema)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of features from an array of lists."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def featured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces the text by features, those of the whole text."""
    return _replaced(docs, text_col, "features array<double>", lambda texts: [pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))])


def _newton(judge: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The n slopes with the least loss; judge gives the mean loss of a pair at slopes, its gradient and its second derivatives.

    Newton's steps, halved while the loss would rise.
    """
    slope, whole = np.zeros(n), lambda at, s: at[0] + PENALTY * (s @ s) / 2
    here = judge(slope)
    while True:
        step = np.linalg.solve(here[2] + PENALTY * np.eye(n), PENALTY * slope + here[1])
        while np.abs(step).max() > LEAST_MOVE and whole(ahead := judge(slope - step), slope - step) > whole(here, slope):
            step = step / 2
        if np.abs(step).max() <= LEAST_MOVE:
            return slope
        slope, here = slope - step, ahead


def fit_pairs(better: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """Slopes of the Bradley-Terry utility: a row of better is preferred to the row of worse beside it.

    The chance of a preference is the logistic of the difference of utilities, so the loss is
    logistic in the differences of features.
    """
    apart = better - worse

    def judge(slope: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        ahead = apart @ slope
        wrong = 1 / (1 + np.exp(np.clip(ahead, -500, 500)))
        return np.logaddexp(0, -ahead).mean(), -apart.T @ wrong / len(apart), (apart * (wrong * (1 - wrong))[:, None]).T @ apart / len(apart)

    return _newton(judge, apart.shape[1])


def _block_sums(blocks: DataFrame, work: Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over blocks of what work makes of one: its number, the rows of label 0 and how often each occurs, and the same of label 1.

    Sums are of decimals, so they don't depend on the order of the blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in enumerate(batch.column(0).to_pylist()):
                rows = batch.column(1).slice(k, 1).flatten()
                label, n, x = (f(v) for f, v in zip((np.asarray, np.asarray, _matrix), rows.flatten()))
                found = work(block, x[label == 0], n[label == 0].astype(float), x[label == 1], n[label == 1].astype(float))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found)), pa.int32()), pa.array(found, pa.float64())], ["k", "value"])

    sums = blocks.mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum(F.col("value").cast("decimal(38,18)")).alias("value"))
    return np.array([float(v) for _, v in sorted((r["k"], r["value"]) for r in sums.collect())])  # a few hundred numbers


def _pair_sums(slope: np.ndarray, worse: np.ndarray, n_worse: np.ndarray, better: np.ndarray, n_better: np.ndarray) -> np.ndarray:
    """Over all pairs of a row of better and one of worse: the loss, its gradient and the upper half of its second derivatives."""
    ahead, often = (better @ slope)[:, None] - worse @ slope, n_better[:, None] * n_worse
    wrong = 1 / (1 + np.exp(np.clip(ahead, -500, 500)))
    first, second = often * wrong, often * wrong * (1 - wrong)
    across = better.T @ second @ worse
    curved = (better * second.sum(axis=1)[:, None]).T @ better + (worse * second.sum(axis=0)[:, None]).T @ worse - across - across.T
    return np.r_[(often * np.logaddexp(0, -ahead)).sum(), first.sum(axis=0) @ worse - first.sum(axis=1) @ better, curved[np.triu_indices(len(slope))]]


def fit_features(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Fits on all rows with features that are labelled 0 or 1; labels has id_col and label_col.

    Preferences are pairs of a document of either label. Documents are dealt by hash to blocks,
    and all pairs of a block count: each document of the more frequent label is in one block,
    those of the other in one or, where they are too few, in several. A step of the fit sums
    up the blocks; only the sums come to the driver. The cut is the quantile of all
    utilities at the share that label 0 has of the documents. Rows without an id or a label don't
    count; where either label is missing, every document scores 0.5.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").distinct()
    alike = rows.select(F.col(id_col).alias("id"), "features").where("id IS NOT NULL").groupBy("id", "features").agg(F.count(F.lit(1)).alias("n"))
    pool = written(alike.join(known, "id"))
    sizes = {r["label"]: (r["kinds"], r["n"]) for r in pool.groupBy("label").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        return QualityModel(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(len(NAMES)), -np.log(1 / CUT_SCORE - 1))
    few = min(sizes, key=lambda k: (sizes[k][0], k))
    own = math.ceil(sizes[few][0] / BLOCK_FEW)
    n = max(own, math.ceil(sizes[1 - few][0] / BLOCK_MANY))
    spot = F.xxhash64(F.lit("quality block"), "id", "features")
    block = F.when(F.col("label") == few, F.sequence(F.pmod(spot, F.lit(own)), F.lit(n - 1).cast("long"), F.lit(own).cast("long"))).otherwise(F.array(F.pmod(spot, F.lit(n))))
    dealt = pool.select("label", "n", "features", F.explode(block).alias("block")).groupBy("block")
    blocks = written(dealt.agg(F.sort_array(F.collect_list(F.struct("label", "n", "features"))).alias("rows")))

    def moments(block: int, worse: np.ndarray, n_worse: np.ndarray, better: np.ndarray, n_better: np.ndarray) -> np.ndarray:
        sides = [(x, m) for k, x, m in ((0, worse, n_worse), (1, better, n_better)) if k != few or block < own]  # copies of a row count once
        return np.r_[n / sizes[0][1] * n_worse.sum() * (n_better.sum() / sizes[1][1]), sum(m @ x for x, m in sides), sum(m @ (x * x) for x, m in sides)]

    weight, *found = _block_sums(blocks, moments)
    mean, squares = np.array(found).reshape(2, -1) / (sizes[0][1] + sizes[1][1])
    spread = np.sqrt(np.maximum(squares - mean**2, 0)) + 1e-3

    def judge(slope: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums = _block_sums(blocks, lambda _, worse, n_worse, better, n_better: _pair_sums(slope, (worse - mean) / spread, n / sizes[0][1] * n_worse, (better - mean) / spread, n_better / sizes[1][1])) / weight
        curved = np.zeros((len(slope), len(slope)))
        curved[np.triu_indices(len(slope))] = sums[1 + len(slope) :]
        return sums[0], sums[1 : 1 + len(slope)], curved + np.triu(curved, 1).T

    model = QualityModel(mean, spread, _newton(judge, len(NAMES)), 0.0)
    utilities = _replaced(pool.select("n", "features"), "features", "utility double", lambda lists: [pa.array(model.utilities(_matrix(lists)))])
    upto, below = running(utilities.groupBy("utility").agg(F.sum("n").alias("n")), "utility", F.col("n"), "upto"), sizes[0][1]
    model.cut = float(np.mean(upto.agg(*[F.min(F.when(F.col("upto") >= k, F.col("utility"))) for k in (below, below + 1)]).first()))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """fit_features() on the whole texts of all documents that have a label."""
    texts = docs.select(id_col, text_col).join(labels.where(F.col(label_col).isNotNull()), id_col, "left_semi")
    return fit_features(featured(texts, text_col), labels, id_col, label_col)


def _verdicts(found: np.ndarray) -> list[pa.Array]:
    return [pa.array(found, pa.float64()), pa.array((found >= CUT_SCORE).astype(np.int32), pa.int32())]


def score_features(rows: DataFrame, model: QualityModel) -> DataFrame:
    """score_quality() of rows with features instead of a text."""
    return _replaced(rows, "features", "score double, predicted int", lambda lists: _verdicts(model.scores(_matrix(lists))))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """Replaces the text by score, from 0 to 1 and higher where label 1 is likelier, and predicted, 1 from CUT_SCORE on.

    Only the whole text counts. Null texts count as empty and are scored, too; repeated rows
    and null ids like any others. Columns named score or predicted are replaced.
    """
    work = lambda texts: _verdicts(model.scores(np.array([features(t) for t in texts.to_pylist()], float).reshape(-1, len(NAMES))))
    return _replaced(docs, text_col, "score double, predicted int", work)
