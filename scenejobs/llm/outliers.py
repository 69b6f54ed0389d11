"""Quality rules: robust multivariate outliers per language and source, DataFrame functions only."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scenejobs.llm.shared import SPACES, words_of, written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Estimates of a group are drawn towards its language's, and these towards all documents', as if by so many documents.
PRIOR = 50
#: Share of a group that the determinant is minimised over.
CORE_SHARE = 0.75
#: Share that the first step from each start takes: medians, medians with a small core, and the whole group.
FIRST_SHARES = (0.75, 0.5, 0.75)
#: Concentration goes on until no logarithm of a determinant falls by more than this.
LEAST_FALL = 1e-2
#: Documents beyond this quantile of the reference distribution are rejected.
QUANTILE = 0.9999
#: Statistics are kept as integers of 1/UNIT, so that sums don't depend on their order.
UNIT = 1024
#: Least standard deviation of each transformed statistic; a group may repeat one value. In the shortest text
#: that the base rule passes, 50 words of some 300 characters on five lines, the smallest change is 0.03 for one
#: symbol, 2 for one repeated line and 1.2 for one repeated window: floors are three symbols, half a line, a window.
LEAST_SPREAD = (0.5, 0.25, 0.1, 1.0, 1.0)
VECTOR = [f"x{i}" for i in range(len(LEAST_SPREAD))]
#: Bins per unit of distance in the histograms that give cores and medians of distances.
DISTANCE_BINS = 16
#: Distances from here on share the last bin.
FARTHEST = 64
#: Bins per unit of a statistic in the histograms of the medians.
VALUE_BINS = 64


def statistics_of(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of a text; all 0 for null.

    Lines count if they have a word; one is a duplicate if it equals an earlier line.
    A word is repeated if it lies in a window of three words that the text holds twice or more.
    """
    text = F.coalesce(text, F.lit(""))
    words, lines = words_of(text), F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    chars = F.length(F.translate(text, SPACES, ""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    found = F.transform(
        F.array(F.struct(words.alias("w"), lines.alias("l"))),
        lambda s: F.struct(
            F.size(s["w"]).cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
            F.size(s["l"]).cast("long").alias("n_lines"), (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
            _repeated(s["w"]).cast("long").alias("n_repeat_words"),
        ),
    )
    return found[0]


def _bind(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = _bind(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = _bind(pairs, lambda p: F.filter(p, lambda x, j: (x["h"] == F.get(p, j + 1)["h"]) | (F.when(j > 0, F.get(p, F.greatest(j - 1, F.lit(0)))["h"]) == x["h"])))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        steps = _bind(starts, lambda s: F.transform(s, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - x, F.lit(3)))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    some = _bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))
    return F.when(F.size(words) < 4, 0).otherwise(some)


def transformed(stats: DataFrame) -> DataFrame:
    """Adds the vector: log of the length, mean word length, and tenths of symbols, repeated lines and repeated words."""
    share = lambda a, b: F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1))) * 10
    values = [F.log1p("n_words"), F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return stats.withColumns({name: F.round(v * UNIT).cast("long") for name, v in zip(VECTOR, values)})


def chi_square(p: int, quantile: float) -> float:
    """Quantile of the chi-square distribution by Wilson and Hilferty's formula."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(quantile) * (2 / (9 * p)) ** 0.5) ** 3


def _bin_at(counts: DataFrame, keys: list[str], share: Column, name: str) -> DataFrame:
    """The least bin of each key up to which the share of its rows lies."""
    up_to, whole = W.partitionBy(*keys).orderBy("bin"), W.partitionBy(*keys)
    reached = counts.withColumn("seen", F.sum("n").over(up_to)).withColumn("all", F.sum("n").over(whole))
    return reached.where(F.col("seen") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min("bin").alias(name))


_P = range(len(VECTOR))
_PAIRS = [(i, j) for i in _P for j in range(i + 1)]
_MOMENTS = [f"a{i}" for i in _P] + [f"q{i}_{j}" for i, j in _PAIRS]
_FACTORS = [f"m{i}" for i in _P] + [f"l{i}_{j}" for i, j in _PAIRS]
#: Number of rows, and sums of the statistics and their products.
_SUMS = ["count(1) AS n", *[f"sum({x}) AS a{i}" for i, x in enumerate(VECTOR)], *[f"sum({VECTOR[i]} * {VECTOR[j]}) AS q{i}_{j}" for i, j in _PAIRS]]


def _exprs(texts: list[str]) -> list[Column]:
    return [F.expr(t) for t in texts]


def _medians(rows: DataFrame) -> DataFrame:
    """Mean and factor columns of each group from medians and median absolute deviations of each statistic."""
    width = UNIT // VALUE_BINS
    apart = ", ".join(f"named_struct('i', {i}, 'bin', floor({x} / {width}))" for i, x in enumerate(VECTOR))
    tall = rows.selectExpr("grp", f"explode(array({apart})) AS v").groupBy("grp", "v.i", "v.bin").agg(F.expr("count(1) AS n"))
    medians = _bin_at(tall, ["grp", "i"], F.lit(0.5), "median")
    apart = tall.join(medians, ["grp", "i"]).selectExpr("grp", "i", "median", "abs(bin - median) AS bin", "n")
    apart = apart.groupBy("grp", "i", "median", "bin").agg(F.expr("sum(n) AS n"))
    spread = _bin_at(apart, ["grp", "i", "median"], F.lit(0.5), "mad")
    means = [f"max(CASE WHEN i = {i} THEN (median + 0.5D) / {VALUE_BINS} END) AS m{i}" for i in _P]
    one = spread.groupBy("grp").agg(*_exprs(means + [f"max(CASE WHEN i = {i} THEN greatest(1.4826D * mad / {VALUE_BINS}, {LEAST_SPREAD[i]}D) END) AS l{i}_{i}" for i in _P]))
    return one.selectExpr("grp", *_FACTORS[: len(VECTOR)], *[f"l{i}_{j}" if i == j else f"0.0D AS l{i}_{j}" for i, j in _PAIRS])


def _scored(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution, and its bin; a row for each estimate of the group."""
    z = [f"({x} / {UNIT} - m{i}{''.join(f' - l{i}_{j} * z{j}' for j in range(i))}) / l{i}_{i} AS z{i}" for i, x in enumerate(VECTOR)]
    distance = [" + ".join(f"z{i} * z{i}" for i in _P) + " AS d2", f"least(floor(sqrt(d2) * {DISTANCE_BINS}), {FARTHEST * DISTANCE_BINS}) AS bin"]
    return rows.join(estimates, "grp").selectExpr("*", *z, *distance)


def _core(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """grp, start, n and moments of the nearest documents, by one pass that adds up counts and products by bin of distance."""
    cells = _scored(vectors, estimates).groupBy("grp", "start", "share", "bin").agg(*_exprs(_SUMS))
    placed = cells.selectExpr("*", "coalesce(sum(n) OVER (PARTITION BY grp, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before", "sum(n) OVER (PARTITION BY grp, start) AS all_n")
    return _means(placed.where("before < ceil(all_n * share)").groupBy("grp", "start").agg(*_exprs(["sum(n) AS n", *[f"sum(CAST({c} AS DECIMAL(20, 0))) AS {c}" for c in _MOMENTS]])), "grp", "start")


def _means(sums: DataFrame, *keys: str) -> DataFrame:
    """Sums over documents as means; sums are of integers, so their order doesn't matter."""
    return sums.selectExpr(*keys, "n", *[f"CAST({c} AS DOUBLE) / n / {UNIT if c[0] == 'a' else UNIT**2} AS {c}" for c in _MOMENTS])


def _factored(moments: DataFrame) -> DataFrame:
    """Adds mean, Cholesky factor of the covariance and log of its determinant; a variance under LEAST_SPREAD squared is raised to it."""
    covariance = [f"q{i}_{j} - a{i} * a{j} AS c{i}_{j}" if i > j else f"greatest(q{i}_{i} - a{i} * a{i}, {LEAST_SPREAD[i] ** 2}D) AS c{i}_{i}" for i, j in _PAIRS]
    factor = []
    for i, j in _PAIRS:
        left = f"c{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
        factor.append(f"({left}) / l{j}_{j} AS l{i}_{j}" if i > j else f"sqrt(greatest({left}, {LEAST_SPREAD[i] ** 2 / 4}D)) AS l{i}_{i}")
    logdet = " + ".join(f"2 * ln(l{i}_{i})" for i in _P) + " AS logdet"
    made = moments.selectExpr("*", *covariance, *factor, *[f"a{i} AS m{i}" for i in _P])
    return made.selectExpr(*moments.columns, *_FACTORS, logdet)


def least_determinants(vectors: DataFrame) -> DataFrame:
    """grp, n, moments, logdet of the core with the least determinant that concentration reaches from several starts.

    vectors has grp and VECTOR. From each start, steps take the nearest CORE_SHARE of the group and
    estimate anew from these, for as long as that lowers the determinant by a share that
    matters; so every start comes to an end, and only the others go on.
    """
    medians, whole = _medians(vectors), _factored(_means(vectors.groupBy("grp").agg(*_exprs(_SUMS)), "grp")).select("grp", *_FACTORS)
    starts = [df.select("grp", F.lit(k).alias("start"), F.lit(share).alias("share"), *_FACTORS) for k, (df, share) in enumerate(zip((medians, medians, whole), FIRST_SHARES))]
    estimates = written(starts[0].unionByName(starts[1]).unionByName(starts[2]))
    first = _factored(_core(vectors, estimates)).withColumn("logdet", F.lit(float("inf")))  # of another share of the group, so not compared
    state, columns = written(first.withColumn("open", F.lit(True))), first.columns[2:]
    while not state.where("open").isEmpty():
        found = _factored(_core(vectors, state.where("open").selectExpr("grp", "start", f"{CORE_SHARE}D AS share", *_FACTORS)))
        both = state.alias("s").join(found.alias("f"), ["grp", "start"], "left").withColumn("fell", F.expr(f"coalesce(f.logdet < s.logdet - {LEAST_FALL}, FALSE)"))
        state = written(both.selectExpr("grp", "start", *[f"IF(fell, f.{c}, s.{c}) AS {c}" for c in columns], "fell AS open"))
    best = F.min_by(F.struct("n", *_MOMENTS, "logdet"), F.struct("logdet", "start")).alias("b")
    return state.groupBy("grp").agg(best).select("grp", "b.*")


def _drawn(own: DataFrame, groups: DataFrame) -> DataFrame:
    """Moments of each group drawn towards those of its language, and these towards all documents', by PRIOR documents."""
    mean = lambda name: _exprs([f"sum(n) AS {name}_n", *[f"sum(n * {c}) / sum(n) AS {name}_{c}" for c in _MOMENTS]])
    towards = lambda n, a, b, name: f"({n} * {a} + {PRIOR} * {b}) / ({n} + {PRIOR}) AS {name}"
    named = own.join(groups, "grp")
    whole = F.broadcast(named.agg(*mean("whole")))  # one row
    alike = named.groupBy("lang").agg(*mean("lang")).crossJoin(whole)
    alike = alike.selectExpr("lang AS l_lang", *[towards("lang_n", f"lang_{c}", f"whole_{c}", f"lang_{c}") for c in _MOMENTS])
    return named.join(alike, F.expr("lang <=> l_lang")).selectExpr("grp", "n", *[towards("n", c, f"lang_{c}", c) for c in _MOMENTS])


def robust_outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Returns id, the statistics of statistics_of(), base_failed, distance, kept for every row.

    base_failed: under 50 words, or more than half of the words repeated. The others are judged by
    minimum-covariance-determinant estimates of their language and source, see
    least_determinants(). These are drawn towards the estimates of the language and of all
    documents with the weight of PRIOR documents, so a small group leans on its like and a
    large one on itself. Where the median distance is above that of the reference
    distribution, distances shrink to it (they never grow, which would undo the floor under
    spreads); what lies beyond its quantile is rejected.

    Texts are read once. Each step is one pass over the small table of statistics, which adds up
    integers by group, start and bin of distance before anything moves, so hot sources don't
    gather in a task and reruns agree; estimates have a row for each language and source, and
    Spark broadcasts them where that table is small. Null texts have no words and fail; null
    languages and sources are groups of their own; repeated rows count each. A group of one
    value has its floor as spread. An empty table gives no rows.
    """
    p = len(VECTOR)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), statistics_of(F.col(text_col)).alias("s")).select("id", "lang", "source", "s.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = written(transformed(rows.withColumns({"base_failed": failed, "grp": F.to_json(F.array("lang", "source"))})))
    judged = rows.where("NOT base_failed")
    vectors = judged.select("grp", *VECTOR)
    groups = written(judged.groupBy("grp").agg(F.first("lang").alias("lang")))
    estimates = written(_factored(_drawn(least_determinants(vectors), groups)).select("grp", *_FACTORS))
    bins = written(_scored(vectors, estimates).groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n")).join(groups, "grp"))
    of_lang = _bin_at(bins.groupBy("lang", "bin").agg(F.sum("n").alias("n")), ["lang"], F.lit(0.5), "middle_lang").withColumnRenamed("lang", "l_lang")
    middle = _bin_at(bins, ["grp", "lang"], F.lit(0.5), "middle").join(bins.groupBy("grp").agg(F.sum("n").alias("n")), "grp").join(of_lang, F.expr("lang <=> l_lang"))
    middle = middle.select("grp", ((F.col("n") * F.col("middle") + PRIOR * F.col("middle_lang")) / (F.col("n") + PRIOR)).alias("middle"))
    estimates = written(estimates.join(middle, "grp"))
    scale = F.least(F.lit(1.0), chi_square(p, 0.5) ** 0.5 / ((F.col("middle") + 0.5) / DISTANCE_BINS))
    verdicts = _scored(judged, estimates).withColumn("distance", F.sqrt("d2") * scale).withColumn("kept", F.col("distance") <= chi_square(p, QUANTILE) ** 0.5)
    rest = rows.where("base_failed").withColumns({"distance": F.lit(None).cast("double"), "kept": F.lit(False)})
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
    return verdicts.select(names).unionAll(rest.select(names)).withColumnRenamed("id", id_col)
