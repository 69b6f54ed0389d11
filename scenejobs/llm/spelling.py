"""Spelling variants: words at one error from each other, found by forward and backward minimal acyclic automata."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenejobs.llm.shared import written

#: Letters that words are made of.
RUN = "[A-Za-zÀ-ÿ]+"
#: One in so many pairs of document and run loses a letter in mistyped().
MISTYPED_ONE_IN = 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: About so many entries go into one automaton.
ENTRIES_PER_TASK = 20_000
#: A half that more words share is dealt out in slices of about so many.
ENTRIES_PER_SLICE = 10_000


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (as text, empty for null), word: the runs of letters of every whole text, only A to Z in lower case; null texts have none."""
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("word"))
    return found.withColumn("word", F.translate("word", UPPER, LOWER))


def mistyped(found: DataFrame, one_in: int = MISTYPED_ONE_IN) -> DataFrame:
    """The same rows; where crc32 of `<id>:<word>` is a multiple of one_in, the word loses the letter at that value modulo its length."""
    h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
    at = (h % F.length("word")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return found.withColumn("word", F.when(h % one_in == 0, less).otherwise(F.col("word")))


def word_counts(found: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """word, n: distinct words of least_length code points or more that occur least_count times or more."""
    return found.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """Minimal acyclic automaton of sorted distinct words; a word's number is its place in their order.

    A state is (final, {letter: (next state, words passed over)}, words from here on). States
    that accept the same endings are one; words passed over are those that sort before any
    word along an edge, so their sum along a path is the number of the word at its end.
    """

    def __init__(self, words: list[str]) -> None:
        known: dict[tuple, tuple] = {}
        open_ends: list[tuple[str, list]] = []  # letters of the last word, with the edges that lead on and whether a word ends here
        top: list = [False, []]

        def closed(state: list) -> tuple:
            """The one state that equals a finished one."""
            shape = (state[0], tuple((letter, id(after)) for letter, after in state[1]))
            if shape not in known:
                passed, edges = int(state[0]), {}
                for letter, after in state[1]:
                    edges[letter] = (after, passed)
                    passed += after[2]
                known[shape] = (state[0], edges, passed)
            return known[shape]

        def close(depth: int) -> None:
            while len(open_ends) > depth:
                letter, state = open_ends.pop()
                (open_ends[-1][1] if open_ends else top)[1].append((letter, closed(state)))

        last = ""
        for word in words:
            same = len(os.path.commonprefix((last, word)))
            close(same)
            open_ends.extend((letter, [False, []]) for letter in word[same:])
            open_ends[-1][1][0] = True
            last = word
        close(0)
        self.top = closed(top)

    @staticmethod
    def _end(state: tuple, word: str, at: int, number: int) -> int:
        """Number of the word that the rest of word leads to, or -1."""
        for letter in word[at:]:
            edge = state[1].get(letter)
            if edge is None:
                return -1
            state, number = edge[0], number + edge[1]
        return number if state[0] else -1

    def near(self, word: str, fixed: int) -> set[int]:
        """Numbers of the words with the first `fixed` letters of word that replace one further letter, or hold one more."""
        found, state, number = set(), self.top, 0
        for at, letter in enumerate([*word, ""]):
            if at >= fixed:
                for other, (after, passed) in state[1].items():
                    if at < len(word) and other != letter:
                        found.add(self._end(after, word, at + 1, number + passed))
                    found.add(self._end(after, word, at, number + passed))
            edge = state[1].get(letter)
            if edge is None:
                break
            state, number = edge[0], number + edge[1]
        found.discard(-1)
        return found


def _entries(words: DataFrame) -> DataFrame:
    """word, n, back, half, own: the halves under which a word meets words at one error from it.

    Of two words at one error the shorter one's first half begins both, or its second half
    ends both; of two of one length likewise. So a word of m letters is entered under its first
    m // 2 letters and, for words shorter by one, its first (m - 1) // 2, and backward under the
    rest; own marks the halves that the word itself looks up. Backward entries are reversed.
    """
    size = F.length("word")
    sides = []
    for back in (False, True):
        spelt = F.reverse("word") if back else F.col("word")
        own = size - F.floor(size / 2) if back else F.floor(size / 2)
        shorter = (size - 1) - F.floor((size - 1) / 2) if back else F.floor((size - 1) / 2)
        half = lambda k: F.substring(spelt, F.lit(1), k.cast("int"))  # noqa: E731, B023
        sides.append(F.struct(F.lit(back).alias("back"), spelt.alias("spelt"), half(own).alias("half"), F.lit(True).alias("own")))
        sides.append(F.when(own != shorter, F.struct(F.lit(back).alias("back"), spelt.alias("spelt"), half(shorter).alias("half"), F.lit(False).alias("own"))))
    return words.select("n", F.explode(F.array_compact(F.array(*sides))).alias("e")).select("n", "e.*")


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: pairs of words of at least two code points that differ by one inserted, deleted or replaced one, both ways.

    words has word and n, each word once. Halves are dealt to tasks by their hash. A half that
    more than ENTRIES_PER_SLICE words share is dealt in slices: each slice of its words as an
    automaton to each slice of those that look them up, so no task holds more than two slices
    of one half. A task builds a forward and a backward automaton and matches each word's half exactly, then
    the rest with one error. A pair may come twice, if both halves allow its error.
    """
    entries = written(_entries(words))
    sizes = entries.groupBy("back", "half").agg(F.count(F.lit(1)).alias("size")).withColumn("slices", F.ceil(F.col("size") / ENTRIES_PER_SLICE).cast("int"))
    heavy = sizes.where("slices > 1").select("back", "half", "slices")  # few: each has ENTRIES_PER_SLICE words
    tasks = max(1, entries.count() // ENTRIES_PER_TASK)
    light = F.concat(F.lit("="), F.pmod(F.xxhash64("half"), F.lit(tasks)).cast("string"))
    place = F.pmod(F.xxhash64("spelt"), F.col("slices")).cast("int")
    dealt = entries.join(heavy, ["back", "half"], "left")
    one = dealt.where("slices IS NULL").select("back", light.alias("unit"), "spelt", "half", "n", F.lit(True).alias("entry"), "own")
    each = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    several = dealt.where("slices IS NOT NULL").select("*", place.alias("place"))
    unit = lambda entry, look: F.concat_ws("/", "half", F.col(entry), F.col(look))
    held = several.select("*", each).select("back", unit("place", "slice").alias("unit"), "spelt", "half", "n", F.lit(True).alias("entry"), F.lit(False).alias("own"))
    asked = several.where("own").select("*", each).select("back", unit("slice", "place").alias("unit"), "spelt", "half", "n", F.lit(False).alias("entry"), F.lit(True).alias("own"))

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        numbered = dict(zip(frame["spelt"][frame["entry"]], frame["n"][frame["entry"]]))
        known = sorted(numbered)
        counts, automaton, back = [numbered[w] for w in known], Automaton(known), bool(frame["back"].iloc[0])
        rows = []
        for word, half, n in frame.loc[frame["own"], ["spelt", "half", "n"]].itertuples(index=False):
            for i in automaton.near(word, len(half)):
                a, b = (word[::-1], known[i][::-1]) if back else (word, known[i])
                rows += [(a, b, counts[i]), (b, a, n)]
        return pd.DataFrame(rows, columns=["word", "near", "near_n"])

    return one.unionAll(held).unionAll(asked).groupBy("back", "unit").applyInPandas(match, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow each other from word; forms has word, form.

    Each round doubles the way; n grows by a factor along it, so it ends, within a few rounds.
    """
    steps = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.join(steps.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        further = written(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if further.where("moved").isEmpty():
            return further.select("word", "root")
        steps = further.select("word", "root")


def variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word with its likely right spelling.

    words has word and n, each word once. A word's form is its near word of largest n (the
    smallest in code-point order on ties) if that n is at least factor times the word's own,
    else null; root follows the forms to the last, and is the word itself without one; n_near
    counts near words; form_n is the form's n or null. An empty table gives no rows.
    """
    words = written(words.select("word", "n"))
    best = near_words(words).groupBy("word").agg(F.size(F.collect_set("near")).cast("long").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    right = -F.col("best.less") >= factor * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(right, F.col("best.near")).alias("form"), F.when(right, -F.col("best.less")).alias("form_n"))
    rows = written(rows)
    return rows.join(_roots(rows.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
