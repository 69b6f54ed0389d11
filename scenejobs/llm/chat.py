"""Chat formatting: typed content parts flattened into a template that can be read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts lie under the loss mask.
TRAINED_ROLE = "assistant"
#: Content parts: kind is text, image, audio or document; ref and n_tokens belong to attachments.
PART = "struct<kind:string,text:string,ref:string,n_tokens:int>"
#: Kinds of attachments.
KINDS = ("image", "audio", "document")
#: A placeholder; text never holds one, for it is escaped.
PLACEHOLDER = rf"<\|(?:{'|'.join(KINDS)}):[0-9]{{1,9}}\|>"


def escaped(text: Column) -> Column:
    r"""Adds one backslash inside every `<|`, `<\|`, `<\\|` ..., so that no control string is left."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """The inverse of escaped()."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    """A role on one line: its own backslashes and newlines are escaped too."""
    return escaped(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    pieces = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def visit_parts(parts: Column) -> Column:
    """Flattens an array of PART into struct(body, attachments, n_expanded).

    Text parts that follow each other are joined and then escaped, so no control string can
    arise across their borders. The k-th attachment of a message becomes the placeholder
    `<|kind:k|>`; the same string in a text is escaped, so the two stay apart. attachments
    lists position, kind, ref and expanded tokens in the same order, and n_expanded sums the
    tokens that the placeholders stand for. Null parts and a null array give nothing; a part of
    an unknown or null kind is text.
    """
    known = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    is_file = lambda p: F.coalesce(p["kind"], F.lit("text")).isin(*KINDS)
    files = F.filter(known, is_file)
    attachments = F.transform(files, lambda p, i: F.struct(i.alias("position"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["n_tokens"], F.lit(0)).alias("n_tokens")))
    start = F.struct(F.lit("").alias("body"), F.lit("").alias("run"), F.lit(0).alias("k"))

    def visit(state: Column, p: Column) -> Column:
        mark = F.concat(F.lit("<|"), p["kind"], F.lit(":"), state["k"].cast("string"), F.lit("|>"))
        return F.struct(
            F.when(is_file(p), F.concat(state["body"], escaped(state["run"]), mark)).otherwise(state["body"]).alias("body"),
            F.when(is_file(p), F.lit("")).otherwise(F.concat(state["run"], F.coalesce(p["text"], F.lit("")))).alias("run"),
            (state["k"] + is_file(p).cast("int")).alias("k"),
        )

    plain = F.concat_ws("", F.transform(known, lambda p: F.coalesce(p["text"], F.lit(""))))
    mixed = F.aggregate(known, start, visit, lambda state: F.concat(state["body"], escaped(state["run"])))
    body = F.when(F.size(files) == 0, escaped(plain)).otherwise(mixed)
    expanded = F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"])
    return F.struct(body.alias("body"), attachments.alias("attachments"), expanded.alias("n_expanded"))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, n_expanded.

    Each message becomes `<|im_start|>role\\nbody<|im_end|>\\n`, in order of turn; rows with an
    equal turn follow by role, body and attachments, null turns come first, a null conversation is one.
    loss_spans are (start, length) in code points of the bodies of assistant messages.
    attachments of the whole conversation carry the number of their message, from 0.
    A conversation is one output row, so its messages meet in one task, as they must.
    Places are running sums over its rows, so the time grows with its turns. Repeated rows are
    messages of their own.
    Empty input gives no rows; other columns are ignored.
    """
    seen = visit_parts(F.col(parts_col))
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), _role(F.col(role_col)).alias("role"), seen.alias("seen"))
    rows = rows.select("conv_id", "turn", "role", "seen.*")
    in_order = W.partitionBy("conv_id").orderBy("turn", "role", "body", "attachments")
    message = F.concat(F.lit(START), F.col("role"), F.lit("\n"), F.col("body"), F.lit(END + "\n"))
    placed = rows.withColumns({"at": F.row_number().over(in_order), "before": F.sum(F.length(message)).over(in_order.rowsBetween(W.unboundedPreceding, -1))})
    begin = F.coalesce("before", F.lit(0)) + len(START) + 1 + F.length("role")
    span = F.struct(begin.cast("int").alias("start"), F.length("body").alias("length"))
    turns = F.sort_array(F.collect_list(F.struct("at", message.alias("message"), (F.col("role") == TRAINED_ROLE).alias("trained"), span.alias("span"), "attachments", "n_expanded")))
    chats = placed.groupBy("conv_id").agg(turns.alias("turns"))
    return chats.select(
        "conv_id", F.array_join("turns.message", "").alias("formatted"), F.transform(F.filter("turns", lambda m: m["trained"]), lambda m: m["span"]).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda m, i: F.transform(m["attachments"], lambda a: F.struct(i.alias("message"), a["position"].alias("position"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens"))))).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, m: n + m["n_expanded"]).alias("n_expanded"),
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _under(formatted: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
    """The pieces of each text that begin at starts, in time linear in the text."""
    return pd.Series([[text[i : i + n] for i, n in zip(a, b)] for text, a, b in zip(formatted, starts, lengths)], dtype=object)


def read_back(chats: DataFrame) -> DataFrame:
    """Adds turns (array of role, text, parts) and loss_text, both read from the formatted string.

    parts are typed as they went in, with neighbouring texts joined and empty ones left out;
    attachments get their ref and tokens back. text and loss_text hold the texts alone, without
    placeholders.
    """
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 2_000_000_000)
    border = f"(?={PLACEHOLDER})|(?<={PLACEHOLDER})"
    is_mark = lambda x: x.rlike(f"^{PLACEHOLDER}$")
    cut = lambda body: F.filter(F.split(body, border, -1), lambda x: x != "")
    words = lambda body: F.array_join(F.transform(cut(body), lambda x: F.when(is_mark(x), F.lit("")).otherwise(unescaped(x))), "")
    texts = lambda body: F.when(body.rlike(PLACEHOLDER), words(body)).otherwise(unescaped(body))
    none = F.lit(None).cast("string")

    def part(x: Column, message: Column) -> Column:
        position = F.regexp_extract(x, r":([0-9]+)\|>$", 1).cast("int")
        file = F.filter("attachments", lambda a: (a["message"] == message) & (a["position"] == position))[0]
        real = F.struct(file["kind"].alias("kind"), none.alias("text"), file["ref"].alias("ref"), file["n_tokens"].alias("n_tokens"))
        return F.when(is_mark(x), real).otherwise(F.struct(F.lit("text").alias("kind"), unescaped(x).alias("text"), none.alias("ref"), F.lit(None).cast("int").alias("n_tokens")))

    def parsed(piece: Column, message: Column) -> Column:
        at = F.locate("\n", piece)
        body = F.substring(piece, at + 1, F.length(piece) - at - len(END) - 1)
        parts = F.transform(cut(body), lambda x: part(x, message))
        return F.struct(_role_back(F.substring(piece, F.lit(1), at - 1)).alias("role"), texts(body).alias("text"), parts.alias("parts"))

    loss = F.array_join(F.transform(_under("formatted", "loss_spans.start", "loss_spans.length"), texts), "")
    return chats.withColumns({"turns": F.transform(pieces, parsed), "loss_text": loss})
