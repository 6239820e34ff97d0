"""Operator 8: chat formatting with Spark expressions only.

Template: a run of adjacent turns of one role is a block
``<|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n``; blocks follow each other.
Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no
control string can arise from data, and the way back is exact; a line feed in a role
becomes ``<\\n|`` with a backslash and the letter n.

Turns of a conversation are collected as structs, sorted, and joined by array functions.
Null turn sorts first, null role and text are empty, rows that tie in turn are ordered
by role and text, repeated rows are repeated turns, rows of null conv_id form one
conversation. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("<\\n|"), F.lit("\n")))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: ``conv``, ``formatted`` string and ``segments`` array<struct<text, loss>>, which
    concatenate to ``formatted``; ``loss``, the loss mask, is true for the texts of ``loss_role``."""
    empty = F.lit("")
    rows = df.select(F.col(conv), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).alias("t"))
    # Sorted as they are: escaped texts have another order.
    escaped = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["turn"].alias("turn"), escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    turns = rows.groupBy(conv).agg(escaped.alias("turns"))
    n = F.size("turns")

    def head(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.get("turns", i - 1)["role"] == t["role"])
        return F.when(same, F.lit(SEP)).otherwise(F.concat(F.lit(START), t["role"], F.lit("\n")))

    def tail(t: Column, i: Column) -> Column:
        last = (i == n - 1) | (F.get("turns", i + 1)["role"] != t["role"])
        return F.when(last, F.lit(END)).otherwise(empty)

    pieces = turns.select(conv, F.transform("turns", lambda t, i: F.struct(head(t, i).alias("head"), t["text"].alias("text"), tail(t, i).alias("tail"), (t["role"] == F.lit(loss_role)).alias("loss"))).alias("pieces"))
    whole = F.transform("pieces", lambda p: F.concat(p["head"], p["text"], p["tail"]))
    part = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    segments = F.transform("pieces", lambda p: F.when(p["loss"], F.array(part(p["head"], False), part(p["text"], True), part(p["tail"], False))).otherwise(F.array(part(F.concat(p["head"], p["text"], p["tail"]), False))))
    return pieces.select(conv, F.array_join(whole, "").alias("formatted"), F.flatten(segments).alias("segments"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        body = F.substring(block, F.lit(len(START) + 1), F.length(block))
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substring(body, F.length(role) + 2, F.length(body)), r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, in order, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
