"""Chat formatting with Spark expressions only.

A conversation becomes ``<s>`` + blocks + ``</s>``.  A block holds adjacent turns of one role:
``<|start|>role<|text|>first text<|turn|>next text<|end|>``.  Control strings inside roles and texts are broken up reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
START, TEXT, TURN, END = "<|start|>", "<|text|>", "<|turn|>", "<|end|>"
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
"""Where a control string of this template, or of the common [INST] and <<SYS>> ones, begins."""


def escape(text: Column) -> Column:
    """``\\`` becomes ``\\b``; then ``\\e`` goes in after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), CONTROL, r"$0\\e")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: every ``\\e`` was put in, and every other backslash is a ``\\b``."""
    return F.replace(F.replace(text, F.lit("\\e"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conv_id of ``turns`` (conv_id, turn, role, text): conv_id, formatted, loss_spans.

    Turns go by number; turns with the same number by role, then text, and a null number comes first.  A null role or text
    counts as empty; rows with a null conv_id are one conversation; repeated rows are repeated turns.  Other columns are not
    read.  ``loss_spans`` are the ranges (start, length) of ``formatted``, in characters from 0 and in order, that are trained on: the
    whole escaped text of each ``loss_role`` turn and nothing else.  An empty table gives no rows.

    Places are running sums along a conversation, so a text travels once.  A conversation is one output string, so its turns meet in
    one task, which is inherent; conversations are spread by conv_id.
    """
    empty = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumns({"k": F.row_number().over(w), "previous": F.lag("role").over(w), "next": F.lead("role").over(w)})
    head = F.when(F.col("role") == F.col("previous"), F.lit(TURN)).otherwise(F.concat(F.lit(START), escape(F.col("role")), F.lit(TEXT)))
    tail = F.when(F.col("role") == F.col("next"), empty).otherwise(F.lit(END))
    parts = placed.select("conv_id", "turn", "role", "text", "k", head.alias("head"), escape(F.col("text")).alias("body"), tail.alias("tail"))
    end = F.sum(F.length("head") + F.length("body") + F.length("tail")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    length = F.length("body").cast("long")
    start = F.lit(len(OPEN)) + F.col("end") - F.length("tail") - length
    told = parts.withColumn("end", end).select(
        "conv_id",
        F.struct("k", F.concat("head", "body", "tail").alias("piece"), start.alias("start"), length.alias("length"), (F.col("role") == F.lit(loss_role)).alias("loss")).alias("t"),
    )
    whole = told.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return whole.select("conv_id", F.concat(F.lit(OPEN), F.array_join("t.piece", ""), F.lit(CLOSE)).alias("formatted"), spans.alias("loss_spans"))


def cut(text: Column, spans: Column) -> Column:
    """What ``text`` holds at each of ``spans`` (start, length), which are in order.

    Finding a character takes time by its place, so about as many blocks of spans as the root of their number are cut out first.
    """
    width = F.ceil(F.sqrt(F.size(spans))).cast("int")

    def block(i: Column) -> Column:
        own = F.slice(spans, i * width + 1, width)
        base, last = own[0]["start"], F.element_at(own, -1)
        inside = F.substring(text, (base + 1).cast("int"), (last["start"] + last["length"] - base).cast("int"))
        return F.struct(inside.alias("text"), base.alias("base"), own.alias("spans"))

    n_blocks = F.ceil(F.size(spans) / width).cast("int")
    blocks = F.when(F.size(spans) > 0, F.transform(F.sequence(F.lit(0), n_blocks - 1), block)).otherwise(F.array())
    return F.flatten(F.transform(blocks, lambda b: F.transform(b["spans"], lambda x: F.substring(b["text"], (x["start"] - b["base"] + 1).cast("int"), x["length"].cast("int")))))


def with_turns(formatted: DataFrame) -> DataFrame:
    """Add ``turns``, an array of (role, text) read back from the column ``formatted``."""
    inside = F.expr(f"substring(formatted, {len(OPEN) + 1}, length(formatted) - {len(OPEN) + len(CLOSE)})")
    blocks = F.filter(F.split(inside, r"<\|end\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        halves = F.split(block, r"<\|text\|>")
        role = unescape(F.replace(halves[0], F.lit(START), F.lit("")))
        return F.transform(F.split(halves[1], r"<\|turn\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted conversations hold, taken from them alone."""
    all_turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(cut(F.col("formatted"), F.col("loss_spans")), unescape), "")
    read = with_turns(formatted).select("conv_id", F.size("turns").cast("long").alias("n_turns"), all_turns.alias("all"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("all", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
