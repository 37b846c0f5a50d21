"""Chat formatting by prefix-target expansion, all in DataFrame functions.

Every assistant turn becomes its own example: all turns before it are context, and only that reply lies under the loss mask. Where a
conversation does not end in an assistant turn, one more example without a mask carries the rest. A turn is written

    <turn>role⏎text</turn>

and control strings inside roles and texts are escaped so that they can be read back: a backslash becomes \\-, <turn> becomes \\o, </turn>
becomes \\c, and in roles a line break becomes \\n. After a backslash there is thus always one of - o c n, which makes it reversible.

One shuffle deals the turns by conversation; examples are exploded and read back in the same partitioning, one at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, BREAK = "<turn>", "</turn>", "\n"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\-"), (OPEN, "\\o"), (CLOSE, "\\c")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in ((CLOSE, "\\c"), (OPEN, "\\o"), ("\\", "\\-")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(BREAK), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit(BREAK)))


def format_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each example: conversation, example (from 0), text, mask_start and mask_chars (code points; 0 and 0 without a reply), whole (holds all turns).

    Turns are taken by turn, then role, then text, a null turn first; a repeated row is a turn again. Null roles and texts are empty. Rows with a
    null conversation form one conversation. A conversation's turns meet in one row, and every reply's example repeats those before it, so the
    longest conversation must fit in a task. Other columns are not read; an empty table gives an empty one.
    """
    part = lambda c: F.coalesce(turns[c].cast("string"), F.lit(""))
    rows = turns.select(turns[conv_col].alias("conv"), turns[turn_col].alias("turn"), part(role_col).alias("role"), part(text_col).alias("text"))
    rows = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    written = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(BREAK), escape(t["text"]), F.lit(CLOSE)))
    reply = F.transform("turns", lambda t: F.when(t["role"] == TRAINED, F.length(escape(t["text"]))).otherwise(F.lit(-1)))
    rows = rows.select("conv", written.alias("written"), reply.alias("reply"))
    ends = F.filter(F.transform("reply", lambda n, i: F.when((n >= 0) | (i + 1 == F.size("reply")), F.struct((i + 1).alias("n"), n.alias("chars")))), lambda e: e.isNotNull())
    rows = rows.select("conv", "written", F.posexplode(ends).alias("example", "end"))
    text = F.array_join(F.slice("written", F.lit(1), F.col("end.n")), "")
    rows = rows.select("conv", "example", text.alias("formatted"), F.col("end.chars").alias("chars"), (F.col("end.n") == F.size("written")).alias("whole"))
    start = F.when(F.col("chars") >= 0, F.length("formatted") - len(CLOSE) - F.col("chars")).otherwise(F.lit(0))
    return rows.select(F.col("conv").alias(conv_col), "example", F.col("formatted").alias("text"), start.cast("long").alias("mask_start"), F.greatest("chars", F.lit(0)).cast("long").alias("mask_chars"), "whole")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    body = F.substring(text, F.lit(len(OPEN) + 1), F.length(text) - len(OPEN) - len(CLOSE))
    both = F.split(body, CLOSE + OPEN)
    return F.transform(both, lambda t: F.struct(unescape_role(F.substring_index(t, BREAK, 1)).alias("role"), unescape(F.substring(t, F.instr(t, BREAK) + 1, F.length(t))).alias("text")))


def read_back(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """For each conversation, from the formatted texts alone: n_turns, turns_sha256 (role, line break, text, line break of each turn), loss_chars and loss_sha256 (all text under the masks, unescaped), formatted_chars.

    Examples are taken in their order. Null and empty texts, which format_examples() never makes, count as empty; a conversation without a whole example has
    no turns; a null conversation is one; an empty table gives an empty one. A conversation's texts meet in one task."""
    loss = unescape(F.substring(F.col("text"), (F.col("mask_start") + 1).cast("int"), F.col("mask_chars").cast("int")))
    turns = F.when(F.col("whole"), read_turns(F.col("text")))
    rows = examples.select(F.col(conv_col).alias("conv"), "example", loss.alias("loss"), F.length("text").cast("long").alias("chars"), turns.alias("turns"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(BREAK), t["text"], F.lit(BREAK))), ""), 256)
    rows = rows.select("conv", "example", "loss", "chars", F.size("turns").alias("n"), F.when(F.col("turns").isNotNull(), digest).alias("digest"))
    rows = rows.groupBy("conv").agg(F.max("n").cast("long").alias("n_turns"), F.max("digest").alias("turns_sha256"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"), F.sum("chars").alias("formatted_chars"))
    return rows.select(F.col("conv").alias(conv_col), "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
