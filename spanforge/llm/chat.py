"""Chat formatting by prefix-target expansion (native).

Every assistant turn becomes an example of its own: all earlier turns of the conversation as context, and that reply alone under the
loss mask. A conversation whose last turn isn't an assistant's gets one more example without a mask, so that no turn is lost.

Template: "<s>", then for every turn "<|im_start|>" role "\\n" text "<|im_end|>" "\\n". Control strings (of this template and of other
common ones, see CONTROL_TAIL) inside texts get a backslash after their first character; where backslashes stand there already, one
more. A reader takes one away, so every text comes back as it was and no text can open or close a turn. In roles, a backslash is
doubled and a newline becomes backslash n first.

Everything is native: escaping before the shuffle, one grouping by conversation, one explode. An example holds its whole context by
definition, so the output grows with the square of a conversation's turns; a conversation has to fit into a task's memory.

Edge cases: null texts and roles count as empty; rows of the same turn are ordered by role, then text, and all are kept; null turns come
first; each row with a null conv_id is a conversation by itself, with id null; only the role "assistant" is trainable; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, table

BOS, START, END = "<s>", "<|im_start|>", "<|im_end|>"
#: What may follow the first character of a control string, backslashes apart.
CONTROL_TAIL = r"(?:/?s>|/?INST\]|/?SYS>|\|[A-Za-z0-9_]{1,32}\|>)"
_ESCAPE = r"([<\[])(\\*)(?=" + CONTROL_TAIL + ")"
_UNESCAPE = r"([<\[])\\(\\*)(?=" + CONTROL_TAIL + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # doubled backslashes part the text, so that none is read with an n that follows it
    pieces = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def expand(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) to examples: conv_id, lone, example (from 0), formatted, loss_start (from 0), loss_length, in code points.

    lone tells conversations with a null conv_id apart: each such row is one.
    loss_start and loss_length are null in the example that closes a conversation without a reply."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    written = turns.select("conv_id", lone.alias("lone"), "turn", role.alias("role"), text.alias("text"), F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"), escape(text).alias("body"))
    grouped = written.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("turns"))
    tail = END + "\n"
    # where each turn's text starts in the whole conversation, and how long it is
    ends = F.aggregate(
        "turns",
        F.array(F.struct(F.lit(0).alias("start"), F.lit(len(BOS)).alias("end"), F.lit(False).alias("reply"))),
        lambda acc, t: let(
            F.element_at(acc, -1)["end"] + F.length(t["head"]),
            lambda at: F.concat(acc, F.array(F.struct(at.alias("start"), (at + F.length(t["body"]) + len(tail)).alias("end"), (t["role"] == "assistant").alias("reply")))),
        ),
    )
    whole = F.concat(F.lit(BOS), F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), ""))
    laid = grouped.select("conv_id", "lone", whole.alias("whole"), F.slice(ends, F.lit(2), F.size("turns")).alias("ends"))
    last = F.size("ends") - 1
    wanted = F.filter(F.transform("ends", lambda e, i: F.struct(i.alias("i"), e.alias("e"))), lambda x: x["e"]["reply"] | (x["i"] == last))
    each = laid.select("conv_id", "lone", "whole", F.posexplode(wanted).alias("example", "x"))
    shown = F.when(F.col("x.e.reply"), F.lit(1))
    return each.select(
        "conv_id",
        "lone",
        "example",
        F.substring(F.col("whole"), F.lit(1), F.col("x.e.end")).alias("formatted"),
        (shown * F.col("x.e.start")).alias("loss_start"),
        (shown * (F.col("x.e.end") - F.col("x.e.start") - len(tail))).alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    pieces = F.split(F.substring(formatted, F.lit(len(BOS) + 1), F.length(formatted)), r"\Q" + END + r"\E\n")
    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        at = F.locate("\n", body)
        return F.struct(unescape_role(F.substring(body, F.lit(1), at - 1)).alias("role"), unescape(F.substring(body, at + 1, F.length(body))).alias("text"))
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def digest(examples: DataFrame) -> DataFrame:
    """A row for each conversation, read back from its examples alone."""
    masked = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    read = examples.select("conv_id", "lone", "example", "formatted", masked.alias("masked"))
    one = read.groupBy("conv_id", "lone").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("masked").isNotNull(), F.struct("example", "masked")))), lambda x: x["masked"]), "").alias("loss"),
    )
    one = one.withColumn("turns", read_turns(F.col("whole")))
    return one.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and conversation -1, writes the examples and reads the digest columns back from them."""
    fixed = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("x"))
    fixed = fixed.select("conv_id", "x.turn", "x.role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return digest(cut(expand(turns), "chat-examples"))
