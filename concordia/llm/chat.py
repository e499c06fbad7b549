"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role
share a header.  The output of a conversation is ::

    <|turn|>role<|text|>text[<|next|>text of the same role ...]<|end|>...

and ``loss``, the (start, end) code points of each assistant text in it, end exclusive.

Control strings inside roles and texts, these and those of other common templates, get a
backslash after their first character; one that already has backslashes there gets one more,
so taking one away again gives back the text.

Defined results: null text and null role are empty; turns sort by turn (null first), then role,
then text, so that repeated rows stay and ties have one order; rows with a null conversation id
form one conversation; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import quoted, with_running_sums

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
_CONTROL = r"(\||/?s>|/?INST\]|</?SYS>>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\" + _CONTROL, r"$1$2$3")


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``(conv_id, formatted, loss)``."""
    role, text = (F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in (role_col, text_col))
    one = F.struct(F.col(quoted(turn_col)).alias("turn"), role.alias("role"), text.alias("text"))
    rows = turns.groupBy(F.col(quoted(conv_col)).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))

    def marks(x: Column, i: Column) -> Column:
        header = F.concat(F.lit(TURN), escaped(x["role"]), F.lit(TEXT))
        return F.when(i == 0, header).when(F.get("turns", i - 1)["role"] == x["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(END), header))

    piece = lambda x, i: F.struct(marks(x, i).alias("mark"), escaped(x["text"]).alias("text"), (x["role"] == loss_role).alias("loss"))
    rows = rows.withColumn("pieces", F.transform("turns", piece))
    rows = rows.withColumn("lengths", F.transform("pieces", lambda p: F.length(p["mark"]) + F.length(p["text"])))
    rows = with_running_sums(rows, "lengths", "ends")
    spans = F.transform("pieces", lambda p, i: F.struct((F.get("ends", i) - F.length(p["text"])).cast("long").alias("start"), F.get("ends", i).cast("long").alias("end"), p["loss"].alias("loss")))
    loss = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    whole = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), ""), F.lit(END))
    return rows.select(F.col("conv_id").alias(conv_col), whole.alias("formatted"), loss.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns`` (role, text) and ``loss_text``, recovered from ``formatted`` and ``loss`` alone."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda b: b != "")
    halves = F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(TURN) + 1)), r"<\|text\|>"))
    turns = F.flatten(F.transform(halves, lambda h: F.transform(F.split(h[1], r"<\|next\|>", -1), lambda t: F.struct(unescaped(h[0]).alias("role"), unescaped(t).alias("text")))))
    loss = F.transform("loss", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return chats.withColumn("turns", turns).withColumn("loss_text", F.array_join(loss, ""))
