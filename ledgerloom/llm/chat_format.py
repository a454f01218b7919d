"""Chat formatting by relational steps (Spark expressions only).

Turns of a conversation are collected as structs and sorted; runs of the
same role are merged by array functions; the result is one string:

    <|im_start|>role\\n text <|im_sep|> text <|im_end|>\\n

``<|im_sep|>`` parts the texts of a merged run, so nothing is lost by
merging. Roles are URL-encoded. In texts, ``<`` + k backslashes + ``|``
becomes ``<`` + (k + 1) backslashes + ``|``: no text can then hold ``<|``,
so no control string, and dropping one backslash restores it.

``loss_spans`` are [start, end) code points of the assistant's texts, so
marks and separators carry no loss. ``parse`` reads everything back.

Defined results: a null text or role is empty; turns with the same number
are ordered by role, then text; repeated rows are turns of their own; a null
conversation id is one conversation; an empty table gives an empty result;
other columns are not read. A conversation becomes one string, so it is the
one thing that must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv id, n_turns, n_merged, formatted, loss_spans: one row per conversation."""
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                     F.url_encode(F.coalesce(F.col(role_col).cast("string"), F.lit(""))).alias("role"),
                     escape(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    # where each text ends in the formatted string: a running length in turn order
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    first = F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True))
    last = F.coalesce(F.lead("role").over(order) != F.col("role"), F.lit(True))
    before = F.when(F.col("first"), F.length("role") + len(START) + 1).otherwise(len(SEP))
    after = F.when(F.col("last"), F.lit(len(END) + 1)).otherwise(0)
    so_far = F.sum(before + F.length("text") + after).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = (rows.withColumn("first", first).withColumn("last", last)
              .withColumn("end", (so_far - after).cast("long")))
    turns = placed.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "end"))).alias("turns"))
    starts = turns.withColumn("starts", F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])))
    merged = starts.withColumn("merged", F.transform("starts", lambda s, k: F.struct(
        F.get("turns", s)["role"].alias("role"),
        F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s),
                    lambda t: t["text"]).alias("texts"))))
    block = lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), F.array_join(m["texts"], SEP),
                               F.lit(END + "\n"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == loss_role),
                        lambda t: F.struct((t["end"] - F.length(t["text"])).cast("long").alias("start"),
                                           t["end"].alias("end")))
    return merged.select(F.col("conv").alias(conv_col), F.size("turns").cast("long").alias("n_turns"),
                         F.size("merged").cast("long").alias("n_merged"),
                         F.array_join(F.transform("merged", block), "").alias("formatted"),
                         spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns behind a formatted string."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b, i: i > 0)

    def turns(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        start = F.length(role) + 2
        body = F.substr(b, start, F.length(b) - start - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1),
                           lambda x: F.struct(F.url_decode(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(
        spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"),
                                           (s["end"] - s["start"]).cast("int")))), "")
