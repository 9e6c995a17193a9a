"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context and that reply
alone under the loss mask. Turns after the last reply, which no example would hold, form
one more example without a target, so that the output holds every turn.

The template marks a turn as `<|role|>`, a new line, the text and `<|end|>`. Control
strings of this and of other common templates inside roles and texts, and the end of a
head inside roles, get a backslash after their first character, and one more where
backslashes follow it already; taking one away gives the text back.

A conversation is taken in blocks of turn numbers. Within a block, a window joins the
turns so far; of the few conversations with several blocks, the texts of the blocks before
are joined to each example. So no task holds a long conversation, only what an example
itself holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.llm.shared import shared_table

#: What follows `<` or `[` in a control string: of this template, and `<s>`, `</s>`,
#: `[INST]`, `[/INST]`, `<<SYS>>`, `<</SYS>>`.
TAILS = r"\||/?s>|/?INST\]|</?SYS>>"
END = "<|end|>"
#: Turn numbers of one block.
BLOCK_TURNS = 64


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={TAILS})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={TAILS})", "$1$2")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(escaped(role), r"(\|)(\\*)(?=>)", r"$1\\$2")


def unescaped_role(role: Column) -> Column:
    return unescaped(F.regexp_replace(role, r"(\|)\\(\\*)(?=>)", "$1$2"))


def chat_examples(conversations: DataFrame, trainable: str = "assistant", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start and loss_end (code points; both
    null in an example without target, whose turns follow the last reply).

    Rows of `conversations` (conv_id, turn, role, text; further columns are left alone)
    are taken by turn, a number, equal turns by role and text, null turns first; null
    roles and texts count as empty, null conv_ids as one conversation. Repeated rows are
    turns of their own; no rows give no examples.
    """
    turns = conversations.select(
        "conv_id",
        F.col("turn").alias("turn"),
        F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(2**63))).alias("block"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("target", F.col("role") == trainable)
    long = shared_table(several_blocks(turns), "long-conversations")
    several = not long.isEmpty()
    same = turns["conv_id"].eqNullSafe(long["conv_id"]) & (turns["block"] == long["block"])
    none = (("past", 0), ("earlier", False), ("later", False))
    if several:
        held = turns.join(long, same, "left").select(turns["*"], *[F.coalesce(long[c], F.lit(x)).alias(c) for c, x in none])
    else:
        held = turns.withColumns({c: F.lit(x) for c, x in none})
    # dealt before the texts are formatted, which makes them several columns
    held = formatted(held.repartition("conv_id", "block"))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = held.select(
        "conv_id",
        "block",
        "earlier",
        "target",
        (F.col("past") + F.sum(F.col("target").cast("int")).over(so_far) - F.col("target").cast("int")).alias("example"),
        (F.lead(F.lit(True)).over(order).isNull() & ~F.col("later")).alias("last"),
        F.concat_ws("", F.collect_list("formatted").over(so_far)).alias("formatted"),
        F.length("body").alias("body_chars"),
    ).filter("target or last")
    if several:
        texts = formatted(turns).join(long, same, "left_semi").groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "formatted"))).alias("own"))
        texts = shared_table(texts.select(F.col("conv_id").alias("__conv"), F.col("block").alias("__block"), F.concat_ws("", "own.formatted").alias("whole")), "chat-blocks")
        placed = shared_table(placed, "chat-examples")
        of = F.col("conv_id").eqNullSafe(F.col("__conv"))
        met = placed.filter("earlier").select("conv_id", "block", "example").join(texts, of & (F.col("__block") < F.col("block")))
        heads = met.groupBy("__conv", F.col("example").alias("__example")).agg(F.array_sort(F.collect_list(F.struct("__block", "whole"))).alias("before"))
        rest = placed.filter("earlier").join(heads, of & (F.col("example") == F.col("__example")))
        rest = rest.withColumn("formatted", F.concat(F.concat_ws("", "before.whole"), "formatted"))
        placed = placed.filter("not earlier").unionByName(rest.select(*placed.columns))
    end = F.length("formatted") - len(END)
    return placed.select(
        "conv_id",
        "example",
        "formatted",
        F.when(F.col("target"), end - F.col("body_chars")).cast("bigint").alias("loss_start"),
        F.when(F.col("target"), end).cast("bigint").alias("loss_end"),
    )


def formatted(turns: DataFrame) -> DataFrame:
    """`turns` with body (the text, escaped) and formatted (the whole turn)."""
    turns = turns.withColumn("body", escaped(F.col("text")))
    return turns.withColumn("formatted", F.concat(F.lit("<|"), escaped_role(F.col("role")), F.lit("|>\n"), "body", F.lit(END)))


def several_blocks(turns: DataFrame) -> DataFrame:
    """Of conversations with more than one block, each block: conv_id, block, past (the
    targets before it), and whether there are earlier and later ones.
    """
    sizes = turns.groupBy("conv_id", "block").agg(F.sum(F.col("target").cast("int")).alias("targets"))
    order = Window.partitionBy("conv_id").orderBy("block")
    past = F.sum("targets").over(order.rowsBetween(Window.unboundedPreceding, -1))
    beside = [f(F.lit(True)).over(order).isNotNull().alias(c) for f, c in ((F.lag, "earlier"), (F.lead, "later"))]
    return sizes.select("conv_id", "block", F.coalesce(past, F.lit(0)).alias("past"), *beside).filter("earlier or later")


def read_turns(formatted: Column) -> Column:
    """The turns of an example, read back from its text: array of (role, text)."""
    parts = F.regexp_extract_all(formatted, F.lit(r"(?s)<\|(.*?)\|>\n(.*?)<\|end\|>"), F.lit(0))
    field = lambda turn, n: F.regexp_extract(turn, r"(?s)^<\|(.*?)\|>\n(.*?)<\|end\|>$", n)
    return F.transform(parts, lambda t: F.struct(unescaped_role(field(t, 1)).alias("role"), unescaped(field(t, 2)).alias("text")))


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The text under an example's loss mask, unescaped; null without target."""
    return unescaped(formatted.substr((start + 1).cast("int"), (end - start).cast("int")))
