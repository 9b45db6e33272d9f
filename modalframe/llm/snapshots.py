"""Chat formatting: cumulative snapshots of one conversation collapse into the longest, which is rendered."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turn_prefixes(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns in order with the rolling hash of all turns up to each: ``conv, pos, role, text, h1, h2, last``.

    The hash of a prefix is the sum of hashes of (place, role, text), so it rolls from turn to turn in one window; two
    independent sums of 64-bit hashes stand for the prefix.
    """
    t = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("conv is not null")
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    t = t.withColumn("pos", F.row_number().over(order))
    rolled = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wide = lambda *c: F.xxhash64(*c).cast("decimal(28,0)")
    return t.select("conv", "pos", "role", "text", F.sum(wide("pos", "role", "text")).over(rolled).alias("h1"), F.sum(wide("text", "role", "pos", F.lit("b"))).over(rolled).alias("h2"),
                    F.lead("pos").over(order).isNull().alias("last"))


def collapse_snapshots(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Maximal conversations, rendered: ``conv_col, n_turns, n_copies, chat``.

    A conversation whose turns are the first turns of a longer one is a snapshot of it and goes (an anti-join with all proper
    prefixes); of equal ones the least id stays and ``n_copies`` counts them all. Turns are ordered by turn, then role, then
    text, so ties and repeated rows have a fixed place; a null role or text is an empty one, and a null turn comes first.
    Turns without a conversation id belong to no conversation and are left out. A table without turns gives an empty one;
    other columns are not read. Each turn is written as ``<|im_start|>role, line end, text<|im_end|>, line end``. Only the
    turns of one retained conversation are ever brought together, to become its text.
    """
    t = turn_prefixes(turns, conv_col, turn_col, role_col, text_col)
    whole = t.filter("last").groupBy("pos", "h1", "h2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = t.filter("not last").select("pos", "h1", "h2").distinct()
    maximal = whole.join(prefixes, ["pos", "h1", "h2"], "left_anti").select("conv", F.col("pos").cast("bigint").alias("n_turns"), "n_copies")
    said = F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))), lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["text"], F.lit("<|im_end|>\n")))
    chats = t.select("conv", "pos", "role", "text").join(maximal, "conv").groupBy("conv", "n_turns", "n_copies").agg(F.array_join(said, "").alias("chat"))
    return chats.select(F.col("conv").alias(conv_col), "n_turns", "n_copies", "chat")
