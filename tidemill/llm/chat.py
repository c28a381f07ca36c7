"""Chat formatting: cumulative snapshots collapse to the longest conversations, which are then rendered.

Chat logs often hold a conversation once per turn, each copy a prefix of the next.  A rolling hash over turns tells: a
conversation whose whole hash is the prefix hash of a longer one goes, by anti-join.  Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _turn_hash(place: Column) -> list[Column]:
    """128 bits of a turn at its place."""
    digest = F.md5(F.concat_ws("\x1f", place.cast("string"), F.coalesce(F.concat(F.lit("="), F.col("role")), F.lit("0")), F.coalesce(F.concat(F.lit("="), F.col("body")), F.lit("0"))).cast("binary"))
    return [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(2)]


def prefix_hashes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each turn with its place (from 1) and the rolling hash of its conversation up to it.

    Turns come in the order of their number, ties by role and text; nulls first.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumn("place", F.row_number().over(order))
    for name, h in zip(("t0", "t1"), _turn_hash(F.col("place"))):
        rows = rows.withColumn(name, h)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("h0", F.bit_xor("t0").over(upto)).withColumn("h1", F.bit_xor("t1").over(upto)).drop("t0", "t1")


def maximal_conversations(turns: DataFrame, **columns) -> DataFrame:
    """``conv_id``, ``n_turns`` and ``n_logs`` (equal copies) of conversations that no longer one starts with.

    Of equal conversations that with the smallest id stays.  Rows without a conversation id belong to none.
    """
    turns = turns.where(F.col(columns.get("conv_col", "conv_id")).isNotNull())
    rolled = prefix_hashes(turns, **columns)
    whole = rolled.groupBy("conv_id").agg(F.max_by(F.struct("h0", "h1"), "place").alias("h"), F.max("place").alias("n_turns"))
    firsts = whole.groupBy(F.col("h.h0").alias("h0"), F.col("h.h1").alias("h1"), "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logs"))
    last = Window.partitionBy("conv_id")
    inner = rolled.withColumn("n", F.max("place").over(last)).where("place < n").select("h0", "h1", F.col("place").alias("n_turns")).distinct()
    return firsts.join(inner, ["h0", "h1", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_logs")


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id`` and ``rendered``: per turn a start mark, role, line break, text, end mark and line break.

    A null role reads ``user``, a null text is empty.  A rendered conversation is one value, so its turns meet in one row.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("body")).alias("t"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    text = F.transform("t", lambda t: F.concat(F.lit(START), F.coalesce(t["role"], F.lit("user")), F.lit("\n"), F.coalesce(t["body"], F.lit("")), F.lit(END + "\n")))
    return listed.select("conv_id", F.array_join(text, "").alias("rendered"))


def format_chats(turns: DataFrame, **columns) -> DataFrame:
    """Maximal conversations with their rendered text.

    Only the four columns named are read, so others may have any name.  An empty table gives no rows; turns without a conversation
    id are left out; repeated turns stay; a conversation of any length is one text.
    """
    kept = maximal_conversations(turns, **columns)
    return kept.join(render(turns, **columns), "conv_id")
