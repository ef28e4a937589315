"""Chat transcripts rendered from the view of each participant.

For every speaker of a conversation the whole dialogue is rendered once with that speaker as the assistant: the speaker's turns
carry the loss mask, all other turns become user turns that name their speaker. System turns stay system turns in every view and speak for nobody.

The result is one row per view and turn with the rendered segment, its place and its mask, so that no conversation, however long,
is gathered in one task: places are running sums in two levels (within blocks of BLOCK turns, and over blocks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SYSTEM = "system"
BLOCK = 256


def _name(role: Column) -> Column:
    """A role as a name inside a mark: what could end the mark is written as %XX, so different roles keep different names."""
    for c in ("%", "|", "<", ">", "\n"):
        role = F.replace(role, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return role


def _head(role: Column, view: Column) -> Column:
    named = F.concat(F.lit("<|user name="), _name(role), F.lit("|>\n"))
    return F.when(role == SYSTEM, F.lit("<|system|>\n")).when(role == view, F.lit("<|assistant|>\n")).otherwise(named)


def perspectives(turns: DataFrame) -> DataFrame:
    """One row per (conv_id, view, turn row): conv_id, view, position, turn, segment, begin, mask_begin, mask_end.

    turns: conv_id, turn, role, text. position is the place of the turn in the conversation (from 0; by turn, then role, then
    text; null turns first); begin is the code point offset of the segment in the rendered dialogue, which is the segments in
    order of position. mask_begin and mask_end bound the text that the view's speaker has to learn, in code points of the
    dialogue, end exclusive; they are null in other speakers' turns. The end mark after a text is learned with it. A null
    text is empty. What opens a mark (<|) is written <&#124; inside texts, so no text ends its turn or opens another, and names
    write the characters of marks as %XX. A null role is the speaker "unknown". Rows with a null conv_id are left out; conversations of system
    turns only have no view. Repeated turns stay, as turns of their own. Other columns are ignored.
    """
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<&#124;")).alias("text"))
    speakers = rows.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("view")).distinct()
    # blocks are ranges of turn numbers, so one long conversation spreads over tasks
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    within = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("in_block", F.row_number().over(within) - 1)
    views = rows.join(speakers, "conv_id")
    segment = F.concat(_head(F.col("role"), F.col("view")), F.col("text"), F.lit("<|end|>\n"))
    views = views.withColumns({"segment": segment, "size": F.length(segment).cast("long")})
    inner = Window.partitionBy("conv_id", "view", "block").orderBy("in_block").rowsBetween(Window.unboundedPreceding, -1)
    views = views.withColumn("inner_begin", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    blocks = views.groupBy("conv_id", "view", "block").agg(F.sum("size").alias("block_size"), F.count("*").alias("block_turns"))
    outer = Window.partitionBy("conv_id", "view").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "view", "block", F.coalesce(F.sum("block_size").over(outer), F.lit(0)).alias("block_begin"), F.coalesce(F.sum("block_turns").over(outer), F.lit(0)).alias("turns_before"))
    placed = views.join(blocks, ["conv_id", "view", "block"])
    begin = F.col("block_begin") + F.col("inner_begin")
    own, text_begin = F.col("role") == F.col("view"), begin + F.length(_head(F.col("role"), F.col("view")))
    return placed.select(
        "conv_id", "view", (F.col("turns_before") + F.col("in_block")).alias("position"), "turn", "segment", begin.alias("begin"),
        F.when(own, text_begin).alias("mask_begin"), F.when(own, text_begin + F.length("text") + F.length(F.lit("<|end|>"))).alias("mask_end"),
    )


def dialogues(turns: DataFrame) -> DataFrame:
    """Whole rendered dialogues for conversations known to be short: conv_id, view, text, masks (array of begin and end)."""
    rows = perspectives(turns).groupBy("conv_id", "view").agg(F.array_sort(F.collect_list(F.struct("position", "segment", "mask_begin", "mask_end"))).alias("s"))
    masks = F.transform(F.filter("s", lambda x: x["mask_begin"].isNotNull()), lambda x: F.struct(x["mask_begin"].alias("begin"), x["mask_end"].alias("stop")))
    return rows.select("conv_id", "view", F.concat_ws("", F.transform("s", lambda x: x["segment"])).alias("text"), masks.alias("masks"))
