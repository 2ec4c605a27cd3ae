"""Chat formatting of preference pairs.

A pair is a chosen and a rejected conversation.  Their longest common prefix of turns (same role, same
text) is rendered once as the prompt; what follows is rendered as two completions, each with the
spans that count in training (the assistant's turns), all else being masked.

Turns are brought together once by pair; the turns of both sides are then compared place by place and
measured by running sums, so a conversation is handled in linear time and only its rendered strings
are held as one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col

# The template's marks.  A mark inside a text is opened by a space, so it cannot pass for one.
OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE + "\n"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, trained: str = "assistant") -> DataFrame:
    """Two tables ``(pair_id, turn, role, text)`` -> a row per pair:

    pair_id, prompt, chosen, rejected, prompt_turns, and ``chosen_mask`` / ``rejected_mask``: the spans
    ``start:end`` (code points of the completion, end exclusive, comma-joined) of the trained turns with their
    end marks.  Equal conversations have empty completions.  A side without turns is an empty
    conversation.  Null roles and texts count as empty; turns with equal numbers follow by role and text;
    rows without a pair_id are dropped; empty tables give no rows.
    """
    def side(df, n):
        return df.select(col("pair_id").alias("pair_id"), F.lit(n).alias("side"), col("turn").alias("turn"),
                         F.coalesce(col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(col("text").cast("string"), F.lit("")).alias("text"))

    t = side(chosen, 0).unionByName(side(rejected, 1)).where("pair_id is not null").repartition("pair_id")
    own = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    t = t.withColumn("pos", F.row_number().over(own))
    place = Window.partitionBy("pair_id", "pos")
    turn = F.struct("role", "text")
    t = t.withColumn("same", (F.count(F.lit(1)).over(place) == 2) & (F.min(turn).over(place) == F.max(turn).over(place)))
    t = t.withColumn("first", F.min(F.when(~F.col("same"), F.col("pos"))).over(Window.partitionBy("pair_id")))
    common = F.col("first").isNull() | (F.col("pos") < F.col("first"))
    opening = head(F.replace("role", F.lit(OPEN), F.lit("< |")))
    t = t.withColumn("common", common).withColumn("piece", F.concat(opening, F.replace("text", F.lit(OPEN), F.lit("< |")), F.lit(END)))
    t = t.withColumn("skip", F.length(opening))
    upto = Window.partitionBy("pair_id", "side", "common").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(upto), F.lit(0).cast("long")))
    span = F.concat_ws(":", (F.col("at") + F.col("skip")).cast("string"), (F.col("at") + F.length("piece")).cast("string"))

    def ordered(cond, value):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", value.alias("v"))))), lambda x: x["v"]), "")

    def masked(cond):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond & (F.col("role") == trained), F.struct("pos", span.alias("v"))))),
                                        lambda x: x["v"]), ",")

    first, second, rest = F.col("side") == 0, F.col("side") == 1, ~F.col("common")
    return t.groupBy("pair_id").agg(
        ordered(first & F.col("common"), F.col("piece")).alias("prompt"),
        ordered(first & rest, F.col("piece")).alias("chosen"), ordered(second & rest, F.col("piece")).alias("rejected"),
        F.count_if(first & F.col("common")).alias("prompt_turns"),
        masked(first & rest).alias("chosen_mask"), masked(second & rest).alias("rejected_mask"))


def swapped_answers(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations ``(conv_id, turn, role, text)``: chosen is the conversation itself, rejected the
    conversation up to its last assistant turn, whose text is that of its neighbour (2k and 2k+1 swap).

    Without an assistant turn in a conversation both sides are equal; without one in the neighbour, the
    rejected side ends before the answer.
    """
    c = turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").where("pair_id is not null")
    last = c.where("role = 'assistant'").groupBy("pair_id").agg(F.max_by(F.struct("turn", "text"), F.struct("turn", "text")).alias("a"))
    neighbour = last.select(F.expr("pair_id ^ 1").alias("pair_id"), F.col("a.text").alias("other"))
    ends = last.select("pair_id", F.col("a.turn").alias("answer")).join(neighbour, "pair_id", "left")
    r = c.join(ends, "pair_id", "left")
    kept = r.where(F.col("answer").isNull() | (F.col("turn") < F.col("answer"))).select("pair_id", "turn", "role", "text")
    new = ends.where("other is not null").select("pair_id", F.col("answer").alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"))
    return c, kept.unionByName(new)
