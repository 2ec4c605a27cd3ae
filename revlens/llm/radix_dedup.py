"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive bytes, most significant first: a round reads the next digit (a
block of bytes, ``first`` of them at the start and ``grow`` times as many in each later round, so a
text of n bytes needs log(n) rounds), and a group is the documents that agreed in every digit
so far.  A document that is alone in its group is done; documents that end in the same digit are
equal.  The bytes decide; no digest takes part.

A round counts its groups with a partial aggregate (a group of copies leaves one row per task) and
joins the counts back; AQE can split the rows of a hot group in that join.  Only unresolved
documents, and of them only the bytes not yet read, go on to the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, col, written


def normalised(c):
    """Text with every run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), SPACES, " ")


def radix_groups(rows: DataFrame, first: int = 64, grow: int = 4) -> DataFrame:
    """``rows(body binary, doc_id, ...)`` -> the other columns with ``group_size``, ``keep_id`` and ``kept``.

    ``keep_id`` is the smallest doc_id of the equal bodies (null ids come last; null if all are).
    Of the rows that carry it exactly one is ``kept``.
    """
    others = [c for c in rows.columns if c != "body"]
    key, active, width, level, done = ["gid", "digit", "ended"], rows.withColumn("gid", F.lit(0).cast("long")), first, 0, []
    while True:
        cut = active.select(*others, "gid", F.substring("body", 1, width).alias("digit"),
                            (F.length("body") <= width).alias("ended"),
                            F.expr(f"substring(body, {width + 1})").alias("rest"))
        groups = written(cut.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"))
                         .where("n > 1").withColumn("next", F.monotonically_increasing_id()), "radix-groups")
        # sort-merge at every size: AQE splits the rows of a hot group, and the cost follows the rows
        step = written(cut.join(groups.hint("merge"), key, "left").select(
            *others, F.coalesce("n", F.lit(1).cast("long")).alias("n"), F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("low"),
            F.col("next").alias("gid"), F.lit(level).alias("level"),
            F.when(F.col("n").isNotNull() & ~F.col("ended"), F.col("rest")).alias("body")), "radix-round")
        done.append(step.where("body is null").drop("body"))
        active = step.where("body is not null").select(*others, "gid", "body")
        if active.isEmpty():
            break
        width, level = width * grow, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = written(out.withColumn("tag", F.monotonically_increasing_id()), "radix-result")
    # the one row that stays: rows may repeat with their id, so a tag settles it
    stay = (out.where("n > 1").where(F.col("doc_id").eqNullSafe(F.col("low")))
            .groupBy("level", "gid").agg(F.min("tag").alias("tag")).select("tag", F.lit(True).alias("stays")))
    return out.join(stay, "tag", "left").select(
        *others, F.col("low").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("n") == 1) | F.coalesce("stays", F.lit(False))).alias("kept"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Null texts count as empty; empty texts are one group.  Repeated rows are copies like any others and
    one of them is kept.  Other columns of ``docs`` are not read.  An empty table gives an empty result.
    """
    body = normalised(col(text))
    rows = docs.select(col(doc_id).alias("doc_id"), body.cast("binary").alias("body"))
    rows = rows.withColumn("text_sha256", F.sha2("body", 256))
    return radix_groups(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
