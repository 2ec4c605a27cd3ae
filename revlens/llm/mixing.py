"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots.  Slot i gets the golden-ratio point ``i * 2654435769 mod 2**32``, the point
is mapped through the cumulative target shares to a source, and the slots of a source are ranked.
Each source's documents, shuffled by a seeded hash, are laid end to end (and repeated while the
source's target asks for it) and cut into blocks of equal words; the k-th slot of a source takes its
k-th block by an equality join.  Any stretch of the schedule thus holds the sources close to their
shares.  Blocks grow with the corpus, so whole slots can miss a source's target, a small source's by
far: every source takes its target to the word, its last block cut at the remainder, slots beyond it
left empty, and missing blocks added at even distances of the schedule.

Nothing is ordered by one task: documents and slots are numbered inside buckets of hashed or
consecutive keys, and running totals are taken over the bucket sums.  Only the table of sources, one
row each, is ordered as a whole.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, packed, unpacked, written

GOLDEN = 2654435769   # 2**32 divided by the golden ratio, odd: i * GOLDEN mod 2**32 visits every point once
POINTS = 1 << 32
CELLS = 4096          # equal cells of the points, through which points meet the shares by equality
CHUNK = 1 << 16       # consecutive slots that are ranked together


def word_count(c):
    return F.regexp_count(F.coalesce(c.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """``sources(source, ...)`` with ``rank`` (by code point, null last, from 0) and ``weight`` 1..cycle, repeating."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(w) - 1)
    return ranked.withColumn("weight", (F.col("rank") % cycle + 1).cast("double"))


def targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """Water filling: ``sources(rank, source_size, weight)`` with ``target`` = min(most * size, level * weight).

    The level is the one at which the targets add up to all sizes: what a source cannot take is shared
    among the others by weight until none is above its cap.  The sources whose caps bind are
    those of the smallest cap per weight, so one ordered pass finds the level.
    """
    cap = F.col("source_size") * F.lit(float(most))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(cap / F.col("weight"), "rank")
    whole = Window.partitionBy(F.lit(0))
    s = (sources.withColumn("cap", cap)
         .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(
             F.sum("weight").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("total", F.sum("source_size").over(whole).cast("double"))
         .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
         .withColumn("free", F.col("level") * F.col("weight") < F.col("cap"))
         # the level of the first source whose cap does not bind holds for all after it
         .withColumn("first_free", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(whole)))
    return s.withColumn("target", F.when(F.col("first_free").isNull(), F.col("cap")).otherwise(
        F.least("cap", F.col("first_free.level") * F.col("weight")))) \
        .drop("cap", "cap_before", "weight_left", "total", "level", "free", "first_free")


def _running(sums: DataFrame, key: str, bucket: str, value: str) -> DataFrame:
    """``value`` of the buckets before, by key: over one row per (key, bucket)."""
    w = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))).drop(value)


def stream(docs: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """``docs(rank, size, doc_id, h)`` -> with ``start``: words of the source's documents before it in shuffled order.

    The root of ``rows`` buckets, so that rows in a bucket and sums over buckets grow alike.
    """
    buckets = isqrt(rows) + 1
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "h")
    order = F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")
    d = docs.withColumn("o", order).withColumn("bucket", F.shiftright("o", 20) % F.lit(buckets))
    sums = d.groupBy("rank", "bucket").agg(F.sum("size").alias("size"))
    inside = Window.partitionBy("rank", "bucket").orderBy("o", "doc_id", "h", "size", "tag") \
        .rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    return d.join(_running(sums, "rank", "bucket", "size"), ["rank", "bucket"]) \
        .withColumn("start", F.col("before") + F.col("inside")).drop("o", "bucket", "inside", "before")


def schedule(spark, shares: DataFrame, slots: int) -> DataFrame:
    """``shares(rank, low, high)``, consecutive ranges of the points -> ``(slot, rank, k)``: the k-th slot of a source."""
    cells = shares.where("low < high").withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") / (POINTS // CELLS)), F.floor((F.col("high") - 1) / (POINTS // CELLS)))))
    s = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(POINTS // 2)) * GOLDEN, F.lit(POINTS)).alias("point"))
    s = s.withColumn("cell", F.floor(F.col("point") / (POINTS // CELLS)))
    s = s.join(cells, (s.cell == cells.cell) & (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))) \
        .select("slot", "rank", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = s.groupBy("rank", "chunk").agg(F.count(F.lit(1)).alias("n"))
    inside = F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("slot")) - 1
    return s.withColumn("inside", inside).join(_running(counts, "rank", "chunk", "n"), ["rank", "chunk"]) \
        .select("slot", "rank", (F.col("before") + F.col("inside")).alias("k"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
        most: float = 3.0, density: int = 32, weigh=cyclic_weights, carry: list[str] | None = None):
    """-> (documents, segments).

    documents: one row per document: ``row`` (the carried columns), doc_id, size, source_size,
    target, ``taken`` (words the mix takes, repeats counted), ``tag`` (names the row).
    segments: the mix itself: slot, ``tag``, ``offset`` (first word taken), ``words``; read in slot
    order it is the mixed stream.

    ``weigh`` maps the table of sources (source, source_size) to itself with rank and weight.  Slots:
    ``density * sqrt(words)``, so a block grows like the root of the corpus and the deviation from the
    targets falls in proportion.  Null texts have size 0; null sources are one source, the last;
    documents of size 0 and sources of size 0 take nothing; repeated rows count each; an empty table
    gives empty results.
    """
    carry = [doc_id] if carry is None else carry
    spark = docs.sparkSession
    base = written(docs.select(packed(docs.select(*[col(c) for c in carry]), "row"), col(doc_id).alias("doc_id"),
                               col(source).alias("source"), word_count(col(text)).alias("size"),
                               F.md5(F.coalesce(col(text).cast("string"), F.lit("")).cast("binary")).alias("h")).withColumn("tag", F.monotonically_increasing_id()), "mix")
    plan = targets(weigh(base.groupBy("source").agg(F.sum("size").alias("source_size"))), most)
    # equal blocks, and each source's share of the points
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    slots = density * (isqrt(total) + 1) if total else 0
    block = -(-total // slots) if total else 1
    slots = -(-total // block) if total else 0
    upto = Window.partitionBy(F.lit(0)).orderBy("rank")
    edge = F.least(F.lit(POINTS), F.round(F.sum("target").over(upto) * (POINTS / max(total, 1)))).cast("long")
    # the last source takes what rounding leaves of the points
    last = F.col("rank") == F.max("rank").over(Window.partitionBy(F.lit(0)))
    plan = plan.withColumn("high", F.when(last, F.lit(POINTS)).otherwise(edge))
    plan = plan.withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0).cast("long")))
    plan = written(plan.select("source", "rank", "source_size", "target", "low", "high"), "mix-plan")
    slot = schedule(spark, plan.select("rank", "low", "high"), slots)
    # each source takes its target to the word: blocks that its slots lack are added, slots beyond it find no block
    plan = plan.join(slot.groupBy("rank").agg(F.count(F.lit(1)).alias("n")), "rank", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    cap = F.floor(F.col("source_size") * F.lit(float(most)))
    plan = written(plan.withColumn("limit", F.least(cap, F.round("target").cast("long")))
                   .withColumn("more", F.greatest(F.lit(0).cast("long"), F.ceil(F.col("limit") / block) - F.col("n")))
                   .select("source", "rank", "source_size", "target", "limit", "n", "more"), "mix-quota")
    added = plan.where("more > 0").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more") - 1))).select(
        F.floor((F.col("j") * 2 + 1) * slots / (F.col("more") * 2)).alias("slot"), "rank", (F.col("n") + F.col("j")).alias("k"))
    ranked = base.select("tag", "doc_id", "h", "size", "source").join(
        plan.select(F.col("source").alias("of"), "rank", "source_size", "target", "limit"), F.col("source").eqNullSafe(F.col("of"))) \
        .drop("source", "of")
    ranked = written(stream(ranked, rows), "mix-stream")
    # the stream's blocks: pass e of the source starts at e * source_size
    passes = int(-(-most // 1))
    part = (ranked.where("size > 0").withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
            .withColumn("a", F.col("start") + F.col("e") * F.col("source_size"))
            .withColumn("b", F.least(F.col("a") + F.col("size"), F.col("limit")))
            .where("a < b")
            .withColumn("k", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block)))))
    got = part.join(slot.unionByName(added), ["rank", "k"])
    first = F.greatest(F.col("a"), F.col("k") * block)
    segments = got.select("slot", "tag", (first - F.col("a")).alias("offset"),
                          (F.least(F.col("b"), (F.col("k") + 1) * block) - first).alias("words"))
    taken = segments.groupBy("tag").agg(F.sum("words").alias("taken"))
    out = ranked.select("tag", "doc_id", "size", "source_size", "target").join(taken, "tag", "left") \
        .withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    if carry == [doc_id]:
        return out, segments
    return base.select("row", "tag").join(out, "tag"), segments


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Whole documents as the mix takes them: each row as many times as its words are taken, rounded.

    A source's stream is cut at one place, so at most one document of a source is rounded.  A document
    that the mix does not reach goes, as does one without a word.  Columns are those of ``docs``.
    """
    rows, _ = mix(docs, carry=docs.columns, **options)
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    return rows.where("taken > 0").withColumn("times", times).where("times > 0") \
        .select(F.explode(F.array_repeat(F.lit(0), F.col("times"))), "row").select(*unpacked(docs.columns, "row"))
