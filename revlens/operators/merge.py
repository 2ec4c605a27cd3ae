"""Batch split and merge of per-batch model results (inventory G1-G12).

Merges are grouped aggregates per scope (a business): weighted sums, ``max_by`` for the
summary of the largest batch and "first-seen distinct, first N" lists built from
``min(struct(batch, position))`` per item followed by a per-scope top-N.  Every step is a
map-side-combinable aggregate or a WindowGroupLimit, so a business with very many batches
never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .modelio import SENTIMENTS, TOPICS
from .joins import join_on
from .ordering import _cols, dense_index

# --- fixed values -------------------------------------------------------------------
BATCH_SIZE = 100
MAX_HIGHLIGHTS = 5
MAX_KEYWORDS = 4
DEFAULT_TOPIC_SCORE = 3.0
# ------------------------------------------------------------------------------------


def split_batches(reviews: DataFrame, scope: Sequence[str] = ("business_id",), order: str = "seq",
                  batch_size: int = BATCH_SIZE) -> DataFrame:
    """G1: consecutive batches of ``batch_size`` rows per scope in input order; adds
    ``batch_id`` (0-based) and ``batch_size`` (rows in that batch).  The position comes
    from the skew-free dense index, the batch size from the scope's number of rows."""
    scope = _cols(scope)
    idx = dense_index(reviews, scope, order, name="_pos", total="_rows")
    with_b = idx.withColumn("batch_id", F.floor(F.col("_pos") / batch_size).cast("long"))
    size = F.least(F.lit(batch_size).cast("long"), F.col("_rows") - F.col("batch_id") * batch_size)
    return with_b.withColumn("batch_size", size).drop("_pos", "_rows")


def _first_seen(items: DataFrame, scope: list[str], group: list[str], item: str, n: int,
                out: str) -> DataFrame:
    """First-seen distinct ``item`` per (scope, group) in (batch_id, pos) order, first n,
    as an ordered array."""
    firsts = items.groupBy(*scope, *group, item).agg(F.min(F.struct("batch_id", "pos")).alias("_o"))
    w = Window.partitionBy(*scope, *group).orderBy("_o")
    top = firsts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return (top.groupBy(*scope, *group)   # at most n rows per group
            .agg(F.array_sort(F.collect_list(F.struct("_rn", item))).alias("_l"))
            .select(*scope, *group, F.transform("_l", lambda x: x[item]).alias(out)))


def merge_sentiment(results: DataFrame, scope: Sequence[str] = ("scope",), batch: str = "batch_id",
                    size: str = "batch_size", ok: str | None = "ok") -> DataFrame:
    """Merge checked per-batch sentiment results per scope.

    Input columns: scope, ``batch``, ``size``, positive, negative, neutral, summary,
    positive_highlights, negative_highlights (and ``ok``: failed batches are skipped and
    left out of the weights).  One result -> returned as is (``batches_processed`` and
    ``total_reviews_analyzed`` NULL, ``single_batch_size`` kept); several -> batch-size
    weighted means re-normalised to 100 (half-even; remainder to neutral; a zero total
    keeps the unrounded values), first-seen distinct highlights (first 5), summary of the
    largest batch (first on ties).  Scopes whose batches all failed produce no row.
    """
    scope = _cols(scope)
    r = results.withColumnRenamed(batch, "batch_id").withColumnRenamed(size, "batch_size")
    # failed batches are skipped inside the aggregates (conditional sums, NULL orderings for
    # max_by/min_by) rather than by a filter on ``ok``: such a filter is pushed below a
    # checker's projection and re-evaluates the parsed answer for every reference
    good = F.col(ok) if ok else F.lit(True)
    n = F.col("batch_size")
    agg = r.groupBy(*scope).agg(
        F.count_if(good).alias("n_batches"), F.sum(F.when(good, n)).alias("total_n"),
        *[F.sum(F.when(good, F.col(k) * n)).alias(f"_w_{k}") for k in SENTIMENTS],
        # largest batch, first (smallest batch_id) on ties
        F.max_by(F.struct(*[F.col(k).alias(k) for k in
                            ["summary", "positive", "negative", "neutral", "batch_size"]]),
                 F.when(good, F.struct(n, -F.col("batch_id")))).alias("_best"),
        F.min_by(F.struct("positive_highlights", "negative_highlights"),
                 F.when(good, F.col("batch_id"))).alias("_only")).filter(F.col("n_batches") > 0)
    w = {k: F.col(f"_w_{k}") / F.col("total_n") for k in SENTIMENTS}
    tot = w["positive"] + w["negative"] + w["neutral"]
    p = F.when(tot > 0, F.rint(w["positive"] / tot * 100)).otherwise(w["positive"])
    ng = F.when(tot > 0, F.rint(w["negative"] / tot * 100)).otherwise(w["negative"])
    u = F.when(tot > 0, 100 - p - ng).otherwise(w["neutral"])
    single = F.col("n_batches") == 1
    merged = agg.select(
        *scope, "n_batches",
        F.when(single, F.col("_best.positive")).otherwise(p).alias("positive"),
        F.when(single, F.col("_best.negative")).otherwise(ng).alias("negative"),
        F.when(single, F.col("_best.neutral")).otherwise(u).alias("neutral"),
        F.col("_best.summary").alias("summary"),
        F.when(~single, F.col("total_n")).alias("total_reviews_analyzed"),
        F.when(~single, F.col("n_batches")).alias("batches_processed"),
        F.when(single, F.col("total_n")).alias("single_batch_size"),
        F.col("_only.positive_highlights").alias("_pos_one"), F.col("_only.negative_highlights").alias("_neg_one"))

    items = []
    for k in ["positive_highlights", "negative_highlights"]:
        ex = (r.select(*scope, "batch_id", F.posexplode(F.when(good, F.col(k))).alias("pos", "item"))
              .withColumn("kind", F.lit(k)))
        items.append(ex)
    hl = _first_seen(items[0].unionByName(items[1]), scope, ["kind"], "item", MAX_HIGHLIGHTS, "items")
    hl_wide = hl.groupBy(*scope).pivot("kind", ["positive_highlights", "negative_highlights"]).agg(F.first("items"))
    empty = F.array().cast("array<string>")
    out = join_on(merged, hl_wide, scope, "left")
    return out.select(
        *scope, "positive", "negative", "neutral", "summary",
        F.when(F.col("n_batches") == 1, F.col("_pos_one"))
        .otherwise(F.coalesce(F.col("positive_highlights"), empty)).alias("positive_highlights"),
        F.when(F.col("n_batches") == 1, F.col("_neg_one"))
        .otherwise(F.coalesce(F.col("negative_highlights"), empty)).alias("negative_highlights"),
        "total_reviews_analyzed", "batches_processed", "single_batch_size")


def merge_topics(topics: DataFrame, batches: DataFrame, scope: Sequence[str] = ("scope",),
                 batch: str = "batch_id", size: str = "batch_size", denominator: str = "all") -> DataFrame:
    """Merge per-batch topic rows per (scope, topic).

    ``topics``: long rows (scope, batch, topic, sentiment, score, mentions, keywords,
    summary) of successful batches; ``batches``: every successful batch (scope, batch,
    size) - the weight denominator.  score = sum(score * n) over batches having the topic
    / sum(n) over all batches (``denominator="all"``, the reference's bias) or over the
    batches having it (``"present"``), rounded to 1 dp; mentions summed; sentiment by
    summed batch size with ties in order positive, negative, neutral; keywords first-seen
    distinct (first 4); summary of the largest batch having the topic.  Topics in no batch
    are omitted.  A scope with a single batch returns that batch's values unchanged.
    """
    scope = _cols(scope)
    t = topics.withColumnRenamed(batch, "batch_id").withColumnRenamed(size, "batch_size")
    b = batches.withColumnRenamed(batch, "batch_id").withColumnRenamed(size, "batch_size")
    totals = b.groupBy(*scope).agg(F.sum("batch_size").alias("total_n"), F.count(F.lit(1)).alias("n_batches"))
    tw = join_on(t, b.select(*scope, "batch_id", "batch_size"), [*scope, "batch_id"]) if "batch_size" not in t.columns \
        else t
    n = F.col("batch_size")
    score = F.coalesce(F.col("score"), F.lit(DEFAULT_TOPIC_SCORE))
    agg = tw.groupBy(*scope, "topic").agg(
        F.sum(score * n).alias("_ws"), F.sum(n).alias("_present_n"),
        F.sum(F.coalesce(F.col("mentions"), F.lit(0))).alias("mentions"),
        *[F.sum(F.when(F.col("sentiment") == s, n).otherwise(0)).alias(f"_s_{s}") for s in SENTIMENTS],
        F.max_by(F.col("summary"), F.struct(n, -F.col("batch_id"))).alias("summary"),
        F.min_by(F.struct(F.col("sentiment"), score.alias("score"), F.col("mentions"), F.col("keywords")),
                 F.col("batch_id")).alias("_one"))
    j = join_on(agg, totals, scope)
    den = F.col("total_n") if denominator == "all" else F.col("_present_n")
    sp, sn, su = (F.col(f"_s_{s}") for s in SENTIMENTS)
    dom = F.when((sp >= sn) & (sp >= su), "positive").when(sn >= su, "negative").otherwise("neutral")
    single = F.col("n_batches") == 1
    merged = j.select(
        *scope, "topic",
        F.when(single, F.col("_one.sentiment")).otherwise(dom).alias("sentiment"),
        F.when(single, F.col("_one.score")).otherwise(F.bround(F.col("_ws") / den, 1)).alias("score"),
        F.when(single, F.col("_one.mentions")).otherwise(F.col("mentions")).alias("mentions"),
        F.col("summary"), F.col("_one.keywords").alias("_kw_one"), "n_batches", "total_n")
    kw = _first_seen(tw.select(*scope, "topic", "batch_id", F.posexplode("keywords").alias("pos", "kw")),
                     scope, ["topic"], "kw", MAX_KEYWORDS, "keywords")
    out = join_on(merged, kw, [*scope, "topic"], "left")
    empty = F.array().cast("array<string>")
    order = F.array_position(F.array(*[F.lit(x) for x in TOPICS]), F.col("topic")).cast("int") - 1
    return out.select(
        *scope, "topic", order.alias("topic_ord"), "sentiment", "score", "mentions",
        F.when(single, F.col("_kw_one")).otherwise(F.coalesce("keywords", empty)).alias("keywords"),
        "summary",
        F.when(~single, F.col("total_n")).alias("total_reviews_analyzed"),
        F.when(~single, F.col("n_batches")).alias("batches_processed"))
