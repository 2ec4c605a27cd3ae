"""Report marts per business (inventory H1-H8).

The reference's report is free text from a model; the data parts of it are re-aimed as
deterministic aggregates over the merged sentiment and topic marts: overall score,
strengths / weaknesses, recommendations from an action catalogue, the metadata envelope,
the error row naming the first failing stage, and the chart data the UI draws.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .modelio import SENTIMENTS, TOPICS
from .joins import join_on
from .ordering import _cols
from ..sources.literal import literal_table

# --- fixed values -------------------------------------------------------------------
MAX_STRENGTHS = 3
MAX_WEAKNESSES = 3
MAX_RECOMMENDATIONS = 4
# default action catalogue: (topic, max_score, priority, action)
ACTION_CATALOGUE = [
    ("food_quality", 3.5, 1, "Review recipes, portion sizes and ingredient freshness"),
    ("service", 3.5, 1, "Train staff on speed and courtesy at peak hours"),
    ("price", 3.5, 2, "Revisit pricing and add value offers"),
    ("ambiance", 3.5, 2, "Improve cleanliness, noise level and decor"),
    ("food_quality", 2.5, 0, "Audit the kitchen and the menu items that draw complaints"),
    ("service", 2.5, 0, "Add staff or simplify ordering to cut waiting times"),
]
ERROR_STAGES = ["no_reviews", "no_valid_reviews", "sentiment_failed", "topic_failed", "report_failed"]
# ------------------------------------------------------------------------------------


def action_catalogue(spark, rows=ACTION_CATALOGUE) -> DataFrame:
    return literal_table(spark, rows, "topic string, max_score double, priority int, action string")


def _first_names(items, keep, order, n: int, name: str):
    """Names of the first ``n`` of an array of structs that pass ``keep``, by the fields of ``order``."""
    ranked = F.array_sort(F.transform(F.filter(items, keep), lambda x: F.struct(*order(x), x[name].alias("name"))))
    return F.slice(F.transform(ranked, lambda x: x["name"]), 1, n)


def build_report(sentiment: DataFrame, topics: DataFrame, catalogue: DataFrame,
                 scope: Sequence[str] = ("business_id",)) -> DataFrame:
    """H1-H5: one report row per scope having both a sentiment and a topic result (H4).

    * overall_score: mean topic score over topics with mentions > 0, 1 dp (half-even);
    * strengths: up to 3 positive topics by score desc; weaknesses: up to 3 negative
      topics by score asc (ties in topic order);
    * recommendations: up to 4 catalogue actions whose topic scored at most
      ``max_score``, by priority, then score, then topic order; priority_action = first.
    Checker keys are not part of the report (H5).

    The topics of a scope are gathered once into an array (one row per topic); the catalogue
    is grouped by topic and joined plainly, so its size decides how it is joined."""
    scope = _cols(scope)
    order = F.array_position(F.array(*[F.lit(x) for x in TOPICS]), F.col("topic")).alias("topic_ord")
    actions = catalogue.groupBy("topic").agg(F.collect_list(F.struct("max_score", "priority", "action")).alias("actions"))
    t = topics.select(*scope, "topic", "sentiment", "score", "mentions", order).join(actions, "topic", "left")
    g = t.groupBy(*scope).agg(
        # 12 decimals first: whether a mean ends in a 5 must not depend on the order in which the scores are added
        F.bround(F.round(F.avg(F.when(F.col("mentions") > 0, F.col("score"))), 12), 1).alias("overall_score"),
        F.collect_list(F.struct("topic", "sentiment", "score", "topic_ord", "actions")).alias("_t"))
    advice = F.flatten(F.transform("_t", lambda x: F.transform(
        F.filter(F.coalesce(x["actions"], F.array().cast("array<struct<max_score:double,priority:int,action:string>>")),
                 lambda a: x["score"] <= a["max_score"]),
        lambda a: F.struct(a["priority"].alias("priority"), x["score"].alias("score"), x["topic_ord"].alias("topic_ord"),
                           a["action"].alias("action")))))
    g = g.select(
        *scope, "overall_score",
        _first_names("_t", lambda x: x["sentiment"] == "positive", lambda x: [-x["score"], x["topic_ord"]],
                     MAX_STRENGTHS, "topic").alias("strengths"),
        _first_names("_t", lambda x: x["sentiment"] == "negative", lambda x: [x["score"], x["topic_ord"]],
                     MAX_WEAKNESSES, "topic").alias("weaknesses"),
        F.slice(F.transform(F.array_sort(advice), lambda x: x["action"]), 1, MAX_RECOMMENDATIONS).alias("recommendations"))
    s = sentiment.select(*scope, *SENTIMENTS)
    return join_on(s, g, scope).select(                      # H4: both parts required
        *scope, "overall_score", *SENTIMENTS, "strengths", "weaknesses", "recommendations",
        F.try_element_at("recommendations", F.lit(1)).alias("priority_action"))


def envelope(report: DataFrame, stats: DataFrame, sentiment: DataFrame, topics: DataFrame,
             scope: Sequence[str] = ("business_id",), data_source: str = "reviews", use_rag: bool = True) -> DataFrame:
    """H6: report + metadata struct (data source, retrieval flag, validation stats,
    sentiment and topic detail incl. checker messages).  Wall-clock fields are left out
    (not comparable between runs)."""
    scope = _cols(scope)
    st = stats.select(*scope, F.struct(*[c for c in stats.columns if c not in scope]).alias("validation_stats"))
    sd = sentiment.select(*scope, F.struct(*[c for c in sentiment.columns if c not in scope]).alias("sentiment_detail"))
    td = topics.groupBy(*scope).agg(F.array_sort(F.collect_list(
        F.struct(*["topic_ord", *[c for c in topics.columns if c not in scope and c != "topic_ord"]]))).alias("topic_detail"))
    j = join_on(join_on(join_on(report, st, scope, "left"), sd, scope, "left"), td, scope, "left")
    meta = F.struct(F.lit(data_source).alias("data_source"), F.lit(use_rag).alias("use_rag"),
                    "validation_stats", "sentiment_detail", "topic_detail")
    return j.select(*[c for c in report.columns], meta.alias("metadata"))


def error_rows(requested: DataFrame, raw_counts: DataFrame, clean_counts: DataFrame, sentiment: DataFrame,
               topics: DataFrame, report: DataFrame, scope: Sequence[str] = ("business_id",)) -> DataFrame:
    """H7: for each requested scope that has no report, the first stage that failed:
    no reviews, no valid review, sentiment, topic, report."""
    scope = _cols(scope)
    def flag(df, name):
        return df.select(*scope).distinct().withColumn(name, F.lit(True))
    j = requested.select(*scope).distinct()
    for df, name in [(raw_counts, "_raw"), (clean_counts, "_clean"), (sentiment, "_sent"), (topics, "_top"),
                     (report, "_rep")]:
        j = join_on(j, flag(df, name), scope, "left")
    reason = (F.when(F.col("_raw").isNull(), "no_reviews").when(F.col("_clean").isNull(), "no_valid_reviews")
              .when(F.col("_sent").isNull(), "sentiment_failed").when(F.col("_top").isNull(), "topic_failed")
              .when(F.col("_rep").isNull(), "report_failed"))
    return j.select(*scope, reason.alias("error")).filter(F.col("error").isNotNull())


def chart_data(sentiment: DataFrame, topics: DataFrame, scope: Sequence[str] = ("business_id",)) -> DataFrame:
    """H8: long-form chart table: 3 sentiment slices, 4 topic scores, 4 topic mention
    counts per scope; a missing value is 0."""
    scope = _cols(scope)
    s = sentiment.select(*scope, F.explode(F.array(*[
        F.struct(F.lit("sentiment").alias("chart"), F.lit(i).alias("ord"), F.lit(x).alias("item"),
                 F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("value"))
        for i, x in enumerate(SENTIMENTS)])).alias("r")).select(*scope, "r.*")
    keys = sentiment.select(*scope).distinct()
    grid = keys.withColumn("topic", F.explode(F.array(*[F.lit(x) for x in TOPICS])))
    tj = join_on(grid, topics.select(*scope, "topic", "score", "mentions"), [*scope, "topic"], "left")
    order = F.array_position(F.array(*[F.lit(x) for x in TOPICS]), F.col("topic")).cast("int") - 1
    t = tj.select(*scope, F.explode(F.array(
        F.struct(F.lit("topic_score").alias("chart"), order.alias("ord"), F.col("topic").alias("item"),
                 F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("value")),
        F.struct(F.lit("topic_mentions").alias("chart"), order.alias("ord"), F.col("topic").alias("item"),
                 F.coalesce(F.col("mentions").cast("double"), F.lit(0.0)).alias("value")))).alias("r")).select(*scope, "r.*")
    return s.unionByName(t)
