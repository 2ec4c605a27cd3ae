"""End-to-end plans: the whole analysis for every business in one job.

``analyze_all`` is the grouped equivalent of the reference's per-request
``run_analysis``: collect -> validate -> retrieve -> score -> report, keyed by business.
A single-business request is the same plan with a pushed-down ``business_id`` filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collect as B
from ..operators import report as H
from ..operators import retrieve as D
from ..operators import sentiment as S
from ..operators import validate as V
from ..operators.joins import join_on
from ..operators.lineage import materialize, write_table
from ..operators.profile import stars_to_label
from ..sources.fixtures import fx_reviews


def business_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: per business, validation statistics (C15, presented with the reference's
    rounding), reliability tier of the loaded reviews (B2/B8) and sentiment shares of the
    clean reviews (E9)."""
    raw = fx_reviews(spark, sf_dir)
    clean = V.validate_reviews(raw, scope=["business_id"])
    stats = V.present_validation_stats(V.validation_stats(raw, clean, scope=["business_id"]))
    meta = B.load_metadata(raw).select("business_id", "reliability")
    pct = S.sentiment_percentages(clean.withColumn("label", stars_to_label("stars")), ["business_id"]) \
        .drop("n_reviews")
    return stats.join(meta, "business_id", "left").join(pct, "business_id", "left")


def analyze_all(spark: SparkSession, reviews: DataFrame, topics: dict[str, str] | None = None,
                use_rag: bool = True, top_k: int = D.MANAGER_TOP_K, scope: str = "business_id") -> dict[str, DataFrame]:
    """The whole analysis for every business.  Returns the marts:

    ``clean``, ``stats`` (C), ``retrieval`` (D), ``sentiment`` (E9 + E10 highlights),
    ``topics`` (E11 on the retrieval set, or all reviews when retrieval is off / empty),
    ``report`` (H1-H4), ``envelope`` (H6), ``errors`` (H7), ``charts`` (H8).
    Sentiment sees every clean review, topics the retrieval union only (as the
    reference's manager does).
    """
    sc = [scope]
    # the clean table feeds every mart: write it once to the shared checkpoint folder
    # (reliable checkpoint, cuts the lineage; a lost executor re-reads instead of re-validating)
    # dealt out by count: coalesced to a few large partitions, each task's bigram counts outgrow its memory
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    clean = materialize(V.validate_reviews(reviews, scope=sc).repartition(parts, "seq"))
    stats = V.validation_stats(reviews, clean, scope=sc)
    labelled = clean.withColumn("label", stars_to_label("stars"))

    qtab = D.topic_query_table(spark, topics)
    if use_rag:
        hits = D.tfidf_topk(clean, qtab, k=top_k, scope=sc)
        # a few rows per business, of known size: no text is shuffled to meet them
        hits = write_table(hits.filter(F.col("score") > 0), "topic-hits")
        sel = hits.select(scope, "review_id").distinct()
        found = write_table(join_on(labelled, sel, [scope, "review_id"], "left_semi"), "topic-reviews")
        topic_input = D.with_fallback(found, labelled, sc)
    else:
        hits = None
        topic_input = labelled.withColumn("source", F.lit("all_reviews"))

    pct = S.sentiment_percentages(labelled, sc)
    hl = S.highlight_phrases(labelled, sc)
    hl_lists = (hl.groupBy(scope).pivot("label", ["positive", "negative"])
                .agg(F.array_sort(F.collect_list(F.struct("rank", "phrase"))).alias("l")))
    # pivot output columns 'positive'/'negative' collide with the percentages: rename first
    lists = hl_lists.withColumnRenamed("positive", "_pos_l").withColumnRenamed("negative", "_neg_l")
    sentiment = pct.join(lists, scope, "left").select(
        scope, "positive", "negative", "neutral", F.col("n_reviews").alias("total_reviews_analyzed"),
        F.coalesce(F.transform("_pos_l", lambda x: x["phrase"]), F.array().cast("array<string>"))
        .alias("positive_highlights"),
        F.coalesce(F.transform("_neg_l", lambda x: x["phrase"]), F.array().cast("array<string>"))
        .alias("negative_highlights"))

    # report, envelope, errors and charts all read the two marts: a few rows per business, written once
    sentiment = materialize(sentiment)
    lex = S.lexicon_table(spark, topics)
    topic_mart = materialize(S.topic_stats(topic_input, lex, sc))
    report = H.build_report(sentiment, topic_mart, H.action_catalogue(spark), scope=sc)
    env = H.envelope(report, stats, sentiment, topic_mart, scope=sc, use_rag=use_rag)
    errors = H.error_rows(reviews.select(scope), reviews, clean, sentiment, topic_mart, report, scope=sc)
    charts = H.chart_data(sentiment, topic_mart, scope=sc)
    return {"clean": clean, "stats": stats, "retrieval": hits, "sentiment": sentiment, "topics": topic_mart,
            "report": report, "envelope": env, "errors": errors, "charts": charts}
