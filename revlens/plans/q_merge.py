"""Queries for batch split and merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as G
from ..sources.fixtures import (FX_BATCH_RESULTS_SQL, FX_REVIEWS_SQL, FX_TOPIC_RESULTS_SQL, fx_batch_results,
                                fx_reviews, fx_topic_results, with_ctes)
from .catalog import query


@query("split_batches", with_ctes(FX_REVIEWS_SQL, body="""
, b AS (SELECT review_id, business_id,
               CAST(floor((row_number() OVER (PARTITION BY business_id ORDER BY seq) - 1) / 20) AS BIGINT) AS batch_id
        FROM fx_reviews)
SELECT review_id, business_id, batch_id, count(*) OVER (PARTITION BY business_id, batch_id) AS batch_size FROM b"""))
def q_split_batches(spark, sf_dir):
    """G1 with batches of 20 (the reference uses 100; the documents fixture has 50 reviews
    per business)."""
    b = G.split_batches(fx_reviews(spark, sf_dir), ["business_id"], "seq", batch_size=20)
    return b.select("review_id", "business_id", "batch_id", "batch_size")


def _first_seen_sql(src: str, col: str, n: int, group: str = "scope") -> str:
    return f"""(SELECT {group}, string_agg(item, '|' ORDER BY rn) AS {col} FROM (
      SELECT {group}, item, row_number() OVER (PARTITION BY {group} ORDER BY b, p) AS rn FROM (
        SELECT {group}, item, min(batch_id * 100000 + p) AS b, 0 AS p FROM (
          SELECT {group}, batch_id, unnest({col}) AS item, unnest(generate_series(1, len({col}))) AS p FROM {src})
        GROUP BY ALL)) WHERE rn <= {n} GROUP BY {group})"""


MERGE_SENT_SQL = with_ctes(FX_BATCH_RESULTS_SQL, body=f"""
, r AS (SELECT * FROM fx_batch_results WHERE ok),
a AS (SELECT scope, count(*) AS nb, sum(batch_size) AS tn,
             sum(positive * batch_size) / sum(batch_size) AS wp, sum(negative * batch_size) / sum(batch_size) AS wn,
             sum(neutral * batch_size) / sum(batch_size) AS wu,
             arg_max(summary, batch_size * 1000000000 - batch_id) AS summary,
             arg_min(positive, batch_id) AS p1, arg_min(negative, batch_id) AS n1, arg_min(neutral, batch_id) AS u1,
             array_to_string(arg_min(positive_highlights, batch_id), '|') AS ph1,
             array_to_string(arg_min(negative_highlights, batch_id), '|') AS nh1
      FROM r GROUP BY scope),
m AS (SELECT *, wp + wn + wu AS tot FROM a),
m2 AS (SELECT *, CASE WHEN tot > 0 THEN round_even(wp / tot * 100, 0) ELSE wp END AS p,
              CASE WHEN tot > 0 THEN round_even(wn / tot * 100, 0) ELSE wn END AS n FROM m)
SELECT m2.scope,
       CASE WHEN nb = 1 THEN p1 ELSE p END AS positive, CASE WHEN nb = 1 THEN n1 ELSE n END AS negative,
       CASE WHEN nb = 1 THEN u1 WHEN tot > 0 THEN 100 - p - n ELSE wu END AS neutral, summary,
       CASE WHEN nb = 1 THEN ph1 ELSE coalesce(ph.positive_highlights, '') END AS positive_highlights,
       CASE WHEN nb = 1 THEN nh1 ELSE coalesce(nh.negative_highlights, '') END AS negative_highlights,
       CAST(CASE WHEN nb > 1 THEN tn END AS DOUBLE) AS total_reviews_analyzed,
       CAST(CASE WHEN nb > 1 THEN nb END AS DOUBLE) AS batches_processed,
       CAST(CASE WHEN nb = 1 THEN tn END AS DOUBLE) AS single_batch_size
FROM m2 LEFT JOIN {_first_seen_sql('r', 'positive_highlights', 5)} ph USING (scope)
        LEFT JOIN {_first_seen_sql('r', 'negative_highlights', 5)} nh USING (scope)""")


@query("merge_sentiment", MERGE_SENT_SQL)
def q_merge_sentiment(spark, sf_dir):
    m = G.merge_sentiment(fx_batch_results(spark, sf_dir), scope=["scope"])
    return m.select("scope", "positive", "negative", "neutral", "summary",
                    F.array_join("positive_highlights", "|").alias("positive_highlights"),
                    F.array_join("negative_highlights", "|").alias("negative_highlights"),
                    *[F.col(c).cast("double").alias(c) for c in
                      ["total_reviews_analyzed", "batches_processed", "single_batch_size"]])


def _merge_topics_sql(denominator: str) -> str:
    den = "t.tn" if denominator == "all" else "a.pn"
    return with_ctes(FX_BATCH_RESULTS_SQL, FX_TOPIC_RESULTS_SQL, body=f"""
, t AS (SELECT scope, sum(batch_size) AS tn, count(*) AS nb FROM fx_batch_results WHERE ok GROUP BY scope),
a AS (SELECT scope, topic, sum(score * batch_size) AS ws, sum(batch_size) AS pn, sum(mentions) AS mentions,
             sum(CASE WHEN sentiment = 'positive' THEN batch_size ELSE 0 END) AS sp,
             sum(CASE WHEN sentiment = 'negative' THEN batch_size ELSE 0 END) AS sn,
             sum(CASE WHEN sentiment = 'neutral' THEN batch_size ELSE 0 END) AS su,
             arg_max(summary, batch_size * 1000000000 - batch_id) AS summary,
             arg_min(sentiment, batch_id) AS s1, arg_min(score, batch_id) AS score1,
             arg_min(mentions, batch_id) AS m1, array_to_string(arg_min(keywords, batch_id), '|') AS k1
      FROM fx_topic_results GROUP BY scope, topic),
kw AS (SELECT scope, topic, string_agg(item, '|' ORDER BY rn) AS keywords FROM (
        SELECT scope, topic, item, row_number() OVER (PARTITION BY scope, topic ORDER BY b, p) AS rn FROM (
          SELECT scope, topic, item, min(batch_id * 100000 + p) AS b, 0 AS p FROM (
            SELECT scope, topic, batch_id, unnest(keywords) AS item, unnest(generate_series(1, len(keywords))) AS p
            FROM fx_topic_results) GROUP BY ALL)) WHERE rn <= 4 GROUP BY scope, topic)
SELECT a.scope, a.topic,
       CASE WHEN nb = 1 THEN s1 WHEN sp >= sn AND sp >= su THEN 'positive' WHEN sn >= su THEN 'negative'
            ELSE 'neutral' END AS sentiment,
       CASE WHEN nb = 1 THEN score1 ELSE round_even(ws / {den}, 1) END AS score,
       CAST(CASE WHEN nb = 1 THEN m1 ELSE mentions END AS BIGINT) AS mentions,
       CASE WHEN nb = 1 THEN k1 ELSE coalesce(kw.keywords, '') END AS keywords, summary,
       CAST(CASE WHEN nb > 1 THEN tn END AS DOUBLE) AS total_reviews_analyzed,
       CAST(CASE WHEN nb > 1 THEN nb END AS DOUBLE) AS batches_processed
FROM a JOIN t USING (scope) LEFT JOIN kw USING (scope, topic)""")


def _merged_topics(spark, sf_dir, denominator):
    br = fx_batch_results(spark, sf_dir).filter("ok").select("scope", "batch_id", "batch_size")
    m = G.merge_topics(fx_topic_results(spark, sf_dir), br, scope=["scope"], denominator=denominator)
    return m.select("scope", "topic", "sentiment", "score", "mentions",
                    F.array_join("keywords", "|").alias("keywords"), "summary",
                    F.col("total_reviews_analyzed").cast("double").alias("total_reviews_analyzed"),
                    F.col("batches_processed").cast("double").alias("batches_processed"))


@query("merge_topics", _merge_topics_sql("all"))
def q_merge_topics(spark, sf_dir):
    """G6-G11 with the reference's denominator (all batches)."""
    return _merged_topics(spark, sf_dir, "all")


@query("merge_topics_present", _merge_topics_sql("present"))
def q_merge_topics_present(spark, sf_dir):
    """G6 option: weights over the batches that mention the topic."""
    return _merged_topics(spark, sf_dir, "present")
