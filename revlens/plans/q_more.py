"""Queries for paths that the other modules leave out: absent columns, broad requests, text dates,
file headers and encodings, default topics, every failing stage, the report's metadata."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import collect as C
from ..operators import merge as G
from ..operators import profile as P
from ..operators import report as H
from ..operators import sentiment as S
from ..operators import validate as V
from ..operators.modelio import TOPIC_QUERIES, TOPICS
from ..sources import readers as R
from ..sources.fixtures import (FX_BATCH_RESULTS_SQL, FX_BUSINESS_SQL, FX_REVIEWS_SQL, fx_batch_results, fx_business, fx_reviews,
                                fx_topic_results, read_table, with_ctes)
from .catalog import query
from .q_report import REPORT_SQL
from .q_sources import NA_SQL, _scratch
from .q_validate import strip_sql


@query("defaulted_review_ids", with_ctes(FX_REVIEWS_SQL, body="""
SELECT seq, 'r_' || (row_number() OVER (ORDER BY seq) - 1) AS review_id, 3 AS stars, 'Unknown' AS business_name FROM fx_reviews"""))
def q_defaulted_ids(spark, sf_dir):
    """A frame of texts alone gets ids by position and default stars and names."""
    return V.ensure_columns(fx_reviews(spark, sf_dir).select("seq", "text")).select("seq", "review_id", "stars", "business_name")


@query("broad_ranked_matches", with_ctes(FX_BUSINESS_SQL, body="""
SELECT request, business_id, row_number() OVER (PARTITION BY request ORDER BY review_count DESC, seq) AS match_rank
FROM fx_business, (VALUES ('supplier'), ('#')) AS rq(request) WHERE contains(lower(name), request)"""))
def q_broad_ranked(spark, sf_dir):
    """B3 for requests that match every business."""
    return C.rank_matches(C.search_businesses(fx_business(spark, sf_dir), ["supplier", "#"])).select("request", "business_id", "match_rank")


@query("search_in_matching_city", with_ctes(FX_BUSINESS_SQL, body="""
SELECT business_id, city FROM fx_business WHERE contains(lower(name), 'supplier') AND contains(lower(city), 'ation_1')"""))
def q_search_matching_city(spark, sf_dir):
    """B4 with a city that occurs."""
    return C.search_businesses(fx_business(spark, sf_dir), "Supplier", city="ATION_1").select("business_id", "city")


@query("blank_requests", """
SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 < 2""")
def q_blank_requests(spark, sf_dir):
    """Requests without a name (here every seventh is missing, every seventh blank)."""
    k = F.col("c_custkey") % 7
    req = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(k == 0, F.lit(None)).when(
        k == 1, F.lit(" \t")).otherwise(F.col("c_name")).alias("request"))
    return C.blank_request_rows(req).select("k")


@query("first_profile_rows", with_ctes(FX_REVIEWS_SQL, body="""
SELECT review_id, stars FROM fx_reviews ORDER BY seq LIMIT 500"""))
def q_first_rows(spark, sf_dir):
    """A10: the documented prefix option of the profile."""
    return P.first_rows(fx_reviews(spark, sf_dir), 500).select("review_id", "stars")


@query("orders_per_text_year", """
SELECT CASE WHEN o_orderkey % 100 <> 0 THEN year(o_orderdate) END AS year, count(*) AS n FROM orders GROUP BY 1""")
def q_text_years(spark, sf_dir):
    """Years of dates given as text; what is no date has no year."""
    text = F.when(F.col("o_orderkey") % 100 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return P.per_year(read_table(spark, sf_dir, "orders").select(text.alias("date")), "date")


@query("dated_review_summary", with_ctes(FX_REVIEWS_SQL, body="""
SELECT count(*) AS n_reviews, 2004 + min(seq % 17) AS min_year, 2004 + max(seq % 17) AS max_year FROM fx_reviews"""))
def q_dated_summary(spark, sf_dir):
    """I10 with dates: the range of years."""
    date = F.concat((F.lit(2004) + F.col("seq") % 17).cast("string"), F.lit("-03-09 10:00:00"))
    return P.review_summary(fx_reviews(spark, sf_dir).withColumn("date", date)).select("n_reviews", "min_year", "max_year")


@query("mixed_csv_files", with_ctes(FX_REVIEWS_SQL, body=f"""
SELECT md5(text) AS text_md5, stars, CASE WHEN seq % 2 = 0 THEN business_name ELSE 'Unknown' END AS business_name FROM fx_reviews
WHERE text IS NOT NULL AND text NOT IN ({NA_SQL}) AND {strip_sql('text')} <> '' AND stars BETWEEN 1 AND 5"""))
def q_mixed_csv(spark, sf_dir):
    """A1, A3: one folder with files of two column orders, one of them without business_name."""
    path = _scratch(spark, "csvmixed")
    r = fx_reviews(spark, sf_dir).select("seq", "business_name", F.col("stars").cast("string").alias("stars"), "text")
    R.write_csv(r.filter("seq % 2 = 0").select("business_name", "text", "stars"), os.path.join(path, "a"))
    R.write_csv(r.filter("seq % 2 = 1").select("stars", "text"), os.path.join(path, "b"))
    out = R.load_review_csv(spark, [os.path.join(path, x, "*.csv") for x in "ab"])
    return out.select(F.md5("text").alias("text_md5"), "stars", "business_name")


TOPIC_ROWS = ", ".join(f"('{t}', '{w}')" for t in TOPICS for w in dict.fromkeys(TOPIC_QUERIES[t].split()))
_WORDS = ["food", "waiter", "expensive", "noise", "parking"]


@query("default_topic_mentions", f"""
WITH r AS (SELECT c_nationkey AS business_id, c_custkey AS review_id, (c_custkey % 5 + 1)::DOUBLE AS stars,
                  ['the', ['{"', '".join(_WORDS)}'][c_custkey % 5 + 1], 'was', ['{"', '".join(_WORDS)}'][c_custkey % 3 + 1]] AS w FROM customer),
lex(topic, word) AS (VALUES {TOPIC_ROWS}),
h AS (SELECT DISTINCT business_id, topic, review_id, stars FROM r JOIN lex ON list_contains(w, word))
SELECT business_id, topic, count(*) AS mentions, round_even(avg(stars), 1) AS score FROM h GROUP BY ALL""")
def q_default_topics(spark, sf_dir):
    """D4 / E11 with the default topic words."""
    k, words = F.col("c_custkey"), F.array(*[F.lit(w) for w in _WORDS])
    pick = lambda n: F.get(words, (k % n).cast("int"))
    r = read_table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("business_id"), k.alias("review_id"), (k % 5 + 1).cast("double").alias("stars"),
        F.concat_ws(" ", F.lit("the"), pick(5), F.lit("was"), pick(3)).alias("text"))
    return S.topic_stats(r, S.lexicon_table(spark)).select("business_id", "topic", "mentions", "score")


@query("report_failures", """
SELECT c_custkey AS scope, ['no_reviews', 'no_valid_reviews', 'sentiment_failed', 'topic_failed', 'report_failed'][c_custkey % 6 + 1] AS error
FROM customer WHERE c_custkey % 6 < 5""")
def q_report_failures(spark, sf_dir):
    """H7: every stage at which a request can fail."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope"))
    upto = [c.filter(F.col("scope") % 6 > i) for i in range(5)]
    return H.error_rows(c, *upto, scope=["scope"])


@query("report_metadata", REPORT_SQL + f""",
st2 AS (WITH {FX_BATCH_RESULTS_SQL} SELECT scope, count(*) AS total_before, count(*) FILTER (WHERE ok) AS total_after FROM fx_batch_results GROUP BY scope)
SELECT ms.scope, overall_score, total_before, total_after, total_before - total_after AS removed, positive, 'reviews' AS data_source, true AS use_rag,
       (SELECT count(*) FROM t WHERE t.scope = ms.scope) AS n_topics
FROM ms JOIN ov USING (scope) JOIN st2 USING (scope)""")
def q_report_metadata(spark, sf_dir):
    """H6: the envelope over the validation statistics (C15) of what the batches held."""
    res = fx_batch_results(spark, sf_dir)
    sent = G.merge_sentiment(res, scope=["scope"])
    top = G.merge_topics(fx_topic_results(spark, sf_dir), res.filter("ok").select("scope", "batch_id", "batch_size"), scope=["scope"])
    rows = res.select("scope", "ok", (F.col("positive") / 25 + 1).alias("stars"), F.col("summary").alias("text"))
    stats = V.validation_stats(rows, rows.filter("ok"), ["scope"])
    env = H.envelope(H.build_report(sent, top, H.action_catalogue(spark), scope=["scope"]), stats, sent, top, scope=["scope"])
    return env.select("scope", "overall_score", *[F.col(f"metadata.validation_stats.{c}").alias(c) for c in ("total_before", "total_after", "removed")],
                      "positive", F.col("metadata.data_source").alias("data_source"), F.col("metadata.use_rag").alias("use_rag"),
                      F.size("metadata.topic_detail").cast("long").alias("n_topics"))
