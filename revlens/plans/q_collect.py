"""Queries for search, selection and collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collect as C
from ..sources.fixtures import FX_BUSINESS_SQL, FX_REVIEWS_SQL, fx_business, fx_reviews, read_table, with_ctes
from ..sources.literal import literal_table
from .catalog import query

# bounded request list (user input), evaluated in one scan
REQUESTS = ["supplier#0000000", "#00000001", "IER#000000005", "%", "no such business", "  "]
REQ_SQL = "(VALUES " + ", ".join(f"('{r}')" for r in REQUESTS if r.strip()) + ") AS rq(request)"
TIER_SQL = ("CASE WHEN {n} >= 100 THEN 'High' WHEN {n} >= 50 THEN 'Medium' WHEN {n} >= 10 THEN 'Low' "
            "ELSE 'Very low' END")

MATCH_SQL = f"""matches AS (
  SELECT request, business_id, coalesce(name, '') AS name, coalesce(city, '') AS city,
         coalesce(state, '') AS state, coalesce(stars, 0.0) AS stars, coalesce(review_count, 0) AS review_count,
         coalesce(categories, '') AS categories, {TIER_SQL.format(n='coalesce(review_count, 0)')} AS reliability, seq
  FROM fx_business JOIN {REQ_SQL} ON contains(lower(coalesce(name, '')), lower(request)))"""


@query("search_businesses", with_ctes(FX_BUSINESS_SQL, MATCH_SQL, body="""
SELECT request, business_id, name, city, state, stars, review_count, categories, reliability FROM matches"""))
def q_search(spark, sf_dir):
    return C.search_businesses(fx_business(spark, sf_dir), REQUESTS).drop("seq")


@query("ranked_matches", with_ctes(FX_BUSINESS_SQL, MATCH_SQL, body="""
SELECT request, business_id, review_count,
       row_number() OVER (PARTITION BY request ORDER BY review_count DESC, seq) AS match_rank FROM matches"""))
def q_ranked(spark, sf_dir):
    m = C.rank_matches(C.search_businesses(fx_business(spark, sf_dir), REQUESTS))
    return m.select("request", "business_id", "review_count", "match_rank")


@query("search_in_city", with_ctes(FX_BUSINESS_SQL, MATCH_SQL, body="""
SELECT request, business_id, city FROM matches WHERE contains(lower(city), 'an')"""))
def q_search_city(spark, sf_dir):
    return C.search_businesses(fx_business(spark, sf_dir), REQUESTS, city="AN").select("request", "business_id", "city")


@query("resolved_requests", with_ctes(FX_BUSINESS_SQL, MATCH_SQL, body="""
SELECT request, business_id FROM matches WHERE request IN (
  SELECT request FROM matches GROUP BY request HAVING count(*) = 1)"""))
def q_resolved(spark, sf_dir):
    return C.resolve(C.search_businesses(fx_business(spark, sf_dir), REQUESTS)).select("request", "business_id")


# requests from a table: pieces of customer names (one to nine characters), nation names, and names nobody has
REQUEST_TABLE_SQL = f"""rq AS (
  SELECT DISTINCT request FROM (
    SELECT substr(c_name, 18 - CAST(c_custkey % 9 AS INTEGER)) AS request FROM customer
    UNION ALL SELECT n_name FROM nation UNION ALL SELECT ' ' UNION ALL SELECT 'SUPPLIER#0'))"""


@query("search_request_table", with_ctes(FX_BUSINESS_SQL, REQUEST_TABLE_SQL, body=f"""
SELECT request, business_id, coalesce(name, '') AS name, coalesce(review_count, 0) AS review_count,
       {TIER_SQL.format(n='coalesce(review_count, 0)')} AS reliability
FROM fx_business JOIN rq ON trim(request) <> '' AND contains(lower(coalesce(name, '')), lower(request))"""))
def q_request_table(spark, sf_dir):
    """B1 for a table of requests (one per customer and nation): gram look-up, then the literal test."""
    c, n = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    requests = c.select(F.expr("substr(c_name, 18 - cast(c_custkey % 9 as int))").alias("request")) \
        .unionByName(n.select(F.col("n_name").alias("request"))).unionByName(literal_table(spark, [(" ",), ("SUPPLIER#0",)], "request string"))
    return C.search_request_table(fx_business(spark, sf_dir), requests).select("request", "business_id", "name", "review_count", "reliability")


def _review_business(spark, sf_dir):
    """Businesses of the review fixture: one per document source."""
    r = fx_reviews(spark, sf_dir)
    return r.groupBy("business_id").agg(F.first("business_name").alias("name"))


@query("first_reviews_per_business", with_ctes(FX_REVIEWS_SQL, body="""
SELECT review_id, business_id, business_name FROM (
  SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY seq) AS rn FROM fx_reviews) WHERE rn <= 15"""))
def q_first_reviews(spark, sf_dir):
    out = C.reviews_of(fx_reviews(spark, sf_dir), _review_business(spark, sf_dir), limit=15)
    return out.select("review_id", "business_id", "business_name")


@query("load_metadata", with_ctes(FX_REVIEWS_SQL, body=f"""
SELECT business_id, count(*) AS review_count, {TIER_SQL.format(n='count(*)')} AS reliability,
       CASE WHEN count(*) >= 100 THEN printf('%d reviews - enough for an accurate analysis', count(*))
            WHEN count(*) >= 50 THEN printf('%d reviews - fairly reliable result', count(*))
            WHEN count(*) >= 10 THEN printf('only %d reviews - the result may not be representative', count(*))
            ELSE printf('only %d reviews - not enough for a reliable analysis', count(*)) END AS reliability_note
FROM fx_reviews GROUP BY business_id"""))
def q_load_metadata(spark, sf_dir):
    return C.load_metadata(fx_reviews(spark, sf_dir))


def _lang_sources(spark, sf_dir):
    r = fx_reviews(spark, sf_dir)
    return {"csv": r.filter(F.col("lang") == "de"), "yelp": r.filter(F.col("lang") == "en"),
            "google": r.filter(F.coalesce(~F.col("lang").isin("de", "en"), F.lit(True)))}


@query("source_fallback", with_ctes(FX_REVIEWS_SQL, body="""
, t AS (SELECT review_id, business_id, CASE lang WHEN 'de' THEN 'csv' WHEN 'en' THEN 'yelp' ELSE 'google' END AS source,
               CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 ELSE 3 END AS source_rank
        FROM fx_reviews)
SELECT review_id, business_id, source FROM t
WHERE source_rank = (SELECT min(source_rank) FROM t t2 WHERE t2.business_id = t.business_id)"""))
def q_source_fallback(spark, sf_dir):
    return C.source_fallback(_lang_sources(spark, sf_dir)).select("review_id", "business_id", "source")


def _overlap_sources(spark, sf_dir):
    r = fx_reviews(spark, sf_dir)
    return {"yelp": r.filter(F.col("useful") < 6), "google": r.filter(F.col("useful") >= 3)}


COMBINE_SQL = """t AS (
  SELECT *, 'yelp' AS source, 2 AS r FROM fx_reviews WHERE useful < 6
  UNION ALL SELECT *, 'google' AS source, 3 AS r FROM fx_reviews WHERE useful >= 3)"""


@query("combine_sources", with_ctes(FX_REVIEWS_SQL, COMBINE_SQL, body="""
SELECT review_id, business_id, source FROM (
  SELECT *, row_number() OVER (PARTITION BY business_id, text ORDER BY r, seq) AS rn FROM t) WHERE rn = 1"""))
def q_combine(spark, sf_dir):
    kept, _ = C.combine_sources(_overlap_sources(spark, sf_dir))
    return kept.select("review_id", "business_id", "source")


@query("sources_used", with_ctes(FX_REVIEWS_SQL, COMBINE_SQL, body="""
SELECT business_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources_used
FROM t GROUP BY business_id"""))
def q_sources_used(spark, sf_dir):
    _, used = C.combine_sources(_overlap_sources(spark, sf_dir))
    return used.select("business_id", F.array_join("sources_used", ",").alias("sources_used"))
