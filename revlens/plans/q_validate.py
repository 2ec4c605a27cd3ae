"""Queries for validation and cleaning (C1-C17) on the review fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validate as V
from ..sources.fixtures import FX_REVIEWS_SQL, fx_reviews, with_ctes
from .catalog import query

# --- DuckDB building blocks (RE2 regex syntax; same classes as revlens.functions.text) ---
WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\p{Z}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def spam_sql(c: str) -> str:
    return (f"(regexp_matches({c}, '^[^\\p{{L}}\\p{{Nl}}\\p{{No}}_]+$') "
            f"OR (length({c}) >= 5 AND {c} = repeat(substr({c}, 1, 1), length({c}))) "
            f"OR length(regexp_replace({c}, '[^a-zA-Z\\x{{00C0}}-\\x{{1EF9}}]', '', 'g')) < 5)")

TAGGED_SQL = f"""tagged AS (
  SELECT *, CASE WHEN text IS NULL OR t0 IN ('', 'nan') THEN 'text'
                 WHEN length(t0) < 10 THEN 'short'
                 WHEN stars IS NULL OR NOT (stars BETWEEN 1 AND 5) THEN 'stars' END AS reason,
         substr(t0, 1, 5000) AS tt, round_even(stars * 2, 0) / 2 AS st, length(t0) AS len_raw
  FROM (SELECT *, {strip_sql('text')} AS t0 FROM fx_reviews)),
firsts AS (
  SELECT business_id, tt, min(seq) AS first_seq, count(*) AS copies
  FROM tagged WHERE reason IS NULL GROUP BY business_id, tt),
kept AS (
  SELECT t.*, f.copies, {spam_sql('t.tt')} AS spam
  FROM tagged t JOIN firsts f ON t.business_id = f.business_id AND t.seq = f.first_seq),
clean AS (SELECT seq, review_id, business_id, business_name, st AS stars, tt AS text, useful, lang
          FROM kept WHERE NOT spam)"""


@query("validate_reviews", with_ctes(FX_REVIEWS_SQL, TAGGED_SQL, body="""
SELECT review_id, business_id, business_name, stars, text, useful FROM clean"""))
def q_validate_reviews(spark, sf_dir):
    clean = V.validate_reviews(fx_reviews(spark, sf_dir), scope=["business_id"])
    return clean.select("review_id", "business_id", "business_name", "stars", "text", "useful")


@query("validation_stats", with_ctes(FX_REVIEWS_SQL, TAGGED_SQL, body="""
SELECT b.business_id, b.total_before, coalesce(a.total_after, 0) AS total_after,
       b.total_before - coalesce(a.total_after, 0) AS removed,
       coalesce(a.total_after, 0) * CAST(100 AS DOUBLE) / b.total_before AS kept_ratio,
       b.avg_stars_before, a.avg_stars_after, coalesce(a.avg_text_length, CAST(0 AS DOUBLE)) AS avg_text_length
FROM (SELECT business_id, count(*) AS total_before, avg(stars) AS avg_stars_before
      FROM fx_reviews GROUP BY business_id) b
FULL OUTER JOIN (SELECT business_id, count(*) AS total_after, avg(stars) AS avg_stars_after,
                        avg(CAST(length(text) AS DOUBLE)) AS avg_text_length
                 FROM clean GROUP BY business_id) a USING (business_id)"""))
def q_validation_stats(spark, sf_dir):
    raw = fx_reviews(spark, sf_dir)
    clean = V.validate_reviews(raw, scope=["business_id"])
    return V.validation_stats(raw, clean, scope=["business_id"])


@query("reject_counts", with_ctes(FX_REVIEWS_SQL, TAGGED_SQL, body="""
SELECT * FROM (
  SELECT business_id, reason AS step, count(*) AS removed FROM tagged WHERE reason IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT business_id, 'truncated', count(*) FROM tagged
  WHERE (reason IS NULL OR reason <> 'text') AND len_raw > 5000 GROUP BY ALL
  UNION ALL
  SELECT business_id, 'duplicate', CAST(sum(copies - 1) AS BIGINT) FROM kept GROUP BY ALL
  UNION ALL
  SELECT business_id, 'spam', count(*) FILTER (WHERE spam) FROM kept GROUP BY ALL)
WHERE removed > 0"""))
def q_reject_counts(spark, sf_dir):
    return V.reject_counts(fx_reviews(spark, sf_dir), scope=["business_id"])


@query("reindex_clean", with_ctes(FX_REVIEWS_SQL, TAGGED_SQL, body="""
SELECT review_id, business_id, row_number() OVER (PARTITION BY business_id ORDER BY seq) - 1 AS idx
FROM clean"""))
def q_reindex(spark, sf_dir):
    clean = V.validate_reviews(fx_reviews(spark, sf_dir), scope=["business_id"])
    return V.reindex(clean, scope=["business_id"], order="seq").select("review_id", "business_id", "idx")


@query("validate_global_scope", with_ctes(FX_REVIEWS_SQL, body=f"""
, t AS (SELECT *, {strip_sql('text')} AS t0 FROM fx_reviews),
r AS (SELECT *, substr(t0, 1, 5000) AS tt FROM t
      WHERE text IS NOT NULL AND t0 NOT IN ('', 'nan') AND length(t0) >= 10 AND stars BETWEEN 1 AND 5),
f AS (SELECT tt, min(seq) AS seq FROM r GROUP BY tt)
SELECT r.review_id, r.tt AS text FROM r JOIN f USING (seq) WHERE NOT {spam_sql('r.tt')}"""))
def q_validate_global(spark, sf_dir):
    """Dedup over the whole frame (one uploaded file): the same text in two businesses
    counts as a duplicate."""
    clean = V.validate_reviews(fx_reviews(spark, sf_dir), scope=[])
    return clean.select("review_id", "text")


@query("near_duplicates")
def q_near_duplicates(spark, sf_dir):
    """C17: optional near-copy finder (approximate candidate stage -> rows-only check)."""
    clean = V.validate_reviews(fx_reviews(spark, sf_dir), scope=["business_id"])
    return V.near_duplicates(clean, scope=["business_id"]).select(
        "business_id", "seq", "earlier_seq", F.round("jaccard", 6).alias("jaccard"))
