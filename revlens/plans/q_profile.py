"""Queries for profiling (I1-I23): businesses = fx_business, reviews = fx_reviews,
dated rows = orders (several years)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..sources.fixtures import (FX_BUSINESS_SQL, FX_REVIEWS_SQL, fx_business, fx_reviews, read_table,
                                with_ctes)
from .catalog import query
from .q_validate import WS, strip_sql


def _stop_words():
    from ..functions.text import spark_stop_words
    return sorted(set(spark_stop_words("english")))


def _label_sql(c="stars"):
    return f"CASE WHEN {c} >= 4 THEN 'positive' WHEN {c} <= 2 THEN 'negative' ELSE 'neutral' END"


D = "CAST(100 AS DOUBLE)"


@query("business_summary", with_ctes(FX_BUSINESS_SQL, body="""
SELECT count(*) AS n_business, count(DISTINCT state) AS n_states, count(DISTINCT city) AS n_cities,
       avg(stars) AS mean_stars, avg(review_count) AS mean_review_count, max(review_count) AS max_review_count
FROM fx_business"""))
def q_business_summary(spark, sf_dir):
    return P.business_summary(fx_business(spark, sf_dir))


@query("business_null_counts", with_ctes(FX_BUSINESS_SQL, body="""
SELECT * FROM (
  SELECT 'categories' AS "column", count(*) FILTER (WHERE categories IS NULL) AS nulls FROM fx_business
  UNION ALL SELECT 'name', count(*) FILTER (WHERE name IS NULL) FROM fx_business
  UNION ALL SELECT 'city', count(*) FILTER (WHERE city IS NULL) FROM fx_business
  UNION ALL SELECT 'state', count(*) FILTER (WHERE state IS NULL) FROM fx_business
  UNION ALL SELECT 'stars', count(*) FILTER (WHERE stars IS NULL) FROM fx_business
  UNION ALL SELECT 'review_count', count(*) FILTER (WHERE review_count IS NULL) FROM fx_business
  UNION ALL SELECT 'business_id', count(*) FILTER (WHERE business_id IS NULL) FROM fx_business
  UNION ALL SELECT 'seq', count(*) FILTER (WHERE seq IS NULL) FROM fx_business)
WHERE nulls > 0"""))
def q_business_null_counts(spark, sf_dir):
    return P.null_counts(fx_business(spark, sf_dir))


@query("business_star_distribution", with_ctes(FX_BUSINESS_SQL, body="""
SELECT stars, count(*) AS n FROM fx_business GROUP BY stars"""))
def q_business_stars(spark, sf_dir):
    return P.value_distribution(fx_business(spark, sf_dir), "stars")


@query("top_states", with_ctes(FX_BUSINESS_SQL, body="""
SELECT state, count(*) AS n FROM fx_business GROUP BY state ORDER BY n DESC, state LIMIT 10"""))
def q_top_states(spark, sf_dir):
    return P.top_counts(fx_business(spark, sf_dir), "state", 10)


def _hist_sql(src: str, x: str, bins: int, by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON TRUE"
    return f"""
, v AS (SELECT {g}{x} AS x FROM {src} WHERE {x} IS NOT NULL),
b AS (SELECT {g}min(x) AS lo, max(x) AS hi FROM v {'GROUP BY ' + by if by else ''}),
c AS (SELECT {g}CASE WHEN hi = lo THEN 0 ELSE
             least(greatest(CAST(floor((x - lo) / ((hi - lo) / {bins})) AS INTEGER), 0), {bins - 1}) END AS bin,
             count(*) AS n
      FROM v JOIN b {on} GROUP BY ALL),
g AS (SELECT {g}lo, hi, CAST(unnest(range(0, {bins})) AS INTEGER) AS bin FROM b)
SELECT {g}g.bin, lo + g.bin * ((hi - lo) / {bins}) AS bin_lo, lo + (g.bin + 1) * ((hi - lo) / {bins}) AS bin_hi,
       coalesce(c.n, 0) AS n
FROM g LEFT JOIN c ON g.bin = c.bin {'AND g.' + by + ' = c.' + by if by else ''}"""


@query("review_count_histogram", with_ctes(FX_BUSINESS_SQL, body=_hist_sql(
    "fx_business", "CAST(review_count AS DOUBLE)", 50)))
def q_review_count_hist(spark, sf_dir):
    return P.histogram(fx_business(spark, sf_dir), "review_count", bins=50)


@query("top_categories", with_ctes(FX_BUSINESS_SQL, body=f"""
SELECT category, count(*) AS n FROM (
  SELECT {strip_sql('unnest(string_split(categories, \',\'))')} AS category
  FROM fx_business WHERE categories IS NOT NULL)
GROUP BY category ORDER BY n DESC, category LIMIT 20"""))
def q_top_categories(spark, sf_dir):
    return P.category_counts(fx_business(spark, sf_dir), 20)


FOOD_SQL = " OR ".join(f"contains(lower(coalesce(categories, '')), '{k.lower()}')" for k in P.FOOD_KEYWORDS)


@query("food_business_summary", with_ctes(FX_BUSINESS_SQL, body=f"""
SELECT count(*) FILTER (WHERE {FOOD_SQL}) AS n_food,
       count(*) FILTER (WHERE {FOOD_SQL}) * {D} / count(*) AS pct_food,
       avg(stars) FILTER (WHERE {FOOD_SQL}) AS mean_stars_food,
       avg(review_count) FILTER (WHERE {FOOD_SQL}) AS mean_review_count_food
FROM fx_business"""))
def q_food_summary(spark, sf_dir):
    return P.food_summary(fx_business(spark, sf_dir))


WORDS_SQL = (f"CASE WHEN {strip_sql('text')} = '' THEN 0 ELSE "
             f"len(regexp_split_to_array({strip_sql('text')}, '{WS}+')) END")


@query("review_text_metrics", with_ctes(FX_REVIEWS_SQL, body=f"""
SELECT review_id, length(text) AS text_length, {WORDS_SQL} AS word_count FROM fx_reviews"""))
def q_text_metrics(spark, sf_dir):
    return P.with_text_metrics(fx_reviews(spark, sf_dir)).select("review_id", "text_length", "word_count")


@query("orders_per_year", """
SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL""")
def q_per_year(spark, sf_dir):
    return P.per_year(read_table(spark, sf_dir, "orders"), "o_orderdate")


@query("review_summary", with_ctes(FX_REVIEWS_SQL, body=f"""
SELECT count(*) AS n_reviews, avg(stars) AS mean_stars, avg(length(text)) AS mean_length,
       min(length(text)) AS min_length, max(length(text)) AS max_length, avg({WORDS_SQL}) AS mean_words
FROM fx_reviews"""))
def q_review_summary(spark, sf_dir):
    return P.review_summary(fx_reviews(spark, sf_dir))


@query("review_star_distribution", with_ctes(FX_REVIEWS_SQL, body=f"""
SELECT stars, count(*) AS n, count(*) * {D} / (SELECT count(*) FROM fx_reviews) AS pct
FROM fx_reviews GROUP BY stars"""))
def q_review_stars(spark, sf_dir):
    return P.value_distribution(fx_reviews(spark, sf_dir), "stars", share=True)


@query("review_length_histogram", with_ctes(FX_REVIEWS_SQL, body=_hist_sql(
    "fx_reviews", "least(greatest(CAST(length(text) AS DOUBLE), 0.0), 2000.0)", 50).replace(
    "\nSELECT g.bin", "\nSELECT (SELECT avg(length(text)) FROM fx_reviews) AS mean_length, g.bin")))
def q_review_length_hist(spark, sf_dir):
    rev = fx_reviews(spark, sf_dir).withColumn("text_length", F.length("text"))
    hist = P.histogram(rev, "text_length", bins=50, clip=(0, 2000))
    return P.attach_one_row(hist, rev.agg(F.avg("text_length").alias("mean_length")))


@query("useful_by_stars", with_ctes(FX_REVIEWS_SQL, body="""
SELECT stars, avg(useful) AS mean_useful FROM fx_reviews GROUP BY stars"""))
def q_useful_by_stars(spark, sf_dir):
    return P.mean_by(fx_reviews(spark, sf_dir), "stars", "useful")


@query("short_reviews", with_ctes(FX_REVIEWS_SQL, body=f"""
SELECT count(*) FILTER (WHERE length(text) < 10) AS n_short,
       count(*) FILTER (WHERE length(text) < 10) * {D} / count(*) AS pct_short,
       coalesce((SELECT string_agg(text, ' | ' ORDER BY seq) FROM
          (SELECT seq, text FROM fx_reviews WHERE length(text) < 10 ORDER BY seq LIMIT 5)), '') AS examples
FROM fx_reviews"""))
def q_short_reviews(spark, sf_dir):
    out = P.short_reviews(fx_reviews(spark, sf_dir))
    return out.withColumn("examples", F.array_join("examples", " | "))


@query("valid_share", with_ctes(FX_REVIEWS_SQL, body=f"""
SELECT count(*) FILTER (WHERE length(text) BETWEEN 10 AND 5000 AND stars BETWEEN 1 AND 5) AS n_valid,
       count(*) FILTER (WHERE length(text) BETWEEN 10 AND 5000 AND stars BETWEEN 1 AND 5) * {D} / count(*)
         AS pct_valid
FROM fx_reviews"""))
def q_valid_share(spark, sf_dir):
    return P.valid_share(fx_reviews(spark, sf_dir))


@query("label_distribution", with_ctes(FX_REVIEWS_SQL, body=f"""
SELECT {_label_sql()} AS label, count(*) AS n, count(*) * {D} / (SELECT count(*) FROM fx_reviews) AS pct
FROM fx_reviews GROUP BY ALL"""))
def q_label_distribution(spark, sf_dir):
    return P.label_distribution(fx_reviews(spark, sf_dir))


@query("length_by_label", with_ctes(FX_REVIEWS_SQL, body=f"""
, lab AS (SELECT {_label_sql()} AS label, CAST(length(text) AS DOUBLE) AS text_length FROM fx_reviews),
v AS (SELECT label, least(greatest(text_length, 0.0), 2000.0) AS x FROM lab),
b AS (SELECT label, min(x) AS lo, max(x) AS hi FROM v GROUP BY label),
c AS (SELECT label, CASE WHEN hi = lo THEN 0 ELSE
             least(greatest(CAST(floor((x - lo) / ((hi - lo) / 40)) AS INTEGER), 0), 39) END AS bin,
             count(*) AS n
      FROM v JOIN b USING (label) GROUP BY ALL),
g AS (SELECT label, lo, hi, CAST(unnest(range(0, 40)) AS INTEGER) AS bin FROM b),
m AS (SELECT label, avg(text_length) AS mean_length FROM lab GROUP BY label)
SELECT g.label, g.bin, lo + g.bin * ((hi - lo) / 40) AS bin_lo, lo + (g.bin + 1) * ((hi - lo) / 40) AS bin_hi,
       coalesce(c.n, 0) AS n, m.mean_length
FROM g LEFT JOIN c ON g.bin = c.bin AND g.label = c.label JOIN m ON m.label = g.label"""))
def q_length_by_label(spark, sf_dir):
    return P.length_by_label(fx_reviews(spark, sf_dir))


@query("sample_per_label", with_ctes(FX_REVIEWS_SQL, body=f"""
SELECT label, review_id FROM (
  SELECT {_label_sql()} AS label, review_id,
         row_number() OVER (PARTITION BY {_label_sql()}
                            ORDER BY md5('42:' || seq), seq) AS rn
  FROM fx_reviews) WHERE rn <= 500"""))
def q_sample_per_label(spark, sf_dir):
    return P.sample_per_label(fx_reviews(spark, sf_dir), 500).select("label", "review_id")


def _word_weights_sql():
    sw = ", ".join("('" + w.replace("'", "''") + "')" for w in _stop_words())
    return with_ctes(FX_REVIEWS_SQL, body=f"""
, sw(word) AS (VALUES {sw}),
t AS (SELECT {_label_sql()} AS label,
             unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_'']+')) AS word
      FROM fx_reviews),
c AS (SELECT label, word, count(*) AS n FROM t WHERE word NOT IN (SELECT word FROM sw) GROUP BY ALL)
SELECT label, word, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 80""")


@query("word_weights", _word_weights_sql())
def q_word_weights(spark, sf_dir):
    return P.word_weights(fx_reviews(spark, sf_dir), top=80)


@query("validator_funnel", with_ctes(FX_REVIEWS_SQL, body=f"""
, f AS (SELECT text, text IS NOT NULL AND {strip_sql('text')} <> '' AS nb,
             text IS NOT NULL AND {strip_sql('text')} <> '' AND length(text) >= 10 AS lo,
             text IS NOT NULL AND {strip_sql('text')} <> '' AND length(text) >= 10 AND stars BETWEEN 1 AND 5 AS so
        FROM fx_reviews),
a AS (SELECT count(*) AS raw, count(*) FILTER (WHERE nb) AS nonblank, count(*) FILTER (WHERE lo) AS min_length,
             count(*) FILTER (WHERE so) AS stars_ok, count(DISTINCT CASE WHEN so THEN text END) AS dedup FROM f)
SELECT stage_ord, stage, n, n * {D} / raw AS pct FROM (
  SELECT 0 AS stage_ord, 'raw' AS stage, raw AS n, raw FROM a UNION ALL
  SELECT 1, 'nonblank', nonblank, raw FROM a UNION ALL
  SELECT 2, 'min_length', min_length, raw FROM a UNION ALL
  SELECT 3, 'stars_ok', stars_ok, raw FROM a UNION ALL
  SELECT 4, 'dedup', dedup, raw FROM a)"""))
def q_validator_funnel(spark, sf_dir):
    return P.validator_funnel(fx_reviews(spark, sf_dir))


@query("insight_summary", with_ctes(FX_BUSINESS_SQL, FX_REVIEWS_SQL, body=f"""
SELECT (SELECT count(*) FROM fx_business) AS n_business,
       (SELECT count(*) FILTER (WHERE {FOOD_SQL}) FROM fx_business) AS n_food,
       (SELECT count(*) FILTER (WHERE {FOOD_SQL}) * {D} / count(*) FROM fx_business) AS pct_food,
       count(*) AS n_reviews,
       count(*) FILTER (WHERE {_label_sql()} = 'positive') * {D} / count(*) AS pct_positive,
       count(*) FILTER (WHERE {_label_sql()} = 'negative') * {D} / count(*) AS pct_negative,
       count(*) FILTER (WHERE {_label_sql()} = 'neutral') * {D} / count(*) AS pct_neutral,
       avg(length(text)) AS mean_length,
       count(*) FILTER (WHERE length(text) < 10) * {D} / count(*) AS pct_short
FROM fx_reviews"""))
def q_insight_summary(spark, sf_dir):
    return P.insight_summary(fx_business(spark, sf_dir), fx_reviews(spark, sf_dir))
