"""Queries for sources and sinks (A1-A13): round trips through the file formats the
reference reads, written from the driver tables into the session's checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import readers as R
from ..sources.fixtures import FX_BUSINESS_SQL, FX_REVIEWS_SQL, fx_business, fx_reviews, with_ctes
from ..functions.text import PANDAS_NA_TOKENS
from .catalog import query
from .q_validate import strip_sql


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (cluster-visible)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "revlens-io", f"{name}-{uuid.uuid4().hex}")


NA_SQL = ", ".join("'" + t.replace("'", "''") + "'" for t in PANDAS_NA_TOKENS)


@query("csv_roundtrip", with_ctes(FX_REVIEWS_SQL, body=f"""
SELECT review_id, business_name, stars, text FROM (
  SELECT 'csv_' || CAST(row_number() OVER (ORDER BY seq) - 1 AS VARCHAR) AS review_id, business_name, stars, text
  FROM fx_reviews)
WHERE text IS NOT NULL AND text NOT IN ({NA_SQL}) AND {strip_sql('text')} <> '' AND stars BETWEEN 1 AND 5"""))
def q_csv_roundtrip(spark, sf_dir):
    """A7 write -> A1 read (A3 encoding check, A4 required columns, A5 defaults with
    ``csv_{i}`` ids by file position, A6 cleaning)."""
    path = _scratch(spark, "csv")
    src = fx_reviews(spark, sf_dir).orderBy("seq").select("business_name", F.col("stars").cast("string"), "text")
    R.write_csv(src, path)
    out = R.load_review_csv(spark, path + "/*.csv", clean=True)
    return out.select("review_id", "business_name", "stars", "text")


@query("csv_bare_load", with_ctes(FX_REVIEWS_SQL, body="""
SELECT business_name, CAST(stars AS VARCHAR) AS stars, text FROM fx_reviews"""))
def q_csv_bare(spark, sf_dir):
    """A2: required columns only, no defaults, no cleaning."""
    path = _scratch(spark, "csvbare")
    src = fx_reviews(spark, sf_dir).select("business_name", F.col("stars").cast("string").alias("stars"), "text")
    R.write_csv(src, path)
    return R.load_review_csv(spark, path + "/*.csv", clean=False).select("business_name", "stars", "text")


@query("csv_required_columns", with_ctes(FX_REVIEWS_SQL, body="""
SELECT CASE seq % 3 WHEN 0 THEN 'text,stars' WHEN 1 THEN 'text,rating' ELSE 'business_name' END AS present,
       CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN 'stars' ELSE 'stars,text' END AS missing, count(*) AS n_rows
FROM fx_reviews GROUP BY ALL"""))
def q_csv_required(spark, sf_dir):
    """A4: files with three headers, the required columns that each lacks, and its rows."""
    path = _scratch(spark, "csvrequired")
    r = fx_reviews(spark, sf_dir)
    stars = F.col("stars").cast("string")
    R.write_csv(r.filter("seq % 3 = 0").select("text", stars.alias("stars")), os.path.join(path, "a"))
    R.write_csv(r.filter("seq % 3 = 1").select("text", stars.alias("rating")), os.path.join(path, "b"))
    R.write_csv(r.filter("seq % 3 = 2").select("business_name"), os.path.join(path, "c"))
    said = R.header_report(spark, [os.path.join(path, x, "*.csv") for x in "abc"])
    return said.select(F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"), "n_rows")


@query("csv_quoted_headers", with_ctes(FX_REVIEWS_SQL, body=f"""
SELECT md5(text) AS text_md5, stars, CASE WHEN seq % 2 = 0 THEN useful END AS votes FROM fx_reviews
WHERE text IS NOT NULL AND text NOT IN ({NA_SQL}) AND {strip_sql('text')} <> '' AND stars BETWEEN 1 AND 5"""))
def q_csv_quoted_headers(spark, sf_dir):
    """A1, A3: half of the files with a header cell that holds a line break and a comma."""
    path = _scratch(spark, "csvquoted")
    r = fx_reviews(spark, sf_dir)
    stars, votes = F.col("stars").cast("string").alias("stars"), "useful votes,\nall kinds"
    R.write_csv(r.filter("seq % 2 = 0").select(F.col("useful").cast("string").alias(votes), "text", stars), os.path.join(path, "a"))
    R.write_csv(r.filter("seq % 2 = 1").select("text", stars), os.path.join(path, "b"))
    out = R.load_review_csv(spark, [os.path.join(path, x, "*.csv") for x in "ab"])
    return out.select(F.md5("text").alias("text_md5"), "stars", F.col(f"`{votes}`").cast("long").alias("votes"))


@query("review_json_roundtrip", with_ctes(FX_REVIEWS_SQL, body="""
SELECT review_id, business_id, stars, text, useful FROM fx_reviews"""))
def q_review_json(spark, sf_dir):
    """A13 write -> A9 read with the explicit review schema."""
    path = _scratch(spark, "reviews-json")
    R.write_json(fx_reviews(spark, sf_dir).select("review_id", "business_id", "stars", "text", "useful"), path)
    return R.read_review_json(spark, path).select("review_id", "business_id", "stars", "text", "useful")


@query("business_json_roundtrip", with_ctes(FX_BUSINESS_SQL, body="""
SELECT business_id, name, city, state, stars, review_count, categories FROM fx_business"""))
def q_business_json(spark, sf_dir):
    """Business JSON lines with the explicit schema."""
    path = _scratch(spark, "business-json")
    R.write_json(fx_business(spark, sf_dir).drop("seq"), path)
    return R.read_business_json(spark, path).select(
        "business_id", "name", "city", "state", "stars", "review_count", "categories")


def _cards(spark, sf_dir):
    r = fx_reviews(spark, sf_dir)
    m = F.col("seq") % 4
    label = (F.when(m == 0, F.lit(None).cast("string"))
             .when(m == 1, F.concat(F.floor(F.col("stars")).cast("string"), F.lit(" stars")))
             .when(m == 2, F.lit("five stars")).otherwise(F.lit("")))
    return r.select(F.col("business_name"), label.alias("aria_label"),
                    F.when(F.col("seq") % 13 == 0, F.lit("")).otherwise(F.col("text")).alias("text"),
                    F.lit("2 weeks ago").alias("date"), "seq")


@query("scraped_cards", with_ctes(FX_REVIEWS_SQL, body="""
, c AS (SELECT business_name,
               CASE seq % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(CAST(floor(stars) AS BIGINT) AS VARCHAR) || ' stars'
                    WHEN 2 THEN 'five stars' ELSE '' END AS aria_label,
               CASE WHEN seq % 13 = 0 THEN '' ELSE text END AS text, seq FROM fx_reviews),
k AS (SELECT business_name, CASE WHEN seq % 4 = 1 THEN CAST(split_part(aria_label, ' ', 1) AS INTEGER) END AS stars,
             text, seq FROM c WHERE seq % 4 <> 2 AND text <> '')
SELECT business_name, CAST(stars AS DOUBLE) AS stars, text FROM (
  SELECT *, row_number() OVER (PARTITION BY business_name ORDER BY seq) AS rn FROM k) WHERE rn <= 100"""))
def q_cards(spark, sf_dir):
    """Captured cards -> reviews, capped at 100 per business (the scraper's limit)."""
    return R.normalise_cards(_cards(spark, sf_dir), limit=100).select(
        "business_name", F.col("stars").cast("double").alias("stars"), "text")
