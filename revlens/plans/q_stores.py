"""Queries on written stores: the clustered review table, the store of model answers, the profile by loads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import clustered as L
from ..operators import load_profile as LP
from ..operators import merge as G
from ..operators import modelio as M
from ..operators.profile import attach_one_row
from ..sources.fixtures import FX_REVIEWS_SQL, fx_reviews, with_ctes
from .catalog import query
from .q_collect import _review_business
from .q_model import keyword_scorer
from .q_profile import WORDS_SQL
from .q_sources import _scratch
from .q_validate import strip_sql


@query("clustered_first_reviews", with_ctes(FX_REVIEWS_SQL, body="""
SELECT review_id, business_id, business_name, text FROM (
  SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY seq) AS rn FROM fx_reviews WHERE business_id IS NOT NULL) WHERE rn <= 15"""))
def q_clustered_first_reviews(spark, sf_dir):
    """The reviews are written clustered by slices of their business, then the first 15 of every business load from there."""
    stored = L.write_clustered(fx_reviews(spark, sf_dir), f"clustered_{uuid.uuid4().hex}", _scratch(spark, "clustered"), buckets=32, rows_per_slice=10_000)
    return L.clustered_reviews_of(stored, _review_business(spark, sf_dir), limit=15).select("review_id", "business_id", "business_name", "text")


def no_scorer(blocks):
    raise RuntimeError("asked again")


@query("stored_model_answers", with_ctes(FX_REVIEWS_SQL, body=f"""
, b AS (SELECT *, floor((row_number() OVER (PARTITION BY business_id ORDER BY seq) - 1) / 20) AS batch_id FROM fx_reviews),
p AS (SELECT business_id, CAST(batch_id AS BIGINT) AS batch_id, string_agg('- ' || text, chr(10) ORDER BY seq) AS block
      FROM b WHERE text IS NOT NULL GROUP BY ALL),
l AS (SELECT business_id, batch_id, list_filter(string_split(block, chr(10)), lambda x: {strip_sql('x')} <> '') AS lines FROM p),
c AS (SELECT business_id, batch_id, lines, greatest(len(lines), 1) AS n,
             len(list_filter(lines, lambda x: contains(lower(x), ' with '))) AS pos,
             len(list_filter(lines, lambda x: contains(lower(x), ' from ') AND NOT contains(lower(x), ' with '))) AS neg FROM l)
SELECT business_id, batch_id, CAST(round_even(pos * CAST(100 AS DOUBLE) / n, 0) AS BIGINT) AS positive,
       CAST(round_even(neg * CAST(100 AS DOUBLE) / n, 0) AS BIGINT) AS negative, substr(lines[1], 3, 38) AS summary, TRUE AS answered
FROM c"""))
def q_stored_model_answers(spark, sf_dir):
    """E1 -> E7 -> E2: every batch's prompt is answered once and stored; the rows come from a second run, whose scorer refuses every call."""
    batches = G.split_batches(fx_reviews(spark, sf_dir), ["business_id"], "seq", batch_size=20)
    blocks = M.review_block(batches, ["business_id", "batch_id"])
    path, keys = _scratch(spark, "answers"), ["business_id", "batch_id"]
    blocks = A.named_prompts(blocks, "keywords", keys)   # both runs read it
    A.answer_batches(blocks, keyword_scorer, path, model="keywords", keys=keys)
    got = A.answer_batches(blocks, no_scorer, path, model="keywords", keys=keys).withColumn("v", M.extract_json("raw"))
    return got.select(*keys, F.try_variant_get("v", "$.positive", "bigint").alias("positive"), F.try_variant_get("v", "$.negative", "bigint").alias("negative"),
                      F.try_variant_get("v", "$.summary", "string").alias("summary"), F.col("error").isNull().alias("answered"))


LOADS = 7


def _profiled(spark, sf_dir) -> str:
    """The reviews arrive in seven loads, each profiled by itself."""
    path, rows = _scratch(spark, "loads"), fx_reviews(spark, sf_dir)
    for k in range(LOADS):
        LP.add_load(rows.where(F.pmod("seq", F.lit(LOADS)) == k), path, f"{k:03}")
    return path


@query("load_profile", with_ctes(FX_REVIEWS_SQL, body=f"""
, f AS (SELECT *, text IS NOT NULL AND {strip_sql('text')} <> '' AS nb FROM fx_reviews)
SELECT business_id, count(*) AS n_reviews, avg(stars) AS mean_stars, avg(length(text)) AS mean_length, min(length(text)) AS shortest_text,
       max(length(text)) AS longest_text, avg({WORDS_SQL}) AS mean_words, count(*) FILTER (WHERE nb) AS nonblank,
       count(*) FILTER (WHERE nb AND length(text) >= 10) AS min_length,
       count(*) FILTER (WHERE nb AND length(text) >= 10 AND stars BETWEEN 1 AND 5) AS stars_ok FROM f GROUP BY business_id"""))
def q_load_profile(spark, sf_dir):
    """I10, I22 by business, merged from the figures of seven loads: equal to one pass over all reviews."""
    got = LP.merged_profile(spark, _profiled(spark, sf_dir), by=["business_id"])
    return got.select("business_id", "n_reviews", "mean_stars", "mean_length", "shortest_text", "longest_text", "mean_words", "nonblank", "min_length", "stars_ok")


@query("load_profile_error", with_ctes(FX_REVIEWS_SQL, body=f"""
SELECT count(DISTINCT CASE WHEN text IS NOT NULL AND {strip_sql('text')} <> '' AND length(text) >= 10 AND stars BETWEEN 1 AND 5 THEN text END) AS exact_texts,
       TRUE AS texts_near, TRUE AS quantiles_near FROM fx_reviews"""))
def q_load_profile_error(spark, sf_dir):
    """I22's distinct texts and the length quantiles from merged sketches, held against exact figures: 4 % of the count, 3 % of the rank."""
    got = LP.merged_profile(spark, _profiled(spark, sf_dir))
    rev = fx_reviews(spark, sf_dir)
    from ..operators.profile import validator_funnel
    exact = validator_funnel(rev).where("stage = 'dedup'").select(F.col("n").alias("exact_texts"))
    size = attach_one_row(rev.where("text IS NOT NULL").select(F.length("text").alias("size")), got)
    near = [((F.avg((F.col("size") < F.col(f"length_q{round(q * 100)}")).cast("double")) <= q + 0.03)
             & (F.avg((F.col("size") <= F.col(f"length_q{round(q * 100)}")).cast("double")) >= q - 0.03)) for q in LP.QUANTILES]
    ranks = size.agg(F.coalesce(near[0] & near[1] & near[2] & near[3], F.lit(True)).alias("quantiles_near"))
    both = attach_one_row(attach_one_row(exact, got.select("distinct_texts")), ranks)
    return both.select("exact_texts", (F.abs(F.col("distinct_texts") - F.col("exact_texts")) <= F.col("exact_texts") * 0.04).alias("texts_near"), "quantiles_near")
