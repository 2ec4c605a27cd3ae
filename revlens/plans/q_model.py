"""Queries for the built-in scoring path (E8-E11) on validated reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sentiment as S
from ..operators import validate as V
from ..operators.lineage import write_table
from ..operators.modelio import TOPICS
from ..operators.profile import stars_to_label
from ..sources.fixtures import FX_REVIEWS_SQL, fx_reviews, with_ctes
from .catalog import query
from .q_retrieve import DRIVER_TOPICS
from .q_validate import TAGGED_SQL

LBL = "CASE WHEN stars >= 4 THEN 'positive' WHEN stars <= 2 THEN 'negative' ELSE 'neutral' END"
D = "CAST(100 AS DOUBLE)"
TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


def _labelled(spark, sf_dir):
    clean = V.validate_reviews(fx_reviews(spark, sf_dir), ["business_id"])
    return clean.withColumn("label", stars_to_label("stars"))


@query("sentiment_percentages", with_ctes(FX_REVIEWS_SQL, TAGGED_SQL, body=f"""
SELECT business_id, p AS positive, n AS negative, 100 - p - n AS neutral, n_reviews FROM (
  SELECT business_id, round_even(count(*) FILTER (WHERE {LBL} = 'positive') * {D} / count(*), 0) AS p,
         round_even(count(*) FILTER (WHERE {LBL} = 'negative') * {D} / count(*), 0) AS n, count(*) AS n_reviews
  FROM clean GROUP BY business_id)"""))
def q_sentiment_percentages(spark, sf_dir):
    """Percentages per business from labels, summing to 100."""
    return S.sentiment_percentages(_labelled(spark, sf_dir), ["business_id"])


@query("highlight_phrases", with_ctes(FX_REVIEWS_SQL, TAGGED_SQL, body=f"""
, lab AS (SELECT business_id, review_id, {LBL} AS label, {TOK} AS t FROM clean),
bi AS (SELECT business_id, review_id, label, unnest(list_distinct(
         list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))
       AS phrase FROM lab WHERE len(t) >= 2),
dfc AS (SELECT business_id, label, phrase, count(*) AS df FROM bi GROUP BY ALL),
sizes AS (SELECT business_id, label, count(*) AS n_class FROM lab GROUP BY ALL),
tot AS (SELECT business_id, count(*) AS n_all FROM lab GROUP BY ALL),
alldf AS (SELECT business_id, phrase, sum(df) AS df_all FROM dfc GROUP BY ALL),
s AS (SELECT d.business_id, d.label, d.phrase, d.df,
             d.df / n_class - CASE WHEN n_all > n_class THEN (df_all - d.df) / (n_all - n_class) ELSE 0.0 END AS contrast
      FROM dfc d JOIN sizes USING (business_id, label) JOIN tot USING (business_id)
      JOIN alldf USING (business_id, phrase)
      WHERE d.label IN ('positive', 'negative'))
SELECT business_id, label, rank, phrase, df, contrast FROM (
  SELECT *, row_number() OVER (PARTITION BY business_id, label ORDER BY contrast DESC, df DESC, phrase) AS rank
  FROM s WHERE contrast > 0) WHERE rank <= 5"""))
def q_highlight_phrases(spark, sf_dir):
    """Top-5 contrasting bigrams per business and class."""
    return S.highlight_phrases(_labelled(spark, sf_dir), ["business_id"])


def _lex_sql():
    rows = []
    for t, q in DRIVER_TOPICS.items():
        for w in dict.fromkeys(q.lower().split()):
            rows.append(f"('{t}', {TOPICS.index(t)}, '{w}')")
    return "lex(topic, topic_ord, word) AS (VALUES " + ", ".join(rows) + ")"


@query("topic_stats", with_ctes(FX_REVIEWS_SQL, TAGGED_SQL, _lex_sql(), body=f"""
, toks AS (SELECT business_id, review_id, stars, {LBL} AS label, list_distinct({TOK}) AS t FROM clean),
hits AS (SELECT business_id, review_id, stars, label, topic, topic_ord, word FROM toks JOIN lex ON list_contains(t, word)),
per AS (SELECT DISTINCT business_id, topic, topic_ord, review_id, stars, label FROM hits),
agg AS (SELECT business_id, topic, topic_ord, count(*) AS mentions, avg(stars) AS a,
               count(*) FILTER (WHERE label = 'positive') AS np, count(*) FILTER (WHERE label = 'negative') AS nn,
               count(*) FILTER (WHERE label = 'neutral') AS nu FROM per GROUP BY ALL),
kw AS (SELECT business_id, topic, string_agg(word, '|' ORDER BY r) AS keywords FROM (
         SELECT business_id, topic, word, row_number() OVER (PARTITION BY business_id, topic ORDER BY count(*) DESC, word) AS r
         FROM hits GROUP BY business_id, topic, word) WHERE r <= 4 GROUP BY ALL)
SELECT business_id, topic, topic_ord,
       CASE WHEN np >= nn AND np >= nu THEN 'positive' WHEN nn >= nu THEN 'negative' ELSE 'neutral' END AS sentiment,
       round_even(a, 1) AS score, mentions, keywords
FROM agg JOIN kw USING (business_id, topic)"""))
def q_topic_stats(spark, sf_dir):
    """Per business and topic: mentions, dominant label, mean stars, keywords."""
    lex = S.lexicon_table(spark, DRIVER_TOPICS)
    out = S.topic_stats(V.validate_reviews(fx_reviews(spark, sf_dir), ["business_id"]), lex, ["business_id"])
    return out.withColumn("keywords", F.array_join("keywords", "|"))


@query("sentiment_classifier")
def q_sentiment_classifier(spark, sf_dir):
    """A text classifier trained on star-derived labels of all validated reviews,
    applied to every review (model output: rows-only check)."""
    # validated once: training and labelling read the written reviews
    lab = write_table(_labelled(spark, sf_dir).select("review_id", "business_id", "label", "text"), "labelled-reviews")
    model = S.train_classifier(lab, max_iter=20)
    return S.apply_classifier(model, lab).select("review_id", "business_id", "label", "predicted")


@query("business_overview", with_ctes(FX_REVIEWS_SQL, TAGGED_SQL, body=f"""
, b AS (SELECT business_id, count(*) AS total_before, avg(stars) AS avg_stars_before FROM fx_reviews GROUP BY ALL),
a AS (SELECT business_id, count(*) AS total_after, avg(stars) AS avg_stars_after,
             avg(CAST(length(text) AS DOUBLE)) AS avg_text_length,
             round_even(count(*) FILTER (WHERE {LBL} = 'positive') * {D} / count(*), 0) AS positive,
             round_even(count(*) FILTER (WHERE {LBL} = 'negative') * {D} / count(*), 0) AS negative
      FROM clean GROUP BY ALL)
SELECT business_id, total_before, coalesce(total_after, 0) AS total_after, total_before - coalesce(total_after, 0) AS removed,
       round_even(coalesce(total_after, 0) * {D} / total_before, 1) AS kept_ratio,
       round_even(avg_stars_before, 2) AS avg_stars_before, round_even(avg_stars_after, 2) AS avg_stars_after,
       round_even(coalesce(avg_text_length, 0), 1) AS avg_text_length,
       CASE WHEN total_before >= 100 THEN 'High' WHEN total_before >= 50 THEN 'Medium' WHEN total_before >= 10 THEN 'Low'
            ELSE 'Very low' END AS reliability,
       positive, negative, 100 - positive - negative AS neutral
FROM b LEFT JOIN a USING (business_id)"""))
def q_business_overview(spark, sf_dir):
    """The flagship (``entry``): validation statistics, tier and sentiment per business."""
    from .flagship import business_overview
    return business_overview(spark, sf_dir)


@query("analysis_report")
def q_analysis_report(spark, sf_dir):
    """The whole per-business analysis (collect -> validate -> retrieve -> score -> report)
    for every business at once; the component marts have their own oracles."""
    from .flagship import analyze_all
    marts = analyze_all(spark, fx_reviews(spark, sf_dir), topics=DRIVER_TOPICS)
    r = marts["report"]
    return r.select("business_id", "overall_score", "positive", "negative", "neutral",
                    F.array_join("strengths", "|").alias("strengths"),
                    F.array_join("weaknesses", "|").alias("weaknesses"),
                    F.array_join("recommendations", "|").alias("recommendations"), "priority_action")


def keyword_scorer(blocks):
    """A tiny stand-in for a user's text model (E7): for each prompt block it answers in
    the model's JSON shape, from word cues in the block's lines.  Real deployments pass
    their own scorer to ``modelio.score_batches``."""
    import json

    import pandas as pd
    out = []
    for b in blocks:
        lines = [x for x in (b or "").split("\n") if x.strip()]
        n = max(len(lines), 1)
        pos = sum(1 for x in lines if " with " in x.lower())
        neg = sum(1 for x in lines if " from " in x.lower() and " with " not in x.lower())
        p, q = round(pos * 100 / n), round(neg * 100 / n)
        out.append("Here you go: " + json.dumps({
            "positive": p, "negative": q, "neutral": 100 - p - q, "summary": (lines[0][2:40] if lines else ""),
            "positive_highlights": ["with"], "negative_highlights": ["from"]}))
    return pd.Series(out)


@query("model_hook_merge")
def q_model_hook_merge(spark, sf_dir):
    """E1 -> E7 -> E2 -> F -> G: batches of 20 validated reviews per business become prompt
    blocks, a user scorer answers each batch inside ``mapInPandas``, answers are parsed,
    checked against the batch corpus and merged per business (rows-only: the scorer is
    user code)."""
    from ..operators import checker as K
    from ..operators import merge as G
    from ..operators import modelio as M
    from ..operators.joins import join_large
    clean = V.validate_reviews(fx_reviews(spark, sf_dir), ["business_id"])
    b = G.split_batches(clean, ["business_id"], "seq", batch_size=20)
    blocks = M.review_block(b, ["business_id", "batch_id"])
    sizes = b.groupBy("business_id", "batch_id").agg(F.first("batch_size").alias("batch_size"))
    raw = M.score_batches(blocks, keyword_scorer, keys=["business_id", "batch_id"])
    parsed = (join_large(raw, blocks.select("business_id", "batch_id", "corpus"), ["business_id", "batch_id"])
              .withColumn("v", M.extract_json("raw")))
    checked = join_large(K.check_sentiment(parsed), sizes, ["business_id", "batch_id"])
    merged = G.merge_sentiment(checked, scope=["business_id"])
    return merged.select("business_id", "positive", "negative", "neutral", "summary",
                         F.array_join("positive_highlights", "|").alias("positive_highlights"),
                         "total_reviews_analyzed", "batches_processed")
