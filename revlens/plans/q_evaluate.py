"""Queries for quality evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as J
from ..operators import validate as V
from ..operators.profile import stars_to_label
from ..sources.fixtures import (FX_BATCH_RESULTS_SQL, FX_REVIEWS_SQL, FX_TRUTH_SQL, fx_batch_results, fx_reviews,
                                fx_truth, with_ctes)
from .catalog import query
from .q_checker import checked_sentiment, _sentiment_sql
from .q_collect import _review_business
from .q_retrieve import DRIVER_TOPICS, TFIDF_SQL, _topic_hits
from .q_validate import TAGGED_SQL
from ..sources.fixtures import FX_MODEL_RAW_SQL, FX_BATCH_CORPUS_SQL

LBL = "CASE WHEN {c} >= 4 THEN 'positive' WHEN {c} <= 2 THEN 'negative' ELSE 'neutral' END"
D = "CAST(100 AS DOUBLE)"


def _review_business_full(spark, sf_dir):
    r = fx_reviews(spark, sf_dir)
    return r.groupBy("business_id").agg(
        F.first("business_name").alias("name"), F.count(F.lit(1)).alias("review_count"),
        F.min("seq").alias("seq"), F.avg("stars").alias("stars"),
        F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("state"),
        F.lit(None).cast("string").alias("categories"))


@query("eval_test_set", with_ctes(FX_REVIEWS_SQL, body=f"""
, biz AS (SELECT business_id, count(*) AS review_count, min(seq) AS seq FROM fx_reviews
          WHERE contains(lower(business_name), 'src1') GROUP BY business_id),
best AS (SELECT business_id FROM biz ORDER BY review_count DESC, seq LIMIT 1),
t AS (SELECT r.review_id, r.stars, row_number() OVER (ORDER BY r.seq) AS rn
      FROM fx_reviews r JOIN best USING (business_id))
SELECT review_id, {LBL.format(c='stars')} AS ground_truth, rn <= 30 AS in_eval_sample FROM t WHERE rn <= 100"""))
def q_eval_test_set(spark, sf_dir):
    """J1 + J2: best match of a search, its first 100 reviews labelled from stars, the
    first 30 marked as the evaluation sample."""
    ts = J.test_set(_review_business_full(spark, sf_dir), fx_reviews(spark, sf_dir), "SRC1", limit=100)
    from pyspark.sql import Window
    w = Window.partitionBy("business_id").orderBy("seq")
    return ts.withColumn("_rn", F.row_number().over(w)).select(
        "review_id", "ground_truth", (F.col("_rn") <= 30).alias("in_eval_sample"))


@query("eval_predicted_labels", with_ctes(FX_BATCH_RESULTS_SQL, body="""
SELECT batch_id, CASE WHEN NOT ok THEN 'neutral' WHEN positive >= negative AND positive >= neutral THEN 'positive'
                      WHEN negative >= neutral THEN 'negative' ELSE 'neutral' END AS predicted
FROM fx_batch_results"""))
def q_eval_predicted(spark, sf_dir):
    """Predicted label = argmax of the percentages (ties positive, negative,
    neutral); failed answers predict neutral."""
    r = fx_batch_results(spark, sf_dir)
    return r.select("batch_id", J.predicted_label("positive", "negative", "neutral", F.col("ok")).alias("predicted"))


@query("eval_accuracy", with_ctes(FX_TRUTH_SQL, body="""
SELECT avg(CAST(y = p AS DOUBLE)) AS accuracy FROM fx_truth"""))
def q_eval_accuracy(spark, sf_dir):
    return J.accuracy(fx_truth(spark, sf_dir))


@query("eval_confusion", with_ctes(FX_TRUTH_SQL, body="""
, g AS (SELECT y, p FROM (VALUES ('positive'), ('negative'), ('neutral')) a(y),
                        (VALUES ('positive'), ('negative'), ('neutral')) b(p))
SELECT g.y, g.p, coalesce(c.n, 0) AS n FROM g LEFT JOIN
  (SELECT y, p, count(*) AS n FROM fx_truth GROUP BY y, p) c USING (y, p)"""))
def q_eval_confusion(spark, sf_dir):
    return J.confusion(fx_truth(spark, sf_dir))


@query("eval_report", with_ctes(FX_TRUTH_SQL, body="""
, c AS (SELECT y, p, count(*) AS n FROM fx_truth GROUP BY y, p),
lab AS (SELECT y AS label FROM c UNION SELECT p FROM c),
per AS (SELECT label,
          coalesce((SELECT sum(n) FROM c WHERE c.y = label), 0) AS support,
          coalesce((SELECT sum(n) FROM c WHERE c.p = label), 0) AS predicted,
          coalesce((SELECT sum(n) FROM c WHERE c.y = label AND c.p = label), 0) AS tp FROM lab),
m AS (SELECT label, support, tp,
        CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
        CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
      FROM m)
SELECT label, precision, recall, f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f"""))
def q_eval_report(spark, sf_dir):
    """J5 + J6: per-class precision/recall/F1/support, accuracy, macro and weighted F1."""
    return J.class_report(fx_truth(spark, sf_dir))


@query("eval_count_alignment", with_ctes(FX_TRUTH_SQL, body="""
SELECT coalesce(t.label, q.label) AS label, coalesce(t.n, 0) AS ground_truth, coalesce(q.n, 0) AS predicted
FROM (SELECT y AS label, count(*) AS n FROM fx_truth GROUP BY y) t
FULL OUTER JOIN (SELECT p AS label, count(*) AS n FROM fx_truth GROUP BY p) q USING (label)"""))
def q_eval_alignment(spark, sf_dir):
    return J.count_alignment(fx_truth(spark, sf_dir))


@query("eval_truth_shares", with_ctes(FX_REVIEWS_SQL, TAGGED_SQL, body=f"""
SELECT business_id,
       count(*) FILTER (WHERE {LBL.format(c='stars')} = 'positive') * {D} / count(*) AS pct_positive,
       count(*) FILTER (WHERE {LBL.format(c='stars')} = 'negative') * {D} / count(*) AS pct_negative,
       count(*) FILTER (WHERE {LBL.format(c='stars')} = 'neutral') * {D} / count(*) AS pct_neutral
FROM clean GROUP BY business_id"""))
def q_eval_truth_shares(spark, sf_dir):
    """Ground-truth label distribution after validation, per business."""
    clean = V.validate_reviews(fx_reviews(spark, sf_dir), ["business_id"])
    return J.label_shares(clean.withColumn("y", stars_to_label("stars")), "y", ["business_id"])


def _pred_sql(c="useful"):
    return f"CASE WHEN {c} >= 7 THEN 'positive' WHEN {c} <= 3 THEN 'negative' ELSE 'neutral' END"


def _pred_col():
    u = F.col("useful")
    return F.when(u >= 7, "positive").when(u <= 3, "negative").otherwise("neutral")


def _pct_sql(lbl: str, src: str, alias: str) -> str:
    return f"""{alias} AS (SELECT business_id,
     round_even(count(*) FILTER (WHERE {lbl} = 'positive') * {D} / count(*), 0) AS p,
     round_even(count(*) FILTER (WHERE {lbl} = 'negative') * {D} / count(*), 0) AS n FROM {src} GROUP BY business_id)"""


@query("eval_retrieval_mae", with_ctes(FX_REVIEWS_SQL, TAGGED_SQL, "src AS (SELECT * FROM clean)", body=TFIDF_SQL + f"""
, ragset AS (SELECT DISTINCT c.business_id, c.text, c.useful FROM top t JOIN clean c USING (review_id)),
{_pct_sql(LBL.format(c='stars'), 'clean', 'gt')},
{_pct_sql(_pred_sql(), 'clean', 'nr')},
{_pct_sql(_pred_sql(), 'ragset', 'wr')}
SELECT business_id,
  (abs(gt.p - nr.p) + abs(gt.n - nr.n) + abs((100 - gt.p - gt.n) - (100 - nr.p - nr.n))) / 3 AS mae_without_retrieval,
  (abs(gt.p - wr.p) + abs(gt.n - wr.n) + abs((100 - gt.p - gt.n) - (100 - wr.p - wr.n))) / 3 AS mae_with_retrieval
FROM gt JOIN nr USING (business_id) JOIN wr USING (business_id)"""))
def q_eval_retrieval_mae(spark, sf_dir):
    """J10 + J11: predicted sentiment shares over all clean reviews vs over the distinct
    retrieval set, each compared with the star-derived truth by 3-class MAE.  (The
    predictor here is a fixed rule on the ``useful`` column, standing in for a model.)"""
    from ..operators.lineage import write_table
    from ..operators.sentiment import sentiment_percentages
    # the clean table feeds the index, the candidates and three marts: validate it once
    clean = write_table(V.validate_reviews(fx_reviews(spark, sf_dir), ["business_id"]), "clean-reviews")
    hits = write_table(_topic_hits(spark, sf_dir, clean).select("business_id", "review_id"), "topic-hits")
    # at most 15 rows per business and topic, written: of known size, so that no text is shuffled to meet them
    ragset = (hits.join(clean.select("review_id", "text", "useful"), "review_id")
              .select("business_id", "text", "useful").distinct())
    gt = sentiment_percentages(clean.withColumn("label", stars_to_label("stars")), ["business_id"])
    nr = sentiment_percentages(clean.withColumn("label", _pred_col()), ["business_id"])
    wr = sentiment_percentages(ragset.withColumn("label", _pred_col()), ["business_id"])
    j = gt.alias("g").join(nr.alias("a"), "business_id").join(wr.alias("b"), "business_id")
    cols = ["positive", "negative", "neutral"]
    return j.select("business_id",
                    J.mae3([F.col(f"g.{c}") for c in cols], [F.col(f"a.{c}") for c in cols]).alias("mae_without_retrieval"),
                    J.mae3([F.col(f"g.{c}") for c in cols], [F.col(f"b.{c}") for c in cols]).alias("mae_with_retrieval"))


@query("eval_checker_coverage", with_ctes(FX_MODEL_RAW_SQL, FX_BATCH_CORPUS_SQL,
                                          body=_sentiment_sql().replace("\nSELECT batch_id, NOT failed AS ok",
                                                                        ", checked AS (\nSELECT batch_id, NOT failed AS ok")
                                          + f""")
SELECT count(*) AS cases, CAST(sum(n_errors) AS BIGINT) AS errors, CAST(sum(n_warnings) AS BIGINT) AS warnings,
       count(*) FILTER (WHERE n_errors > 0) AS fixed, count(*) FILTER (WHERE n_errors > 0) * {D} / count(*) AS pct_fixed
FROM checked WHERE ok"""))
def q_eval_checker_coverage(spark, sf_dir):
    """How many answers the checker had to fix."""
    return J.checker_coverage(checked_sentiment(spark, sf_dir))


__all__ = ["DRIVER_TOPICS", "_review_business"]
