"""Queries for report marts (H1-H8) over merged batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as G
from ..operators import report as H
from ..sources.fixtures import fx_batch_results, fx_topic_results
from .catalog import query
from .q_merge import MERGE_SENT_SQL, _merge_topics_sql


def _marts(spark, sf_dir):
    res = fx_batch_results(spark, sf_dir)
    sent = G.merge_sentiment(res, scope=["scope"])
    br = res.filter("ok").select("scope", "batch_id", "batch_size")
    top = G.merge_topics(fx_topic_results(spark, sf_dir), br, scope=["scope"])
    return sent, top


def _cat_sql() -> str:
    rows = ", ".join(f"('{t}', {m}, {p}, '{a}')" for t, m, p, a in H.ACTION_CATALOGUE)
    return f"cat(topic, max_score, priority, action) AS (VALUES {rows})"


REPORT_SQL = f"""WITH ms AS ({MERGE_SENT_SQL}),
mt AS ({_merge_topics_sql('all')}),
{_cat_sql()},
t AS (SELECT scope, topic, sentiment, score, mentions,
             list_position(['food_quality', 'service', 'price', 'ambiance'], topic) AS topic_ord FROM mt),
ov AS (SELECT scope, round_even(avg(score) FILTER (WHERE mentions > 0), 1) AS overall_score FROM t GROUP BY scope),
st AS (SELECT scope, string_agg(topic, '|' ORDER BY r) AS strengths FROM (
         SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, topic_ord) AS r FROM t
         WHERE sentiment = 'positive') WHERE r <= 3 GROUP BY scope),
wk AS (SELECT scope, string_agg(topic, '|' ORDER BY r) AS weaknesses FROM (
         SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score, topic_ord) AS r FROM t
         WHERE sentiment = 'negative') WHERE r <= 3 GROUP BY scope),
rc AS (SELECT scope, string_agg(action, '|' ORDER BY r) AS recommendations,
              min(CASE WHEN r = 1 THEN action END) AS priority_action FROM (
         SELECT t.scope, cat.action, row_number() OVER (PARTITION BY t.scope ORDER BY priority, score, topic_ord, action) AS r
         FROM t JOIN cat USING (topic) WHERE score <= max_score) WHERE r <= 4 GROUP BY scope)"""


@query("business_report", REPORT_SQL + """
SELECT ms.scope, overall_score, positive, negative, neutral, coalesce(strengths, '') AS strengths,
       coalesce(weaknesses, '') AS weaknesses, coalesce(recommendations, '') AS recommendations, priority_action
FROM ms JOIN ov USING (scope) LEFT JOIN st USING (scope) LEFT JOIN wk USING (scope) LEFT JOIN rc USING (scope)""")
def q_business_report(spark, sf_dir):
    """H1-H5: overall score, strengths, weaknesses, recommendations per scope."""
    sent, top = _marts(spark, sf_dir)
    rep = H.build_report(sent, top, H.action_catalogue(spark), scope=["scope"])
    return rep.select("scope", "overall_score", "positive", "negative", "neutral",
                      F.array_join("strengths", "|").alias("strengths"),
                      F.array_join("weaknesses", "|").alias("weaknesses"),
                      F.array_join("recommendations", "|").alias("recommendations"), "priority_action")


@query("report_envelope")
def q_report_envelope(spark, sf_dir):
    """H6: report rows with the nested metadata struct (shape check)."""
    sent, top = _marts(spark, sf_dir)
    rep = H.build_report(sent, top, H.action_catalogue(spark), scope=["scope"])
    stats = fx_batch_results(spark, sf_dir).groupBy("scope").agg(
        F.count(F.lit(1)).alias("batches"), F.count_if("ok").alias("ok_batches"))
    env = H.envelope(rep, stats, sent, top, scope=["scope"])
    return env.select("scope", "overall_score", F.to_json("metadata").alias("metadata_json"))


@query("report_errors", """
WITH c AS (SELECT c_custkey AS k, c_nationkey AS scope FROM customer),
req AS (SELECT DISTINCT CASE WHEN k % 50 = 0 THEN 100 + k ELSE scope END AS scope FROM c),
okb AS (SELECT DISTINCT CASE WHEN k % 50 = 0 THEN 100 + k ELSE scope END AS scope FROM c WHERE k % 17 <> 0)
SELECT scope, 'sentiment_failed' AS error FROM req WHERE scope NOT IN (SELECT scope FROM okb)""")
def q_report_errors(spark, sf_dir):
    """H7: requested scopes without a report and the first failing stage (here: scopes
    whose only batch failed)."""
    res = fx_batch_results(spark, sf_dir)
    sent, top = _marts(spark, sf_dir)
    rep = H.build_report(sent, top, H.action_catalogue(spark), scope=["scope"])
    requested = res.select("scope").distinct()
    return H.error_rows(requested, res, res, sent, top, rep, scope=["scope"])


@query("chart_data", REPORT_SQL + """
, g AS (SELECT ms.scope, x.topic, x.o FROM ms, (VALUES ('food_quality', 0), ('service', 1), ('price', 2), ('ambiance', 3)) x(topic, o))
SELECT scope, 'sentiment' AS chart, 0 AS ord, 'positive' AS item, CAST(coalesce(positive, 0) AS DOUBLE) AS value FROM ms
UNION ALL SELECT scope, 'sentiment', 1, 'negative', CAST(coalesce(negative, 0) AS DOUBLE) FROM ms
UNION ALL SELECT scope, 'sentiment', 2, 'neutral', CAST(coalesce(neutral, 0) AS DOUBLE) FROM ms
UNION ALL SELECT g.scope, 'topic_score', g.o, g.topic, CAST(coalesce(t.score, 0) AS DOUBLE)
          FROM g LEFT JOIN t ON g.scope = t.scope AND g.topic = t.topic
UNION ALL SELECT g.scope, 'topic_mentions', g.o, g.topic, CAST(coalesce(t.mentions, 0) AS DOUBLE)
          FROM g LEFT JOIN t ON g.scope = t.scope AND g.topic = t.topic""")
def q_chart_data(spark, sf_dir):
    """H8: chart table (sentiment slices, topic scores, topic mentions; missing = 0)."""
    sent, top = _marts(spark, sf_dir)
    return H.chart_data(sent, top, scope=["scope"])
