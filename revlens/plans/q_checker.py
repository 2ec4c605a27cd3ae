"""Queries for model input/output and the result checker."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checker as K
from ..operators import merge as G
from ..operators import modelio as M
from ..operators.joins import join_large
from ..operators.lineage import materialize
from ..sources.fixtures import (FX_BATCH_CORPUS_SQL, FX_MODEL_RAW_SQL, FX_REVIEWS_SQL, FX_TOPIC_RAW_SQL,
                                TOPIC_NAMES, fx_batch_corpus, fx_model_raw, fx_reviews, fx_topic_raw, with_ctes)
from .catalog import ORACLES, query
from .q_validate import WS, strip_sql

NUM_T = "('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN')"
INT_T = "('BIGINT', 'UBIGINT', 'BOOLEAN')"


def _words_sql(h: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({h}), '{WS}+'), lambda w: length(w) > 3)"


def _unsupported_sql(hl: str) -> str:
    return (f"len(list_filter({hl}, lambda h: len({_words_sql('h')}) > 0 AND "
            f"NOT list_bool_or(list_transform({_words_sql('h')}, lambda w: contains(corpus, w)))))")


# ---------------------------------------------------------------- sentiment
SENT_KEYS = ["positive", "negative", "neutral", "summary", "positive_highlights", "negative_highlights"]
PCT = ["positive", "negative", "neutral"]


def _sentiment_sql() -> str:
    t = {k: f"json_type(j, '$.{k}')" for k in SENT_KEYS}
    val = {k: (f"CASE WHEN {t[k]} IS NULL THEN CAST(0 AS DOUBLE) WHEN {t[k]} = 'BOOLEAN' "
               f"THEN CAST(json_extract_string(j, '$.{k}') = 'true' AS DOUBLE) "
               f"ELSE CAST(json_extract(j, '$.{k}') AS DOUBLE) END") for k in PCT}
    hl_fail = " OR ".join(
        f"({t[k]} IN ('NULL', 'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') OR ({t[k]} = 'ARRAY' AND "
        f"coalesce(list_bool_or(list_transform(json_extract(j, '$.{k}[*]'), lambda e: json_type(e) <> 'VARCHAR')), false)))"
        for k in ["positive_highlights", "negative_highlights"])
    fail = ("NOT valid OR coalesce(json_type(j) <> 'OBJECT', true) OR j ~ '^\\{\\s*\\}$' OR "
            + " OR ".join(f"({t[k]} IS NOT NULL AND {t[k]} NOT IN {NUM_T})" for k in PCT)
            + f" OR ({t['summary']} IS NOT NULL AND {t['summary']} <> 'VARCHAR') OR " + hl_fail)
    hl = {k: f"CASE WHEN {t[k]} = 'ARRAY' THEN CAST(json_extract(j, '$.{k}') AS VARCHAR[]) ELSE [] END"
          for k in ["positive_highlights", "negative_highlights"]}
    return f"""
, p AS (SELECT r.batch_id, regexp_extract(r.raw, '(?s)\\{{.*\\}}', 0) AS j, coalesce(c.corpus, '') AS corpus
        FROM fx_model_raw r LEFT JOIN fx_batch_corpus c USING (batch_id)),
q AS (SELECT * REPLACE (CASE WHEN j <> '' AND coalesce(json_valid(j), false) THEN j END AS j),
             j <> '' AND coalesce(json_valid(j), false) AS valid FROM p),
s AS (SELECT batch_id, corpus, ({fail}) AS failed,
             {val['positive']} AS vp, {val['negative']} AS vn, {val['neutral']} AS vu,
             json_extract_string(j, '$.summary') AS summ, {t['summary']} AS tsum,
             {hl['positive_highlights']} AS ph, {hl['negative_highlights']} AS nh,
             {' + '.join(f"CAST({t[k]} IS NULL AS INTEGER)" for k in SENT_KEYS)} AS e_missing,
             {' + '.join(f"CAST({t[k]} IS DISTINCT FROM 'ARRAY' AS INTEGER)"
                         for k in ['positive_highlights', 'negative_highlights'])} AS e_list
      FROM q),
f AS (SELECT *, vp + vn + vu AS total FROM s),
g AS (SELECT *,
        CASE WHEN total <> 100 AND total > 0 THEN round_even(vp / total * 100, 0) WHEN total <> 100 THEN 34 ELSE vp END AS p2,
        CASE WHEN total <> 100 AND total > 0 THEN round_even(vn / total * 100, 0) WHEN total <> 100 THEN 33 ELSE vn END AS n2
      FROM f),
h AS (SELECT *, CASE WHEN total <> 100 AND total > 0 THEN 100 - p2 - n2 WHEN total <> 100 THEN 33 ELSE vu END AS u2,
             tsum IS NULL OR {strip_sql('summ')} = '' AS blank FROM g)
SELECT batch_id, NOT failed AS ok,
       CASE WHEN NOT failed THEN CASE WHEN vp < 0 THEN 0 WHEN vp > 100 THEN 100 ELSE p2 END END AS positive,
       CASE WHEN NOT failed THEN CASE WHEN vn < 0 THEN 0 WHEN vn > 100 THEN 100 ELSE n2 END END AS negative,
       CASE WHEN NOT failed THEN CASE WHEN vu < 0 THEN 0 WHEN vu > 100 THEN 100 ELSE u2 END END AS neutral,
       CASE WHEN NOT failed THEN CASE WHEN blank THEN '{K.DEFAULT_SENTIMENT_SUMMARY}' ELSE summ END END AS summary,
       CASE WHEN NOT failed THEN array_to_string(ph, '|') END AS positive_highlights,
       CASE WHEN NOT failed THEN array_to_string(nh, '|') END AS negative_highlights,
       CAST(CASE WHEN NOT failed THEN e_missing + e_list
            + CAST(vp < 0 OR vp > 100 AS INTEGER) + CAST(vn < 0 OR vn > 100 AS INTEGER)
            + CAST(vu < 0 OR vu > 100 AS INTEGER) END AS DOUBLE) AS n_errors,
       CAST(CASE WHEN NOT failed THEN CAST(total <> 100 AS INTEGER) + CAST(blank AS INTEGER)
            + {_unsupported_sql('ph')} + {_unsupported_sql('nh')} END AS DOUBLE) AS n_warnings
FROM h"""


def checked_sentiment(spark, sf_dir):
    raw = fx_model_raw(spark, sf_dir)
    corpus = M.review_block(fx_batch_corpus(spark, sf_dir), ["batch_id"]).select("batch_id", "corpus")
    parsed = join_large(raw, corpus, "batch_id", "left").withColumn("v", M.extract_json("raw"))
    return K.check_sentiment(parsed)


@query("check_sentiment", with_ctes(FX_MODEL_RAW_SQL, FX_BATCH_CORPUS_SQL, body=_sentiment_sql()))
def q_check_sentiment(spark, sf_dir):
    c = checked_sentiment(spark, sf_dir)
    return c.select("batch_id", "ok", "positive", "negative", "neutral", "summary",
                    F.array_join("positive_highlights", "|").alias("positive_highlights"),
                    F.array_join("negative_highlights", "|").alias("negative_highlights"),
                    F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings")) \
        .withColumn("n_errors", F.when(F.col("ok"), F.col("n_errors")).cast("double")) \
        .withColumn("n_warnings", F.when(F.col("ok"), F.col("n_warnings")).cast("double"))


STATUS_SQL = """
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN NOT ok THEN 'FAILED' WHEN n_errors = 0 AND n_warnings = 0 THEN 'OK'
              WHEN n_errors > 0 THEN printf('%d errors', CAST(n_errors AS BIGINT)) ELSE printf('%d warnings', CAST(n_warnings AS BIGINT)) END AS status
  FROM checked) GROUP BY status"""


@query("check_status", with_ctes(FX_MODEL_RAW_SQL, FX_BATCH_CORPUS_SQL,
                                 body=_sentiment_sql().replace("\nSELECT batch_id, NOT failed AS ok",
                                                               ", checked AS (\nSELECT batch_id, NOT failed AS ok")
                                 + ")" + STATUS_SQL))
def q_check_status(spark, sf_dir):
    """F16: answers per check status."""
    return K.check_status(checked_sentiment(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- topics
def _topic_sql() -> str:
    cols, errs, warns, fails = [], [], [], []
    for t in TOPIC_NAMES:
        b = f"'$.{t}"
        ty = {x: f"json_type(j, {b}.{x}')" for x in ["score", "mentions", "keywords", "summary", "sentiment"]}
        pres = f"(json_type(j, {b}') IS NOT NULL)"
        score_num = f"({ty['score']} IN {NUM_T})"
        score = f"TRY_CAST(json_extract(j, {b}.score') AS DOUBLE)"
        oor = f"({score_num} AND ({score} < 1 OR {score} > 5))"
        fscore = (f"(CASE WHEN NOT {pres} THEN 3.0 WHEN NOT {score_num} THEN 3.0 "
                  f"WHEN {oor} THEN round_even(greatest(1.0, least(5.0, {score})), 1) ELSE {score} END)")
        sent = f"(CASE WHEN {ty['sentiment']} = 'VARCHAR' THEN json_extract_string(j, {b}.sentiment') END)"
        sent_ok = f"coalesce({sent} IN ('positive', 'negative', 'neutral'), false)"
        fsent = f"(CASE WHEN {pres} AND {sent_ok} THEN {sent} ELSE 'neutral' END)"
        ment_ok = (f"({ty['mentions']} IN {INT_T} AND TRY_CAST(json_extract(j, {b}.mentions') AS DOUBLE) >= 0)")
        fment = f"(CASE WHEN {pres} AND {ment_ok} THEN TRY_CAST(json_extract(j, {b}.mentions') AS BIGINT) ELSE 0 END)"
        kws = (f"(CASE WHEN {pres} AND {ty['keywords']} = 'ARRAY' THEN list_filter(list_transform("
               f"json_extract(j, {b}.keywords[*]'), lambda e: CASE WHEN json_type(e) = 'VARCHAR' "
               f"THEN json_extract_string(e, '$') END), lambda x: x IS NOT NULL) ELSE [] END)")
        summ = f"json_extract_string(j, {b}.summary')"
        blank = f"({ty['summary']} IS NULL OR {strip_sql(summ)} = '')"
        fsumm = (f"(CASE WHEN NOT {pres} THEN '{K.DEFAULT_TOPIC_SUMMARY_MISSING}' "
                 f"WHEN {blank} THEN '{K.DEFAULT_TOPIC_SUMMARY_BLANK}' ELSE {summ} END)")
        fails.append(f"({pres} AND (json_type(j, {b}') <> 'OBJECT' OR {ty['score']} IS NULL OR {ty['mentions']} IS NULL"
                     f" OR ({ty['summary']} IS NOT NULL AND {ty['summary']} <> 'VARCHAR')))")
        cols.append(f"struct_pack(sentiment := {fsent}, score := {fscore}, mentions := {fment}, "
                    f"keywords := array_to_string({kws}, '|'), summary := {fsumm}) AS {t}")
        errs.append(f"CAST(NOT {pres} AS INTEGER) + CAST({pres} AND NOT {score_num} AS INTEGER) + "
                    f"CAST({pres} AND NOT {sent_ok} AS INTEGER) + "
                    f"CAST({pres} AND {ty['keywords']} IS DISTINCT FROM 'ARRAY' AS INTEGER)")
        warns.append(f"CAST({pres} AND {oor} AS INTEGER) + CAST({pres} AND NOT coalesce({ment_ok}, false) AS INTEGER) + "
                     f"len(list_filter({kws}, lambda k: length(k) > 3 AND NOT contains(corpus, lower(k)))) + "
                     f"CAST({pres} AND {blank} AS INTEGER) + "
                     f"CAST({fsent} = 'positive' AND {fscore} < 3.0 AS INTEGER) + "
                     f"CAST({fsent} = 'negative' AND {fscore} > 3.5 AS INTEGER)")
    return f"""
, a AS (SELECT r.batch_id, {strip_sql('r.raw')} AS s, coalesce(c.corpus, '') AS corpus
        FROM fx_topic_raw r LEFT JOIN fx_batch_corpus c USING (batch_id)),
b AS (SELECT batch_id, corpus, {strip_sql("CASE WHEN starts_with(s, '```') THEN CASE WHEN starts_with(coalesce(string_split(s, '```')[2], ''), 'json') THEN substr(string_split(s, '```')[2], 5) ELSE coalesce(string_split(s, '```')[2], '') END ELSE s END")} AS s2 FROM a),
c AS (SELECT batch_id, corpus, regexp_extract(s2, '(?s)\\{{.*\\}}', 0) AS j FROM b),
d AS (SELECT * REPLACE (CASE WHEN j <> '' AND coalesce(json_valid(j), false) THEN j END AS j),
             j <> '' AND coalesce(json_valid(j), false) AS valid FROM c),
e AS (SELECT batch_id,
             NOT (NOT valid OR coalesce(json_type(j) <> 'OBJECT', true) OR j ~ '^\\{{\\s*\\}}$' OR {' OR '.join(fails)}) AS ok,
             {', '.join(cols)},
             {' + '.join(errs)} AS n_errors, {' + '.join(warns)} AS n_warnings
      FROM d)"""


def checked_topics(spark, sf_dir):
    raw = fx_topic_raw(spark, sf_dir)
    corpus = M.review_block(fx_batch_corpus(spark, sf_dir), ["batch_id"]).select("batch_id", "corpus")
    parsed = join_large(raw, corpus, "batch_id", "left").withColumn("v", M.extract_json(M.strip_fence("raw")))
    return K.check_topics(parsed)


@query("check_topics", with_ctes(FX_TOPIC_RAW_SQL, FX_BATCH_CORPUS_SQL, body=_topic_sql() + """
SELECT batch_id, ok, CAST(CASE WHEN ok THEN n_errors END AS DOUBLE) AS n_errors,
       CAST(CASE WHEN ok THEN n_warnings END AS DOUBLE) AS n_warnings
FROM e"""))
def q_check_topics(spark, sf_dir):
    c = checked_topics(spark, sf_dir)
    return c.select("batch_id", "ok", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings")) \
        .withColumn("n_errors", F.when(F.col("ok"), F.col("n_errors")).cast("double")) \
        .withColumn("n_warnings", F.when(F.col("ok"), F.col("n_warnings")).cast("double"))


@query("topic_rows", with_ctes(FX_TOPIC_RAW_SQL, FX_BATCH_CORPUS_SQL, body=_topic_sql() + """
SELECT batch_id, x.topic AS topic, x.r.sentiment AS sentiment, x.r.score AS score, x.r.mentions AS mentions,
       x.r.keywords AS keywords, x.r.summary AS summary
FROM (SELECT batch_id, unnest([""" + ", ".join(f"{{'topic': '{t}', 'r': {t}}}" for t in TOPIC_NAMES) + """]) AS x
      FROM e WHERE ok)"""))
def q_topic_rows(spark, sf_dir):
    long = K.topics_long(checked_topics(spark, sf_dir), ["batch_id"])
    return long.select("batch_id", "topic", "sentiment", "score", "mentions",
                       F.array_join("keywords", "|").alias("keywords"), "summary")


# ---------------------------------------------------------------- F6 / F13 on review rows, without a corpus string
def _by_rows(spark, sf_dir, raw, parse, phrases, check):
    # written once: five branches read the answers, and each would parse them again for every reference to a phrase
    answers = materialize(raw.withColumn("v", parse).withColumn("phrases", phrases))
    found = K.supported_phrases(answers, fx_batch_corpus(spark, sf_dir), ["batch_id"])
    return check(join_large(answers, found, "batch_id", "left"), supported="supported")


@query("check_sentiment_by_rows", ORACLES["check_sentiment"])
def q_check_sentiment_by_rows(spark, sf_dir):
    """F0-F7 with the highlights looked up in the review rows."""
    c = _by_rows(spark, sf_dir, fx_model_raw(spark, sf_dir), M.extract_json("raw"), K.sentiment_phrases(), K.check_sentiment)
    return c.select("batch_id", "ok", "positive", "negative", "neutral", "summary",
                    *[F.array_join(k, "|").alias(k) for k in ("positive_highlights", "negative_highlights")],
                    *[F.when(F.col("ok"), F.size(k)).cast("double").alias(f"n_{k}") for k in ("errors", "warnings")])


@query("check_topics_by_rows", ORACLES["check_topics"])
def q_check_topics_by_rows(spark, sf_dir):
    """F8-F15 with the keywords looked up in the review rows."""
    c = _by_rows(spark, sf_dir, fx_topic_raw(spark, sf_dir), M.extract_json(M.strip_fence("raw")), K.topic_phrases(), K.check_topics)
    return c.select("batch_id", "ok", *[F.when(F.col("ok"), F.size(k)).cast("double").alias(f"n_{k}") for k in ("errors", "warnings")])


# ---------------------------------------------------------------- E1 review blocks
@query("review_blocks", with_ctes(FX_REVIEWS_SQL, body="""
, b AS (SELECT *, floor((row_number() OVER (PARTITION BY business_id ORDER BY seq) - 1) / 20) AS batch_id
        FROM fx_reviews)
SELECT business_id, CAST(batch_id AS BIGINT) AS batch_id, count(*) AS n_reviews,
       md5(string_agg('- ' || text, chr(10) ORDER BY seq)) AS block_md5,
       md5(lower(string_agg(text, ' ' ORDER BY seq))) AS corpus_md5
FROM b GROUP BY ALL"""))
def q_review_blocks(spark, sf_dir):
    b = G.split_batches(fx_reviews(spark, sf_dir), ["business_id"], "seq", batch_size=20)
    blk = M.review_block(b, ["business_id", "batch_id"])
    return blk.select("business_id", "batch_id", "n_reviews", F.md5("block").alias("block_md5"),
                      F.md5("corpus").alias("corpus_md5"))


# ---------------------------------------------------------------- E6 report answers
from ..sources.fixtures import FX_REPORT_RAW_SQL, fx_report_raw  # noqa: E402


@query("report_answers", with_ctes(FX_REPORT_RAW_SQL, body="""
, p AS (SELECT batch_id, regexp_extract(raw, '(?s)\\{.*\\}', 0) AS j0 FROM fx_report_raw),
q AS (SELECT batch_id, CASE WHEN j0 <> '' AND json_valid(j0) THEN j0 END AS j FROM p)
SELECT batch_id, j IS NOT NULL AS ok,
       json_extract_string(j, '$.business_name') AS business_name,
       CAST(CAST(json_extract(j, '$.total_reviews') AS BIGINT) AS DOUBLE) AS total_reviews,
       CAST(json_extract(j, '$.overall_score') AS DOUBLE) AS overall_score,
       CAST(json_extract(j, '$.sentiment_overview.positive') AS DOUBLE) AS positive,
       CAST(json_extract(j, '$.sentiment_overview.negative') AS DOUBLE) AS negative,
       CAST(json_extract(j, '$.sentiment_overview.neutral') AS DOUBLE) AS neutral,
       CASE WHEN json_type(j, '$.strengths') = 'ARRAY'
            THEN array_to_string(CAST(json_extract(j, '$.strengths') AS VARCHAR[]), '|') END AS strengths,
       CASE WHEN json_type(j, '$.weaknesses') = 'ARRAY'
            THEN array_to_string(CAST(json_extract(j, '$.weaknesses') AS VARCHAR[]), '|') END AS weaknesses,
       json_extract_string(j, '$.priority_action') AS priority_action
FROM q"""))
def q_report_answers(spark, sf_dir):
    """Report answers parsed into the typed report struct; a wrong type (weaknesses as
    a string) or an absent field reads as NULL, no JSON at all -> not ok."""
    r = fx_report_raw(spark, sf_dir).withColumn("rep", M.parse_report(M.extract_json("raw")))
    return r.select("batch_id", F.col("rep").isNotNull().alias("ok"), "rep.business_name",
                    F.col("rep.total_reviews").cast("double").alias("total_reviews"),
                    "rep.overall_score", F.col("rep.sentiment_overview.positive").alias("positive"),
                    F.col("rep.sentiment_overview.negative").alias("negative"),
                    F.col("rep.sentiment_overview.neutral").alias("neutral"),
                    F.array_join("rep.strengths", "|").alias("strengths"),
                    F.array_join("rep.weaknesses", "|").alias("weaknesses"), "rep.priority_action")
