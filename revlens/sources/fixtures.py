"""Review-shaped views over the driver's tables.

The driver ships TPC-H-like tables plus ``documents``/``labels``/``embeddings``; the
review operators need reviews, businesses, ground truth, batch results and raw model
answers.  Each view below is a pure projection/join of a driver table, so its size grows
with the scale factor.  ``*_SQL`` holds the identical definition for DuckDB (used as CTEs
inside the oracle queries).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


# --- reviews: one business per document source ---------------------------------------
def fx_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("seq"),
        F.col("doc_id").cast("string").alias("review_id"),
        F.col("source").alias("business_id"),
        F.concat(F.lit("Biz "), F.col("source")).alias("business_name"),
        # quarter steps 0..6: exercises half-even rounding and the 1..5 range check
        (((F.col("doc_id") * 7) % 25).cast("double") / 4).alias("stars"),
        F.col("text"),
        (F.col("doc_id") % 11).alias("useful"),
        F.col("lang"),
    )


FX_REVIEWS_SQL = """fx_reviews AS (
  SELECT doc_id AS seq, CAST(doc_id AS VARCHAR) AS review_id, source AS business_id,
         concat('Biz ', source) AS business_name,
         CAST(((doc_id*7) % 25) AS DOUBLE)/4 AS stars,
         text, doc_id % 11 AS useful, lang
  FROM documents)"""


# --- businesses: one per supplier -----------------------------------------------------
def fx_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    k = F.col("s_suppkey")
    cats = (F.when(k % 5 == 0, "Restaurants, Pizza").when(k % 5 == 1, "Fast Food,  Burgers")
            .when(k % 5 == 2, "Shopping").when(k % 5 == 3, "Sushi Bars, Nightlife"))
    # nation (25 rows) and region (5 rows) are fixed-size TPC-H dimensions: broadcast
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
            .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
            .select(k.alias("seq"), k.cast("string").alias("business_id"), F.col("s_name").alias("name"),
                    F.col("n_name").alias("city"), F.col("r_name").alias("state"),
                    (F.lit(2) + (k % 7)).cast("double").alias("stars_x2"),
                    ((k * 37) % 240).alias("review_count"), cats.alias("categories"))
            .withColumn("stars", F.col("stars_x2") / 2).drop("stars_x2"))


FX_BUSINESS_SQL = """fx_business AS (
  SELECT s_suppkey AS seq, CAST(s_suppkey AS VARCHAR) AS business_id, s_name AS name,
         n_name AS city, r_name AS state,
         ((s_suppkey*37) % 240) AS review_count,
         CASE s_suppkey % 5 WHEN 0 THEN 'Restaurants, Pizza' WHEN 1 THEN 'Fast Food,  Burgers'
              WHEN 2 THEN 'Shopping' WHEN 3 THEN 'Sushi Bars, Nightlife' ELSE NULL END AS categories,
         CAST(2 + (s_suppkey % 7) AS DOUBLE)/2 AS stars
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


# --- ground truth vs predictions for the evaluation metrics -------------------------
def fx_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read_table(spark, sf_dir, "labels")
    m = (F.col("doc_id") * 7) % 25
    return lab.select(
        "doc_id",
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
        .otherwise("neutral").alias("y"),
        F.when(m >= 16, "positive").when(m <= 8, "negative").otherwise("neutral").alias("p"),
    )


FX_TRUTH_SQL = """fx_truth AS (
  SELECT doc_id,
         CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS y,
         CASE WHEN (doc_id*7) % 25 >= 16 THEN 'positive' WHEN (doc_id*7) % 25 <= 8 THEN 'negative'
              ELSE 'neutral' END AS p
  FROM labels)"""


# --- per-batch model results (already parsed) ----------------------------------------
def fx_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("batch_id"), F.col("c_nationkey").alias("scope"),
        (1 + k % 100).alias("batch_size"),
        ((k * 13) % 101).alias("positive"), ((k * 29) % 61).alias("negative"),
        ((k * 3) % 17).alias("neutral"), F.col("c_mktsegment").alias("topic_word"),
    )


FX_BATCHES_SQL = """fx_batches AS (
  SELECT c_custkey AS batch_id, c_nationkey AS scope, 1 + c_custkey % 100 AS batch_size,
         (c_custkey*13) % 101 AS positive, (c_custkey*29) % 61 AS negative,
         (c_custkey*3) % 17 AS neutral, c_mktsegment AS topic_word
  FROM customer)"""


# --- raw text answers of a model, one per batch --------------------------------------
def fx_model_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    body = F.concat(
        F.lit('Answer: {"positive": '), ((k * 13) % 131 - 10).cast("string"),
        F.lit(', "negative": '), ((k * 29) % 61).cast("string"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(', "neutral": '), ((k * 3) % 17).cast("string"))),
        F.lit(', "summary": "'), F.when(k % 5 == 0, F.lit(" ")).otherwise(seg),
        F.lit('", "positive_highlights": ["'), F.lower(seg), F.lit('"], "negative_highlights": '),
        F.when(k % 11 == 0, F.lit('"late"')).otherwise(F.lit("[]")), F.lit("} done"),
    )
    return c.select(k.alias("batch_id"), F.col("c_nationkey").alias("scope"),
                    F.when(k % 9 == 0, F.lit("no json here")).otherwise(body).alias("raw"))


FX_MODEL_RAW_SQL = """fx_model_raw AS (
  SELECT c_custkey AS batch_id, c_nationkey AS scope,
         CASE WHEN c_custkey % 9 = 0 THEN 'no json here' ELSE concat(
           'Answer: {"positive": ', CAST((c_custkey*13) % 131 - 10 AS VARCHAR),
           ', "negative": ', CAST((c_custkey*29) % 61 AS VARCHAR),
           CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat(', "neutral": ', CAST((c_custkey*3) % 17 AS VARCHAR)) END,
           ', "summary": "', CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_mktsegment END,
           '", "positive_highlights": ["', lower(c_mktsegment), '"], "negative_highlights": ',
           CASE WHEN c_custkey % 11 = 0 THEN '"late"' ELSE '[]' END, '} done') END AS raw
  FROM customer)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- raw topic answers of a model, one per batch ---------------------------------------
TOPIC_NAMES = ["food_quality", "service", "price", "ambiance"]
_SENT4 = ["positive", "negative", "neutral", "excellent"]


def fx_topic_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic answers with the usual defects: missing topics, invalid sentiment, scores out
    of range or not numbers, negative or fractional mentions, keywords not a list, blank
    summaries; some answers fail outright (a topic without mentions, a topic that is a
    string, no JSON at all)."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    parts = []
    for i, t in enumerate(TOPIC_NAMES):
        ki = k + i
        x = (k * 7 + i) % 13
        sent = F.element_at(F.array(*[F.lit(s) for s in _SENT4]), (ki % 4 + 1).cast("int"))
        score = F.when(ki % 11 == 0, F.lit('"high"')).otherwise(
            F.concat((x / 2).cast("long").cast("string"), F.when(x % 2 == 1, F.lit(".5")).otherwise(F.lit(".0"))))
        ment = F.when(ki % 7 == 0, F.lit("2.0")).otherwise(((k * 3 + i) % 9 - 2).cast("string"))
        kws = F.when(ki % 6 == 0, F.lit('"tasty"')).otherwise(
            F.concat(F.lit('["'), F.lower(seg), F.lit('", "ok", "the"]')))
        summ = F.when(ki % 8 == 0, F.lit('" "')).otherwise(F.concat(F.lit('"'), seg, F.lit(' note"')))
        body = F.concat(F.lit(f'"{t}": {{"sentiment": "'), sent, F.lit('", "score": '), score,
                        F.when(k % 23 == 0, F.lit("")).otherwise(F.concat(F.lit(', "mentions": '), ment)),
                        F.lit(', "keywords": '), kws, F.lit(', "summary": '), summ, F.lit("}"))
        if t == "service":
            body = F.when(k % 29 == 0, F.lit('"service": "good"')).otherwise(body)
        parts.append(F.when(ki % 5 != 0, body))
    raw = F.when(k % 31 == 0, F.lit("sorry, no answer")).otherwise(
        F.concat(F.lit("```json\n{"), F.concat_ws(", ", *parts), F.lit("}\n```")))
    return c.select(k.alias("batch_id"), F.col("c_nationkey").alias("scope"), raw.alias("raw"))


def _topic_raw_sql() -> str:
    parts = []
    for i, t in enumerate(TOPIC_NAMES):
        ki = f"(c_custkey + {i})"
        x = f"((c_custkey * 7 + {i}) % 13)"
        sent = "CASE " + ki + " % 4 " + " ".join(f"WHEN {j} THEN '{s}'" for j, s in enumerate(_SENT4)) + " END"
        score = (f"CASE WHEN {ki} % 11 = 0 THEN '\"high\"' ELSE CAST(CAST(floor({x} / 2) AS BIGINT) AS VARCHAR) || "
                 f"CASE WHEN {x} % 2 = 1 THEN '.5' ELSE '.0' END END")
        ment = f"CASE WHEN {ki} % 7 = 0 THEN '2.0' ELSE CAST((c_custkey * 3 + {i}) % 9 - 2 AS VARCHAR) END"
        kws = f"CASE WHEN {ki} % 6 = 0 THEN '\"tasty\"' ELSE '[\"' || lower(c_mktsegment) || '\", \"ok\", \"the\"]' END"
        summ = f"CASE WHEN {ki} % 8 = 0 THEN '\" \"' ELSE '\"' || c_mktsegment || ' note\"' END"
        body = (f"'\"{t}\": {{\"sentiment\": \"' || ({sent}) || '\", \"score\": ' || ({score}) || "
                f"(CASE WHEN c_custkey % 23 = 0 THEN '' ELSE ', \"mentions\": ' || ({ment}) END) || "
                f"', \"keywords\": ' || ({kws}) || ', \"summary\": ' || ({summ}) || '}}'")
        if t == "service":
            body = f"CASE WHEN c_custkey % 29 = 0 THEN '\"service\": \"good\"' ELSE {body} END"
        parts.append(f"CASE WHEN {ki} % 5 <> 0 THEN {body} END")
    return ("fx_topic_raw AS (\n  SELECT c_custkey AS batch_id, c_nationkey AS scope,\n"
            "         CASE WHEN c_custkey % 31 = 0 THEN 'sorry, no answer' ELSE\n"
            "           '```json' || chr(10) || '{' || concat_ws(', ', " + ", ".join(parts) + ") || '}' || chr(10) || '```'"
            " END AS raw\n  FROM customer)")


FX_TOPIC_RAW_SQL = _topic_raw_sql()


# --- the reviews a batch's answer is checked against: the document with the batch's id ---
def fx_batch_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("batch_id"), F.col("doc_id").alias("seq"), "text")


FX_BATCH_CORPUS_SQL = """fx_batch_corpus AS (
  SELECT doc_id AS batch_id, lower(text) AS corpus FROM documents)"""


# --- checked per-batch results with highlights, summaries, topics ----------------------
def fx_batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_batches as checked sentiment results: every 17th batch failed; every 50th batch
    is the only batch of its own scope (single-result pass-through)."""
    b = fx_batches(spark, sf_dir)
    k = F.col("batch_id")
    return b.select(
        F.when(k % 50 == 0, F.lit(100) + k).otherwise(F.col("scope")).alias("scope"),
        "batch_id", "batch_size", (k % 17 != 0).alias("ok"),
        F.col("positive").cast("double").alias("positive"), F.col("negative").cast("double").alias("negative"),
        F.col("neutral").cast("double").alias("neutral"),
        F.concat(F.col("topic_word"), F.lit("#"), k.cast("string")).alias("summary"),
        F.array(F.lower("topic_word"), F.concat(F.lit("h"), (k % 7).cast("string"))).alias("positive_highlights"),
        F.array(F.concat(F.lit("late"), (k % 3).cast("string"))).alias("negative_highlights"),
        "topic_word")


FX_BATCH_RESULTS_SQL = FX_BATCHES_SQL + """,
fx_batch_results AS (
  SELECT CASE WHEN batch_id % 50 = 0 THEN 100 + batch_id ELSE scope END AS scope, batch_id, batch_size,
         batch_id % 17 <> 0 AS ok, CAST(positive AS DOUBLE) AS positive, CAST(negative AS DOUBLE) AS negative,
         CAST(neutral AS DOUBLE) AS neutral, topic_word || '#' || CAST(batch_id AS VARCHAR) AS summary,
         [lower(topic_word), 'h' || CAST(batch_id % 7 AS VARCHAR)] AS positive_highlights,
         ['late' || CAST(batch_id % 3 AS VARCHAR)] AS negative_highlights, topic_word
  FROM fx_batches)"""

_SENT_VOTES = ["positive", "negative", "neutral", "mixed"]


def fx_topic_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic rows of the successful batches of ``fx_batch_results``: each batch speaks
    about topic ``batch_id % 4`` and, every third batch, also about ``(batch_id + 2) % 4``."""
    r = fx_batch_results(spark, sf_dir).filter("ok")
    k = F.col("batch_id")
    topics = F.array(*[F.lit(t) for t in TOPIC_NAMES])
    first = F.element_at(topics, (k % 4 + 1).cast("int"))
    second = F.element_at(topics, ((k + 2) % 4 + 1).cast("int"))
    t = F.when(k % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    sent = F.element_at(F.array(*[F.lit(s) for s in _SENT_VOTES]), (F.floor(k / 4) % 4 + 1).cast("int"))
    return r.select("scope", "batch_id", "batch_size", F.explode(t).alias("topic"),
                    sent.alias("sentiment"),
                    (F.lit(1.0) + (F.col("positive").cast("long") % 17).cast("double") / 4).alias("score"),
                    F.col("negative").cast("long").alias("mentions"),
                    F.array(F.lower("topic_word"), F.concat(F.lit("kw"), (k % 5).cast("string"))).alias("keywords"),
                    "summary")


FX_TOPIC_RESULTS_SQL = """fx_topic_results AS (
  SELECT scope, batch_id, batch_size, unnest(CASE WHEN batch_id % 3 = 0
           THEN [['food_quality', 'service', 'price', 'ambiance'][batch_id % 4 + 1],
                 ['food_quality', 'service', 'price', 'ambiance'][(batch_id + 2) % 4 + 1]]
           ELSE [['food_quality', 'service', 'price', 'ambiance'][batch_id % 4 + 1]] END) AS topic,
         ['positive', 'negative', 'neutral', 'mixed'][CAST(floor(batch_id / 4) AS BIGINT) % 4 + 1] AS sentiment,
         1.0 + CAST(CAST(positive AS BIGINT) % 17 AS DOUBLE) / 4 AS score, CAST(negative AS BIGINT) AS mentions,
         [lower(topic_word), 'kw' || CAST(batch_id % 5 AS VARCHAR)] AS keywords, summary
  FROM fx_batch_results WHERE ok)"""


# --- raw report answers, one per batch -------------------------------------------------
def fx_report_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    seg = F.lower(F.col("c_mktsegment"))
    score = F.concat((F.lit(1) + k % 4).cast("string"), F.lit("."), (k % 10).cast("string"))
    body = F.concat(
        F.lit('{"business_name": "'), F.col("c_name"), F.lit('", "total_reviews": '), (k % 500).cast("string"),
        F.lit(', "overall_score": '), score,
        F.lit(', "sentiment_overview": {"positive": '), (k % 61).cast("string"), F.lit(', "negative": '),
        (k % 23).cast("string"), F.lit(', "neutral": '), (100 - k % 61 - k % 23).cast("string"),
        F.lit('}, "strengths": ["'), seg, F.lit(' service"'),
        F.when(k % 3 == 0, F.lit(', "fast"')).otherwise(F.lit("")),
        F.lit('], "weaknesses": '), F.when(k % 4 == 0, F.lit('"none"')).otherwise(F.lit('["price"]')),
        F.lit(', "recommendations": ["train staff", "cut waiting time"], "executive_summary": "'), seg,
        F.lit(' customers"'), F.when(k % 5 == 0, F.lit("")).otherwise(F.lit(', "priority_action": "hire"')),
        F.lit("}"))
    return c.select(k.alias("batch_id"), F.when(k % 13 == 0, F.lit("I cannot help with that."))
                    .otherwise(F.concat(F.lit("Report:\n"), body)).alias("raw"))


FX_REPORT_RAW_SQL = """fx_report_raw AS (
  SELECT c_custkey AS batch_id,
         CASE WHEN c_custkey % 13 = 0 THEN 'I cannot help with that.' ELSE
           'Report:' || chr(10) || '{"business_name": "' || c_name || '", "total_reviews": '
           || CAST(c_custkey % 500 AS VARCHAR) || ', "overall_score": '
           || CAST(1 + c_custkey % 4 AS VARCHAR) || '.' || CAST(c_custkey % 10 AS VARCHAR)
           || ', "sentiment_overview": {"positive": ' || CAST(c_custkey % 61 AS VARCHAR) || ', "negative": '
           || CAST(c_custkey % 23 AS VARCHAR) || ', "neutral": ' || CAST(100 - c_custkey % 61 - c_custkey % 23 AS VARCHAR)
           || '}, "strengths": ["' || lower(c_mktsegment) || ' service"'
           || CASE WHEN c_custkey % 3 = 0 THEN ', "fast"' ELSE '' END
           || '], "weaknesses": ' || CASE WHEN c_custkey % 4 = 0 THEN '"none"' ELSE '["price"]' END
           || ', "recommendations": ["train staff", "cut waiting time"], "executive_summary": "'
           || lower(c_mktsegment) || ' customers"'
           || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ', "priority_action": "hire"' END || '}' END AS raw
  FROM customer)"""
