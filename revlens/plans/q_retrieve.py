"""Queries for retrieval."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import collections as CO
from ..operators import retrieve as D
from ..operators import vector_index as VI
from ..operators.modelio import TOPICS
from ..session import ensure_checkpoint_dir
from ..sources.fixtures import FX_BUSINESS_SQL, FX_REVIEWS_SQL, fx_business, fx_reviews, read_table, with_ctes
from .catalog import query

# Topic lexicon for the driver's documents (the default food/service/price words do not
# occur in them): frequent words of the generated prose.
DRIVER_TOPICS = {"food_quality": "that with", "service": "this from", "price": "ther than", "ambiance": "les des"}


def _cos_sql(a: str, b: str) -> str:
    dot = f"list_reduce(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2]), lambda acc, x: acc + x, 0.0)"
    na = f"sqrt(list_reduce(list_transform({a}, lambda x: x * x), lambda acc, x: acc + x, 0.0))"
    nb = f"sqrt(list_reduce(list_transform({b}, lambda x: x * x), lambda acc, x: acc + x, 0.0))"
    return f"({dot} / ({na} * {nb}))"


EMBEDDING_TOPK_SQL = f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT label, unnest(v) AS x, unnest(generate_series(1, len(v))) AS i FROM e),
c AS (SELECT label AS query, list(m ORDER BY i) AS qv FROM (
        SELECT label, i, avg(x) AS m FROM x GROUP BY label, i) GROUP BY label),
s AS (SELECT c.query, e.vec_id, e.label, {_cos_sql('e.v', 'c.qv')} AS score FROM e, c)
SELECT query, rank, vec_id, label, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s) WHERE rank <= 15"""


@query("embedding_topk", EMBEDDING_TOPK_SQL)
def q_embedding_topk(spark, sf_dir):
    """D2-D4 on precomputed vectors: the 15 vectors nearest to each label centroid, with
    the document's own metadata (label) carried on the row."""
    emb = read_table(spark, sf_dir, "embeddings")
    hits = D.cosine_topk(emb, D.label_centroids(emb), k=15, id_col="vec_id")
    return (hits.join(emb.select("vec_id", "label"), "vec_id")
            .select("query", "rank", "vec_id", "label", F.round("score", 6).alias("score")))


def _embedding_index(spark, sf_dir):
    """The written index of the table's embeddings, below the session's shared folder."""
    emb = read_table(spark, sf_dir, "embeddings")
    path = os.path.join(ensure_checkpoint_dir(spark), "vector-index", uuid.uuid4().hex)
    return emb, path, VI.build_index(emb, path, scope=["label"], id_col="vec_id")


@query("indexed_topk", EMBEDDING_TOPK_SQL)
def q_indexed_topk(spark, sf_dir):
    """D3 through the written index with every cluster probed: equals the exact lists."""
    emb, path, clusters = _embedding_index(spark, sf_dir)
    hits = VI.index_topk(spark, path, D.label_centroids(emb), k=15, probes=clusters, id_col="vec_id")
    return hits.join(emb.select("vec_id", "label"), "vec_id").select("query", "rank", "vec_id", "label", F.round("score", 6).alias("score"))


@query("index_recall", """
SELECT vec_id AS query, least(10, (SELECT count(*) FROM embeddings)) AS n_exact, true AS enough FROM embeddings WHERE vec_id % 50 = 0""")
def q_index_recall(spark, sf_dir):
    """D3: every vector with an id divisible by 50 asks the index for its 10 nearest, with two thirds of the clusters
    probed (the table's vectors lie in all directions); per query, whether 0.9 of its exact list is found."""
    emb, path, clusters = _embedding_index(spark, sf_dir)
    queries = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"))
    found = VI.index_topk(spark, path, queries, k=10, probes=-(-2 * clusters // 3), id_col="vec_id")
    each = VI.recall(found, D.cosine_topk(emb, queries, k=10, id_col="vec_id"), ["query"], "vec_id")
    return each.select("query", "n_exact", (F.col("recall") >= 0.9).alias("enough"))


def _q_sql() -> str:
    rows = ", ".join(f"('{t}', {i}, '{DRIVER_TOPICS[t]}')" for i, t in enumerate(TOPICS))
    return f"q(topic, topic_ord, query) AS (VALUES {rows})"


TFIDF_SQL = f"""
, {_q_sql()},
toks AS (SELECT business_id, review_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM src),
tf AS (SELECT business_id, review_id, term, count(*) AS tf FROM toks GROUP BY ALL),
nd AS (SELECT business_id, count(*) AS n_docs FROM src GROUP BY ALL),
idf AS (SELECT business_id, term, ln((n_docs + 1) / (count(*) + 1)) + 1 AS idf
        FROM tf JOIN nd USING (business_id) GROUP BY business_id, term, n_docs),
w AS (SELECT business_id, review_id, term, tf * idf AS w, idf FROM tf JOIN idf USING (business_id, term)),
norms AS (SELECT business_id, review_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
qt AS (SELECT topic, term, count(*) AS qtf FROM (SELECT topic, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM q) GROUP BY ALL),
dots AS (SELECT business_id, review_id, topic, sum(w * qtf * idf) AS dot FROM w JOIN qt USING (term) GROUP BY ALL),
qn AS (SELECT business_id, topic, sqrt(sum((qtf * idf) * (qtf * idf))) AS qnorm FROM idf JOIN qt USING (term) GROUP BY ALL),
hits AS (SELECT business_id, review_id, topic, dot / (norm * qnorm) AS score
         FROM dots JOIN norms USING (business_id, review_id) JOIN qn USING (business_id, topic)),
base AS (SELECT business_id, review_id, topic FROM src, q),
scored AS (SELECT b.business_id, b.review_id, b.topic, coalesce(h.score, 0.0) AS score
           FROM base b LEFT JOIN hits h USING (business_id, review_id, topic)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id, topic ORDER BY round(score, 12) DESC, review_id) AS rank
                       FROM scored) WHERE rank <= 15)"""


def _topic_hits(spark, sf_dir, reviews=None):
    r = reviews if reviews is not None else fx_reviews(spark, sf_dir)
    return D.tfidf_topk(r, D.topic_query_table(spark, DRIVER_TOPICS), k=15, scope=["business_id"])


@query("text_topic_topk", with_ctes(FX_REVIEWS_SQL, "src AS (SELECT * FROM fx_reviews)", body=TFIDF_SQL + """
SELECT business_id, topic, rank, review_id, round(score, 6) AS score FROM top"""))
def q_text_topic_topk(spark, sf_dir):
    """D1 (built-in TF-IDF) + D4: top 15 reviews per business and topic."""
    h = _topic_hits(spark, sf_dir)
    return h.select("business_id", "topic", "rank", "review_id", F.round("score", 6).alias("score"))


@query("topic_union", with_ctes(FX_REVIEWS_SQL, "src AS (SELECT * FROM fx_reviews)", body=TFIDF_SQL + """
, j AS (SELECT t.business_id, r.text, q.topic_ord, t.rank FROM top t JOIN q USING (topic)
        JOIN fx_reviews r ON r.review_id = t.review_id),
f AS (SELECT business_id, text, min(topic_ord * 1000 + rank) AS o FROM j GROUP BY ALL)
SELECT business_id, md5(text) AS text_md5, CAST(o // 1000 AS INTEGER) AS topic_ord, o % 1000 AS rank,
       row_number() OVER (PARTITION BY business_id ORDER BY o) AS union_rank FROM f"""))
def q_topic_union(spark, sf_dir):
    """Distinct texts of the four topic lists, in topic then rank order."""
    r = fx_reviews(spark, sf_dir)
    h = _topic_hits(spark, sf_dir, r).join(D.topic_query_table(spark, DRIVER_TOPICS).select("topic", "topic_ord"), "topic")
    h = h.join(r.select("review_id", "text"), "review_id")
    u = D.union_topic_hits(h, ["business_id"])
    return u.select("business_id", F.md5("text").alias("text_md5"), "topic_ord", F.col("rank").cast("long"),
                    "union_rank")


@query("retrieval_fallback", with_ctes(FX_REVIEWS_SQL, "src AS (SELECT * FROM fx_reviews WHERE lang = 'de')",
                                       body=TFIDF_SQL + """
, sel AS (SELECT DISTINCT business_id, review_id FROM top)
SELECT business_id, review_id, 'retrieval' AS source FROM sel
UNION ALL
SELECT business_id, review_id, 'all_reviews' FROM fx_reviews
WHERE business_id NOT IN (SELECT business_id FROM sel)"""))
def q_retrieval_fallback(spark, sf_dir):
    """Retrieval ran over the German reviews only; businesses without any use all
    their reviews."""
    r = fx_reviews(spark, sf_dir)
    hits = _topic_hits(spark, sf_dir, r.filter(F.col("lang") == "de")).select("business_id", "review_id").distinct()
    out = D.with_fallback(hits, r.select("business_id", "review_id"), ["business_id"])
    return out.select("business_id", "review_id", "source")


@query("collection_keys", with_ctes(FX_BUSINESS_SQL, body="""
SELECT business_id, 'reviews_' || regexp_replace(lower(replace(name, ' ', '_')), '[^a-zA-Z0-9._-]', '', 'g')
       AS collection FROM fx_business"""))
def q_collection_keys(spark, sf_dir):
    """The per-business collection name."""
    return fx_business(spark, sf_dir).select("business_id", D.collection_key("name").alias("collection"))


@query("refreshed_collections", with_ctes(FX_REVIEWS_SQL, body="""
SELECT business_id, 'reviews_biz_' || regexp_replace(lower(business_id), '[^a-zA-Z0-9._-]', '', 'g') AS collection, review_id, md5(text) AS text_md5,
       CASE WHEN bool_or(useful = 10) OVER (PARTITION BY business_id) THEN 2 ELSE 1 END AS rows_version
FROM fx_reviews WHERE text IS NOT NULL"""))
def q_refreshed_collections(spark, sf_dir):
    """Collections built from a first load (all but the reviews of usefulness 10), then refreshed with the whole table:
    the businesses that gained reviews are indexed anew."""
    r = fx_reviews(spark, sf_dir)
    path = os.path.join(ensure_checkpoint_dir(spark), "collections", uuid.uuid4().hex)

    def index(rows):
        return D.embed_texts(rows.select("business_id", "review_id", "text"), D.hashing_embedder(64))

    CO.refresh_collections(r.where("useful != 10"), path, index)
    CO.refresh_collections(r, path, index)
    return CO.read_collections(spark, path).select("business_id", "collection", "review_id", F.md5("text").alias("text_md5"), "rows_version")


@query("embedded_topic_topk")
def q_embedded_topic_topk(spark, sf_dir):
    """D1(c) + D3/D4: reviews and topic queries embedded by a user model in an iterator
    ``pandas_udf`` (here the small hashing stand-in), then exact cosine top 15 per
    business and topic (rows-only: the model is user code)."""
    r = fx_reviews(spark, sf_dir)
    emb = D.embed_texts(r.select("business_id", "review_id", "text"), D.hashing_embedder())
    q = D.embed_texts(D.topic_query_table(spark, DRIVER_TOPICS).withColumnRenamed("query", "text"),
                      D.hashing_embedder(), out_col="qvec").select(F.col("topic").alias("query"), "qvec")
    hits = D.cosine_topk(emb, q, k=15, scope=["business_id"], id_col="review_id")
    return hits.select("business_id", F.col("query").alias("topic"), "rank", "review_id",
                       F.round("score", 6).alias("score"))
