"""Retrieval: reviews most similar to each topic query (inventory D1-D7).

The reference embeds one business's reviews into an embedded vector index and asks it
for the top k per topic.  Here retrieval is exact and grouped: every review of every
business is scored against the (few, fixed) topic queries in one projection, and the top
k per (business, topic) are kept with a WindowGroupLimit - each input partition forwards
at most k rows per (business, topic) to the shuffle, so a huge business costs
k x partitions shuffled rows, not its whole review set.

Two embeddings are supported:

* precomputed vectors (``ARRAY<FLOAT|DOUBLE>``, e.g. from a user ``pandas_udf`` model)
  scored with cosine similarity (``cosine_topk``);
* the built-in text path (``tfidf_topk``): relational TF-IDF over tokens, no UDF.

The stated query set (4 topics by default) meets every document: as one array row for
vectors, by an equi-join on the terms for texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .modelio import TOPIC_QUERIES, TOPICS
from .joins import join_on
from .ordering import _cols
from .profile import attach_one_row
from ..sources.literal import literal_table

# --- fixed values -------------------------------------------------------------------
DEFAULT_TOP_K = 10
MANAGER_TOP_K = 15
TOKEN_PATTERN = "[\\p{L}\\p{N}_]+"
# ------------------------------------------------------------------------------------


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two equal-length arrays: dot / (|a| |b|)."""
    return _dot(a, b) / (_norm(a) * _norm(b))


def _as_array(queries: DataFrame, cols: Sequence[str]) -> DataFrame:
    return queries.agg(F.collect_list(F.struct(*cols)).alias("_queries"))


def cosine_topk(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, scope: Sequence[str] = (),
                id_col: str = "doc_id", vec_col: str = "embedding", qid_col: str = "query",
                qvec_col: str = "qvec") -> DataFrame:
    """For every query and scope, the ``k`` documents with the highest cosine
    similarity (``k = min(k, n)``), most similar first, ties by id.  Output
    ``(scope..., query, rank, id, score)``.  Exact (the reference's index is approximate).

    Each Arrow batch is scored against all queries as one matrix product and passes on its own
    top k per query and scope.  Vectors without a direction (null, zero) have no score and no
    rank.  A query set larger than a task should hold is scored by expressions instead, a row
    per document and query."""
    from .vector_index import held_queries, scored_batches
    scope = _cols(scope)
    held = held_queries(queries, qid_col, qvec_col)
    if held is not None:
        found = scored_batches(docs, held, k, scope, id_col, vec_col, qid_col, dict(queries.dtypes)[qid_col])
        return top_k(found, [*scope, qid_col], k, id_col)
    q = _as_array(queries.select(F.col(qid_col).alias("q"), F.transform(qvec_col, lambda x: x.cast("double")).alias("d"))
                  .select("q", "d", _norm(F.col("d")).alias("n")).where("n > 0")
                  .select("q", F.transform("d", lambda x: x / F.col("n")).alias("v")), ["q", "v"])
    d = docs.select(*scope, id_col, F.transform(vec_col, lambda x: x.cast("double")).alias("_d")) \
        .withColumn("_n", _norm(F.col("_d"))).where("_n > 0").select(*scope, id_col, F.transform("_d", lambda x: x / F.col("_n")).alias("_v"))
    scored = attach_one_row(d, q).select(*scope, id_col, "_v", F.explode("_queries").alias("_q")).select(
        *scope, id_col, F.col("_q.q").alias(qid_col), _dot(F.col("_v"), F.col("_q.v")).alias("score"))
    return top_k(scored, [*scope, qid_col], k, id_col)


def top_k(scored: DataFrame, keys: Sequence[str], k: int, id_col: str, score: str = "score") -> DataFrame:
    """Top ``k`` per key by score desc, id asc (planned as a WindowGroupLimit).

    Scores are compared at 12 decimal places so that mathematically equal scores (e.g.
    copies of one text) tie exactly whatever order the floating-point sums ran in, and
    the id decides."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 12)), F.asc(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def topic_query_table(spark, topics: dict[str, str] | None = None) -> DataFrame:
    """The fixed topic queries (topic, topic_ord, query)."""
    topics = topics or TOPIC_QUERIES
    rows = [(t, i, topics[t]) for i, t in enumerate(TOPICS) if t in topics] + \
        [(t, len(TOPICS) + i, q) for i, (t, q) in enumerate(topics.items()) if t not in TOPICS]
    return literal_table(spark, rows, "topic string, topic_ord int, query string")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, not in every place (and element) that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _term_counts(text: Column) -> Column:
    """Distinct tokens of a text and their counts, ``array<struct<term, tf>>``, from the runs of its sorted tokens."""
    def runs(tokens: Column) -> Column:
        n = F.size(tokens)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, i - 1)))
        return F.when(n > 0, _bound(starts, lambda s: F.transform(s, lambda i, j: F.struct(
            F.get(tokens, i).alias("term"), (F.coalesce(F.get(s, j + 1), n) - i).cast("long").alias("tf")))))
    # sort_array compares in compiled code, array_sort by a lambda; a token is never null
    return _bound(F.sort_array(_tokens(text)), runs)


def tfidf_topk(reviews: DataFrame, queries: DataFrame, k: int = MANAGER_TOP_K,
               scope: Sequence[str] = ("business_id",), id_col: str = "review_id", text_col: str = "text",
               qid_col: str = "topic", qtext_col: str = "query") -> DataFrame:
    """D1 built-in path + D3/D4: TF-IDF cosine between each review and each query text.

    A review is one row, so its terms are counted inside the row and stay there: one narrow pass
    over the texts writes (scope, review, terms with counts, whether a query term is among them).
    Only document frequencies are summed over the cluster, as partial counts per (scope, term)
    without a review in the key.  They are written with their inverse frequency, so that Spark knows
    their size: it broadcasts them when they are small, and else shuffles the terms of the reviews that
    hit, once.  Only those need a dot product and a norm.  Reviews that share no term with a query score 0
    and still rank (by id) where fewer than k reviews match, as an index returns k neighbours
    regardless: only scopes that are short of k are filled, from their first 2k ids.
    Joins are plain equi-joins (NULL scopes are scopes): Spark sizes them, AQE splits a hot
    (business, common word) key.  Review ids are unique within a scope.
    """
    from .lineage import write_table
    scope = _cols(scope)
    qt = (queries.select(F.col(qid_col).alias(qid_col), F.explode(_tokens(F.col(qtext_col))).alias("term"))
          .groupBy(qid_col, "term").agg(F.count(F.lit(1)).alias("qtf")))
    asked = qt.agg(F.collect_set("term").alias("asked")).select("asked").scalar()
    bags = write_table(reviews.select(*scope, id_col, _term_counts(F.col(text_col)).alias("_terms"))
                       .withColumn("_hit", F.arrays_overlap(F.col("_terms.term"), asked)), "tfidf-terms")
    n_docs = reviews.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_docs"))
    dfc = bags.select(*scope, F.explode("_terms.term").alias("term")).groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    idf = write_table((join_on(dfc, n_docs, scope) if scope else attach_one_row(dfc, n_docs)).select(
        *scope, "term", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf")), "tfidf-idf")

    tf = bags.filter("_hit").select(*scope, id_col, F.inline("_terms"))
    q_idf = idf.join(qt, "term").withColumn("qw", F.col("qtf") * F.col("idf"))
    # of a review only the few query terms go to the dot product; all its terms are shuffled once, to the norm
    hits = join_on(tf.filter(F.array_contains(asked, F.col("term"))), q_idf, [*scope, "term"])
    dots = write_table(hits.groupBy(*scope, id_col, qid_col).agg(F.sum(F.col("tf") * F.col("idf") * F.col("qw")).alias("dot")), "tfidf-dots")
    # each task holds its share of the frequencies, so that the terms of the reviews, many times more, are not sorted
    w = join_on(tf, idf.hint("shuffle_hash"), [*scope, "term"]).select(*scope, id_col, (F.col("tf") * F.col("idf")).alias("w"))
    norms = w.groupBy(*scope, id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # query norm per scope over the query terms present in the scope's vocabulary
    qn = q_idf.groupBy(*scope, qid_col).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    scored = (join_on(join_on(dots, norms, [*scope, id_col]), qn, [*scope, qid_col])
              .select(*scope, id_col, qid_col, (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score")))

    have = dots.groupBy(*scope, qid_col).agg(F.count(F.lit(1)).alias("have"))
    wanted = attach_one_row(n_docs, _as_array(queries.select(F.col(qid_col).alias("q")), ["q"])).select(
        *scope, F.explode(F.transform("_queries", lambda x: x["q"])).alias(qid_col))
    short = join_on(wanted, have, [*scope, qid_col], "left").filter(F.coalesce("have", F.lit(0)) < k).select(*scope, qid_col)
    first = Window.partitionBy(*scope).orderBy(id_col)
    spare = (reviews.select(*scope, id_col).withColumn("_r", F.row_number().over(first))
             .filter(F.col("_r") <= 2 * k).drop("_r"))
    fill = join_on(spare, short, scope) if scope else spare.join(short)
    fill = join_on(fill, dots, [*scope, id_col, qid_col], "left_anti").select(
        *scope, id_col, qid_col, F.lit(0.0).alias("score"))
    return top_k(scored.unionByName(fill), [*scope, qid_col], k, id_col)


def union_topic_hits(hits: DataFrame, scope: Sequence[str] = ("business_id",), topic_ord: str = "topic_ord",
                     rank: str = "rank", text_col: str = "text") -> DataFrame:
    """Union of the per-topic lists, one row per distinct text, ordered by topic then
    rank (``min(struct(topic_ord, rank))`` per text, map-side combined)."""
    scope = _cols(scope)
    first = hits.groupBy(*scope, text_col).agg(F.min(F.struct(topic_ord, rank)).alias("_o"))
    w = Window.partitionBy(*scope).orderBy("_o")
    return first.withColumn("union_rank", F.row_number().over(w)).select(
        *scope, text_col, F.col("_o")[topic_ord].alias(topic_ord), F.col("_o")[rank].alias(rank), "union_rank")


def with_fallback(selected: DataFrame, all_reviews: DataFrame, scope: Sequence[str] = ("business_id",)) -> DataFrame:
    """Scopes with retrieval rows use them; scopes without (retrieval off, failed or
    empty) use all their clean reviews.  ``source`` tells which."""
    scope = _cols(scope)
    have = selected.select(*scope).distinct()
    rest = join_on(all_reviews, have, scope, "left_anti").withColumn("source", F.lit("all_reviews"))
    return selected.withColumn("source", F.lit("retrieval")).unionByName(rest, allowMissingColumns=True)


def collection_key(name) -> Column:
    """``reviews_`` + name lower-cased, spaces to ``_``, characters outside
    ``[a-zA-Z0-9._-]`` removed.  Distinct names can collide; tables here are keyed by
    ``business_id`` instead, so no collision affects results."""
    n = F.col(name) if isinstance(name, str) else name
    return F.concat(F.lit("reviews_"), F.regexp_replace(F.replace(F.lower(n), F.lit(" "), F.lit("_")),
                                                        "[^a-zA-Z0-9._-]", ""))


def label_centroids(vectors: DataFrame, label: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per label (a query set derived from the data): per-dimension averages
    with partial aggregation, reassembled in dimension order."""
    ex = vectors.select(label, F.posexplode(vec_col).alias("i", "x"))
    m = ex.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return (m.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_l"))
            .select(F.col(label).alias("query"), F.transform("_l", lambda s: s["m"]).alias("qvec")))


def embed_texts(df: DataFrame, load_model, text_col: str = "text", out_col: str = "embedding",
                dim: int | None = None) -> DataFrame:
    """D1(c): embed a text column with a user model inside an iterator ``pandas_udf``.

    ``load_model()`` runs once per Python worker and returns ``f(list[str]) ->
    list[list[float]]``; Arrow batches of texts stream through it.  Use the vectors with
    ``cosine_topk``."""
    import warnings

    import pandas as pd
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    def _embed_iter(batches):
        model = load_model()
        for s in batches:
            yield pd.Series(list(model(s.fillna("").tolist())))

    with warnings.catch_warnings():   # iterator-of-Series UDF declared without type hints
        warnings.simplefilter("ignore")
        _embed = pandas_udf(_embed_iter, "array<float>", PandasUDFType.SCALAR_ITER)

    return df.withColumn(out_col, _embed(F.col(text_col)))


def hashing_embedder(dim: int = 256, n: int = 3):
    """A small stand-in model for ``embed_texts``: L2-normalised counts of hashed character
    n-grams, a few array operations per text.  Loads nothing; replace with a real sentence encoder."""
    def load():
        import numpy as np

        def model(texts):
            out = []
            for t in texts:
                c = np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                h = np.zeros(max(len(c) - n + 1, 0), np.uint64)
                for i in range(n):
                    h = (h ^ c[i:i + len(h)]) * np.uint64(0x100000001B3)
                v = np.bincount(((h >> np.uint64(17)) % np.uint64(dim)).astype(np.int64), minlength=dim).astype(np.float32)
                norm = float(np.linalg.norm(v))
                out.append((v / norm if norm else v).tolist())
            return out
        return model
    return load
