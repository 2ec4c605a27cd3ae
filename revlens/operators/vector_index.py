"""A written, cluster-partitioned vector index (inventory D3), and the block product that scores vectors.

The reference asks an approximate in-memory index.  Here the index is a Parquet table partitioned by cluster:

* ``build_index`` learns the centroids from a bounded sample (Spark ML k-means, cosine distance), sends every row to
  its ``copies`` nearest centroids in one pass and writes it below ``cluster=<n>`` (a second copy finds rows that lie
  between clusters); the centroids are a small table beside it.
* ``index_topk`` sends each query to its ``probes`` nearest centroids, reads those partitions alone (partition pruning)
  and re-ranks their rows exactly.  With as many probes as clusters the result is the exact one.

Rows are scored per Arrow batch as one matrix product with all queries, and a batch passes on at most ``k`` rows per
(scope, query): there is no row per document and query at any point.  ``MAX_QUERIES`` bounds the queries held by a
task; beyond it the callers take the relational form (an equi-join on the cluster, a row per pair).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAX_QUERIES = 4096     # queries that a task holds: 4096 x 1024 doubles are 32 MB
MAX_CLUSTERS = 4096    # centroids, likewise
SAMPLE_ROWS = 65_536   # rows that the centroids are learned from


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Array column -> unit rows of ``width`` components (default: the most there are).

    A null, a zero vector, one with a null component or of another length becomes NaN: it has no direction.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy()) * np.asarray(column.is_valid())
    width = int(size.max(initial=0)) if width is None else width
    out = np.full((len(column), width), np.nan)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    full = size == width
    if full.any() and width:
        ends = np.cumsum(size)
        out[full] = flat[(ends[full, None] - width + np.arange(width)[None, :])]
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.where(norm > 0, norm, np.nan)[:, None]


def _codes(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """A number per distinct combination of the columns."""
    code = np.zeros(batch.num_rows, np.int64)
    for n in names:
        d = batch.column(batch.schema.get_field_index(n)).dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code


def best_of_batch(score: np.ndarray, scope: np.ndarray, ids: pa.Array, k: int):
    """For each query (row of ``score``) the places of its ``k`` best columns per scope: score at 12 decimals, then id; no score, no place."""
    by_id = np.empty(len(ids), np.int64)
    by_id[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    for q in range(len(score)):
        ok = np.flatnonzero(np.isfinite(score[q]))
        s = np.round(score[q, ok], 12)
        order = np.lexsort((by_id[ok], -s, scope[ok]))
        sc = scope[ok][order]
        first = np.flatnonzero(np.r_[True, sc[1:] != sc[:-1]]) if len(sc) else np.zeros(0, int)
        place = np.arange(len(sc)) - np.repeat(first, np.diff(np.r_[first, len(sc)]))
        yield q, ok[order[place < k]]


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def held_queries(queries: DataFrame, qid_col: str, qvec_col: str) -> pa.Table | None:
    """The query set as a table, or None if it is larger than a task should hold."""
    got = queries.select(F.col(qid_col).alias("q"), F.transform(qvec_col, lambda x: x.cast("double")).alias("v")).limit(MAX_QUERIES + 1).toArrow()
    return None if got.num_rows > MAX_QUERIES else got


def scored_batches(docs: DataFrame, held: pa.Table, k: int, scope: Sequence[str], id_col: str, vec_col: str, qid_col: str,
                   qid_type: str, probes: list[set] | None = None) -> DataFrame:
    """``(scope..., id, qid, score)``: per Arrow batch the ``k`` best rows of each scope for each query.

    ``probes``: the clusters of each query; rows of other clusters (column ``cluster``) are not scored for it.
    """
    names = [*scope, id_col]
    cols = [*names, vec_col] + (["cluster"] if probes is not None else [])
    queries, qid = matrix(held.column("v")), held.column("q").combine_chunks()

    def part(b: pa.RecordBatch, mine: np.ndarray):
        if not len(mine):
            return
        v = matrix(b.column(len(names)), queries.shape[1])
        score = queries[mine] @ v.T
        qs, at, ss = [], [], []
        for q, rows in best_of_batch(score, _codes(b, scope), b.column(len(names) - 1), k):
            qs.append(np.full(len(rows), mine[q]))
            at.append(rows)
            ss.append(score[q, rows])
        rows = pa.array(np.concatenate(at))
        yield pa.RecordBatch.from_arrays([*(b.column(i).take(rows) for i in range(len(names))), qid.take(pa.array(np.concatenate(qs))),
                                          pa.array(np.concatenate(ss))], names=[*names, qid_col, "score"])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            if probes is None:
                yield from part(b, np.arange(len(queries)))
                continue
            cluster = b.column(len(names) + 1).to_numpy(zero_copy_only=False)
            for c in np.unique(cluster):
                mine = np.array([i for i, p in enumerate(probes) if c in p], int)
                yield from part(b.take(pa.array(np.flatnonzero(cluster == c))), mine)

    return docs.select(*cols).mapInArrow(run, f"{_fields(docs, names)}, `{qid_col}` {qid_type}, score double")


# ---------------------------------------------------------------- the written index
def _nearest(centroids: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each unit row, nearest first; rows without a direction get -1."""
    s = np.nan_to_num(v @ centroids.T, nan=-2.0)
    best = np.argsort(-s, axis=1, kind="stable")[:, :n]
    return np.where(np.isnan(v[:, :1]), -1, best)


def learn_centroids(docs: DataFrame, clusters: int, id_col: str, vec_col: str, sample: int = SAMPLE_ROWS, seed: int = 7) -> np.ndarray:
    """Unit centroids by k-means with cosine distance over at most ``sample`` rows (the first by hash of the id)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    x = F.transform(vec_col, lambda v: v.cast("double"))
    width = docs.where(F.col(vec_col).isNotNull()).agg(F.mode(F.size(vec_col))).first()[0]  # the usual number of components
    rows = docs.where(F.size(vec_col) == F.lit(width)).select(x.alias("x"), F.xxhash64(F.lit(seed), id_col).alias("o")) \
        .where(F.col("x").isNotNull() & F.exists("x", lambda v: v != 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))) \
        .orderBy("o").limit(sample).select(array_to_vector("x").alias("features"))
    if rows.isEmpty():
        return np.zeros((0, 0))
    model = KMeans(k=max(clusters, 2), distanceMeasure="cosine", seed=seed, maxIter=20).fit(rows)
    c = np.array(model.clusterCenters())
    return c / np.linalg.norm(c, axis=1, keepdims=True)


def build_index(docs: DataFrame, path: str, clusters: int | None = None, scope: Sequence[str] = (), id_col: str = "doc_id",
                vec_col: str = "embedding", copies: int = 2, sample: int = SAMPLE_ROWS) -> int:
    """Write the index of all rows below ``path``; returns the number of clusters.

    Default ``clusters``: the square root of the rows, ``MAX_CLUSTERS`` at most.  Rows without a direction (null or zero
    vectors) are kept in cluster -1, which no query probes: they have no cosine.  An index at ``path`` is replaced.
    """
    spark = docs.sparkSession
    n = clusters or max(2, min(MAX_CLUSTERS, round(docs.count() ** 0.5)))
    centroids = learn_centroids(docs, n, id_col, vec_col, sample)
    held = spark.sparkContext.broadcast(centroids)

    @F.arrow_udf("array<int>")
    def cluster(v: pa.Array) -> pa.Array:
        if not len(held.value):
            return pa.array([[-1]] * len(v), pa.list_(pa.int32()))
        x = matrix(v, held.value.shape[1])
        return pa.array([sorted(set(r)) for r in _nearest(held.value, x, copies).tolist()], pa.list_(pa.int32()))

    rows = docs.select(*scope, id_col, vec_col, F.explode(cluster(vec_col)).alias("cluster"))
    # rows of one cluster meet in range slices: a large cluster is written by several tasks, a small one by one
    out = rows.repartitionByRange("cluster", F.xxhash64(id_col)).sortWithinPartitions("cluster", *scope, id_col)
    out.write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/rows")
    spark.createDataFrame([(rows.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cluster int, centroid array<double>") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return len(centroids)


def index_topk(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 8, scope: Sequence[str] = (),
               id_col: str = "doc_id", vec_col: str = "embedding", qid_col: str = "query", qvec_col: str = "qvec") -> DataFrame:
    """The ``k`` nearest indexed rows of each query and scope among the ``probes`` clusters nearest to the query.

    Output ``(scope..., query, rank, id, score)`` as the exact :func:`retrieve.cosine_topk`; scores are exact, rows of
    clusters that are not probed may be missing.  Only the probed partitions are read.
    """
    from .retrieve import cosine, top_k
    schema = StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first()["schema"]))  # an empty index has no file to tell it
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    got = spark.read.parquet(f"{path}/centroids").orderBy("cluster").toArrow()  # MAX_CLUSTERS rows at most
    centroids = matrix(got.column("centroid")) if got.num_rows else np.zeros((0, 0))
    held = held_queries(queries, qid_col, qvec_col)
    scope = list(scope)
    if held is not None:
        v = matrix(held.column("v"), centroids.shape[1])
        chosen = [set(map(int, r)) - {-1} for r in _nearest(centroids, v, probes)] if len(centroids) and len(v) else [set() for _ in range(len(v))]
        read = sorted(set().union(*chosen)) if chosen else []
        found = scored_batches(rows.where(F.col("cluster").isin(read)), held, k, scope, id_col, vec_col, qid_col, dict(queries.dtypes)[qid_col], chosen)
        return top_k(_once(found, [*scope, id_col, qid_col]), [*scope, qid_col], k, id_col).select(*scope, id_col, qid_col, "score", "rank")
    table = spark.sparkContext.broadcast(centroids)

    @F.arrow_udf("array<int>")
    def near(v: pa.Array) -> pa.Array:
        return pa.array([[int(x) for x in r if x >= 0] for r in _nearest(table.value, matrix(v, table.value.shape[1]), probes)], pa.list_(pa.int32()))

    q = queries.select(F.col(qid_col).alias(qid_col), F.transform(qvec_col, lambda x: x.cast("double")).alias("_q"), F.explode(near(qvec_col)).alias("cluster"))
    d = rows.withColumn("_d", F.transform(vec_col, lambda x: x.cast("double")))
    pairs = d.join(q, "cluster").select(*scope, id_col, qid_col, cosine(F.col("_d"), F.col("_q")).alias("score"))
    return top_k(_once(pairs, [*scope, id_col, qid_col]), [*scope, qid_col], k, id_col).select(*scope, id_col, qid_col, "score", "rank")


def _once(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row that was found through several clusters counts once."""
    return found.groupBy(*keys).agg(F.max("score").alias("score"))


def recall(found: DataFrame, exact: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Per key the share of the exact rows that were found (``n_exact``, ``recall``)."""
    from .joins import join_on
    hit = found.select(*keys, id_col).withColumn("_hit", F.lit(1))
    return join_on(exact.select(*keys, id_col), hit, [*keys, id_col], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_exact"), (F.count("_hit") / F.count(F.lit(1))).alias("recall"))
