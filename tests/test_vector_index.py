import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.operators import retrieve as D
from revlens.operators import vector_index as VI


def _table(spark, n=600, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.3 * rng.normal(size=dims)], f"b{i % 3}" if i % 3 else None) for i in range(n)]
    rows += [(n + i, rows[0][1], "b1") for i in range(40)]  # copies: ties go to the smaller id
    rows += [(n + 50, None, "b1"), (n + 51, [0.0] * dims, "b1"), (n + 52, [1.0, None] + [0.0] * (dims - 2), "b2"), (n + 53, [1.0], "b2")]
    return spark.createDataFrame(rows, "doc_id long, embedding array<double>, scope string")


def _hits(df):
    return sorted(((r.scope if "scope" in df.columns else None, r.query, r.rank, r.doc_id, round(r.score, 9)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def built(spark):
    path = tempfile.mkdtemp(prefix="revlens-index-")
    docs = _table(spark)
    clusters = VI.build_index(docs, path, clusters=12, scope=["scope"])
    queries = docs.where("doc_id % 40 = 0 and doc_id < 600").select(F.col("doc_id").alias("query"), F.col("embedding").alias("qvec"))
    return docs, path, clusters, queries


@pytest.mark.parametrize("scope", [[], ["scope"]])
def test_all_probes_give_the_exact_lists(spark, built, scope):
    docs, path, clusters, queries = built
    want = D.cosine_topk(docs, queries, 7, scope)
    assert _hits(VI.index_topk(spark, path, queries, 7, clusters, scope)) == _hits(want)


def test_block_product_equals_the_relational_form(spark, built, monkeypatch):
    docs, path, clusters, queries = built
    docs = docs.where("size(embedding) = 8 and doc_id != 652")
    want = _hits(D.cosine_topk(docs, queries, 7, ["scope"]))
    few = _hits(VI.index_topk(spark, path, queries, 7, 4, ["scope"]))
    monkeypatch.setattr(VI, "MAX_QUERIES", 3)
    assert _hits(D.cosine_topk(docs, queries, 7, ["scope"])) == want
    assert _hits(VI.index_topk(spark, path, queries, 7, 4, ["scope"])) == few


def test_recall_with_few_probes_and_pruned_scan(spark, built):
    docs, path, clusters, queries = built
    found = VI.index_topk(spark, path, queries, 10, 4)
    got = VI.recall(found, D.cosine_topk(docs, queries, 10), ["query"], "doc_id").collect()
    assert len(got) == queries.count() and all(r.recall >= 0.9 for r in got)
    one = VI.index_topk(spark, path, queries.limit(1), 10, 1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster" in plan.replace("PartitionFilters: [isnotnull(cluster", "PartitionFilters: [cluster")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_tables(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="revlens-index-"), "i")
    docs = _table(spark).limit(0)
    q = _table(spark).limit(2).select(F.col("doc_id").alias("query"), F.col("embedding").alias("qvec"))
    VI.build_index(docs, path)
    assert D.cosine_topk(docs, q, 3).count() == 0
    assert D.cosine_topk(_table(spark), q.limit(0), 3).count() == 0
    assert VI.index_topk(spark, path, q, 3).count() == 0
