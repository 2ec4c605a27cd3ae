import re
import statistics
import tempfile
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from revlens.operators import answers as A
from revlens.operators import clustered as L
from revlens.operators import collect as C
from revlens.operators import load_profile as LP
from revlens.operators import profile as P

REVIEWS = "seq long, review_id string, business_id string, business_name string, stars double, text string"


def _reviews(spark, n=3000):
    """A business with a third of all rows, many small ones, one without a name, an empty name."""
    def business(k):
        return "hot" if k % 3 == 0 else None if k % 50 == 1 else "" if k % 50 == 2 else f"b{k % 40}"
    return spark.createDataFrame([(k, str(k), business(k), "N", float(k % 6), None if k % 17 == 0 else f"text {k % 900} " * (1 + k % 9)) for k in range(n)], REVIEWS)


def _clustered(spark, rows, buckets=16, per_slice=100):
    path = tempfile.mkdtemp(prefix="revlens-clustered-")
    return L.write_clustered(rows, f"t_{uuid.uuid4().hex}", path, buckets, per_slice)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _got(df):
    return sorted((r.review_id, r.business_id, r.business_name, r.text or "") for r in df.collect())


def test_clustered_requests_equal_plain_loading(spark):
    rows = _reviews(spark)
    stored = _clustered(spark, rows)
    assert stored.rows(spark).count() == 3000
    sizes = {r.business_id: r.n_slices for r in stored.slices(spark).collect()}
    assert sizes["hot"] == 10 and set(sizes) >= {None, ""}
    spread = [r["count"] for r in stored.rows(spark).where("business_id = 'hot'").groupBy(L.SLICE).count().collect()]
    assert len(spread) == 10 and max(spread) < 200
    asked = spark.createDataFrame([("hot", "Hot"), ("", "Empty"), ("b7", "Seven"), ("b7", "Seven"), (None, "Null"), ("none", "No rows")], "business_id string, name string")
    for limit in (None, 15, 10_000):
        assert _got(L.clustered_reviews_of(stored, asked, limit)) == _got(C.reviews_of(rows, asked, limit))
    assert _got(L.reviews_of_business(stored, spark, ["hot", "b7"])) == _got(rows.where("business_id in ('hot', 'b7')"))
    assert L.reviews_of_business(stored, spark, ["none"]).count() == 0
    again = L.open_clustered(spark, f"t_{uuid.uuid4().hex}", stored.path, 16)
    assert _got(L.clustered_reviews_of(again, asked, 15)) == _got(C.reviews_of(rows, asked, 15))
    assert _clustered(spark, rows.limit(0)).rows(spark).count() == 0


def test_clustered_table_is_not_shuffled_and_is_pruned(spark):
    stored = _clustered(spark, _reviews(spark))
    asked = spark.range(40).select(F.concat(F.lit("b"), "id").alias("business_id"), F.lit("x").alias("name"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(L.clustered_reviews_of(stored, asked).select("review_id", "business_name"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    join = plan.index("SortMergeJoin")
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "Bucketed: true" in line)
    above = plan[join:plan.index(scan)]
    assert "Exchange" not in above and "text" not in re.search(r"ReadSchema: struct<[^>]*", scan).group()
    # the count of buckets is shown only where the scan keeps them apart; without, their files are pruned alike
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        one = _plan(L.reviews_of_business(stored, spark, ["b7"]))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 16" in one and re.search(r"PushedFilters: \[[^\]]*_slice", one)


def _scorer(asked, fails):
    def score(blocks):
        asked.add(len(blocks))
        if any(fails(b) for b in blocks):
            raise ValueError("no answer")
        return pd.Series([f"<{b}>" for b in blocks])
    return score


def test_answers_are_stored_and_never_asked_twice(spark):
    path = tempfile.mkdtemp(prefix="revlens-answers-")
    rows = [(k, f"prompt {k % 200}") for k in range(300)] + [(300, None), (301, "")]
    blocks = spark.createDataFrame(rows, "batch_id long, block string")
    asked = spark.sparkContext.accumulator(0)

    def run(blocks, fails=lambda b: False, **options):
        got = A.answer_batches(blocks, _scorer(asked, fails), path, model="m", keys=["batch_id"], per_task=16, chunk=1, **options)
        return {r.batch_id: (r.raw, r.error) for r in got.collect()}

    bad = re.compile(r"prompt 1\d$")
    got = run(blocks, lambda b: bool(b and bad.match(b)), attempts=3)
    assert asked.value == 201 + 2 * 10                 # equal prompts once, the ten that fail three times
    assert len(got) == 302 and got[0] == ("<prompt 0>", None) and got[200] == got[0]
    assert all(got[k][0] == "" and "no answer" in got[k][1] for k in [*range(10, 20), *range(210, 220)])
    got = run(blocks)                                  # only the open ones are asked
    assert asked.value == 221 + 10 and all(e is None for _, e in got.values()) and got[215] == ("<prompt 15>", None)
    assert got == run(blocks) and asked.value == 231   # none
    more = blocks.unionByName(spark.createDataFrame([(999, "new")], blocks.schema))
    assert run(more)[999] == ("<new>", None) and asked.value == 232
    # another model's answers are its own
    other = A.answer_batches(blocks, _scorer(asked, lambda b: False), path, model="other", keys=["batch_id"])
    assert other.where("error is null").count() == 302 and asked.value == 232 + 201
    assert run(blocks.limit(0)) == {}


def test_a_folder_without_commit_is_not_read(spark):
    path = tempfile.mkdtemp(prefix="revlens-answers-")
    assert A.stored_answers(spark, path).count() == 0 and A.stored_answers(spark, path + "/none").count() == 0
    rows = spark.createDataFrame([("k", "a")], A.STORED)
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/pass=1")
    assert A.stored_answers(spark, path).count() == 0
    for n, raw in ((2, "b"), (3, "a")):                # two runs at once: one row, the same for every reader
        spark.createDataFrame([("k", raw)], A.STORED).write.parquet(f"{path}/pass={n}")
    assert [tuple(r) for r in A.stored_answers(spark, path).collect()] == [("k", "a")]


def test_profile_of_loads_equals_the_whole(spark):
    rows = _reviews(spark)
    path = tempfile.mkdtemp(prefix="revlens-loads-")
    with pytest.raises(ValueError):
        LP.merged_profile(spark, path)
    for k in range(5):
        LP.add_load(rows.where(F.col("seq") % 5 == k), path, f"d{k}")
    LP.add_load(rows.where(F.col("seq") % 5 == 3), path, "d3")          # a rerun counts nothing twice
    LP.add_load(rows.limit(0), path, "empty")
    got = LP.merged_profile(spark, path).first()
    want = P.review_summary(rows).first()
    assert (got.n_reviews, got.shortest_text, got.longest_text) == (want.n_reviews, want.min_length, want.max_length)
    assert [got.mean_stars, got.mean_length, got.mean_words] == pytest.approx([want.mean_stars, want.mean_length, want.mean_words])
    funnel = {r.stage: r.n for r in P.validator_funnel(rows).collect()}
    assert (got.nonblank, got.min_length, got.stars_ok) == (funnel["nonblank"], funnel["min_length"], funnel["stars_ok"])
    assert abs(got.distinct_texts - funnel["dedup"]) <= 0.04 * funnel["dedup"]
    sizes = sorted(len(r.text) for r in rows.where("text is not null").select("text").collect())
    for q, v in ((0.25, got.length_q25), (0.5, got.length_q50), (0.75, got.length_q75), (0.95, got.length_q95)):
        assert sum(s < v for s in sizes) / len(sizes) - 0.03 <= q <= sum(s <= v for s in sizes) / len(sizes) + 0.03
    by = {r.business_id: r for r in LP.merged_profile(spark, path, ["business_id"]).collect()}
    plain = {}
    for r in rows.collect():
        plain.setdefault(r.business_id, []).append(r)
    assert set(by) == set(plain) and all(by[b].n_reviews == len(v) for b, v in plain.items())
    assert by["hot"].mean_stars == pytest.approx(statistics.mean(r.stars for r in plain["hot"]))
    part = LP.merged_profile(spark, path, loads=["d0", "d2"]).first()
    assert part.n_reviews == rows.where("seq % 5 in (0, 2)").count()
    none = LP.merged_profile(spark, path, loads=["empty"]).first()
    assert none.n_reviews == 0 and none.mean_stars is None and none.length_q50 is None


def test_prompts_named_once_serve_several_runs(spark, tmp_path):
    """Two runs over the same named prompts: the texts are written once, null and empty prompts are one, equal ones are asked once."""
    from revlens.operators import lineage
    made = spark.sparkContext.accumulator(0)

    def touch(t):
        made.add(1)
        return t
    rows = [(k, None if k == 7 else "" if k == 8 else f"prompt {k % 50}") for k in range(120)]
    blocks = spark.createDataFrame(rows, "batch_id long, block string").withColumn("block", F.udf(touch)("block"))
    asked = spark.sparkContext.accumulator(0)

    def scorer(b):
        asked.add(len(b))
        return pd.Series([f"answer {x}" for x in b])
    named = A.named_prompts(blocks, "m", ["batch_id"])
    path = str(tmp_path / "answers")
    for _ in range(2):
        got = {r.batch_id: (r.raw, r.error) for r in A.answer_batches(named, scorer, path, model="m", keys=["batch_id"]).collect()}
    assert made.value == 120 and asked.value == 51 and lineage.complete_folders(spark, path)
    assert got == {k: (f"answer {t or ''}", None) for k, t in rows}


def test_batches_are_numbered_without_shuffling_rows_again(spark):
    from revlens.operators.merge import split_batches
    rows = spark.range(5000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("business_id"), F.lit("x" * 300).alias("text"))
    out = split_batches(rows, batch_size=64)
    plan = _plan(out)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "hashpartitioning" not in plan
    sizes = {(r.business_id, r.batch_id): (r.n, r.s, r.t) for r in out.groupBy("business_id", "batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("batch_size").alias("s"), F.max("batch_size").alias("t")).collect()}
    assert all(n == s == t for n, s, t in sizes.values()) and len(sizes) == -(-3333 // 64) + -(-1667 // 64)
