import tempfile

from pyspark.sql import functions as F

from revlens.operators import collections as CO
from revlens.operators import collect as C
from revlens.operators import retrieve as D

ROWS = [("a", "A b", "1", "good food"), ("a", "A b", "2", "bad food"), ("b", "B!", "3", "nice"), ("c", "C", "4", "gone soon"), (None, None, "5", "no business"),
        ("b", "B!", "6", None)]
SCHEMA = "business_id string, business_name string, review_id string, text string"


def _index(acc):
    """Embeds and counts the texts it is given."""
    def load():
        model = D.hashing_embedder(16)()

        def counted(texts):
            acc.add(len(texts))
            return model(texts)
        return counted
    return lambda rows: D.embed_texts(rows.select("business_id", "review_id", "text"), load)


def _rows(spark, path, version=None):
    df = CO.read_collections(spark, path, version)
    return sorted(((r.business_id, r.review_id, r.text, tuple(r.embedding), r.collection) for r in df.collect()), key=str)


def test_refresh_indexes_only_what_changed_and_equals_a_full_build(spark):
    path, acc = tempfile.mkdtemp(prefix="revlens-coll-"), spark.sparkContext.accumulator(0)
    first = spark.createDataFrame(ROWS, SCHEMA)
    assert CO.refresh_collections(first, path, _index(acc)) == 1 and acc.value == 5
    before = _rows(spark, path)
    # nothing changed: nothing is indexed, no version is written; the order of rows is no change
    assert CO.refresh_collections(first.orderBy(F.desc("review_id")).repartition(3), path, _index(acc)) == 1 and acc.value == 5
    # one text edited, one business gone, one new, one row added to no business
    rows = [("a", "A b", "1", "good food"), ("a", "A b", "2", "bad food"), ("b", "B!", "3", "nicer"), (None, None, "5", "no business"),
            (None, None, "7", "nor this"), ("d", "D", "8", "new")]
    second = spark.createDataFrame(rows, SCHEMA)
    assert CO.refresh_collections(second, path, _index(acc)) == 2
    assert acc.value == 5 + 4  # b, the null business and d; a is not read again
    full = tempfile.mkdtemp(prefix="revlens-coll-")
    CO.refresh_collections(second, full, _index(acc))
    assert _rows(spark, path) == _rows(spark, full)
    assert _rows(spark, path, 1) == before  # the first version stays readable
    assert {r[4] for r in before} == {"reviews_a_b", "reviews_b", "reviews_c", None}


def test_a_half_written_refresh_is_invisible_and_its_retry_replaces_it(spark):
    path, acc = tempfile.mkdtemp(prefix="revlens-coll-"), spark.sparkContext.accumulator(0)
    first = spark.createDataFrame(ROWS, SCHEMA)
    CO.refresh_collections(first, path, _index(acc))
    before = _rows(spark, path)
    # the rows of version 2 were written, its manifest was not
    spark.createDataFrame([("a", "9", "stray", [0.0] * 16, 2)], "business_id string, review_id string, text string, embedding array<float>, version int") \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("business_id", "version").parquet(f"{path}/rows")
    assert _rows(spark, path) == before
    changed = first.withColumn("text", F.when(F.col("review_id") == "1", "other").otherwise(F.col("text")))
    assert CO.refresh_collections(changed, path, _index(acc)) == 2
    assert sorted(r[1:3] for r in _rows(spark, path) if r[0] == "a") == [("1", "other"), ("2", "bad food")]


BIZ = [(i, str(i), n, "city", "st", 3.0, i, "Food") for i, n in enumerate(["Ab", "ABC Grill", "100% Cafe", "a_b", "", None, "Ünïcode Öl", "xx abc", "ABC Grill", "a"])]
BIZ_SCHEMA = "seq long, business_id string, name string, city string, state string, stars double, review_count int, categories string"


def test_request_table_equals_the_literal_search(spark):
    biz = spark.createDataFrame(BIZ, BIZ_SCHEMA)
    asked = ["a", "A", "ab", "aB", "abc", "ABC g", "%", "_", "0% c", "ünï", "öl", "zzz", "abcd", " ", "", "grill", "abc grill", "abc grill x", "x a"]
    requests = spark.createDataFrame([(a,) for a in asked] + [(None,), ("a",)], "request string")
    want = sorted(tuple(r) for r in C.search_businesses(biz, asked).collect())
    assert sorted(tuple(r) for r in C.search_request_table(biz, requests).collect()) == want
    assert C.search_request_table(biz.limit(0), requests).count() == 0
    assert C.search_request_table(biz, requests.limit(0)).count() == 0


def test_a_hundred_thousand_requests_without_literals_or_nested_loops(spark):
    biz = spark.range(0, 3000).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("business_id"),
                                      F.concat(F.lit("Place "), F.hex(F.xxhash64("id"))).alias("name"), F.lit("c").alias("city"), F.lit("s").alias("state"),
                                      F.lit(1.0).alias("stars"), F.lit(1).alias("review_count"), F.lit("f").alias("categories"))
    requests = spark.range(0, 100_000).select(F.substring(F.hex(F.xxhash64(F.col("id") % 6000)), 3, 8).alias("request"))
    got = C.search_request_table(biz, requests)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert got.select("request").distinct().count() >= 3000  # half of the requests come from names
