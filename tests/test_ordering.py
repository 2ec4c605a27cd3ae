from pyspark.sql import Window
from pyspark.sql import functions as F

from revlens.operators.ordering import dense_index, first_n, keep_first


def test_dense_index_matches_row_number_on_skewed_keys(spark):
    # one key holds a third of the rows
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"),
        ((F.col("id") * 7919) % 100003).alias("seq"))
    got = dense_index(df, ["k"], "seq", name="i", num_slices=8)
    want = df.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("seq")) - 1)
    assert sorted(map(tuple, got.select("k", "seq", "i").collect())) == \
        sorted(map(tuple, want.select("k", "seq", "i").collect()))


def test_dense_index_global(spark):
    df = spark.range(0, 500).select((F.col("id") * 13 % 997).alias("seq")).repartition(5)
    got = sorted(r.i for r in dense_index(df, [], "seq", name="i").collect())
    assert got == list(range(500))


def test_keep_first_and_first_n(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "x", 1), ("a", "y", 2), ("b", "x", 5)],
                               "k string, t string, seq long")
    kf = sorted(map(tuple, keep_first(df, ["k", "t"], "seq").collect()))
    assert kf == [("a", "x", 1), ("a", "y", 2), ("b", "x", 5)]
    fn = sorted(map(tuple, first_n(df, ["k"], F.col("seq"), 2).collect()))
    assert fn == [("a", "x", 1), ("a", "y", 2), ("b", "x", 5)]


def test_dense_index_of_many_rows_files_and_null_keys(spark, tmp_path):
    """200,000 rows from several files, a hot key, null keys, a wide payload; every column compared after a write."""
    n = 200_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 1, F.lit(None).cast("string"))
        .otherwise((F.col("id") % 50).cast("string")).alias("k"),
        ((F.col("id") * 7919) % 1000003).alias("seq"), F.md5(F.col("id").cast("string").cast("binary")).alias("payload"))
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    src = spark.read.parquet(str(tmp_path / "in"))
    dense_index(src, ["k"], "seq", name="i", num_slices=16).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = df.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("seq")) - 1).withColumn("i", F.col("i").cast("long"))
    cols = ["k", "seq", "payload", "i"]
    assert got.count() == n
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    dense_index(src, [], "seq", name="i", num_slices=16).write.parquet(str(tmp_path / "all"))
    row = spark.read.parquet(str(tmp_path / "all")).agg(F.count("i"), F.countDistinct("i"), F.min("i"), F.max("i")).first()
    assert tuple(row) == (n, n, 0, n - 1)


def test_split_batches_and_ranks_above_sample_size(spark):
    from revlens.operators.collect import rank_matches
    from revlens.operators.merge import split_batches
    rows = spark.range(60_000).select(F.lit("q").alias("request"), F.col("id").cast("string").alias("business_id"),
                                      (F.col("id") % 101).alias("review_count"), F.col("id").alias("seq"))
    r = rank_matches(rows).agg(F.countDistinct("match_rank"), F.min("match_rank"), F.max("match_rank"), F.count("match_rank")).first()
    assert tuple(r) == (60_000, 1, 60_000, 60_000)
    two = spark.createDataFrame([(0, "b"), (1, None)], "seq long, business_id string")
    assert split_batches(two, batch_size=20).count() == 2
    sizes = split_batches(rows.withColumn("business_id", F.when(F.col("seq") % 3 > 0, F.lit("hot"))), batch_size=20) \
        .groupBy("business_id", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.max("batch_size").alias("s")).where("n != 20 or s != 20")
    assert sizes.count() == 0
