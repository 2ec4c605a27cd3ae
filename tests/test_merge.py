from pyspark.sql import functions as F

from revlens.operators import merge as G

SCHEMA = ("scope long, batch_id long, batch_size long, ok boolean, positive double, negative double, "
          "neutral double, summary string, positive_highlights array<string>, negative_highlights array<string>")


def _res(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_merge_weighted_and_first_seen(spark):
    rows = [(1, 0, 100, True, 60.0, 30.0, 10.0, "first", ["a", "b", "c"], ["x"]),
            (1, 1, 100, True, 40.0, 40.0, 20.0, "second", ["c", "d", "e", "f"], ["y"]),
            (1, 2, 50, True, 80.0, 10.0, 10.0, "third", ["g"], []),
            (1, 3, 70, False, 0.0, 0.0, 0.0, "failed", ["zzz"], [])]
    r = G.merge_sentiment(_res(spark, rows), ["scope"]).first()
    # weighted: (60*100+40*100+80*50)/250 = 56, (30*100+40*100+10*50)/250 = 30
    assert (r.positive, r.negative, r.neutral) == (56.0, 30.0, 14.0)
    assert r.positive_highlights == ["a", "b", "c", "d", "e"]
    assert r.summary == "first"          # largest batch, first on ties
    assert (r.total_reviews_analyzed, r.batches_processed) == (250, 3)


def test_single_result_passes_through(spark):
    rows = [(2, 0, 40, True, 33.3, 33.3, 33.4, "only", ["a", "b", "c", "d", "e", "f"], [])]
    r = G.merge_sentiment(_res(spark, rows), ["scope"]).first()
    assert (r.positive, r.negative, r.neutral) == (33.3, 33.3, 33.4)
    assert r.positive_highlights == ["a", "b", "c", "d", "e", "f"]
    assert r.total_reviews_analyzed is None and r.single_batch_size == 40


def test_zero_total_keeps_unrounded(spark):
    rows = [(3, 0, 10, True, 0.0, 0.0, 0.0, "s", [], []), (3, 1, 10, True, 0.0, 0.0, 0.0, "t", [], [])]
    r = G.merge_sentiment(_res(spark, rows), ["scope"]).first()
    assert (r.positive, r.negative, r.neutral) == (0.0, 0.0, 0.0)


def test_all_failed_gives_no_row(spark):
    rows = [(4, 0, 10, False, 1.0, 1.0, 1.0, "s", [], [])]
    assert G.merge_sentiment(_res(spark, rows), ["scope"]).count() == 0


def test_topic_merge_bias_and_ties(spark):
    batches = spark.createDataFrame([(1, 0, 100), (1, 1, 100)], "scope long, batch_id long, batch_size long")
    topics = spark.createDataFrame(
        [(1, 0, "service", "positive", 4.0, 3, ["fast", "kind"], "s0"),
         (1, 1, "service", "negative", 2.0, 2, ["kind", "slow"], "s1"),
         (1, 0, "price", "neutral", 5.0, 1, ["cheap"], "p0")],
        "scope long, batch_id long, topic string, sentiment string, score double, mentions long, "
        "keywords array<string>, summary string")
    out = {r.topic: r for r in G.merge_topics(topics, batches, ["scope"]).collect()}
    assert out["service"].sentiment == "positive"           # tie 100/100 -> positive first
    assert out["service"].score == 3.0 and out["service"].mentions == 5
    assert out["service"].keywords == ["fast", "kind", "slow"]
    assert out["price"].score == 2.5                         # 5.0*100 / 200: missing topic biases down
    present = {r.topic: r for r in G.merge_topics(topics, batches, ["scope"], denominator="present").collect()}
    assert present["price"].score == 5.0
    assert "ambiance" not in out


def test_split_batches(spark):
    df = spark.range(0, 250).select(F.lit("b").alias("business_id"), F.col("id").alias("seq"))
    b = G.split_batches(df, ["business_id"], "seq", batch_size=100)
    sizes = sorted((r.batch_id, r.batch_size) for r in b.select("batch_id", "batch_size").distinct().collect())
    assert sizes == [(0, 100), (1, 100), (2, 50)]


def test_merged_percentages_sum_to_100(spark):
    from pyspark.sql import functions as F
    from revlens.sources.fixtures import fx_batch_results
    m = G.merge_sentiment(fx_batch_results(spark, "/root/testdata/sf0.001"), ["scope"])
    multi = m.filter(F.col("batches_processed").isNotNull())
    bad = multi.filter(F.col("positive") + F.col("negative") + F.col("neutral") != 100).count()
    assert multi.count() > 0 and bad == 0


def test_split_then_merge_mentions_equal_unsplit(spark):
    from revlens.operators import sentiment as S
    from revlens.sources.fixtures import fx_reviews
    from revlens.plans.q_retrieve import DRIVER_TOPICS
    rev = fx_reviews(spark, "/root/testdata/sf0.001")
    lex = S.lexicon_table(spark, DRIVER_TOPICS)
    whole = {(r.business_id, r.topic): r.mentions for r in S.topic_stats(rev, lex).collect()}
    b = G.split_batches(rev, ["business_id"], "seq", batch_size=7)
    per_batch = S.topic_stats(b, lex, scope=["business_id", "batch_id"])
    summed = per_batch.groupBy("business_id", "topic").agg(F.sum("mentions").alias("m")).collect()
    assert {(r.business_id, r.topic): r.m for r in summed} == whole
