"""Plan-shape checks for the scale rules: fixed tables stay JVM-side, the text is tokenized
once per retrieval, answer/corpus pairs never broadcast, reused inputs are written once."""

from pyspark.sql import functions as F

from revlens.operators import retrieve as D
from revlens.operators import sentiment as S
from revlens.operators.joins import join_large
from revlens.operators.lineage import materialize
from revlens.sources.literal import literal_table

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_literal_table_rows_types_and_no_python(spark):
    t = literal_table(spark, [("a", 1, 2.5), ("b'q", 2, None)], "k string, n int, x double")
    assert t.schema.simpleString() == "struct<k:string,n:int,x:double>"
    assert sorted(map(tuple, t.collect()), key=lambda r: r[0]) == [("a", 1, 2.5), ("b'q", 2, None)]
    plan = _plan(t)
    assert "ExistingRDD" not in plan and "PythonRDD" not in plan
    assert t.rdd.getNumPartitions() == 1
    assert literal_table(spark, [], "k string").count() == 0


def test_topic_tables_are_literals(spark):
    for df in (D.topic_query_table(spark), S.lexicon_table(spark)):
        assert "ExistingRDD" not in _plan(df)


def test_tfidf_tokenizes_the_text_at_most_once(spark):
    from revlens.plans.q_retrieve import DRIVER_TOPICS
    from revlens.sources.fixtures import fx_reviews
    top = D.tfidf_topk(fx_reviews(spark, SF), D.topic_query_table(spark, DRIVER_TOPICS), k=3)
    plan = _plan(top)
    assert plan.count("regexp_extract_all(lower(text") <= 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_join_large_is_a_sort_merge_join_even_when_small(spark):
    a = spark.range(10).withColumnRenamed("id", "k")
    b = spark.range(5).withColumnRenamed("id", "k").withColumn("v", F.lit("corpus"))
    j = join_large(a, b, "k", "left")
    plan = _plan(j)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert j.count() == 10 and j.filter(F.col("v").isNotNull()).count() == 5


def test_materialize_keeps_rows_and_cuts_lineage(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("g")).groupBy("g").count()
    m = materialize(df)
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, df.collect()))
    assert "Aggregate" not in m._jdf.queryExecution().optimizedPlan().toString()


def test_highlight_phrases_matches_bruteforce(spark):
    import re
    rows = [("b1", "r1", "positive", "great food great staff"), ("b1", "r2", "positive", "great food here"),
            ("b1", "r3", "negative", "cold food slow staff"), ("b1", "r4", "neutral", "food here ok"),
            ("b2", "r5", "negative", "too noisy"), ("b2", "r6", "positive", "quiet place")]
    df = spark.createDataFrame(rows, "business_id string, review_id string, label string, text string")
    got = {(r.business_id, r.label, r.phrase): round(r.contrast, 9)
           for r in S.highlight_phrases(df, ["business_id"], n=100).collect()}
    want = {}
    for b in {r[0] for r in rows}:
        rs = [r for r in rows if r[0] == b]
        for c in ("positive", "negative"):
            inc = [r for r in rs if r[2] == c]
            out = [r for r in rs if r[2] != c]

            def bigrams(t):
                w = re.findall(r"\w+", t.lower())
                return {w[i] + " " + w[i + 1] for i in range(len(w) - 1)}
            for p in set().union(*[bigrams(r[3]) for r in inc]) if inc else set():
                d_in = sum(p in bigrams(r[3]) for r in inc)
                d_out = sum(p in bigrams(r[3]) for r in out)
                con = d_in / len(inc) - (d_out / len(out) if out else 0.0)
                if con > 0:
                    want[(b, c, p)] = round(con, 9)
    assert got == want


def test_highlight_phrases_computes_bigrams_once_and_shuffles_no_phrase_by_scope(spark):
    rows = [("b1", f"r{i}", "positive" if i % 2 else "negative", t) for i, t in enumerate(
        ["good food here", "good food there", "bad food", "", None, "one", "slow slow slow", "bad food again"])]
    rows += [(None, "n1", "positive", "good food"), ("b2", "e1", "neutral", None)]
    df = spark.createDataFrame(rows, "business_id string, review_id string, label string, text string")
    top = S.highlight_phrases(df, ["business_id"])
    plan = _plan(top)
    assert plan.count("zip_with(") == 1 and plan.count("regexp_extract_all(") == 1
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = {(r.business_id, r.label, r.phrase, r.df) for r in top.collect()}
    assert got == {("b1", "positive", "food there", 1), ("b1", "positive", "food again", 1),
                   ("b1", "negative", "slow slow", 1), ("b1", "negative", "food here", 1)}


def test_tfidf_shuffles_all_terms_once_to_meet_the_frequencies(spark):
    df = spark.createDataFrame([("b1", f"r{i}", t) for i, t in enumerate(["good food good", "food", "nothing of it", "", None])]
                               + [(None, "n1", "good service")], "business_id string, review_id string, text string")
    queries = spark.createDataFrame([("food", "good food"), ("service", "service")], "topic string, query string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        top = D.tfidf_topk(df, queries, k=2)
        plan = _plan(top)
        assert "ShuffledHashJoin" in plan
        got = {(r.business_id, r.topic, r["rank"]): (r.review_id, round(r.score, 6)) for r in top.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    import math
    n, docs = 5, {"r0": {"good": 2, "food": 1}, "r1": {"food": 1}}
    idf = {"good": math.log((n + 1) / 2) + 1, "food": math.log((n + 1) / 3) + 1}
    qnorm = math.sqrt(sum(x * x for x in idf.values()))
    want = {r: sum(tf * idf[t] ** 2 for t, tf in c.items()) / math.sqrt(sum((tf * idf[t]) ** 2 for t, tf in c.items())) / qnorm
            for r, c in docs.items()}
    ranked = sorted(want, key=lambda r: -want[r])
    assert [got["b1", "food", i + 1] for i in range(2)] == [(r, round(want[r], 6)) for r in ranked]
    assert got[None, "service", 1][0] == "n1" and got["b1", "service", 1] == ("r0", 0.0)


def test_rank_matches_of_a_hot_request_equal_a_stable_sort(spark):
    import random
    from revlens.operators.collect import best_matches, rank_matches
    rnd = random.Random(3)
    rows = [("hot" if i % 10 else "cold", f"b{i}", rnd.randint(0, 20), i) for i in range(600)]
    m = spark.createDataFrame(rows, "request string, business_id string, review_count long, seq long")
    got = {(r.request, r.business_id): r.match_rank for r in rank_matches(m.repartition(7)).collect()}
    want = {}
    for req in ("hot", "cold"):
        ordered = sorted((r for r in rows if r[0] == req), key=lambda r: (-r[2], r[3]))
        want.update({(req, r[1]): i + 1 for i, r in enumerate(ordered)})
    assert got == want
    best = {r.request: r.business_id for r in best_matches(m, 1).collect()}
    assert best == {req: b for (req, b), rank in want.items() if rank == 1}


def test_near_duplicates_find_every_bruteforce_pair_on_driver_reviews(spark):
    from collections import defaultdict

    from revlens.operators.validate import near_duplicates
    from revlens.sources.fixtures import fx_reviews
    r = fx_reviews(spark, SF)
    got = {(x.business_id, x.seq, x.earlier_seq) for x in near_duplicates(r, ["business_id"]).collect()}
    by = defaultdict(list)
    for x in r.select("business_id", "seq", "text").collect():
        by[x.business_id].append((x.seq, {x.text[i:i + 5] for i in range(max(len(x.text) - 4, 1))}))
    want = {}
    for b, rows in by.items():
        rows.sort(key=lambda t: t[0])
        for i, (s, a) in enumerate(rows):
            for e, c in rows[:i]:
                if len(a & c) / len(a | c) >= 0.8:
                    want.setdefault((b, s), set()).add(e)
    # a reported pair is a true near-copy, and every row with an earlier near-copy is found
    assert all(e in want.get((b, s), set()) for b, s, e in got)
    assert {(b, s) for b, s, _ in got} == set(want)


def test_model_is_called_once_per_batch_however_often_answers_are_read(spark):
    import pandas as pd

    from revlens.operators import modelio as M
    calls = spark.sparkContext.accumulator(0)
    answer = ('{"positive": 100, "negative": 0, "neutral": 0, "summary": "x", '
              '"positive_highlights": [], "negative_highlights": []}')

    def scorer(blocks: pd.Series) -> pd.Series:
        calls.add(len(blocks))
        return blocks.map(lambda b: answer)
    batches = spark.createDataFrame([(i % 3, i, f"- review {i}") for i in range(12)],
                                    "scope long, batch_id long, block string")
    raw = M.score_batches(batches, scorer, keys=["scope", "batch_id"])
    per_scope = raw.groupBy("scope").count().collect()
    both = raw.join(raw.select("batch_id", F.col("raw").alias("again")), "batch_id").count()
    assert sum(r["count"] for r in per_scope) == 12 and both == 12
    assert calls.value == 12


def test_a_failing_block_is_found_by_asking_its_chunk_only(spark):
    import pandas as pd

    from revlens.operators import modelio as M
    calls = spark.sparkContext.accumulator(0)

    def scorer(blocks: pd.Series) -> pd.Series:
        calls.add(len(blocks))
        if blocks.str.contains("boom").any():
            raise RuntimeError("no answer")
        return blocks.str.upper()
    batches = spark.createDataFrame([(1, i, "boom" if i == 5 else f"b{i}") for i in range(40)],
                                    "scope long, batch_id long, block string").coalesce(1)
    got = {r.batch_id: (r.raw, r.error) for r in M.score_batches(batches, scorer, keys=["scope", "batch_id"], chunk=8).collect()}
    assert got == {i: ("", "RuntimeError: no answer") if i == 5 else (f"B{i}", None) for i in range(40)}
    assert calls.value == 40 + 8


def test_join_on_matches_null_keys_and_keeps_each_key_once(spark):
    from revlens.operators.joins import join_on
    a = spark.createDataFrame([("x", 1), (None, 2), ("y", 3)], "k string, a long")
    b = spark.createDataFrame([("x", 10), (None, 20), ("z", 30)], "k string, b long")

    def rows(df):
        return sorted(map(tuple, df.collect()), key=str)
    assert rows(join_on(a, b, "k")) == sorted([("x", 1, 10), (None, 2, 20)], key=str)
    assert rows(join_on(a, b, ["k"], "left_semi")) == sorted([("x", 1), (None, 2)], key=str)
    assert rows(join_on(a, b, "k", "left_anti")) == [("y", 3)]
    assert rows(join_on(a, b, "k", "full_outer")) == sorted([("x", 1, 10), (None, 2, 20), ("y", 3, None), ("z", None, 30)], key=str)


def test_overall_score_does_not_depend_on_the_order_of_the_topics(spark):
    from revlens.operators import report as H
    names = ["food_quality", "service", "price", "ambiance"]
    sentiment = spark.createDataFrame([("b", 50.0, 30.0, 20.0)], "business_id string, positive double, negative double, neutral double")
    for scores in ([1.0, 1.1, 1.2, 2.9], [1.0, 1.1, 2.9, 1.2]):  # their sums are 6.199999999999999 and 6.2
        topics = spark.createDataFrame([("b", t, "neutral", s, 1) for t, s in zip(names, scores)],
                                       "business_id string, topic string, sentiment string, score double, mentions long").coalesce(1)
        assert [r.overall_score for r in H.build_report(sentiment, topics, H.action_catalogue(spark)).collect()] == [1.6]
