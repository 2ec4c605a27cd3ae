import json

from pyspark.sql import functions as F

from revlens.operators import checker as K
from revlens.operators import modelio as M


def _check_sent(spark, answers, reviews):
    corpus = " ".join(reviews).lower()
    rows = [(i, json.dumps(a) if not isinstance(a, str) else a, corpus) for i, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "id long, raw string, corpus string").withColumn("v", M.extract_json("raw"))
    return {r.id: r for r in K.check_sentiment(df).collect()}


REVIEWS = ["Noodles taste great", "Waited far too long", "Fair price overall"]


def test_golden_sentiment_demo(spark):
    bad = {"positive": 80, "negative": 40, "neutral": 20, "summary": "",
           "positive_highlights": ["noodles taste"], "negative_highlights": "too long"}
    r = _check_sent(spark, [bad], REVIEWS)[0]
    assert r.ok and (r.positive, r.negative, r.neutral) == (57.0, 29.0, 14.0)
    assert len(r.errors) == 1 and len(r.warnings) == 2
    assert r.negative_highlights == [] and r.summary == K.DEFAULT_SENTIMENT_SUMMARY


def test_golden_evaluation_cases(spark):
    cases = [
        {"positive": 80, "negative": 40, "neutral": 20, "summary": "ok", "positive_highlights": [],
         "negative_highlights": []},
        {"positive": 60, "negative": 30},
        {"positive": 60, "negative": 30, "neutral": 10, "summary": "ok",
         "positive_highlights": ["excellent sushi"], "negative_highlights": ["terrible ramen"]},
        {"positive": 60, "negative": 30, "neutral": 10, "summary": "Good",
         "positive_highlights": ["ngon"], "negative_highlights": ["long wait"]},
    ]
    out = _check_sent(spark, cases, ["noodles ngon", "long wait here", "fair price"])
    got = [(len(out[i].errors), len(out[i].warnings)) for i in range(4)]
    assert got == [(0, 1), (6, 2), (0, 2), (0, 0)]
    assert (out[1].positive, out[1].negative, out[1].neutral) == (67.0, 33.0, 0.0)
    fixed = sum(1 for i in range(4) if len(out[i].errors) > 0)
    assert fixed / 4 == 0.25


def test_range_fix_overwrites_normalisation(spark):
    a = {"positive": 120, "negative": 30, "neutral": 0, "summary": "s", "positive_highlights": [],
         "negative_highlights": []}
    r = _check_sent(spark, [a], REVIEWS)[0]
    assert (r.positive, r.negative, r.neutral) == (100.0, 20.0, 0.0)
    assert len(r.errors) == 1 and len(r.warnings) == 1


def test_failures(spark):
    answers = [
        'no json at all',
        {"positive": "60", "negative": 40, "neutral": 0, "summary": "s"},          # non-numeric %
        {"positive": 60, "negative": 40, "neutral": 0, "summary": None},           # null summary
        {"positive": 60, "negative": 40, "neutral": 0, "summary": "s", "positive_highlights": [1]},
        {},
        'Sure! ```json\n{"positive": 100, "negative": 0, "neutral": 0, "summary": "x", '
        '"positive_highlights": [], "negative_highlights": []}\n``` bye',
    ]
    out = _check_sent(spark, answers, REVIEWS)
    assert [out[i].ok for i in range(6)] == [False, False, False, False, False, True]
    assert out[0].positive is None


def _check_topics(spark, answer, reviews):
    corpus = " ".join(reviews).lower()
    df = spark.createDataFrame([(0, json.dumps(answer), corpus)], "id long, raw string, corpus string")
    df = df.withColumn("v", M.extract_json(M.strip_fence("raw")))
    return K.check_topics(df)


def test_golden_topic_demo(spark):
    bad = {
        "food_quality": {"sentiment": "positive", "score": 6.5, "mentions": -1, "keywords": ["sushi", "ramen"],
                         "summary": "Tasty"},
        "service": {"sentiment": "excellent", "score": 4.0, "mentions": 2, "keywords": ["very attentive"],
                    "summary": ""},
    }
    c = _check_topics(spark, bad, REVIEWS)
    r = c.first()
    assert r.ok and len(r.errors) == 3 and len(r.warnings) == 6
    assert r.food_quality.score == 5.0 and r.food_quality.mentions == 0
    assert r.service.sentiment == "neutral" and r.price.present is False
    long = K.topics_long(c, ["id"]).orderBy("topic_ord").collect()
    assert [x.topic for x in long] == ["food_quality", "service", "price", "ambiance"]
    st = K.check_status(c).first()
    assert st.status == "3 errors"


def test_topic_failures(spark):
    no_mentions = {"food_quality": {"sentiment": "positive", "score": 4, "keywords": [], "summary": "x"}}
    not_object = {"service": "good"}
    assert _check_topics(spark, no_mentions, REVIEWS).first().ok is False
    assert _check_topics(spark, not_object, REVIEWS).first().ok is False
    float_mentions = {"price": {"sentiment": "negative", "score": 4.0, "mentions": 8.0, "keywords": [],
                                "summary": "x"}}
    r = _check_topics(spark, float_mentions, REVIEWS).first()
    assert r.ok and r.price.mentions == 0
    # mentions warning + negative-but-high-score warning
    assert len(r.warnings) == 2


def test_topic_rules_do_not_repeat_each_others_expressions(spark):
    """Each fact of a topic is one column: nested, the score's test stood 60 times and more in the plan of four topics."""
    from pyspark.sql import functions as F

    from revlens.operators import checker as K
    from revlens.operators import modelio as M
    rows = [(1, '{"service": {"sentiment": "positive", "score": 2.0, "mentions": 1, "keywords": ["Tasty food", "ok"], "summary": "x"}}', "very tasty food")]
    got = K.check_topics(spark.createDataFrame(rows, "id int, raw string, corpus string").withColumn("v", M.extract_json("raw")))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("schema_of_variant(_t_food_quality_score") <= 3
    r = got.select("service.*", F.size("errors").alias("e"), "warnings").first()
    assert (r.sentiment, r.score, r.mentions, r.keywords, r.e) == ("positive", 2.0, 1, ["Tasty food", "ok"], 3)
    assert r.warnings == ["'service' sentiment=positive but score=2 < 3.0 -> inconsistent"]
