import random

from pyspark.sql import functions as F

from revlens.operators import checker as K
from revlens.operators import modelio as M


def test_phrases_found_in_rows_equal_the_corpus_string(spark):
    """One business of a third of all rows, keywords across the seam of two reviews, null texts, answers without phrases."""
    rnd = random.Random(1)
    words = ["sushi", "ramen", "staff", "good", "Service", "slow", "price", "nhiệt", "tình"]
    rows = [(f"b{i % 20 if i % 3 else 0}", i, None if i % 17 == 0 else " ".join(rnd.choices(words, k=rnd.randrange(3, 7)))) for i in range(600)]
    reviews = spark.createDataFrame(rows, "business_id string, seq long, text string")

    def topic(ks):
        return '{"sentiment":"positive","score":4.0,"mentions":1,"keywords":[%s],"summary":"s"}' % ",".join(f'"{k}"' for k in ks)

    answers = []
    for b in range(22):  # two answers have no review at all
        ks = [" ".join(rnd.choices(words, k=rnd.randrange(1, 4))) for _ in range(8)] + ["unheard of", "abc"]
        answers.append((f"b{b}", '{"food_quality":%s,"service":%s,"price":%s,"ambiance":%s}' % tuple(topic(ks[i::4]) for i in range(4)),
                        '{"positive":60,"negative":20,"neutral":20,"summary":"s","positive_highlights":["%s","nothing there"],"negative_highlights":[]}' % ks[0]))
    df = spark.createDataFrame(answers, "business_id string, raw string, sent string").withColumn("v", M.extract_json("raw")).withColumn("w", M.extract_json("sent"))
    corpus = M.review_block(reviews, ["business_id"]).select("business_id", "corpus")
    whole = df.join(corpus, "business_id", "left")
    for check, phrases, v in ((K.check_topics, K.topic_phrases("v"), "v"), (K.check_sentiment, K.sentiment_phrases("w"), "w")):
        found = K.supported_phrases(df.withColumn("phrases", phrases), reviews, ["business_id"])
        rows_ = check(df.join(found, "business_id", "left"), v, supported="supported")
        pick = ["business_id", "ok", "errors", "warnings"]
        got, want = (sorted(map(str, x.select(*pick).collect())) for x in (rows_, check(whole, v)))
        assert [(g, w) for g, w in zip(got, want) if g != w][:1] == []
    assert K.supported_phrases(df.withColumn("phrases", K.topic_phrases("v")), reviews.limit(0), ["business_id"]).count() == 0
