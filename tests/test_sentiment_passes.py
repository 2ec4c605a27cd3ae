"""The texts pass through an expensive step once."""
from pyspark.sql import functions as F

from revlens.operators import sentiment as S

GOOD, BAD = "tasty dish and friendly waiter", "slow rude and cold soup"


def test_training_reads_the_reviews_once(spark):
    read = spark.sparkContext.accumulator(0)

    def touch(t):
        read.add(1)
        return t
    rows = [(i, GOOD if i % 2 else BAD, "positive" if i % 2 else "negative") for i in range(60)] + [(60, None, "negative"), (61, "unlabelled", None)]
    df = spark.createDataFrame(rows, "review_id long, text string, label string")
    seen = df.withColumn("text", F.udf(touch).asNondeterministic()("text"))
    model = S.train_classifier(seen, max_iter=5)
    assert read.value == 62
    out = {r.review_id: r.predicted for r in S.apply_classifier(model, df.filter("text IS NOT NULL AND label IS NOT NULL")).collect()}
    assert out == {i: "positive" if i % 2 else "negative" for i in range(60)}
