from pyspark.sql import functions as F

from revlens.functions import half_star, is_spam, py_strip, py_word_count, to_numeric


def _col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_py_strip_matches_python(spark):
    vals = [" abc defghij ", "\x1cabcdefghij", "   ", "　x ", "\tq\n"]
    assert _col(spark, vals, py_strip) == [v.strip() for v in vals]


def test_word_count(spark):
    vals = ["  a  b ", "", "one", "x y\nz"]
    assert _col(spark, vals, py_word_count) == [len(v.split()) for v in vals]


def test_spam_rules(spark):
    vals = ["!!!!!!!!!!", "aaaaaaaaaa", "ăăăăăăăăăă", "1234567890", "٣٤٥٣٤٥٣٤٥٣", "ab 123456789",
            "很好吃很好吃很好吃很好吃", "Good food and nice staff"]
    # repeated letters are spam (rule 2); CJK text has no letter in the Latin/Vietnamese range
    assert _col(spark, vals, is_spam) == [True, True, True, True, True, True, True, False]


def test_to_numeric_like_pandas(spark):
    vals = ["5d", " 5 ", "5e0", "inf", "", "True", "2.5", "nan", None]
    out = _col(spark, vals, to_numeric)
    assert out[0] is None and out[1] == 5.0 and out[2] == 5.0 and out[3] == float("inf")
    assert out[4] is None and out[5] is None and out[6] == 2.5 and out[7] is None and out[8] is None


def test_half_star_is_half_even(spark):
    vals = [2.25, 2.75, 4.5 / 2, 1.0, 3.3]
    assert _col(spark, vals, half_star, "double") == [round(v * 2) / 2 for v in vals]
