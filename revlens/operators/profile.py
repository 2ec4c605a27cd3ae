"""Exploratory profiling of business and review tables (inventory I1-I23).

All outputs are aggregates: partial (map-side) aggregation, then a shuffle of at most one
row per group per partition.  Histogram bounds come from a one-row aggregate joined back
(a broadcast of exactly one row); top-k lists are taken from the already-aggregated
counts.  Nothing is sampled unless the step itself is a sample (I20), and the reference's
"first 50,000 lines" profiling prefix is available only as an explicit option
(``first_rows``), never applied by default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import equal_width_bin
from ..functions.text import py_strip, py_word_count
from ..sources.literal import literal_table
from .joins import join_on

# --- fixed values -------------------------------------------------------------------
FOOD_KEYWORDS = ["Restaurant", "Food", "Fast Food", "Burgers", "Pizza", "Sushi"]
PROFILE_SAMPLE_ROWS = 50000
LABELS = ["positive", "negative", "neutral"]
# ------------------------------------------------------------------------------------


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row of ``df``.

    The aggregate is evaluated once as a scalar subquery (``DataFrame.scalar``) and its
    value is attached to each row: no join, no pairs.
    """
    cols = one_row.columns
    s = one_row.select(F.struct(*cols).alias("_one")).scalar()
    out = df.withColumn("_one", s)
    return out.select(*df.columns, *[F.col("_one")[c].alias(c) for c in cols])


def first_rows(df: DataFrame, n: int = PROFILE_SAMPLE_ROWS, order: str = "seq") -> DataFrame:
    """A10: the reference profiles the first ``n`` lines of the file (a prefix, not random).
    Offered as an explicit option; the profiling functions default to the whole table."""
    return df.orderBy(order).limit(n)


# I1
def business_summary(biz: DataFrame) -> DataFrame:
    return biz.agg(
        F.count(F.lit(1)).alias("n_business"),
        F.count_distinct("state").alias("n_states"),
        F.count_distinct("city").alias("n_cities"),
        F.avg("stars").alias("mean_stars"),
        F.avg("review_count").alias("mean_review_count"),
        F.max("review_count").alias("max_review_count"))


# I2
def null_counts(df: DataFrame) -> DataFrame:
    """Null count per column, only columns with at least one null: ``(column, nulls)``."""
    cols = df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.select(F.expr(f"stack({len(cols)}, {pairs}) AS (`column`, nulls)")).filter("nulls > 0")


# I3 / I11
def value_distribution(df: DataFrame, col: str, share: bool = False) -> DataFrame:
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if share:
        total = df.agg(F.count(F.lit(1)).alias("_total"))
        out = attach_one_row(out, total).withColumn("pct", F.col("n") * 100.0 / F.col("_total")).drop("_total")
    return out


# I4 / I6 top-k of counts
def top_counts(df: DataFrame, col: str, k: int) -> DataFrame:
    """Top ``k`` values by count (ties by value). Sorting happens on the aggregated counts."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(col)).limit(k))


# I5 / I12 / I19
def histogram(df: DataFrame, col: str, bins: int = 50, clip: tuple[float, float] | None = None,
              by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram over [min, max] of ``col`` (per ``by`` group), last bin closed,
    empty bins included.  ``clip`` clips values first (the reference's ``clip(0, 2000)``)."""
    by = list(by)
    x = F.col(col).cast("double")
    if clip is not None:
        x = F.least(F.greatest(x, F.lit(float(clip[0]))), F.lit(float(clip[1])))
    vals = df.select(*by, x.alias("_x")).filter(F.col("_x").isNotNull())
    bounds = vals.groupBy(*by).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    # one row per group (one row in all without groups), broadcast by Spark when that is
    # small; beyond, AQE splits the rows of a hot group
    if by:
        joined = join_on(vals, bounds, by)
    else:
        joined = attach_one_row(vals, bounds)
    counts = (joined.withColumn("bin", equal_width_bin("_x", "lo", "hi", bins))
              .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n")))
    grid = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    return (join_on(grid, counts, [*by, "bin"], "left")
            .select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce("n", F.lit(0)).alias("n")))


# I6
def category_counts(biz: DataFrame, k: int = 20) -> DataFrame:
    """Split comma-joined categories, strip each piece, count; null skipped, empty pieces
    counted."""
    pieces = biz.filter(F.col("categories").isNotNull()).select(
        F.explode(F.split("categories", ",")).alias("p")).select(py_strip("p").alias("category"))
    return top_counts(pieces, "category", k)


# I7
def food_filter(biz: DataFrame, keywords: Sequence[str] = FOOD_KEYWORDS) -> DataFrame:
    cats = F.lower(F.coalesce(F.col("categories"), F.lit("")))
    cond = F.lit(False)
    for kw in keywords:
        cond = cond | cats.contains(kw.lower())
    return biz.filter(cond)


def food_summary(biz: DataFrame, keywords: Sequence[str] = FOOD_KEYWORDS) -> DataFrame:
    cats = F.lower(F.coalesce(F.col("categories"), F.lit("")))
    cond = F.lit(False)
    for kw in keywords:
        cond = cond | cats.contains(kw.lower())
    return biz.agg(
        F.count_if(cond).alias("n_food"),
        (F.count_if(cond) * 100.0 / F.count(F.lit(1))).alias("pct_food"),
        F.avg(F.when(cond, F.col("stars"))).alias("mean_stars_food"),
        F.avg(F.when(cond, F.col("review_count"))).alias("mean_review_count_food"))


# I8 / I9
def with_text_metrics(rev: DataFrame, date_col: str | None = "date") -> DataFrame:
    out = rev.withColumn("text_length", F.length("text")).withColumn("word_count", py_word_count("text"))
    if date_col and date_col in rev.columns:
        ts = F.col(date_col) if dict(rev.dtypes)[date_col].startswith("timestamp") \
            else F.try_to_timestamp(F.col(date_col))
        out = out.withColumn("year", F.year(ts))
    return out


# I10
def review_summary(rev: DataFrame) -> DataFrame:
    m = with_text_metrics(rev)
    aggs = [F.count(F.lit(1)).alias("n_reviews"), F.avg("stars").alias("mean_stars"),
            F.avg("text_length").alias("mean_length"), F.min("text_length").alias("min_length"),
            F.max("text_length").alias("max_length"), F.avg("word_count").alias("mean_words")]
    if "year" in m.columns:
        aggs += [F.min("year").alias("min_year"), F.max("year").alias("max_year")]
    return m.agg(*aggs)


# I13
def per_year(df: DataFrame, date_col: str) -> DataFrame:
    ts = F.col(date_col) if dict(df.dtypes)[date_col].startswith("timestamp") else F.try_to_timestamp(F.col(date_col))
    return df.groupBy(F.year(ts).alias("year")).agg(F.count(F.lit(1)).alias("n"))


# I14
def mean_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias(f"mean_{value}"))


# I15
def short_reviews(rev: DataFrame, min_len: int = 10, examples: int = 5, order: str = "seq") -> DataFrame:
    """Count and share of texts shorter than ``min_len`` (unstripped) and the first examples."""
    short = F.length("text") < min_len
    stats = rev.agg(F.count_if(short).alias("n_short"),
                    (F.count_if(short) * 100.0 / F.count(F.lit(1))).alias("pct_short"))
    ex = (rev.filter(short).orderBy(order).limit(examples)
          .agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("e")))  # <= examples rows
    return attach_one_row(stats, ex.select(F.transform("e", lambda s: s["text"]).alias("examples")))


# I16
def valid_share(rev: DataFrame) -> DataFrame:
    ok = F.length("text").between(10, 5000) & F.col("stars").between(1, 5)
    return rev.agg(F.count_if(ok).alias("n_valid"),
                   (F.count_if(ok) * 100.0 / F.count(F.lit(1))).alias("pct_valid"))


# I17
def stars_to_label(stars) -> "F.Column":
    s = F.col(stars) if isinstance(stars, str) else stars
    return F.when(s >= 4, "positive").when(s <= 2, "negative").otherwise("neutral")


# I18
def label_distribution(rev: DataFrame) -> DataFrame:
    return value_distribution(rev.withColumn("label", stars_to_label("stars")), "label", share=True)


# I19
def length_by_label(rev: DataFrame, bins: int = 40, clip: float = 2000) -> DataFrame:
    lab = rev.withColumn("label", stars_to_label("stars")).withColumn("text_length", F.length("text"))
    hist = histogram(lab, "text_length", bins=bins, clip=(0, clip), by=["label"])
    means = lab.groupBy("label").agg(F.avg("text_length").alias("mean_length"))
    return hist.join(means, "label")


# I20
def sample_key(id_col: str, seed: int = 42) -> "F.Column":
    """Deterministic pseudo-random rank key from any id: md5 of seed and id as text (same value
    in any engine, no overflow; a struct id as Spark casts it to text)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))


def sample_per_label(rev: DataFrame, n: int = 500, id_col: str = "seq", seed: int = 42) -> DataFrame:
    """Up to ``n`` rows per label, chosen by a seeded hash rank (a WindowGroupLimit plan:
    at most n rows per label leave each partition).  A label with fewer rows yields them all
    (the reference raises instead)."""
    lab = rev.withColumn("label", stars_to_label("stars")).withColumn("_k", sample_key(id_col, seed))
    w = Window.partitionBy("label").orderBy("_k", id_col)
    return lab.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn", "_k")


# I21
def word_weights(rev: DataFrame, top: int = 80, stop_words: Sequence[str] | None = None,
                 by: str = "label") -> DataFrame:
    """Top ``top`` words per label: lower-cased tokens of 2+ word characters (apostrophes
    allowed inside), stop-words removed by a broadcast anti-join, counted and ranked."""
    if stop_words is None:
        from ..functions.text import spark_stop_words
        stop_words = spark_stop_words("english")
    spark = rev.sparkSession
    sw = literal_table(spark, [(w,) for w in sorted(set(stop_words))], "word string")
    src = rev.withColumn("label", stars_to_label("stars")) if by == "label" and "label" not in rev.columns else rev
    toks = src.select(by, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}_][\\p{L}\\p{N}_']+"), 0))
                      .alias("word"))
    counts = (toks.join(F.broadcast(sw), "word", "left_anti")   # stop list: fixed size
              .groupBy(by, "word").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(by).orderBy(F.desc("n"), F.asc("word"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


# I22
def validator_funnel(rev: DataFrame) -> DataFrame:
    """Raw -> non-blank -> len>=10 -> stars 1..5 -> distinct text; count and % of raw."""
    nonblank = F.col("text").isNotNull() & (py_strip("text") != "")
    longok = nonblank & (F.length("text") >= 10)
    starsok = longok & F.col("stars").between(1, 5)
    one = rev.agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(nonblank).alias("nonblank"),
        F.count_if(longok).alias("min_length"), F.count_if(starsok).alias("stars_ok"),
        F.count_distinct(F.when(starsok, F.col("text"))).alias("dedup"))
    st = one.select(F.col("raw"), F.expr(
        "stack(5, 0, 'raw', raw, 1, 'nonblank', nonblank, 2, 'min_length', min_length, "
        "3, 'stars_ok', stars_ok, 4, 'dedup', dedup) AS (stage_ord, stage, n)"))
    return st.select("stage_ord", "stage", "n",
                     F.when(F.col("raw") > 0, F.col("n") * 100.0 / F.col("raw")).alias("pct"))


# I23
def insight_summary(biz: DataFrame, rev: DataFrame) -> DataFrame:
    b = biz.agg(F.count(F.lit(1)).alias("n_business"))
    f = food_summary(biz).select("n_food", "pct_food")
    lab = stars_to_label("stars")
    r = rev.agg(
        F.count(F.lit(1)).alias("n_reviews"),
        *[(F.count_if(lab == x) * 100.0 / F.count(F.lit(1))).alias(f"pct_{x}") for x in LABELS],
        F.avg(F.length("text")).alias("mean_length"),
        (F.count_if(F.length("text") < 10) * 100.0 / F.count(F.lit(1))).alias("pct_short"))
    return attach_one_row(attach_one_row(b, f), r)   # three one-row aggregates
