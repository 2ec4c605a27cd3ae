"""Quality evaluation of predicted sentiment against star-derived truth (inventory J1-J12).

Metrics are aggregates over the (at most 3 x 3) confusion counts, so the per-review
table is scanned once and everything after that touches a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collect import best_matches, reviews_of, search_businesses
from .modelio import SENTIMENTS
from .ordering import _cols
from .profile import attach_one_row, stars_to_label
from ..sources.literal import literal_table

# --- fixed values -------------------------------------------------------------------
EVAL_TEST_LIMIT = 100
EVAL_SAMPLE = 30
# ------------------------------------------------------------------------------------


def test_set(biz: DataFrame, reviews: DataFrame, request: str, limit: int = EVAL_TEST_LIMIT) -> DataFrame:
    """Best match of a name search (most reviews, file order on ties), its first
    ``limit`` reviews, labelled from stars."""
    best = best_matches(search_businesses(biz, [request]), 1)
    rows = reviews_of(reviews, best, limit=limit)
    return rows.withColumn("ground_truth", stars_to_label("stars"))


def predicted_label(pos, neg, neu, ok: Column | None = None) -> Column:
    """Argmax of the three percentages, ties in order positive, negative, neutral;
    a failed answer predicts neutral."""
    p, n, u = (F.col(x) if isinstance(x, str) else x for x in (pos, neg, neu))
    lab = F.when((p >= n) & (p >= u), "positive").when(n >= u, "negative").otherwise("neutral")
    lab = F.coalesce(lab, F.lit("neutral"))
    return lab if ok is None else F.when(ok, lab).otherwise(F.lit("neutral"))


def confusion(df: DataFrame, y: str = "y", p: str = "p", labels: Sequence[str] = SENTIMENTS) -> DataFrame:
    """Counts per (truth, predicted) over the fixed label order, zero cells included.
    Long form ``(y, p, n)``; ``pivot`` it for the 3 x 3 matrix."""
    counts = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    grid = literal_table(spark, [(a, b) for a in labels for b in labels], "y string, p string")
    extra = counts.join(grid, ["y", "p"], "left_anti")   # labels outside the fixed set
    return (grid.join(counts, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).alias("n"))
            .unionByName(extra))


def class_report(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Per label precision, recall, F1, support (labels = truth U predictions,
    zero_division=0), plus ``accuracy``, ``macro avg`` and ``weighted avg`` rows."""
    c = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tp = c.filter("y = p").select(F.col("y").alias("label"), F.col("n").alias("tp"))
    sup = c.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"))
    pred = c.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    per = (sup.join(pred, "label", "full_outer").join(tp, "label", "left")
           .select("label", *[F.coalesce(x, F.lit(0)).alias(x) for x in ["support", "predicted", "tp"]]))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumn("precision", prec).withColumn("recall", rec)
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(F.lit(0.0)))
    summary = per.agg(F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                      (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                      (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                      (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
                      F.sum("support").alias("total"), F.sum("tp").alias("tp"))
    def row(label, pr, rc, f1):
        return F.struct(F.lit(label).alias("label"), pr.cast("double").alias("precision"),
                        rc.cast("double").alias("recall"), f1.cast("double").alias("f1"),
                        F.col("total").cast("long").alias("support"))
    none = F.lit(None)
    rows = summary.select(F.explode(F.array(
        row("accuracy", none, none, F.col("tp") / F.col("total")),
        row("macro avg", F.col("mp"), F.col("mr"), F.col("mf")),
        row("weighted avg", F.col("wp"), F.col("wr"), F.col("wf")))).alias("r")).select("r.*")
    return per.select("label", "precision", "recall", "f1", F.col("support").cast("long")).unionByName(rows)


def accuracy(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """J4."""
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def count_alignment(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Truth vs predicted counts per label, outer-aligned, missing -> 0."""
    t = df.groupBy(F.col(y).alias("label")).agg(F.count(F.lit(1)).alias("ground_truth"))
    q = df.groupBy(F.col(p).alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    return t.join(q, "label", "full_outer").select(
        "label", F.coalesce("ground_truth", F.lit(0)).alias("ground_truth"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"))


def label_shares(df: DataFrame, label: str, scope: Sequence[str] = ()) -> DataFrame:
    """Percentage of rows per label (per scope), all three labels present (0 if none)."""
    scope = _cols(scope)
    aggs = [(F.count_if(F.col(label) == s) * 100.0 / F.count(F.lit(1))).alias(f"pct_{s}") for s in SENTIMENTS]
    return df.groupBy(*scope).agg(*aggs) if scope else df.agg(*aggs)


def mae3(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Mean absolute difference over the three classes (missing = 0)."""
    terms = [F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))) for x, y in zip(a, b)]
    return (terms[0] + terms[1] + terms[2]) / 3


def checker_coverage(checked: DataFrame) -> DataFrame:
    """Over checked answers: cases, total errors and warnings, answers fixed
    (errors > 0) and their share."""
    # conditional aggregates rather than a filter on ``ok``: the filter would be pushed
    # below the checker's projection and re-evaluate the parsed answer per reference
    ok = F.col("ok")
    fixed = F.count_if(ok & (F.size("errors") > 0))
    return checked.agg(F.count_if(ok).alias("cases"), F.sum(F.when(ok, F.size("errors"))).alias("errors"),
                       F.sum(F.when(ok, F.size("warnings"))).alias("warnings"), fixed.alias("fixed"),
                       (fixed * 100.0 / F.count_if(ok)).alias("pct_fixed"))


__all__ = ["test_set", "predicted_label", "confusion", "class_report", "accuracy", "count_alignment",
           "label_shares", "mae3", "checker_coverage", "attach_one_row"]
