"""Review validation and cleaning (inventory C1-C17).

Step order is the reviewed application's: columns -> text -> short -> long -> stars ->
dedup -> spam -> re-index.  Every row-local step is a column expression; the only shuffle
is keep-first dedup, done as a map-side-combined aggregate per (scope, text).

``scope`` is the dedup/statistics boundary: ``["business_id"]`` for reviews loaded per
business, ``[]`` for one uploaded file treated as one frame.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_star
from ..functions.text import is_spam, nan_to_null, py_strip, to_numeric
from .joins import join_on
from .lineage import write_table
from .ordering import _cols, dense_index, keep_first

# --- fixed values -------------------------------------------------------------------
MIN_TEXT_LENGTH = 10
MAX_TEXT_LENGTH = 5000
MIN_STAR_VALUE = 1
MAX_STAR_VALUE = 5
BUCKET_MEMBERS = 64               # members of a MinHash bucket that are compared without splitting it
NEAR_DUPLICATE_SIMILARITY = 0.8   # declared by the reference, never applied there (C17)
LOST = 1e-12                      # chance at most that a similar pair's sketches disagree so much that it is not compared
DEFAULT_STARS = 3
DEFAULT_BUSINESS_NAME = "Unknown"
# reject reasons, in pipeline order
REJECT_REASONS = ["text", "short", "stars", "duplicate", "spam"]
# ------------------------------------------------------------------------------------


def ensure_columns(df: DataFrame, order: str = "seq", id_prefix: str = "r_") -> DataFrame:
    """``text`` is required; absent columns get defaults.

    ``review_id`` defaults to ``r_{i}`` with ``i`` the 0-based position in the input order
    (computed with a skew-free dense index, not a single-partition window).
    """
    if "text" not in df.columns:
        raise ValueError("input frame has no 'text' column")
    if "stars" not in df.columns:
        df = df.withColumn("stars", F.lit(DEFAULT_STARS))
    if "review_id" not in df.columns:
        df = (dense_index(df, [], order, name="_i")
              .withColumn("review_id", F.concat(F.lit(id_prefix), F.col("_i").cast("string")))
              .drop("_i"))
    if "business_name" not in df.columns:
        df = df.withColumn("business_name", F.lit(DEFAULT_BUSINESS_NAME))
    if "date" not in df.columns:
        df = df.withColumn("date", F.lit(None).cast("string"))
    return df


def tag_row_rejects(df: DataFrame) -> DataFrame:
    """C2-C8 as one projection.

    Adds ``text_len_raw`` (length after strip, before truncation), replaces ``text`` by the
    stripped, truncated text and ``stars`` by the half-star value, and sets
    ``reject_reason`` to the first failing row-local step (NULL = passes).
    """
    t = py_strip(F.col("text").cast("string"))
    stars_num = to_numeric(F.col("stars"))
    reason = (F.when(F.col("text").isNull() | t.isin("", "nan"), F.lit("text"))
              .when(F.length(t) < MIN_TEXT_LENGTH, F.lit("short"))
              .when(stars_num.isNull() | ~stars_num.between(MIN_STAR_VALUE, MAX_STAR_VALUE), F.lit("stars")))
    return (df.withColumn("text_len_raw", F.length(t))
            .withColumn("reject_reason", reason)
            .withColumn("text", F.substring(t, 1, MAX_TEXT_LENGTH))
            .withColumn("stars", half_star(stars_num)))


def _dedup_and_spam(tagged: DataFrame, scope: list[str], order: str) -> DataFrame:
    survivors = tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    # a 64-bit hash of the text leads the key: sort/compare on it first, text breaks ties
    survivors = survivors.withColumn("_text_hash", F.xxhash64("text"))
    firsts = keep_first(survivors, [*scope, "_text_hash", "text"], order, count_col="_copies")
    return firsts.drop("_text_hash").withColumn("_spam", is_spam(F.col("text")))


def validate_reviews(df: DataFrame, scope: Sequence[str] = ("business_id",), order: str = "seq") -> DataFrame:
    """The composite validator; returns the clean rows (input columns, cleaned)."""
    scope = _cols(scope)
    cols = ensure_columns(df, order).columns
    tagged = tag_row_rejects(ensure_columns(df, order))
    out = _dedup_and_spam(tagged, scope, order).filter(~F.col("_spam"))
    return out.select(*cols)


def reindex(df: DataFrame, scope: Sequence[str] = (), order: str = "seq", name: str = "idx") -> DataFrame:
    """C14: dense 0..n-1 position per scope (whole frame when scope is empty)."""
    return dense_index(df, _cols(scope), order, name)


def validation_stats(before: DataFrame, after: DataFrame, scope: Sequence[str] = ("business_id",)) -> DataFrame:
    """Counts and means before/after per scope.

    A scope that loses every row still appears (full outer join) with ``total_after`` 0.
    Means are left unrounded here; ``present_validation_stats`` applies the reference's
    presentation rounding.
    """
    scope = _cols(scope)
    b = before.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("total_before"),
        F.avg(to_numeric(F.col("stars"))).alias("avg_stars_before"))
    a = after.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("total_after"),
        F.avg(nan_to_null(F.col("stars").cast("double"))).alias("avg_stars_after"),
        F.avg(F.length("text").cast("double")).alias("avg_text_length"))
    if scope:
        j = join_on(b, a, scope, "full_outer")
    else:  # global: two one-row aggregates
        from .profile import attach_one_row
        j = attach_one_row(b, a)
    return j.select(
        *scope,
        F.coalesce("total_before", F.lit(0)).alias("total_before"),
        F.coalesce("total_after", F.lit(0)).alias("total_after"),
        (F.coalesce("total_before", F.lit(0)) - F.coalesce("total_after", F.lit(0))).alias("removed"),
        F.when(F.coalesce("total_before", F.lit(0)) > 0,
               F.coalesce("total_after", F.lit(0)) * 100.0 / F.col("total_before")).otherwise(F.lit(0.0))
        .alias("kept_ratio"),
        "avg_stars_before", "avg_stars_after",
        F.coalesce("avg_text_length", F.lit(0.0)).alias("avg_text_length"))


def present_validation_stats(stats: DataFrame) -> DataFrame:
    """Reference rounding: kept % to 1 dp, star means to 2 dp, text length to 1 dp."""
    return (stats.withColumn("kept_ratio", F.bround("kept_ratio", 1))
            .withColumn("avg_stars_before", F.bround("avg_stars_before", 2))
            .withColumn("avg_stars_after", F.bround("avg_stars_after", 2))
            .withColumn("avg_text_length", F.bround("avg_text_length", 1)))


def reject_counts(df: DataFrame, scope: Sequence[str] = ("business_id",), order: str = "seq") -> DataFrame:
    """C16 (+C5 measured before truncation): rows removed per step and scope, long form.

    Row-local reasons come from the tag column, duplicates from the keep-first group sizes
    (``copies - 1``), spam from the kept rows.  Output ``(scope..., step, removed)``; steps
    with no removal are left out.
    """
    scope = _cols(scope)
    tagged = tag_row_rejects(ensure_columns(df, order))
    local = (tagged.filter(F.col("reject_reason").isNotNull())
             .groupBy(*scope, F.col("reject_reason").alias("step")).agg(F.count(F.lit(1)).alias("removed")))
    truncated = (tagged.filter((F.col("reject_reason").isNull() | (F.col("reject_reason") != "text"))
                                & (F.col("text_len_raw") > MAX_TEXT_LENGTH))
                 .groupBy(*scope).agg(F.count(F.lit(1)).alias("removed"))
                 .withColumn("step", F.lit("truncated")))
    kept = _dedup_and_spam(tagged, scope, order)
    later = kept.groupBy(*scope).agg(
        F.sum(F.col("_copies") - 1).alias("duplicate"),
        F.count_if(F.col("_spam")).alias("spam"))
    later_long = later.select(*scope, F.expr("stack(2, 'duplicate', duplicate, 'spam', spam) AS (step, removed)"))
    out = local.unionByName(truncated).unionByName(later_long)
    return out.filter(F.col("removed") > 0).select(*scope, "step", F.col("removed").cast("long"))


def _shingle_set(text, shingle: int):
    """Distinct overlapping ``shingle``-character substrings (the whole text when shorter):
    a zero-width lookahead lets the regex report every window, no per-position lambda."""
    t = F.col(text) if isinstance(text, str) else text
    windows = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{shingle}}}))"), 1)
    return F.when(F.length(t) < shingle, F.array(t)).otherwise(F.array_distinct(windows))


def _min_hashes(keep: Sequence[str], n: int):
    """For ``mapInArrow``: the least ``xxhash64(h, k)`` over the long hashes ``h`` in ``_hs``, for each ``k`` below ``n``, bit for bit as Spark has it."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

        def turned(x, by):
            return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

        def mixed(x):
            x ^= x >> np.uint64(33)
            x *= p2
            x ^= x >> np.uint64(29)
            x *= p3
            x ^= x >> np.uint64(32)
            return x

        old = np.seterr(over="ignore")
        ks = [np.uint64(k) * p1 for k in range(n)]
        try:
            for batch in batches:
                hs = batch.column("_hs")
                ends = hs.offsets.to_numpy()
                flat, ends, got, at = hs.flatten().to_numpy().view(np.uint64), ends - ends[0], [], 0
                while at < len(hs):  # whole texts, a bounded number of hashes at once
                    upto = max(at + 1, int(np.searchsorted(ends, ends[at] + 65536, side="right")) - 1)
                    h = turned(flat[ends[at]:ends[upto]] * p2, 31) * p1
                    h ^= np.uint64(42 + 8) + p5
                    seed = mixed(turned(h, 27) * p1 + p4) + (p5 + np.uint64(4))
                    first = ends[at:upto] - ends[at]
                    got.append(np.stack([np.minimum.reduceat(mixed(turned(seed ^ k, 23) * p2 + p3).view(np.int64), first) for k in ks], axis=1))
                    at = upto
                if got:
                    mins = np.concatenate(got)
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(np.ascontiguousarray(mins[:, k])) for k in range(n)]],
                                                     names=[*keep, *[f"h{k}" for k in range(n)]])
        finally:
            np.seterr(**old)
    return run


def _agreeing(n: int, threshold: float) -> int:
    """Of ``n`` hashes cut to 4 bits, how many agree at least for sets of that similarity, but for a chance of ``LOST``."""
    p = threshold + (1 - threshold) / 16
    below = 0.0
    for m in range(n + 1):
        below += comb(n, m) * p ** m * (1 - p) ** (n - m)
        if below > LOST:
            return m
    return n


def _similarities(keep: Sequence[str], shingle: int):
    """For ``mapInArrow``: the exact Jaccard of the shingle sets of ``text`` and ``rep_text``."""
    def shingles(t: str) -> set:
        return {t[i:i + shingle] for i in range(len(t) - shingle + 1)} if len(t) >= shingle else {t}

    def run(batches):
        import pyarrow as pa
        rep, b = None, set()
        for batch in batches:
            got = []
            for text, other in zip(batch.column("text"), batch.column("rep_text")):
                other = other.as_py()
                if other != rep:
                    rep, b = other, shingles(other)
                a = shingles(text.as_py())
                common = len(a & b)
                got.append(common / (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(got, pa.float64())], names=[*keep, "jaccard"])
    return run


def near_duplicates(df: DataFrame, scope: Sequence[str] = ("business_id",), order: str = "seq",
                    threshold: float = NEAR_DUPLICATE_SIMILARITY, shingle: int = 5,
                    bands: int = 24, rows_per_band: int = 4) -> DataFrame:
    """C17 (optional; the reference declares the 0.8 threshold but never applies it).

    Returns ``(scope..., order, earlier_<order>, jaccard)`` for rows whose character-shingle
    set has Jaccard similarity >= threshold with an earlier row of the same scope; the
    earliest of the rows it was compared with and found similar to is named.

    Equal texts are one text (its earliest row; later copies name it with similarity 1).
    Different texts meet in MinHash band buckets: at similarity 0.8 two texts share one of
    the 24 bands of 4 with probability 1 - (1 - 0.8**4)**24 > 0.99999.  In a bucket each
    text is compared with the bucket's earliest and with the text before it, which finds most
    copies and chains of them.  A text that this leaves without a partner is compared with all
    earlier texts of its buckets; a bucket of more than ``BUCKET_MEMBERS`` is split first, without
    losing a pair, by the shingles that are rarest in it: two sets of that similarity share one among
    the first ``size - ceil(threshold * size) + 1`` of each.  The exact Jaccard of the two
    shingle sets, rebuilt from the two texts, confirms.

    Of each MinHash 4 bits go along with a pair, and a pair is compared if enough of them agree: one of
    that similarity has fewer with a chance below ``LOST``, most others do.

    The texts are written once, named by their SHA-256.  Signatures, buckets and pairs hold names and numbers only;
    only the texts of pairs whose set sizes allow the similarity are fetched, and become shingle sets in the task that compares them.
    """
    scope = _cols(scope)
    nh = bands * rows_per_band
    base = write_table(df.select(*scope, order, "text").filter(F.col("text").isNotNull())
                       .withColumn("_th", F.unhex(F.sha2(F.col("text"), 256)))
                       .withColumn("_plain", ~F.col("text").rlike("[\\x{10000}-\\x{10FFFF}]")), "near-texts")
    # the size of a set bounds its similarity; texts beyond the basic plane have no size and are left to the comparison
    hashed = base.select(*scope, order, "_th", "_plain", F.transform(_shingle_set("text", shingle), lambda x: F.xxhash64(x)).alias("_hs")) \
        .select(*scope, order, "_th", F.when(F.col("_plain"), F.size("_hs")).alias("_size"), "_hs")
    keep, types = hashed.columns[:-1], dict(hashed.dtypes)
    of_text = (hashed.mapInArrow(_min_hashes(keep, nh), ", ".join([*[f"`{c}` {types[c]}" for c in keep], *[f"h{k} bigint" for k in range(nh)]]))
               .groupBy(*scope, "_th").agg(F.min(order).alias("_first"), F.max("_size").alias("_size"), *[F.min(f"h{k}").alias(f"h{k}") for k in range(nh)]))
    nibble = lambda k: F.shiftleft(F.col(f"h{k}").bitwiseAND(15), 4 * (k % 16))
    sketches = [reduce(Column.bitwiseOR, [nibble(k) for k in range(i, min(i + 16, nh))]).alias(f"_k{i // 16}") for i in range(0, nh, 16)]
    signed = write_table(of_text.select("*", *sketches), "near-signatures")
    sketch = [f"_k{i}" for i in range(len(sketches))]
    texts = signed.select(*scope, "_th", "_first", "_size", *sketch)
    band_keys = F.array(*[
        F.struct(F.lit(b).alias("band"),
                 F.xxhash64(*[F.col(f"h{b * rows_per_band + r}") for r in range(rows_per_band)]).alias("bucket"))
        for b in range(bands)])
    member = write_table(
        signed.groupBy(*scope, "_first").agg(*[F.min(f"h{k}").alias(f"h{k}") for k in range(nh)])
        .select(*scope, "_first", F.explode(band_keys).alias("bk")).select(*scope, "_first", "bk.band", "bk.bucket"), "near-buckets")

    def texts_of(names: DataFrame) -> DataFrame:
        """``(scope..., _th, text)`` of the texts with those names, a few bytes each: no other text is shuffled to find them."""
        named = write_table(names.select(*scope, "_th").distinct(), "near-names")
        return join_on(base, named, [*scope, "_th"], "left_semi").select(*scope, "_th", "text")

    def verified(pairs: DataFrame) -> DataFrame:
        reps = texts.select(*scope, F.col("_th").alias("rep_th"), F.col("_first").alias("rep"), F.col("_size").alias("rep_size"), *[F.col(c).alias(f"rep{c}") for c in sketch])
        named = join_on(join_on(pairs, texts, [*scope, "_first"]), reps, [*scope, "rep"])
        may = F.least("_size", "rep_size") >= threshold * F.greatest("_size", "rep_size") - 1e-9
        known = F.col("_size").isNotNull() & F.col("rep_size").isNotNull()
        other = [F.col(c).bitwiseXOR(F.col(f"rep{c}")) for c in sketch]
        other = [x.bitwiseOR(F.shiftrightunsigned(x, 1)) for x in other]
        other = [F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(0x1111111111111111)) for x in other]
        near = sum(other[1:], other[0]) <= nh - _agreeing(nh, threshold)
        named = write_table(named.filter((may | ~known) & near).select(*scope, "_first", "rep", "_th", "rep_th"), "near-pairs")
        held = texts_of(named.select(*scope, "_th").unionByName(named.select(*scope, F.col("rep_th").alias("_th"))))
        both = join_on(join_on(named, held, [*scope, "_th"]),
                       held.select(*scope, F.col("_th").alias("rep_th"), F.col("text").alias("rep_text")), [*scope, "rep_th"])
        types = ", ".join(f"`{c}` {dict(named.dtypes)[c]}" for c in [*scope, "_first", "rep"])
        return both.select(*scope, "_first", "rep", "text", "rep_text") \
            .mapInArrow(_similarities([*scope, "_first", "rep"], shingle), f"{types}, jaccard double").filter(F.col("jaccard") >= threshold)

    w = Window.partitionBy(*scope, "band", "bucket").orderBy("_first")
    other = F.array(F.first("_first").over(w), F.lag("_first").over(w))
    cand = (member.withColumn("_others", F.array_distinct(other)).withColumn("rep", F.explode("_others"))
            .filter(F.col("rep") < F.col("_first")).select(*scope, "_first", "rep").distinct())
    quick = write_table(verified(cand), "near-quick")
    # what found no partner meets all earlier members of its buckets, large ones split by their rarest shingles;
    # a bucket whose members but the earliest all have partners has nothing to find
    found = quick.select(*scope, "_first").distinct().withColumn("_found", F.lit(True))
    at = join_on(member, found, [*scope, "_first"], "left").select(*scope, "_first", "_found", F.xxhash64(*scope, "band", "bucket").alias("_k"))
    crowd = at.groupBy("_k").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_first").alias("_lo"),
        F.max(F.when(F.col("_found").isNull(), F.col("_first"))).alias("_open"))
    crowd = crowd.filter((F.col("_n") > 2) & (F.col("_open") > F.col("_lo"))).select("_k", "_n")
    at = write_table(at.join(crowd, "_k").select(*scope, "_first", "_found", "_k", "_n"), "near-crowded")
    large = at.filter(F.col("_n") > BUCKET_MEMBERS).select(*scope, "_first", "_k")
    large_texts = write_table(join_on(texts, large.select(*scope, "_first").distinct(), [*scope, "_first"], "left_semi"), "near-large")
    hashed = join_on(large_texts, texts_of(large_texts), [*scope, "_th"]) \
        .select(*scope, "_first", F.explode(_shingle_set("text", shingle)).alias("_s")).select(*scope, "_first", F.xxhash64("_s").alias("_h"))
    shared = join_on(large, hashed, [*scope, "_first"])
    rarity = shared.groupBy("_k", "_h").agg(F.count(F.lit(1)).alias("_df"))
    own = Window.partitionBy(*scope, "_first", "_k")
    prefix = (shared.join(rarity, ["_k", "_h"]).withColumn("_size", F.count(F.lit(1)).over(own))
              .withColumn("_rn", F.row_number().over(own.orderBy("_df", "_h")))
              .filter((F.col("_df") > 1) & (F.col("_rn") <= F.col("_size") - F.ceil(F.col("_size") * threshold - 1e-9) + 1)))
    place = write_table(at.filter(F.col("_n") <= BUCKET_MEMBERS).select(*scope, "_first", F.col("_k").alias("_key"))
                        .unionByName(prefix.select(*scope, "_first", F.xxhash64("_k", "_h").alias("_key"))), "near-places")
    left = join_on(place, found, [*scope, "_first"], "left_anti")
    rest = (join_on(left, place.withColumnRenamed("_first", "rep"), [*scope, "_key"])
            .filter(F.col("rep") < F.col("_first")).select(*scope, "_first", "rep").distinct())
    scored = quick.unionByName(verified(rest))
    best = scored.groupBy(*scope, "_first").agg(F.min_by(F.struct("rep", "jaccard"), F.col("rep")).alias("m"))
    near = best.select(*scope, F.col("_first").alias(order), F.col("m.rep").alias("earlier_" + order),
                       F.col("m.jaccard").alias("jaccard"))
    copies = join_on(base.select(*scope, order, "_th"), texts, [*scope, "_th"]).filter(F.col(order) > F.col("_first")).select(
        *scope, order, F.col("_first").alias("earlier_" + order), F.lit(1.0).alias("jaccard"))
    return near.unionByName(copies)
