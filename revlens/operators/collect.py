"""Business search, selection and review collection (inventory B1-B11).

The reference answers one business name per request and rescans the review file each
time.  Here the same rules run for many requests at once: a request list is a bounded,
user-supplied parameter carried as a literal array in one scan of the business table
(no join of requests x businesses), and reviews are attached to the selected businesses
with an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from .joins import join_on
from .ordering import first_n, keep_first

# --- fixed values -------------------------------------------------------------------
# review-count tiers: >= 100 High, >= 50 Medium, >= 10 Low, otherwise Very low
TIER_BOUNDS = [(100, "High"), (50, "Medium"), (10, "Low")]
TIER_LOWEST = "Very low"
TIER_NOTES = {
    "High": "{n} reviews - enough for an accurate analysis",
    "Medium": "{n} reviews - fairly reliable result",
    "Low": "only {n} reviews - the result may not be representative",
    "Very low": "only {n} reviews - not enough for a reliable analysis",
}
SOURCE_RANK = {"csv": 1, "yelp": 2, "google": 3}
# ------------------------------------------------------------------------------------


def reliability_tier(n) -> Column:
    """B2: tier label from a review count."""
    n = F.col(n) if isinstance(n, str) else n
    expr = None
    for bound, label in TIER_BOUNDS:
        expr = F.when(n >= bound, label) if expr is None else expr.when(n >= bound, label)
    return expr.otherwise(TIER_LOWEST)


def reliability_note(n) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    tier = reliability_tier(n)
    expr = None
    for label, fmt in TIER_NOTES.items():
        txt = F.format_string(fmt.replace("{n}", "%d"), n.cast("long"))
        expr = F.when(tier == label, txt) if expr is None else expr.when(tier == label, txt)
    return expr


def search_businesses(biz: DataFrame, requests: Sequence[str] | str, city: str | None = None) -> DataFrame:
    """B1 (+B2, B4): businesses whose name contains the request as a case-insensitive
    literal substring (``%``/``_`` are literal).  Output one row per (request, business)
    with the 8 business fields (missing -> ``""``/0) and the tier from the stored
    ``review_count``.

    Requests are a bounded parameter list: one scan evaluates all of them per row
    (``filter`` over a literal array), no join of requests x businesses.  Blank requests
    never match (B9 reports them).
    """
    reqs = [requests] if isinstance(requests, str) else list(requests)
    reqs = [r for r in reqs if r is not None and r.strip() != ""]
    arr = F.array(*[F.lit(r) for r in reqs]) if reqs else F.array().cast("array<string>")
    name_lc = F.lower(F.coalesce(F.col("name"), F.lit("")))
    hits = F.filter(arr, lambda q: name_lc.contains(F.lower(q)))
    out = biz.withColumn("request", F.explode(hits))
    if city is not None:
        out = out.filter(F.lower(F.coalesce(F.col("city"), F.lit(""))).contains(city.lower()))
    return _match_rows(out, biz.columns)


def _match_rows(out: DataFrame, have: Sequence[str]) -> DataFrame:
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ["name", "city", "state"]]
    if "address" in have:
        cols.append(F.coalesce(F.col("address"), F.lit("")).alias("address"))
    rc = F.coalesce(F.col("review_count"), F.lit(0))
    return out.select("request", "business_id", *cols,
                      F.coalesce(F.col("stars"), F.lit(0.0)).alias("stars"), rc.alias("review_count"),
                      F.coalesce(F.col("categories"), F.lit("")).alias("categories"),
                      reliability_tier(rc).alias("reliability"), "seq")


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of ``n`` characters."""
    last = F.length(text) - n + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))))


def gram_postings(biz: DataFrame) -> DataFrame:
    """Posting table of the distinct lower-cased names: (gram, name_lc) for grams of one, two and three characters.

    Names that many businesses share are one entry.  Write it once where many request tables meet it.
    """
    names = biz.select(F.lower(F.coalesce(F.col("name"), F.lit(""))).alias("name_lc")).distinct()
    grams = F.concat(*[F.coalesce(_grams(F.col("name_lc"), n), F.array().cast("array<string>")) for n in (1, 2, 3)])
    return names.select(F.explode(grams).alias("gram"), "name_lc")


def search_request_table(biz: DataFrame, requests: DataFrame, request: str = "request", postings: DataFrame | None = None) -> DataFrame:
    """B1 for a table of requests: the rows of :func:`search_businesses`, any number of requests.

    A request is looked up by one gram, the rarest of its three-character pieces (one or two characters: the request
    itself), in the posting table by an equi-join, and then verified literally; every name that holds the request holds
    that gram, so none is lost.  Blank and null requests never match; equal requests are looked up once.
    """
    postings = gram_postings(biz) if postings is None else postings
    asked = requests.select(F.col(request).alias("request")).where(F.col("request").isNotNull() & (py_strip("request") != "")) \
        .distinct().withColumn("_lc", F.lower("request"))
    pieces = asked.select("request", "_lc", F.explode(F.when(F.length("_lc") < 3, F.array("_lc")).otherwise(_grams(F.col("_lc"), 3))).alias("gram"))
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    # a piece that no name holds has no count: the inner join drops it, and its request cannot match
    held = pieces.join(counts, "gram").groupBy("request", "_lc").agg(
        F.min(F.struct("_n", "gram")).alias("_best"), F.count(F.lit(1)).alias("_held"))
    held = held.where(F.col("_held") == F.when(F.length("_lc") < 3, 1).otherwise(F.size(_grams(F.col("_lc"), 3))))
    found = held.select("request", "_lc", F.col("_best.gram").alias("gram")).join(postings, "gram") \
        .where(F.contains("name_lc", "_lc")).select("request", "name_lc")
    out = biz.withColumn("name_lc", F.lower(F.coalesce(F.col("name"), F.lit("")))).join(found, "name_lc")
    return _match_rows(out, biz.columns)


def rank_matches(matches: DataFrame) -> DataFrame:
    """Per request, order by review_count descending, ties in file order; adds the
    1-based ``match_rank``.

    A short search string can match a large share of all businesses, so the rank is a
    skew-free dense position (``ordering.dense_index``: range-partitioned slices plus
    running offsets), not a window that would hold a whole request in one task.  For the
    best match only, use ``best_matches`` (a partial top-1)."""
    from .ordering import dense_index
    keyed = matches.withColumn("_ord", F.struct((-F.col("review_count")).alias("neg_count"), F.col("seq").alias("seq")))
    ranked = dense_index(keyed, ["request"], "_ord", name="match_rank")
    return ranked.select(*matches.columns, (F.col("match_rank") + 1).alias("match_rank"))


def best_matches(matches: DataFrame, n: int = 1) -> DataFrame:
    """The first ``n`` matches of each request in B3 order (WindowGroupLimit: each input
    partition forwards at most ``n`` rows per request)."""
    from .ordering import first_n
    return first_n(matches, ["request"], [F.desc("review_count"), F.asc("seq")], n, rank_col="match_rank")


def resolve(matches: DataFrame) -> DataFrame:
    """A request resolves to a business only when exactly one business matches;
    0 or >= 2 matches resolve to nothing (the caller must choose)."""
    n = matches.groupBy("request").agg(F.count(F.lit(1)).alias("n_matches"))
    return matches.join(n.filter("n_matches = 1"), "request", "left_semi")


def blank_request_errors(requests: Sequence[str]) -> list[str]:
    """Blank request names are errors (the API answers 400)."""
    return [r for r in requests if r is None or r.strip() == ""]


def blank_request_rows(requests: DataFrame, name: str = "request") -> DataFrame:
    """B9 for a table of requests: the rows whose name is missing or blank."""
    return requests.filter(F.col(name).isNull() | (py_strip(name) == ""))


def reviews_of(reviews: DataFrame, selected: DataFrame, limit: int | None = None,
               order: str = "seq") -> DataFrame:
    """B6 + B7: reviews of the selected businesses, ``business_name`` attached from the
    selection; ``limit`` keeps the first N per business in file order (``limit`` 0 or
    None = all, as the reference's truthiness test).

    A plain equi-join: Spark broadcasts the selection when its size allows, AQE splits a hot business.
    """
    sel = selected.select("business_id", F.col("name").alias("business_name")).dropDuplicates(["business_id"])
    base = reviews.drop("business_name") if "business_name" in reviews.columns else reviews
    out = base.join(sel, "business_id")
    if limit:
        out = first_n(out, ["business_id"], F.col(order), limit)
    return out


def load_metadata(reviews: DataFrame) -> DataFrame:
    """Per loaded business: review count, tier and note from the loaded rows."""
    return (reviews.groupBy("business_id").agg(F.count(F.lit(1)).alias("review_count"))
            .withColumn("reliability", reliability_tier("review_count"))
            .withColumn("reliability_note", reliability_note("review_count")))


def source_fallback(sources: dict[str, DataFrame], scope: str = "business_id") -> DataFrame:
    """Per business use only the highest-priority source that has rows for it
    (csv, then yelp, then google); adds ``source``.  Sources absent for a business fall
    through to the next.  One union, one aggregate of (business -> best rank), one join
    on (business, rank); a hot business is split by AQE's skew-join handling."""
    tagged = None
    for name, df in sources.items():
        t = df.withColumn("source", F.lit(name)).withColumn("source_rank", F.lit(SOURCE_RANK.get(name, 99)))
        tagged = t if tagged is None else tagged.unionByName(t, allowMissingColumns=True)
    best = tagged.groupBy(scope).agg(F.min("source_rank").alias("source_rank"))
    return join_on(tagged, best, [scope, "source_rank"], "left_semi")


def combine_sources(sources: dict[str, DataFrame], scope: Sequence[str] = ("business_id",),
                    order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Union of all sources (schema union, missing -> NULL), exact-text keep-first
    with sources in priority order, plus the list of sources that contributed rows
    (computed before the dedup).  Returns ``(reviews, sources_used)``."""
    scope = list(scope)
    tagged = None
    for name, df in sources.items():
        t = (df.withColumn("source", F.lit(name))
             .withColumn("_ord", F.struct(F.lit(SOURCE_RANK.get(name, 99)).alias("r"), F.col(order).alias("s"))))
        tagged = t if tagged is None else tagged.unionByName(t, allowMissingColumns=True)
    used = tagged.groupBy(*scope).agg(F.array_sort(F.collect_set("source")).alias("sources_used"))
    kept = keep_first(tagged, [*scope, "text"], "_ord").drop("_ord")
    return kept, used
