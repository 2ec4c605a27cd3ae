"""Result checker and auto-fix for model answers (inventory F0-F16).

Input: one row per model answer with the parsed ``VARIANT`` (``modelio.extract_json``)
and the batch corpus (``modelio.review_block``).  Every rule is a column expression over
that row, so checking is a single projection: no shuffle, no Python.

Outputs a fixed, typed result plus ``errors`` / ``warnings`` arrays in the reference's
rule order, and ``ok``: false where the reference's own code would raise and the whole
answer counts as failed (non-numeric percentage, JSON-null summary, non-string highlight,
topic that is not an object or lacks ``score``/``mentions`` ...).  Messages are English.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip, py_words
from .joins import join_on
from .lineage import materialize
from .modelio import (SENTIMENT_KEYS, SENTIMENTS, TOPICS, v_is_int, v_is_list, v_is_number, v_is_object,
                      v_is_string, v_list, v_num, v_str, vget, vtype)
from .ordering import dense_index

# --- fixed values -------------------------------------------------------------------
DEFAULT_SENTIMENT_SUMMARY = "No summary"
DEFAULT_TOPIC_SUMMARY_MISSING = "No data"
DEFAULT_TOPIC_SUMMARY_BLANK = "No description"
DEFAULT_TOPIC_SCORE = 3.0
MIN_WORD_LEN = 3          # highlight words / keywords must be longer than this
SCORE_RANGE = (1.0, 5.0)
POSITIVE_MIN_SCORE = 3.0  # positive topic with a lower score is inconsistent
NEGATIVE_MAX_SCORE = 3.5  # negative topic with a higher score is inconsistent
# ------------------------------------------------------------------------------------


def _nonnull(*xs: Column) -> Column:
    return F.filter(F.array(*xs), lambda x: x.isNotNull())


def _num_txt(x: Column) -> Column:
    """Python-like rendering of a number: integral values without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def _finder(df: DataFrame, corpus: str, supported: str | None):
    """Whether a lower-cased phrase occurs in the reviews: in the corpus string, or in the array of phrases found there."""
    if supported is not None:
        return lambda w: F.coalesce(F.array_contains(F.col(supported), w), F.lit(False))
    text = F.coalesce(F.col(corpus), F.lit(""))
    return lambda w: text.contains(w)


def _unsupported_highlights(hl: Column, has) -> Column:
    """highlights none of whose words longer than 3 characters occurs in the corpus
    (highlights without such words never warn)."""
    def bad(h):
        words = F.filter(py_words(F.lower(h)), lambda w: F.length(w) > MIN_WORD_LEN)
        return (F.size(words) > 0) & ~F.exists(words, has)
    return F.filter(hl, bad)


def _highlights_fail(x: Column) -> Column:
    """Iterating the value raises in the reference: JSON null, number, boolean, or a list
    with a non-string element."""
    t = vtype(x)
    scalar_bad = t.isin("VOID", "BIGINT", "DOUBLE", "BOOLEAN", "FLOAT") | t.startswith("DECIMAL")
    list_bad = v_is_list(x) & F.exists(v_list(x), lambda e: vtype(e) != "STRING")
    return x.isNotNull() & (scalar_bad | list_bad)


def check_sentiment(df: DataFrame, v: str = "v", corpus: str = "corpus", supported: str | None = None) -> DataFrame:
    """F0-F7 for sentiment answers; adds ``ok, positive, negative, neutral, summary,
    positive_highlights, negative_highlights, errors, warnings`` (result columns NULL when
    ``ok`` is false).  ``supported`` names a column of :func:`supported_phrases` to test against
    instead of a corpus string."""
    V = F.col(v)
    has = _finder(df, corpus, supported)
    # extract each field once into a column; the rules below only reference them
    df = df.select("*", *[vget(V, f"$.{k}").alias(f"_g_{k}") for k in SENTIMENT_KEYS])
    g = {k: F.col(f"_g_{k}") for k in SENTIMENT_KEYS}
    pres = {k: g[k].isNotNull() for k in SENTIMENT_KEYS}
    pct = ["positive", "negative", "neutral"]
    val = {k: F.when(pres[k], v_num(g[k])).otherwise(F.lit(0.0)) for k in pct}

    fail = (V.isNull() | ~v_is_object(V) | (vtype(V) == "OBJECT<>")
            | F.exists(F.array(*[pres[k] & ~v_is_number(g[k]) for k in pct]), lambda x: x)
            | (pres["summary"] & ~v_is_string(g["summary"]))
            | _highlights_fail(g["positive_highlights"]) | _highlights_fail(g["negative_highlights"]))

    total = val["positive"] + val["negative"] + val["neutral"]
    ne100 = total != 100
    p2 = F.when(ne100 & (total > 0), F.rint(val["positive"] / total * 100)).when(ne100, F.lit(34.0)) \
        .otherwise(val["positive"])
    n2 = F.when(ne100 & (total > 0), F.rint(val["negative"] / total * 100)).when(ne100, F.lit(33.0)) \
        .otherwise(val["negative"])
    u2 = F.when(ne100 & (total > 0), 100 - p2 - n2).when(ne100, F.lit(33.0)).otherwise(val["neutral"])
    fixed = {}
    for k, x in zip(pct, [p2, n2, u2]):
        fixed[k] = F.when(val[k] < 0, F.lit(0.0)).when(val[k] > 100, F.lit(100.0)).otherwise(x)

    summ = v_str(g["summary"])
    summ_blank = ~pres["summary"] | (py_strip(summ) == "")
    hl = {k: F.when(v_is_list(g[k]), F.try_variant_get(g[k], "$", "array<string>"))
          .otherwise(F.array().cast("array<string>")) for k in ["positive_highlights", "negative_highlights"]}

    errors = F.concat(
        _nonnull(*[F.when(~pres[k], F.lit(f"missing key '{k}'")) for k in SENTIMENT_KEYS]),
        _nonnull(*[e for k in pct for e in (
            F.when(val[k] < 0, F.format_string(f"'{k}' = %s < 0 -> set to 0", _num_txt(val[k]))),
            F.when(val[k] > 100, F.format_string(f"'{k}' = %s > 100 -> set to 100", _num_txt(val[k]))))]),
        _nonnull(*[F.when(~v_is_list(g[k]), F.lit(f"'{k}' is not a list -> set to []"))
                   for k in ["positive_highlights", "negative_highlights"]]))
    warnings = F.concat(
        _nonnull(F.when(ne100, F.format_string("percentages sum to %s (must be 100) -> normalised", _num_txt(total))),
                 F.when(summ_blank, F.lit("summary is blank -> default used"))),
        *[F.transform(_unsupported_highlights(hl[k], has),
                      lambda h: F.format_string("highlight '%s' not found in the reviews", h))
          for k in ["positive_highlights", "negative_highlights"]])

    ok = ~fail
    res = {
        "positive": fixed["positive"], "negative": fixed["negative"], "neutral": fixed["neutral"],
        "summary": F.when(summ_blank, F.lit(DEFAULT_SENTIMENT_SUMMARY)).otherwise(summ),
        "positive_highlights": hl["positive_highlights"], "negative_highlights": hl["negative_highlights"],
        "errors": errors, "warnings": warnings,
    }
    out = df.withColumn("ok", F.coalesce(ok, F.lit(False)))
    helper = [f"_g_{k}" for k in SENTIMENT_KEYS]
    keep = [c for c in df.columns if c not in helper and c not in res]
    return out.select(*keep, "ok", *[F.when(F.col("ok"), e).alias(k) for k, e in res.items()])


_TOPIC_FIELDS = ["score", "sentiment", "mentions", "keywords", "summary"]


def _topic_facts(t: str) -> list[dict[str, Column]]:
    """What several rules of a topic ask, as columns ``_t_<topic>_<fact>``, in two steps: each is computed once a row,
    and no rule repeats another's expression (nested they grow into a plan that takes longer to make than to run)."""
    present = F.col(f"_t_{t}").isNotNull()
    score_v, sent_v, ment_v, kw_v, summ_v = (F.col(f"_t_{t}_{f}") for f in _TOPIC_FIELDS)
    sent = F.when(v_is_string(sent_v), v_str(sent_v))
    first = {"is_num": v_is_number(score_v), "num": v_num(score_v), "sent": sent, "is_list": v_is_list(kw_v), "elems": v_list(kw_v),
             "ment_ok": v_is_int(ment_v) & (v_num(ment_v) >= 0), "ment": v_num(ment_v).cast("long"),
             "text": v_str(summ_v)}
    is_num, score, sent, is_list, elems, text = (F.col(f"_t_{t}_{f}") for f in ("is_num", "num", "sent", "is_list", "elems", "text"))
    lo, hi = SCORE_RANGE
    out = is_num & ((score < lo) | (score > hi))
    sent_ok = F.coalesce(sent.isin(*SENTIMENTS), F.lit(False))
    second = {
        "out": out, "sent_ok": sent_ok, "blank": summ_v.isNull() | (py_strip(text) == ""),
        "fixed": (F.when(~present, F.lit(DEFAULT_TOPIC_SCORE)).when(~is_num, F.lit(DEFAULT_TOPIC_SCORE))
                  .when(out, F.bround(F.greatest(F.lit(lo), F.least(F.lit(hi), score)), 1)).otherwise(score)),
        "fixed_sent": F.when(present & sent_ok, sent).otherwise(F.lit("neutral")),
        "kws": F.when(present & is_list, F.filter(F.transform(elems, lambda e: F.when(vtype(e) == "STRING", v_str(e))),
                                                  lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))}
    return [{f"_t_{t}_{k}": c for k, c in step.items()} for step in (first, second)]


def _topic_struct(has, t: str):
    tv = F.col(f"_t_{t}")
    present = tv.isNotNull()
    score_v, ment_v, summ_v = (F.col(f"_t_{t}_{f}") for f in ("score", "mentions", "summary"))
    score_num, score, sent, is_list, kw_elems, ment_ok, summ = (
        F.col(f"_t_{t}_{f}") for f in ("is_num", "num", "sent", "is_list", "elems", "ment_ok", "text"))
    out_of_range, sent_ok, summ_blank, fixed_score, fixed_sent, kws = (
        F.col(f"_t_{t}_{f}") for f in ("out", "sent_ok", "blank", "fixed", "fixed_sent", "kws"))

    kw_bad = F.exists(kw_elems, lambda e: (vtype(e) != "STRING") & ~(
        v_is_list(e) & (F.size(F.try_variant_get(e, "$", "array<variant>")) <= MIN_WORD_LEN)))
    fail = present & (~v_is_object(tv) | score_v.isNull() | ment_v.isNull()
                      | (summ_v.isNotNull() & ~v_is_string(summ_v))
                      | (is_list & F.coalesce(kw_bad, F.lit(False))))

    fixed_ment = F.when(present & ment_ok, F.col(f"_t_{t}_ment")).otherwise(F.lit(0).cast("long"))
    fixed_summ = (F.when(~present, F.lit(DEFAULT_TOPIC_SUMMARY_MISSING))
                  .when(summ_blank, F.lit(DEFAULT_TOPIC_SUMMARY_BLANK)).otherwise(summ))

    errs = _nonnull(
        F.when(present & ~score_num, F.lit(f"'{t}' score is not a number -> 3.0")),
        F.when(present & ~sent_ok, F.format_string(f"'{t}' sentiment='%s' is invalid -> neutral",
                                                   F.coalesce(sent, F.lit("")))),
        F.when(present & ~is_list, F.lit(f"'{t}' keywords is not a list -> []")))
    bad_kws = F.filter(kws, lambda k: (F.length(k) > MIN_WORD_LEN) & ~has(F.lower(k)))
    warns = F.concat(
        _nonnull(F.when(present & out_of_range, F.format_string(f"'{t}' score=%s outside 1-5 -> clamped", _num_txt(score))),
                 F.when(present & ~ment_ok, F.lit(f"'{t}' mentions is invalid -> 0"))),
        F.transform(bad_kws, lambda k: F.format_string(f"'{t}' keyword '%s' not in the reviews", k)),
        _nonnull(F.when(present & summ_blank, F.lit(f"'{t}' summary is blank -> default used")),
                 F.when((fixed_sent == "positive") & (fixed_score < POSITIVE_MIN_SCORE),
                        F.format_string(f"'{t}' sentiment=positive but score=%s < 3.0 -> inconsistent",
                                        _num_txt(fixed_score))),
                 F.when((fixed_sent == "negative") & (fixed_score > NEGATIVE_MAX_SCORE),
                        F.format_string(f"'{t}' sentiment=negative but score=%s > 3.5 -> inconsistent",
                                        _num_txt(fixed_score)))))
    st = F.struct(present.alias("present"), fixed_sent.alias("sentiment"), fixed_score.alias("score"),
                  fixed_ment.alias("mentions"), kws.alias("keywords"), fixed_summ.alias("summary"))
    return st, fail, errs, warns, present


def check_topics(df: DataFrame, v: str = "v", corpus: str = "corpus", supported: str | None = None) -> DataFrame:
    """F8-F15 for topic answers; adds ``ok``, one struct column per topic
    (present, sentiment, score, mentions, keywords, summary), ``errors`` and ``warnings``.
    ``supported`` as in :func:`check_sentiment`."""
    V = F.col(v)
    has = _finder(df, corpus, supported)
    # extract each topic object, then each of its fields, once into columns
    df = df.select("*", *[vget(V, f"$.{t}").alias(f"_t_{t}") for t in TOPICS])
    df = df.select("*", *[vget(F.col(f"_t_{t}"), f"$.{f}").alias(f"_t_{t}_{f}") for t in TOPICS for f in _TOPIC_FIELDS])
    helper_cols = [f"_t_{t}" for t in TOPICS] + [f"_t_{t}_{f}" for t in TOPICS for f in _TOPIC_FIELDS]
    facts = [_topic_facts(t) for t in TOPICS]
    for step in range(2):
        named = {k: c for f in facts for k, c in f[step].items()}
        helper_cols += named
        df = df.withColumns(named)
    parts = {t: _topic_struct(has, t) for t in TOPICS}
    fail = V.isNull() | ~v_is_object(V) | (vtype(V) == "OBJECT<>")
    for t in TOPICS:
        fail = fail | parts[t][1]
    missing = _nonnull(*[F.when(~parts[t][4], F.lit(f"missing topic '{t}'")) for t in TOPICS])
    errors = F.concat(missing, *[parts[t][2] for t in TOPICS])
    warnings = F.concat(*[parts[t][3] for t in TOPICS])
    out = df.withColumn("ok", F.coalesce(~fail, F.lit(False)))
    res = {**{t: parts[t][0] for t in TOPICS}, "errors": errors, "warnings": warnings}
    keep = [c for c in df.columns if c not in helper_cols and c not in res]
    return out.select(*keep, "ok", *[F.when(F.col("ok"), e).alias(k) for k, e in res.items()])


def sentiment_phrases(v: str = "v") -> Column:
    """The words that F6 looks for in the reviews: those of the highlights, lower-cased, longer than 3 characters."""
    def words(k):
        g = vget(F.col(v), f"$.{k}")
        hl = F.when(v_is_list(g), F.try_variant_get(g, "$", "array<string>")).otherwise(F.array().cast("array<string>"))
        hl = F.filter(F.coalesce(hl, F.array().cast("array<string>")), lambda h: h.isNotNull())
        return F.flatten(F.transform(hl, lambda h: F.filter(py_words(F.lower(h)), lambda w: F.length(w) > MIN_WORD_LEN)))
    return F.array_distinct(F.concat(words("positive_highlights"), words("negative_highlights")))


def topic_phrases(v: str = "v") -> Column:
    """The phrases that F13 looks for in the reviews: keywords of all topics, lower-cased, longer than 3 characters."""
    def keywords(t):
        g = vget(F.col(v), f"$.{t}.keywords")
        found = F.when(v_is_list(g), F.transform(v_list(g), lambda e: F.when(vtype(e) == "STRING", F.lower(v_str(e)))))
        return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda w: w.isNotNull() & (F.length(w) > MIN_WORD_LEN))
    return F.array_distinct(F.concat(*[keywords(t) for t in TOPICS]))


def supported_phrases(answers: DataFrame, reviews: DataFrame, keys: list[str], phrases: str = "phrases", order: str = "seq",
                      text: str = "text") -> DataFrame:
    """F6 / F13 without a corpus string: ``(keys..., supported)``, the phrases of each answer that its reviews hold.

    Every review row is tested against its answer's phrases (a few dozen, one array), and the hits are reduced to
    distinct phrases before they are shuffled, so the reviews of one key are never gathered: a key may hold a third of
    all rows.  Texts are compared lower-cased, as if joined by a space in input order: a phrase may also stand across
    the seam of two reviews (not of three or more).  Null texts are passed over; answers without a hit do not appear.
    """
    asked = answers.select(*keys, F.col(phrases).alias("_p")).where(F.size("_p") > 0)
    rows = reviews.where(F.col(text).isNotNull()).select(*keys, F.col(order).alias("_o"), F.lower(text).alias("_t"))
    inside = join_on(rows.select(*keys, "_t"), asked, keys)
    # neighbours of a key by dense position; only phrases with a space can stand on a seam
    wide = asked.select(*keys, F.filter("_p", lambda p: p.contains(" ")).alias("_p")).where(F.size("_p") > 0)
    placed = materialize(dense_index(join_on(rows, wide.select(*keys), keys, "left_semi"), keys, "_o", name="_i").select(*keys, "_i", "_t"))
    nxt = placed.select(*keys, (F.col("_i") - 1).alias("_i"), F.col("_t").alias("_n"))
    longest = F.array_max(F.transform("_p", lambda p: F.length(p)))
    seams = join_on(join_on(placed, nxt, [*keys, "_i"]), wide, keys)
    seams = seams.select(*keys, F.concat(F.right("_t", longest), F.lit(" "), F.left("_n", longest)).alias("_t"), "_p")
    hits = inside.unionByName(seams).select(*keys, F.explode(F.filter("_p", lambda p: F.contains("_t", p))).alias("_hit"))
    return hits.distinct().groupBy(*keys).agg(F.collect_set("_hit").alias("supported"))


def topics_long(checked: DataFrame, keys: list[str]) -> DataFrame:
    """E5 long form: one row per (answer, topic) for successful answers.

    A topic struct is NULL exactly when the answer failed, so the exploded struct is
    tested instead of ``ok``: a filter on ``ok`` would be pushed below the checker's
    projection and re-evaluate the whole parsed answer for every reference to it."""
    arr = F.array(*[F.struct(F.lit(i).alias("topic_ord"), F.lit(t).alias("topic"), F.col(t).alias("r"))
                    for i, t in enumerate(TOPICS)])
    return (checked.select(*keys, F.explode(arr).alias("x")).filter(F.col("x.r").isNotNull())
            .select(*keys, "x.topic_ord", "x.topic", "x.r.present", "x.r.sentiment", "x.r.score",
                    "x.r.mentions", "x.r.keywords", "x.r.summary"))


def check_status(checked: DataFrame) -> DataFrame:
    """F16: per answer ``n_errors``, ``n_warnings`` and a status: OK / n errors /
    n warnings (errors first), FAILED when the answer failed."""
    ne, nw = F.size("errors"), F.size("warnings")
    status = (F.when(~F.col("ok"), F.lit("FAILED"))
              .when((ne == 0) & (nw == 0), F.lit("OK"))
              .when(ne > 0, F.format_string("%d errors", ne))
              .otherwise(F.format_string("%d warnings", nw)))
    return checked.withColumn("n_errors", F.when(F.col("ok"), ne)) \
        .withColumn("n_warnings", F.when(F.col("ok"), nw)).withColumn("status", status)
