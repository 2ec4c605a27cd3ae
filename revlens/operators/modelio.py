"""Model input / output (inventory E1-E7).

A text model is called once per batch of reviews.  Its input block (E1) is built per
batch with a bounded ``collect_list`` (a batch holds at most ``batch_size`` rows, see
``merge.split_batches``).  Its raw answer is parsed into a ``VARIANT`` (E2/E3) so the
checker can test JSON types exactly; nothing is coerced silently.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip

# --- fixed values -------------------------------------------------------------------
TOPICS = ["food_quality", "service", "price", "ambiance"]
TOPIC_QUERIES = {
    "food_quality": "food quality taste delicious menu dish meal",
    "service": "service staff waiter attitude speed helpful",
    "price": "price cost expensive cheap value worth money",
    "ambiance": "ambiance atmosphere decor noise clean location",
}
SENTIMENTS = ["positive", "negative", "neutral"]
SENTIMENT_KEYS = ["positive", "negative", "neutral", "summary", "positive_highlights", "negative_highlights"]
# ------------------------------------------------------------------------------------


def review_block(reviews: DataFrame, keys: Sequence[str], order: str = "seq", text: str = "text") -> DataFrame:
    """Per batch, each non-null review as ``- text`` joined by newlines in input order,
    and the checker's corpus: all texts joined by a space, lower-cased.

    ``keys`` must identify a bounded batch (at most a few hundred rows): the texts of one
    batch are gathered into one row.
    """
    keys = list(keys)
    g = (reviews.filter(F.col(text).isNotNull())
         .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
                             .alias("_r"), F.count(F.lit(1)).alias("n_reviews")))
    return g.select(*keys, "n_reviews",
                    F.array_join(F.transform("_r", lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias("block"),
                    F.lower(F.array_join(F.transform("_r", lambda x: x["t"]), " ")).alias("corpus"))


def strip_fence(raw) -> Column:
    """Python-strip; when the answer starts with a markdown fence take the part up to
    the next fence and drop a leading ``json``; strip again."""
    r = py_strip(raw if not isinstance(raw, str) else F.col(raw))
    part = F.split(r, "```", -1).getItem(1)
    part = F.when(part.startswith("json"), F.substring(part, 5, 1 << 30)).otherwise(part)
    return py_strip(F.when(r.startswith("```"), F.coalesce(part, F.lit(""))).otherwise(r))


def extract_json(raw) -> Column:
    """The text from the first ``{`` to the last ``}`` parsed as VARIANT; NULL when
    there is none or it is not valid JSON (the reference's empty-result failure).
    Documented divergence: Python also accepts ``NaN`` and duplicate keys."""
    r = raw if not isinstance(raw, str) else F.col(raw)
    body = F.regexp_extract(r, "(?s)\\{.*\\}", 0)
    return F.when(body != "", F.try_parse_json(body))


# --- VARIANT type tests (JSON types as Python's json module would produce) ----------
def vget(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def vtype(v: Column) -> Column:
    """Type name: BIGINT, DOUBLE, DECIMAL(p,s), BOOLEAN, STRING, VOID (JSON null),
    ARRAY<...>, OBJECT<...>; NULL when absent."""
    return F.schema_of_variant(v)


def v_present(v: Column) -> Column:
    return v.isNotNull()


def v_is_number(v: Column) -> Column:
    """Python ``isinstance(x, (int, float))`` (bool included)."""
    t = vtype(v)
    return F.coalesce(t.isin("BIGINT", "DOUBLE", "BOOLEAN", "FLOAT") | t.startswith("DECIMAL"), F.lit(False))


def v_is_int(v: Column) -> Column:
    """Python ``isinstance(x, int)``: JSON integers and booleans.  ``8.0`` parses as
    DECIMAL(1,0) and is a float, integers beyond 64 bits as DECIMAL(p,0) with p >= 19."""
    t = vtype(v)
    big_int = t.rlike("^DECIMAL\\((19|[2-9][0-9]),0\\)$")
    return F.coalesce(t.isin("BIGINT", "BOOLEAN") | big_int, F.lit(False))


def v_is_string(v: Column) -> Column:
    return F.coalesce(vtype(v) == "STRING", F.lit(False))


def v_is_list(v: Column) -> Column:
    """False for an absent value (type tests are null-safe: absent = not that type)."""
    return F.coalesce(vtype(v).startswith("ARRAY"), F.lit(False))


def v_is_object(v: Column) -> Column:
    return F.coalesce(vtype(v).startswith("OBJECT"), F.lit(False))


def v_num(v: Column) -> Column:
    """Numeric value as DOUBLE (booleans as 1/0)."""
    return F.when(vtype(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")) \
        .otherwise(F.try_variant_get(v, "$", "double"))


def v_str(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def v_list(v: Column) -> Column:
    """Array elements as VARIANTs (NULL when not a list)."""
    return F.when(v_is_list(v), F.try_variant_get(v, "$", "array<variant>"))


def v_str_list(v: Column) -> Column:
    return F.when(v_is_list(v), F.try_variant_get(v, "$", "array<string>"))


def v_all_strings(v: Column) -> Column:
    """True when ``v`` is a list whose elements are all strings."""
    return F.forall(v_list(v), lambda e: vtype(e) == "STRING")


# --- E7: user scorer hook ----------------------------------------------------------
def score_batches(batches: DataFrame, scorer: Callable[[pd.Series], pd.Series],
                  keys: Sequence[str] = ("scope", "batch_id"), block: str = "block",
                  write_once: bool = True, chunk: int = 16) -> DataFrame:
    """Call a user-supplied text model on every batch's input block.

    ``scorer`` maps a pandas Series of prompt blocks to a Series of raw answers.  It runs
    inside ``mapInPandas`` (Arrow batches; a model is loaded once per Python worker and
    scores ``chunk`` blocks per call).  Any exception for a block gives an empty answer and the error
    text, as the reference turns every call error into an empty result.  Output:
    ``(keys..., raw, error)``.

    ``write_once``: the answers are written once (reliable checkpoint) before they are
    returned.  Checking and merging read them in several branches; without it every
    branch would call the model again - the most expensive step, and a model need not
    answer the same way twice.
    """
    keys = list(keys)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in batches.select(*keys).schema.fields]
                       + ["raw string", "error string"])

    def answers_of(blocks: pd.Series) -> tuple[list, list]:
        try:
            return list(scorer(blocks)), [None] * len(blocks)
        except Exception as e:  # noqa: BLE001
            if len(blocks) == 1:
                return [""], [f"{type(e).__name__}: {e}"]
        # only this chunk is asked again, one block at a time, to find the one that fails
        got = [answers_of(blocks.iloc[i:i + 1]) for i in range(len(blocks))]
        return [r[0] for r, _ in got], [e[0] for _, e in got]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), chunk):
                part = pdf.iloc[at:at + chunk]
                raw, err = answers_of(part[block])
                yield part[keys].assign(raw=raw, error=err)

    answers = batches.select(*keys, block).mapInPandas(run, schema)
    if write_once:
        from .lineage import materialize
        answers = materialize(answers)
    return answers


# --- E6: report answer --------------------------------------------------------------
REPORT_TYPE = ("struct<business_name: string, total_reviews: bigint, overall_score: double, "
               "sentiment_overview: struct<positive: double, negative: double, neutral: double>, "
               "strengths: array<string>, weaknesses: array<string>, recommendations: array<string>, "
               "executive_summary: string, priority_action: string>")


def parse_report(v) -> Column:
    """The report answer as a typed struct (fields absent or of another type are NULL;
    the reference keeps whatever the model returned, so no repair happens here).  NULL
    when the answer had no JSON object (a failed report, H7)."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(v_is_object(v), F.try_variant_get(v, "$", REPORT_TYPE))
