"""Queries for the landing-folder stream (A12): rows with their batch (arrival order, rows-only), and the kept texts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.fixtures import FX_REVIEWS_SQL, fx_reviews, with_ctes
from ..sources.readers import write_csv
from ..streaming.landing import run_landing_once
from .catalog import query
from .q_validate import TAGGED_SQL


FILE_BYTES = 128_000_000   # text of an uploaded file; a file is read by one task, and two are a micro-batch


def _landed(spark, sf_dir):
    """Uploads land as CSV files (one folder per language here); the stream validates
    each micro-batch (one file per trigger) and drops texts already kept for the same
    business by an earlier batch."""
    base = os.path.join(ensure_checkpoint_dir(spark), "revlens-stream", uuid.uuid4().hex)
    landing, sink, ckpt = (os.path.join(base, x) for x in ("landing", "sink", "checkpoint"))
    src = fx_reviews(spark, sf_dir).select("business_name", F.col("stars").cast("string").alias("stars"),
                                            "text", "lang")
    langs = ["en", "de", "fr", "es"]
    known = F.when(F.col("lang").isin(*langs), F.col("lang"))
    size = {r.lang: r.size or 0 for r in src.groupBy(known.alias("lang")).agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    for lang in [*langs, None]:
        own = src.filter(F.col("lang") == lang if lang else F.coalesce(~F.col("lang").isin(*langs), F.lit(True))).drop("lang")
        # as many files as the texts fill: the settings of the shuffle would make micro-batches of a few MB, each with its own jobs and state
        files = -(-size.get(lang, 0) // FILE_BYTES) or 1
        write_csv(own.repartitionByRange(files, "text").sortWithinPartitions("text"), os.path.join(landing, lang or "other"))
    return run_landing_once(spark, landing, sink, ckpt, max_files_per_trigger=2)


@query("landing_stream")
def q_landing_stream(spark, sf_dir):
    """What the stream keeps, with the batch that kept it (arrival order decides that)."""
    return _landed(spark, sf_dir).select("business_name", "stars", "text", "epoch")


@query("landing_kept_texts", with_ctes(FX_REVIEWS_SQL, TAGGED_SQL, body="""
SELECT DISTINCT business_name, md5(text) AS text_md5 FROM clean"""))
def q_landing_kept(spark, sf_dir):
    """The kept texts, which do not depend on the batches they came in."""
    return _landed(spark, sf_dir).select("business_name", F.md5("text").alias("text_md5"))
