"""A store of model answers (inventory E7): a prompt that was answered once is never sent again.

An answer is named by the SHA-256 of the model's name and the prompt.  Answers lie in append-only Parquet folders, one
per pass over the open prompts:

    <path>/pass=<uuid>/    prompt_key, raw

A run takes the distinct prompts that no committed folder answers (an anti-join, before the model is called), scores
them in tasks of ``per_task`` prompts, and writes what succeeded.  A failed prompt is tried again, ``attempts`` times in
all, then left open: the next run tries it anew.  A lost task repeats its own prompts only; a lost run keeps all
committed passes; a folder that was not committed is not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import join_large
from .lineage import complete_folders, write_table
from .modelio import score_batches

STORED = "prompt_key string, raw string"


def prompt_key(prompt, model: str = "") -> Column:
    """The content address of a prompt; a null prompt is the empty one."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.sha2(F.concat(F.lit(f"{len(model)}:{model}"), F.coalesce(p, F.lit(""))), 256)


def stored_answers(spark: SparkSession, path: str) -> DataFrame:
    """``(prompt_key, raw)``, one row per key: of answers that two runs wrote at once, the smaller text."""
    folders = complete_folders(spark, path)
    if not folders:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(*folders).groupBy("prompt_key").agg(F.min("raw").alias("raw"))


def named_prompts(blocks: DataFrame, model: str = "", keys: Sequence[str] = ("scope", "batch_id"), block: str = "block") -> DataFrame:
    """``(keys..., block, prompt_key)``, written once: what several runs of :func:`answer_batches` read."""
    return write_table(blocks.select(*keys, block).withColumn("prompt_key", prompt_key(block, model)), "prompts")


def answer_batches(blocks: DataFrame, scorer: Callable[[pd.Series], pd.Series], path: str, model: str = "",
                   keys: Sequence[str] = ("scope", "batch_id"), block: str = "block", attempts: int = 3,
                   per_task: int = 64, chunk: int = 16) -> DataFrame:
    """E7 through the store at ``path``: ``(keys..., raw, error)`` as :func:`modelio.score_batches` gives them.

    ``blocks`` of :func:`named_prompts` (the same model) are taken as they are, others are written first.  The open
    prompts are counted by their names; a prompt's text is shuffled once, to the task that asks it.
    Equal prompts are sent once.  Of a prompt that failed ``attempts`` times, ``raw`` is empty and ``error`` is the last one.
    """
    spark = blocks.sparkSession
    named = blocks if "prompt_key" in blocks.columns else named_prompts(blocks, model, keys, block)
    prompts = named.select("prompt_key", block)
    todo = write_table(named.select("prompt_key").distinct()
                       .join(stored_answers(spark, path).select("prompt_key"), "prompt_key", "left_anti"), "open-prompts")
    failed = None
    for _ in range(attempts):
        n = todo.count()
        if not n:
            failed = None
            break
        asked = prompts.join(todo, "prompt_key", "left_semi").repartition(-(-n // per_task), "prompt_key") \
            .groupBy("prompt_key").agg(F.min(block).alias(block))
        got = write_table(score_batches(asked, scorer, ["prompt_key"], block, write_once=False, chunk=chunk), "scored")
        got.where("error IS NULL").select("prompt_key", F.coalesce("raw", F.lit("")).alias("raw")).write.parquet(f"{path}/pass={uuid.uuid4().hex}")
        failed = got.where("error IS NOT NULL").select("prompt_key", "error")
        todo = failed.select("prompt_key")
    out = join_large(named.select(*keys, "prompt_key"), stored_answers(spark, path), "prompt_key", "left")
    out = out.withColumn("error", F.lit(None).cast("string")) if failed is None else out.join(failed, "prompt_key", "left")
    return out.select(*keys, F.coalesce("raw", F.lit("")).alias("raw"), F.when(F.col("raw").isNull(), F.col("error")).alias("error"))
