"""Corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; the result is written as Parquet and reread as
the next stage's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from revlens.llm import decontam, langid, mixing, sharding, simhash
from revlens.llm.common import written
from revlens.llm.queries import language_model, table


def keep_known_languages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no text, no letter, or a score below the calibrated threshold."""
    return langid.accepted_documents(docs, language_model(docs))


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component (3-word shingles, 3 bits) the row with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; documents that the mix does not reach go."""
    return mixing.mixed_documents(docs)


def shard(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``shard`` (0 to 39) and ``shard_slot``, the place in the shard."""
    return sharding.sharded_documents(docs, 40)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# A trained model decides in the first stage: no SQL for run().  Tests hold it against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
