"""Materialising an intermediate that several branches of one plan read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once with a reliable ``checkpoint()`` into the session's shared
    checkpoint folder and continue from the written copy.

    Used where Catalyst cannot share one computation between consumers (each consumer
    prunes and filters differently, so their exchanges never match) and recomputing would
    repeat an expensive pass over the text.  The lineage is cut, so a lost executor
    re-reads the written copy instead of recomputing it.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the session's shared checkpoint folder and read it back.

    Like ``materialize``, but compressed, pruned to the columns that a reader needs, and of known
    size, so that Spark broadcasts it only when the written bytes allow.  The table lives as long
    as the checkpoint folder.
    """
    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def complete_folders(spark: SparkSession, top: str) -> list[str]:
    """The folders directly below ``top`` whose write was committed (they hold ``_SUCCESS``), by name; none without ``top``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(top)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(f.getPath().toString() for f in fs.listStatus(path) if fs.exists(hadoop.Path(f.getPath(), "_SUCCESS")))
