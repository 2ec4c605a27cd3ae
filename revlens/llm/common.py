"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# White space of the word contracts: space and \x09-\x0D.  bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts lineage like ``checkpoint()`` but compressed and column-pruned on re-reading.  A lost
    executor re-reads the files.  The folder lives as long as the application's checkpoint folder.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A top-level column whatever its name holds (dots, back-ticks)."""
    return F.col(quoted(name))


def packed(df: DataFrame, alias: str = "__row") -> Column:
    """All columns of ``df`` as one struct, so that private columns cannot clash with them."""
    return F.struct(*[col(c) for c in df.columns]).alias(alias)


def unpacked(columns: list[str], alias: str = "__row") -> list[Column]:
    return [F.col(f"{alias}.{quoted(c)}").alias(c) for c in columns]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_blocks(raw: bytes, block: int = 1 << 20):
    """The words of ``raw`` in lists of about ``block`` bytes: bounded memory for any text."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if at + block < end:
            m = _SPACE.search(raw, at + block)
            end = m.start() if m else end
        yield raw[at:end].split()
        at = end


def utf8(array) -> list:
    """A string column of an Arrow batch as Python bytes (None stays None), without decoding."""
    import pyarrow as pa
    return array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()).to_pylist()
