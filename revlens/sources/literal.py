"""Small fixed tables (topic queries, lexicons, catalogues, label grids) built as JVM-side
literals: one partition, no Python worker and no parallelized Python RDD."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """``rows`` as a DataFrame with the DDL ``schema`` (e.g. ``"topic string, ord int"``)."""
    st = T._parse_datatype_string(schema)
    fields = st.fields
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields)]) for r in rows]
    one = spark.range(0, 1, 1, 1)
    if not structs:
        return one.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).limit(0)
    return one.select(F.inline(F.array(*structs)))
