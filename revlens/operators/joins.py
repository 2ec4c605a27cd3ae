"""Join helpers.

Which side is broadcast is left to Spark's size statistics (static and, under AQE, measured);
nothing here counts rows while a plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Equi-join on equally named columns where NULL equals NULL: a NULL scope is a scope of
    its own, as it is in the aggregates on either side.  Each key comes back once."""
    on = [on] if isinstance(on, str) else list(on)
    other = right.select(*[F.col(f"`{c}`").alias(f"__right_{c}" if c in on else c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(other[f"`__right_{k}`"]) for k in on])
    out = left.join(other, same, how)
    if how in ("left_semi", "left_anti"):
        return out
    if how in ("full", "outer", "full_outer"):
        out = out.withColumns({k: F.coalesce(F.col(f"`{k}`"), F.col(f"`__right_{k}`")) for k in on})
    return out.drop(*[f"__right_{k}" for k in on])


def join_large(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Join two sides that both grow with the data (e.g. model answers with the per-batch
    review corpus) as a sort-merge join on the key: never broadcast on an estimate, spills
    instead of holding a hot key in memory, and AQE splits skewed key partitions.  When a
    side is already hash-partitioned on the key (an aggregate by it) only the other side is
    shuffled."""
    return left.join(right.hint("merge"), on, how)
