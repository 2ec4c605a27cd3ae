"""Connected components by alternating large-star and small-star steps.

Public method: Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each step is
a ``min`` aggregate (combined before the shuffle) and an equi-join that AQE can split where a hub
is hot; the edge table is written after each round, so no lineage builds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(node, root)``, root the smallest node reachable.

    Nodes without an edge do not appear.  Self loops, repeated edges and either direction are
    allowed; null ends are not edges and are dropped.
    """
    e = (edges.where(F.col("u") != F.col("v"))
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = written(e, "edges")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(moved.union(low).distinct(), "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
