"""A review table clustered by business (inventory A9, B6, B7): a request reads the buckets of its business, not the table.

The reviews are written once as a bucketed, sorted Parquet table.  The bucket column is a *slice* of a business: a
business of more than ``rows_per_slice`` reviews is cut into several slices by a hash of the row, so that a hot one
lies in many buckets and never in one task.  A small table beside it holds the number of slices of each business:

    <path>/reviews    the rows and ``_slice``, bucketed and sorted by it, one file per bucket
    <path>/slices     business, its number of slices, its number of reviews

Requests are spread over the slices of their businesses and joined on ``_slice``: the stored side keeps its bucketing
and is not shuffled, whatever the number of requests.  A single business is a filter on its slices, which Spark turns
into a selection of buckets and a filter pushed to Parquet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import join_on
from .ordering import first_n

SLICE = "_slice"


@dataclass(frozen=True)
class ClusteredReviews:
    """A table of the session's catalog over the files below ``path``."""
    table: str
    path: str
    scope: str = "business_id"

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table)

    def slices(self, spark: SparkSession) -> DataFrame:
        """``(<scope>, n_slices, n_reviews)``, one row per business."""
        return spark.read.parquet(f"{self.path}/slices")


def _key(scope: str, part):
    """Names a slice; a null business is a business of its own, apart from the empty name."""
    name = F.when(F.col(scope).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(scope).cast("string")))
    return F.concat(name, F.lit("#"), part.cast("string"))


def _slice_names(sizes: DataFrame, scope: str) -> DataFrame:
    """A row per slice of each row of ``sizes``."""
    return sizes.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slices") - 1))).withColumn(SLICE, _key(scope, F.col("_part")))


def write_clustered(reviews: DataFrame, table: str, path: str, buckets: int = 256, rows_per_slice: int = 1_000_000,
                    scope: str = "business_id", order: str = "seq") -> ClusteredReviews:
    """Write ``reviews`` below ``path`` and name the result ``table`` in the session's catalog.

    Repeated rows are kept; rows with a null business too; an empty table gives an empty one.  ``order`` (the place in
    the input) chooses the slice of a row and sorts a slice.
    """
    spark = reviews.sparkSession
    sizes = reviews.groupBy(scope).agg(F.count(F.lit(1)).alias("n_reviews"))
    sizes.select(scope, F.ceil(F.col("n_reviews") / F.lit(rows_per_slice)).alias("n_slices"), "n_reviews") \
        .write.mode("overwrite").parquet(f"{path}/slices")
    stored = ClusteredReviews(table, path, scope)
    part = F.pmod(F.xxhash64(F.lit(3), order), F.col("n_slices"))
    cut = join_on(reviews, stored.slices(spark).select(scope, "n_slices"), scope) \
        .withColumn(SLICE, _key(scope, part)).select(*reviews.columns, SLICE)
    # the same hash as the buckets': one task and one file per bucket
    cut.repartition(buckets, SLICE).write.mode("overwrite").format("parquet").option("path", f"{path}/reviews") \
        .bucketBy(buckets, SLICE).sortBy(SLICE, order).saveAsTable(table)
    return stored


def open_clustered(spark: SparkSession, table: str, path: str, buckets: int = 256, scope: str = "business_id",
                   order: str = "seq") -> ClusteredReviews:
    """Name the files of an earlier :func:`write_clustered` (same ``buckets`` and ``order``) in this session's catalog; nothing is read but a footer."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/reviews").schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({SLICE}) SORTED BY ({SLICE}, `{order}`) "
              f"INTO {buckets} BUCKETS LOCATION '{path}/reviews'")
    return ClusteredReviews(table, path, scope)


def clustered_reviews_of(stored: ClusteredReviews, selected: DataFrame, limit: int | None = None, order: str = "seq") -> DataFrame:
    """B6 + B7 on a clustered table: the rows of :func:`collect.reviews_of`, the stored side not shuffled.

    ``limit`` first keeps the first N of each slice where the slice lies, so at most N rows per slice move.
    """
    spark = selected.sparkSession
    asked = selected.select(stored.scope, F.col("name").alias("business_name")).dropDuplicates([stored.scope]).where(F.col(stored.scope).isNotNull())
    asked = asked.join(stored.slices(spark).select(stored.scope, "n_slices"), stored.scope)
    asked = _slice_names(asked, stored.scope).select(SLICE, "business_name")
    rows = stored.rows(spark)
    rows = rows.drop("business_name") if "business_name" in rows.columns else rows
    out = rows.join(asked, SLICE)
    if limit:
        out = first_n(first_n(out, [SLICE], F.col(order), limit), [stored.scope], F.col(order), limit)
    return out.drop(SLICE)


def reviews_of_business(stored: ClusteredReviews, spark: SparkSession, businesses: Sequence[str]) -> DataFrame:
    """The reviews of a few named businesses: only their buckets are read (the slices of the named are looked up first)."""
    found = _slice_names(stored.slices(spark).where(F.col(stored.scope).isin(*businesses)), stored.scope).select(SLICE).collect()
    return stored.rows(spark).where(F.col(SLICE).isin(*[r[0] for r in found]) if found else F.lit(False)).drop(SLICE)
