"""Persisted retrieval collections (inventory D5): one per business, indexed anew only when its reviews changed.

The reference drops and rebuilds a business's collection on every request.  Here all collections are one Parquet
table, partitioned by scope and version, beside a manifest that names the version of each:

    <path>/rows/<scope>=.../version=.../     the indexed rows (id, text, vector, ...)
    <path>/manifest/version=<n>/             scope, collection, signature, n_rows, version of its rows

A refresh compares signatures (count and two order-free sums of row hashes) of the present reviews with the manifest,
indexes the changed collections alone, writes them by dynamic partition overwrite under the new version, and then
writes the new manifest.  Readers follow a manifest: a refresh that fails half way is invisible, its retry replaces
what it wrote, and earlier versions stay readable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import join_on
from .retrieve import collection_key


def _manifest(path: str, version: int) -> str:
    return f"{path}/manifest/version={version}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions whose manifest is complete, ascending (one entry per refresh)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(f"{path}/manifest")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found = [f.getPath() for f in fs.listStatus(top) if f.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(hadoop.Path(p, "_SUCCESS")))


def signatures(reviews: DataFrame, scope: str, id_col: str, text_col: str, name_col: str) -> DataFrame:
    """Per collection its row count and signature; the order of its rows does not matter, every id and text does."""
    h1, h2 = F.xxhash64(id_col, text_col), F.xxhash64(F.lit(7), text_col, id_col)
    return reviews.groupBy(scope).agg(
        F.min(collection_key(name_col)).alias("collection"), F.count(F.lit(1)).alias("n_rows"),
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(h1.cast("decimal(38,0)")).cast("string"),
                    F.sum(h2.cast("decimal(38,0)")).cast("string")).alias("signature"))


def refresh_collections(reviews: DataFrame, path: str, index: Callable[[DataFrame], DataFrame], scope: str = "business_id",
                        id_col: str = "review_id", text_col: str = "text", name_col: str = "business_name") -> int:
    """Bring the collections below ``path`` up to date with ``reviews`` and return the manifest's version.

    ``index`` maps review rows to rows to store (e.g. :func:`retrieve.embed_texts`); it sees the rows of new and changed
    collections only.  Reviews without text are not indexed (D1) and do not count.  A collection whose reviews are
    gone leaves the manifest.  Without any change no version is written.
    """
    spark = reviews.sparkSession
    reviews = reviews.where(F.col(text_col).isNotNull())
    have = versions(spark, path)
    now = signatures(reviews, scope, id_col, text_col, name_col)
    if have:
        old = spark.read.parquet(_manifest(path, have[-1]))
        kept = join_on(old, now.select(scope, "signature"), [scope, "signature"], "left_semi")
        changed = join_on(now, old.select(scope, "signature"), [scope, "signature"], "left_anti")
        if changed.isEmpty() and old.count() == kept.count():
            return have[-1]
    else:
        kept, changed = None, now
    version = (have[-1] if have else 0) + 1
    todo = join_on(reviews, changed.select(scope), scope, "left_semi")
    index(todo).withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(scope, "version").parquet(f"{path}/rows")
    new = changed.select(scope, "collection", "signature", "n_rows", F.lit(version).alias("rows_version"))
    new = new if kept is None else kept.select(*new.columns).unionByName(new)
    new.write.mode("overwrite").parquet(_manifest(path, version))
    return version


def read_collections(spark: SparkSession, path: str, version: int | None = None, scope: str = "business_id") -> DataFrame:
    """The indexed rows as of a manifest (default: the last), with ``collection`` and ``rows_version``."""
    have = versions(spark, path)
    if not have:
        raise FileNotFoundError(f"no collections at {path}")
    manifest = spark.read.parquet(_manifest(path, have[-1] if version is None else version))
    rows = spark.read.parquet(f"{path}/rows").withColumnRenamed("version", "rows_version")
    kind = dict(manifest.dtypes)[scope]  # partition values come back with a guessed type
    rows = rows.withColumn(scope, F.col(scope).cast(kind))
    return join_on(rows, manifest.select(scope, "rows_version", "collection"), [scope, "rows_version"])
