"""Continuous ingestion of uploaded review CSV files (inventory A12).

The reference copies each uploaded CSV into a folder and analyses it on request.  Here the
folder is a Structured Streaming file source: new ``*.csv`` files are read with a fixed
all-string schema, cleaned and validated row by row, and appended to a Parquet sink.

Keep-first dedup spans micro-batches through Spark's keyed state: a key is the scope and 128
hashed bits of the text, and its state says that the text was kept.  A micro-batch touches the
state of its own keys only, so its cost follows its rows and not what was kept before; the state
lives in the query's checkpoint and is versioned with it.  On a cluster set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider, which holds state on
disk.  Within a batch the first copy by (file time, file, row) is kept.

Exactly-once: a retried micro-batch starts from the state of its predecessor and overwrites its
own ``epoch=<id>`` folder, also when it keeps nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_spam, na_to_null
from ..operators.validate import ensure_columns, tag_row_rejects
from ..sources.readers import clean_csv

# --- fixed values -------------------------------------------------------------------
LANDING_COLUMNS = ["business_name", "stars", "text"]
# ------------------------------------------------------------------------------------


def landing_schema(columns: Sequence[str] = LANDING_COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _numbered(batches):
    """Appends the row's position in its task; a file of quoted line breaks is read by one task, in order."""
    import pyarrow as pa
    n = 0
    for b in batches:
        at = pa.array(range(n, n + b.num_rows), pa.int64())
        n += b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, at], names=[*b.schema.names, "_row"])


def _keep_first(columns: list[str], ttl_ms: int | None):
    """State function: the first row of a key that was not kept before (and not forgotten since)."""
    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        first = at = None
        for pdf in frames:
            # nearly every key has one row: sorting a frame costs more than all else that a key needs
            low = pdf if len(pdf) == 1 else pdf.sort_values("_place").head(1)
            place = low["_place"].iat[0]
            if first is None or place < at:
                first, at = low, place
        known = state.exists
        state.update((True,))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        if not known and first is not None:
            yield first[columns]
    return run


def start_landing_stream(spark: SparkSession, landing_dir: str, sink_dir: str, checkpoint_dir: str,
                         columns: Sequence[str] = LANDING_COLUMNS, scope: Sequence[str] = ("business_name",),
                         max_files_per_trigger: int | None = None, available_now: bool = True, ttl_ms: int | None = None):
    """Start the landing-folder stream; returns the ``StreamingQuery``.

    ``available_now`` processes everything present and stops (batch-like runs, tests);
    otherwise the query keeps watching the folder.  ``ttl_ms``: forget a text that did not come
    again for so long (default: never), which bounds the state; a later copy is then kept anew.
    """
    scope = list(scope)
    reader = (spark.readStream.schema(landing_schema(columns))
              .option("header", "true").option("multiLine", "true").option("escape", '"')
              .option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    src = (reader.csv(landing_dir)
           .withColumn("_file", F.col("_metadata.file_path"))
           .withColumn("_mtime", F.col("_metadata.file_modification_time")))
    src = src.mapInArrow(_numbered, T.StructType([*src.schema.fields, T.StructField("_row", T.LongType())]))
    # a file is read by one task, as its rows are numbered; its rows are validated by all
    src = src.repartition("_file", "_row")
    src = clean_csv(src.select(*[na_to_null(F.col(c)).alias(c) for c in columns], "_file", "_mtime", "_row"))
    rows = tag_row_rejects(src).where("reject_reason is null").drop("reject_reason", "text_len_raw").where(~is_spam(F.col("text")))
    # a key costs what its frame has in columns, to Python and back: its scope and hashes, its place and its row are one text each
    key = F.to_json(F.struct(*[F.col(c).alias(f"_scope_{i}") for i, c in enumerate(scope)], F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), F.col("text")).alias("_h2")))
    order = F.concat(F.lpad(F.unix_micros("_mtime").cast("string"), 20, "0"), "_file", F.lit(" "), F.lpad(F.col("_row").cast("string"), 20, "0"))
    schema = rows.schema
    moved = T.StructType([T.StructField(f.name, T.LongType() if f.name == "_mtime" else f.dataType) for f in schema])
    packed = F.to_json(F.struct(*[F.unix_micros(c).alias(c) if c == "_mtime" else F.col(c) for c in schema.names]))
    kept = rows.select(key.alias("_key"), order.alias("_place"), packed.alias("_packed")).groupBy("_key").applyInPandasWithState(
        _keep_first(["_packed"], ttl_ms), "_packed string", T.StructType([T.StructField("kept", T.BooleanType())]), "append",
        "ProcessingTimeTimeout" if ttl_ms else "NoTimeout")
    kept = kept.select(F.from_json("_packed", moved).alias("r")).select("r.*").withColumn("_mtime", F.timestamp_micros("_mtime"))

    def write(batch: DataFrame, epoch_id: int) -> None:
        # numbering the rows samples, sorts and joins the batch: without a kept copy each of these would run the whole
        # micro-batch anew, its files, its validation and its state
        batch = batch.persist()
        b = batch.withColumn("seq", F.struct("_mtime", "_file", "_row")).drop("_mtime", "_file", "_row")
        b = ensure_columns(b, "seq").withColumn("text_hash", F.xxhash64("text"))
        b.write.mode("overwrite").parquet(f"{sink_dir}/epoch={epoch_id}")
        batch.unpersist()

    w = kept.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    if not (available_now and ttl_ms):
        return w.start()
    # a processing-time timeout always asks for one more batch without data, so that a run over what is there now never
    # ended; here its batches of data forget.  A query copies the session's settings as it starts.
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    old = spark.conf.get(idle, None)
    spark.conf.set(idle, "false")
    try:
        return w.start()
    finally:
        spark.conf.unset(idle) if old is None else spark.conf.set(idle, old)


def run_landing_once(spark: SparkSession, landing_dir: str, sink_dir: str, checkpoint_dir: str,
                     **kw) -> DataFrame:
    """Process all files present now, wait, and return the sink table."""
    q = start_landing_stream(spark, landing_dir, sink_dir, checkpoint_dir, available_now=True, **kw)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(sink_dir)
