"""Sharding by fixed virtual slots.

A record's key is hashed once and for all into one of ``slots`` virtual slots; a versioned map says
which shard holds a slot.  The map is a table of ``slots`` rows with the bytes and rows of each slot;
rebalancing edits the map, never the hash, and writes a new version.

The base map of n shards gives slot v to the last shard j < n for which ``hash(v, j) mod (j + 1)`` is
0: key and shard count alone decide, each shard gets an even share of the slots, and the map of
n + 1 shards differs only by slots that go to the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import col, packed, quoted, written

SLOTS = 4096


def hash32(c: Column) -> Column:
    """The first 32 bits of the text's md5, as other engines have it too."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long")


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key (as text; null counts as empty text)."""
    return hash32(F.coalesce(key.cast("string"), F.lit(""))) % slots


def _shard(slot: Column, shards: int) -> Column:
    # j + 1 divides the hash of (slot, j): the last such j; j = 0 always does
    j = F.sequence(F.lit(0), F.lit(shards - 1))
    name = lambda j: F.concat(slot.cast("string"), F.lit(":"), j.cast("string"))
    return F.array_max(F.filter(j, lambda j: hash32(name(j)) % (j + 1) == 0))


def base_map(spark, shards: int, slots: int = SLOTS) -> DataFrame:
    """``(version, slot, shard)`` of ``shards`` shards.  The version is the shard count."""
    return spark.range(slots).select(F.lit(shards).alias("version"), F.col("id").alias("slot"),
                                     _shard(F.col("id"), shards).alias("shard"))


def slot_sizes(records: DataFrame) -> DataFrame:
    """``records(slot, size)`` -> bytes and rows per slot (partial sums before the shuffle)."""
    return records.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def store_map(mapping: DataFrame, sizes: DataFrame, path: str, version: int) -> DataFrame:
    """Write one version of the map, with the bytes and rows of its slots, and return the whole stored map.

    A version is a folder of the map table at ``path``: storing it again after a failure replaces it.
    """
    full = mapping.select("slot", "shard").join(sizes.select("slot", "bytes", "rows"), "slot", "left").select(
        F.col("slot").cast("long").alias("slot"), F.col("shard").cast("int").alias("shard"),
        F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))
    full.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")
    return stored_map(mapping.sparkSession, path)


def stored_map(spark, path: str) -> DataFrame:
    """The stored map at ``path`` in all its versions: slot, shard, bytes, rows, version."""
    return spark.read.schema("slot long, shard int, bytes long, rows long, version int").parquet(path)


def grown(stored: DataFrame, version: int, shards: int) -> DataFrame:
    """The stored ``version`` of ``shards`` shards edited for one shard more (law ``key``).

    Slot and shard count decide which slots the new shard takes; every other row stays as it is stored, edits by
    hand or by ``rebalanced`` included.
    """
    takes = hash32(F.concat(F.col("slot").cast("string"), F.lit(f":{shards}"))) % (shards + 1) == 0
    return stored.where(F.col("version") == version).withColumn("shard", F.when(takes, F.lit(shards)).otherwise(F.col("shard")))


def balanced(stored: DataFrame, version: int, spread: float = 0.02) -> DataFrame:
    """The stored ``version`` edited until the fullest and the emptiest shard differ by at most ``spread`` of the mean,
    or until no slot can move without making the difference larger.

    Each round pairs the fullest shard with the emptiest, the second with the second last and so on; a pair
    moves the largest slots that together fit into half of its gap, and if the largest exceeds it, those that
    fit after it.  The map has a fixed number of rows, so a round is a few small jobs at any corpus size.
    """
    m = written(stored.where(F.col("version") == version), "slot-map-round")
    one = Window.partitionBy(F.lit(0))
    while True:
        load = m.groupBy("shard").agg(F.sum("bytes").alias("load"))
        ranked = load.select("shard", "load", F.row_number().over(one.orderBy(F.col("load").desc(), "shard")).alias("place"),
                             F.count(F.lit(1)).over(one).alias("n"))
        low = ranked.select((F.col("n") + 1 - F.col("place")).alias("place"), F.col("shard").alias("to"), F.col("load").alias("low"))
        pairs = ranked.join(low, "place").where("load > low").select("shard", "to", F.expr("(load - low) div 2").alias("gap"))
        most, least, mean = load.agg(F.max("load"), F.min("load"), F.avg("load")).first()
        if most is None or most - least <= spread * mean:
            return m
        w = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "slot").rowsBetween(Window.unboundedPreceding, 0)
        moves = m.join(pairs, "shard").where("bytes > 0 AND bytes <= gap").withColumn("upto", F.sum("bytes").over(w)) \
            .where("upto <= gap").select("slot", "to")
        after = written(m.join(moves, "slot", "left").select(
            "slot", F.coalesce("to", "shard").alias("shard"), "bytes", "rows", "version"), "slot-map-round")
        worst = after.groupBy("shard").agg(F.sum("bytes").alias("load")).agg(F.max("load") - F.min("load")).first()[0]
        if worst >= most - least:
            return m
        m = after


def rebalanced(stored: DataFrame, version: int, new_version: int) -> DataFrame:
    """A new version in which the fullest shard hands slots to the emptiest, by their bytes.

    The largest slots that fit into half the gap between the two move, in order of size, as far as their
    running total stays below it.  The map has a fixed number of rows, so it is ordered as a whole.
    """
    m = stored.where(F.col("version") == version)
    load = m.groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    ends = load.agg(F.max_by("shard", F.struct("bytes", "shard")).alias("full"), F.min_by("shard", F.struct("bytes", "shard")).alias("empty"),
                    F.floor((F.max("bytes") - F.min("bytes")) / 2).alias("gap"))
    full, empty, gap = (ends.select(c).scalar() for c in ("full", "empty", "gap"))
    w = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "slot").rowsBetween(Window.unboundedPreceding, 0)
    fits = m.where(F.col("shard") == full).where((F.col("bytes") > 0) & (F.col("bytes") <= gap)) \
        .withColumn("upto", F.sum("bytes").over(w)).where(F.col("upto") <= gap).select("slot", F.lit(True).alias("moves"))
    return m.join(fits, "slot", "left").select(
        F.lit(new_version).alias("version"), "slot", F.when(F.col("moves"), empty).otherwise(F.col("shard")).alias("shard"))


def assign(docs: DataFrame, shards: int = 40, slots: int = SLOTS, text: str = "text", doc_id: str = "doc_id",
           carry: list[str] | None = None, map_path: str | None = None) -> DataFrame:
    """Documents with their shard: ``row`` (carried columns), doc_id, size, text_crc32, virtual_slot, shard,
    grown_shard (with one shard more), ``slot`` (place in the shard, from 0 without a gap), slot_bytes.

    Size: UTF-8 bytes of the text (null: none) plus 16.  The map is stored at ``map_path`` (a new folder below
    ``spark.checkpoint.dir`` if None) as version ``shards``; the version of one shard more is an edit of the
    stored rows, stored beside it; shard and grown_shard are read from these two versions.  Places are numbered by virtual slot and inside it by hashed
    part, so no task holds a shard: a count per part gives the offsets.  A null id is the key of an
    empty text.  Repeated rows get a place each.  Null texts have crc32 0.  An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    carry = [doc_id] if carry is None else carry
    size = F.coalesce(F.octet_length(col(text).cast("string")), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce(col(text).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(packed(docs.select(*[col(c) for c in carry]), "row"), col(doc_id).alias("doc_id"),
                       size.alias("size"), crc.alias("text_crc32"), virtual_slot(col(doc_id), slots).alias("virtual_slot"))
    rows = rows.withColumn("part", hash32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))) % 64)
    if carry == [doc_id]:
        rows = written(rows, "shard-rows")
    sums = written(rows.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "shard-parts")
    sizes = sums.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("rows"))
    path = map_path or f"{ensure_checkpoint_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    stored = store_map(base_map(spark, shards, slots), sizes, path, shards)
    stored = store_map(grown(stored, shards, shards), sizes, path, shards + 1)
    at = F.col("slot").alias("virtual_slot")
    mapping = stored.where(F.col("version") == shards).select(at, "shard", F.col("bytes").alias("slot_bytes")).join(
        stored.where(F.col("version") == shards + 1).select(at, F.col("shard").alias("grown_shard")), "virtual_slot")
    # one row per (slot, part): bounded by slots * 64
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("virtual_slot", "part", "n").join(mapping, "virtual_slot") \
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")
    inside = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("inside", inside).join(offsets, ["virtual_slot", "part"]).select(
        "row", "doc_id", "size", "text_crc32", "virtual_slot", "shard", "grown_shard",
        (F.col("before") + F.col("inside")).alias("slot"), "slot_bytes")


def sharded_documents(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """The columns of ``docs`` with ``shard`` and ``shard_slot`` (place in the shard).

    Own columns of these names are kept as ``shard`` and ``shard_slot`` with ``_in`` behind.
    """
    rows = assign(docs, shards, carry=docs.columns, **options)
    own = {c.lower() for c in docs.columns}
    cols = [F.col(f"row.{quoted(c)}").alias(c + "_in" if c.lower() in ("shard", "shard_slot") and c.lower() + "_in" not in own else c)
            for c in docs.columns]
    return rows.select(*cols, F.col("shard"), F.col("slot").alias("shard_slot"))
