"""Queries op1 .. op13 of the training-data operators, and their DuckDB SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decontam, gnat, jaccard_join, langid, lattice, mixing, oracles, pfp_dedup, preference, prefix_trie, radix_dedup, secrets, sharding, simhash

def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def language_model(docs: DataFrame) -> langid.Model | None:
    return langid.fit(docs.where(crc_mod(F.col("doc_id"), 3) != 1))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = docs.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"),
                      langid.identify(F.col("text"), language_model(docs)).alias("g"))
    return got.select("doc_id", "held_out", F.col("g.lang").alias("lang_pred"), F.col("g.score").alias("score"),
                      F.col("g.accepted").alias("accepted"))


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_repeat_removal(spark, sf_dir: str) -> DataFrame:
    return pfp_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return radix_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    rows = sharding.assign(table(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
                       "virtual_slot", "slot_bytes")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    rows = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_preference_format(spark, sf_dir: str) -> DataFrame:
    return preference.format_preferences(*preference.swapped_answers(table(spark, sf_dir, "conversations")))


def op9_lattice_score(spark, sf_dir: str) -> DataFrame:
    return lattice.lattice_scores(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.report(secrets.scan(docs, secrets.train(secrets.samples_of(docs))))


def op11_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "links")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_lists(table(spark, sf_dir, "conversations"))))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = gnat.valid_rows(table(spark, sf_dir, "embeddings"))
    return gnat.hard_negatives(rows, rows.where("id % 50 = 0"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_repeat_removal, op4_mixing, op5_exact_dedup, op6_sharding,
                                   op7_preference_format, op8_simhash, op9_lattice_score, op10_secret_scan, op11_jaccard_join, op12_prefix_trie,
                                   op13_hard_negatives)}

# the others learn a model, hash by a function that SQL lacks, or search all byte strings: tests hold them against plain Python
ORACLES: dict[str, str] = {
    "op2_decontamination": oracles.decontamination(decontam.MASKS, decontam.SPAN),
    "op4_mixing": oracles.MIXING,
    "op5_exact_dedup": oracles.EXACT_DEDUP,
    "op6_sharding": oracles.SHARDING,
    "op7_preference_format": oracles.PREFERENCE,
    "op12_prefix_trie": oracles.PREFIX_TRIE,
    "op13_hard_negatives": oracles.HARD_NEGATIVES,
}
