"""The registered queries of this subpackage: (spark, folder of the tables) -> DataFrame, and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import oracles
from rankloom.llm.edit_counts import edit_counts
from rankloom.llm.language_id import language_id
from rankloom.llm.license_scan import license_scan
from rankloom.llm.manifest import manifest
from rankloom.llm.mixing import mix
from rankloom.llm.near_duplicates import near_duplicates
from rankloom.llm.neighbours import nearest
from rankloom.llm.personal_data import personal_data
from rankloom.llm.pieces import decode_ids, encode
from rankloom.llm.prefix_trie import prefix_trie
from rankloom.llm.secret_scan import secret_scan
from rankloom.llm.substring_dedup import repeated_spans
from rankloom.llm.tables import load
from rankloom.llm.top_k import top_k

#: Where the vocabularies of public tokenizers are.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
BYTE_RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(load(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(load(spark, sf_dir, "documents"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda t, x: t + x["stop"] - x["start"])
    said = F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string")))
    return found.select(
        "doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), size.alias("removed_chars"), F.array_join(said, ",").alias("spans")
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(load(spark, sf_dir, "documents"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts(load(spark, sf_dir, "documents"), BYTE_RANKS)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(load(spark, sf_dir, "documents")).drop("key_a", "key_b")
    return found.withColumn("weight", F.round("weight", 9)).withColumn("probability", F.round("probability", 9))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(load(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text: their number, a digest of the ids and of the text that they decode to."""
    found = decode_ids(encode(load(spark, sf_dir, "documents"), PIECE_MODEL), PIECE_MODEL)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.md5(F.array_join("ids", ",")).alias("ids_md5"),
        F.md5("decoded").alias("decoded_md5"),
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(load(spark, sf_dir, "conversations"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_secret_scan": op2_secret_scan,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_id": op4_language_id,
    "op5_near_vectors": op5_near_vectors,
    "op6_edit_counts": op6_edit_counts,
    "op7_mixing": op7_mixing,
    "op8_license_scan": op8_license_scan,
    "op9_pieces": op9_pieces,
    "op10_near_dedup": op10_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_personal_data": op12_personal_data,
    "op13_manifest": op13_manifest,
}

ORACLES = {
    "op1_exact_top_k": oracles.EXACT_TOP_K,
    "op3_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op8_license_scan": oracles.license_scan_sql(),
    "op10_near_dedup": oracles.NEAR_DEDUP,
    "op11_prefix_trie": oracles.PREFIX_TRIE,
    "op13_manifest": oracles.manifest_sql(),
}
