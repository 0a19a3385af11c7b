"""The dealt queries opN_<name> and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jaccard, langid, lmscore, mixing, neardup, packing, secrets, suffix_array, suffix_tree, winnow
from .common import crc_mod, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    model = langid.fit(docs, ~held)
    out = langid.predict(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan from an empty ledger; scan() gives back the ledger that a later scan goes on from."""
    findings, _ = secrets.scan(table(spark, sf_dir, "documents"))
    return secrets.digest(findings)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id", "n_links")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "embeddings"), limit=0.98)


def op2_substring_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.dedup(table(spark, sf_dir, "documents"))


def op9_substring_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup(table(spark, sf_dir, "documents"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_substring_words": op2_substring_words,
    "op3_secret_scan": op3_secret_scan,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_lm_score": op7_lm_score,
    "op8_winnowing": op8_winnowing,
    "op9_substring_bytes": op9_substring_bytes,
    "op10_vector_neardup": op10_vector_neardup,
}
ORACLES = {"op3_secret_scan": secrets.oracle()}
