"""From raw documents to packed sequences.

Language filter, near-duplicate removal, secret redaction, mixing and packing, each by one operator of
tidegrid.llm over everything that the stage before it kept. All stages but the last return the columns of
documents. Nulls, empty and long texts, repeated rows, empty tables and extra columns are handled as the
operators' docstrings say; a repeated doc_id counts as one document where one of a group stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import jaccard, langid, mixing, packing, secrets
from tidegrid.llm.common import cut, forget, shared_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; those without letters or far from every language go."""
    return langid.keep(docs, langid.fit(docs, F.lit(True)))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with _row: null where there is a doc_id, else a number of the row's own, which stays as it is."""
    unnamed = cut(docs.where("doc_id IS NULL").withColumn("_row", F.monotonically_increasing_id()))
    return docs.where("doc_id IS NOT NULL").withColumn("_row", F.lit(None).cast("long")).unionByName(unnamed)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by five-word shingles at 0.8 or more. Rows without doc_id
    come after all others; rows of one doc_id are judged each by its own text."""
    rows = _numbered(docs).withColumn("_id", F.coalesce("doc_id", F.lit(2**63 - 1) - F.col("_row"))).withColumn("_hash", F.xxhash64("text"))
    linked = jaccard.link(rows.select(F.col("_id").alias("doc_id"), "text"), k=5, percent=80)
    gone = linked.where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return rows.join(gone, ["_id", "_hash"], "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret's characters replaced by a mark."""
    findings, _ = secrets.scan(docs)
    clean = secrets.redact(docs, findings)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 3 times); a row without doc_id is a document of its own."""
    rows = _numbered(docs)
    taken = mixing.mix(rows.withColumn("doc_id", F.struct("doc_id", "_row"))).where("taken > 0")
    times = taken.groupBy(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id._row").alias("_at")).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("_times"))
    out = rows.join(times, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_row").eqNullSafe(F.col("_at"))).withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of at most 4096 ids."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("secret_scan", secret_scan), ("mixing", mix_sources), ("packing", pack)]
#: Packing and mixing choose among equally good answers, and models are learnt: SQL cannot state the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each stage's rows written to the shared folder and read again; a stage's rows are deleted
    once the next one's are there."""
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}", table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if before:
            forget(spark, before)
        before = path
    return docs
