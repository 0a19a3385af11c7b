"""What the operators share: table access, the shared folder, sizing and the two word definitions."""

from __future__ import annotations

import gc
import math
import re
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all is one process (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidegrid-"))
    return sc.getCheckpointDir()


def sweep(spark: SparkSession) -> None:
    """Lets the cleaner delete files of shuffles that no table still needs: it learns of them by the driver's collections,
    which may be far apart. py4j tells it of Python's dropped tables from a thread that sleeps a second between turns, so
    a collection sooner than that finds them still held."""
    gc.collect()
    time.sleep(2.5)
    spark._jvm.System.gc()


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder, so that later jobs neither recompute it nor depend on executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate (file sizes for a scan); no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: Estimates beyond this many groups are measured instead: Catalyst multiplies sizes through joins and does not know RDDs'.
DOUBTFUL = 20_000


def parts(df: DataFrame, mb: float, least: int = 8) -> int:
    """How many groups of about mb stored megabytes df (with a column text) makes."""
    size = estimated_bytes(df)
    if size > DOUBTFUL * mb * 1e6:
        row = df.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        size = 16 * row[0] + (row[1] or 0) // 2
    return max(least, math.ceil(size / (mb * 1e6)))


def crc_mod(doc_id: str, m: int):
    """crc32 of the id as text, modulo m; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % m


#: Parts that rows of one key are dealt into where a key may hold a large share of all rows.
SALTS = 24


def salted_join(rows: DataFrame, few: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """rows joined with few (one row for a key) so that no task gets all rows of a frequent key: rows are dealt
    by a hash of `spread` as well, and each row of few goes to every part."""
    parts_ = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(few.withColumn("_salt", parts_), [key, "_salt"], how).drop("_salt")


def running(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name in sums, the sum over all rows before this one in the order of the columns (which tell rows
    apart). Rows are dealt by ranges; only the ranges' totals, as many as there are partitions, meet in one task."""
    dealt = cut(df.repartitionByRange(*order).withColumns({f"_of_{k}": v for k, v in sums.items()}).withColumn("_part", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_of_{k}").alias(k) for k in sums]).withColumn("_one", F.lit(0))
    ahead = totals.select("_part", *[F.coalesce(F.sum(k).over(before(Window.partitionBy("_one").orderBy("_part"))), F.lit(0)).alias(f"_ahead_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order)
    out = dealt.join(ahead, "_part").withColumns({k: F.col(f"_ahead_{k}") + F.coalesce(F.sum(f"_of_{k}").over(before(inside)), F.lit(0)) for k in sums})
    return out.drop("_part", *[f"_of_{k}" for k in sums], *[f"_ahead_{k}" for k in sums])
