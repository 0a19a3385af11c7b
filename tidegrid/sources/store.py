"""Sinks, tables, the run log and resuming."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.joins import latest, not_done

RUN_LOG = "script_name string, subject_id string, execution_time_seconds double, timestamp string"


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    df.write.mode({"replace": "overwrite", "fail": "errorifexists"}.get(mode, mode)).saveAsTable(name)


def load_table(spark: SparkSession, name: str) -> DataFrame | None:
    return spark.table(name) if spark.catalog.tableExists(name) else None


def query(spark: SparkSession, sql: str, args: dict | list | None = None) -> DataFrame:
    return spark.sql(sql, args=args)


def save_parts(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by partition; only the partitions present are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def pending(work: DataFrame, done: DataFrame, key: str, part: str, needed: int) -> DataFrame:
    return not_done(work, done, key, part, needed)


def logged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The run log with new rows taking the place of older ones of the same script and subject."""
    return latest(old.unionByName(new), ["script_name", "subject_id"], [F.desc("timestamp"), F.desc("execution_time_seconds")])


def log_row(spark: SparkSession, script: str, seconds: float, subject: str = "GLOBAL") -> DataFrame:
    return spark.createDataFrame([(script, subject, float(seconds), None)], RUN_LOG).withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))


def save_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def save_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def save_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).coalesce(1).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def export_story(spaces: dict[str, DataFrame], story: str) -> None:
    """One story's spaces as tables story_space, for presentation."""
    for name, df in spaces.items():
        save_table(df.where(F.col("story") == story), f"{story}_{name}")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir); without it, in one process only, a
    temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="tidegrid-")
    return f"{base}/tidegrid-{uuid.uuid4()}"


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: lineage ends here, whichever executors are lost."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def swept(spark: SparkSession) -> None:
    """Lets the driver drop what nobody refers to: files of finished shuffles go when it has run."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def timed(spark: SparkSession, script: str, log: str, subject: str = "GLOBAL") -> Iterator[None]:
    """Runs its block and puts the seconds it took into the run-log table, in place of the last run's."""
    began = time.perf_counter()
    yield
    new = log_row(spark, script, time.perf_counter() - began, subject)
    old = load_table(spark, log)
    save_table(new if old is None else settled(logged(old, new)), log)


def save_model(folder: str, vocab: DataFrame, axis: DataFrame, report: DataFrame) -> None:
    """A latent-semantic model as three tables: term, df, idf; term, axis; and the report's one row."""
    for name, df in (("vocabulary", vocab), ("axes", axis), ("report", report)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in ("vocabulary", "axes", "report"))
