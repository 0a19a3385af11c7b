"""Headers of audio files, listings and matrices in HDF5 (where that library is installed)."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, modificationTime, length of matching files below a folder; contents are pruned."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).drop("content")


def wav_seconds(content: bytes) -> float:
    """Frames over rate from the RIFF header; 0.0 where it cannot be read."""
    try:
        if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
            return 0.0
        at, per_second = 12, 0
        while at + 8 <= len(content):
            kind, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
            if kind == b"fmt ":
                per_second = int.from_bytes(content[at + 16 : at + 20], "little")
            if kind == b"data":
                return size / per_second if per_second else 0.0
            at += 8 + size + (size & 1)
    except IndexError:
        pass
    return 0.0


def durations(spark: SparkSession, folder: str, pattern: str = "*.wav", header: int = 4096) -> DataFrame:
    """path, seconds. Only each file's first bytes reach Python."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "seconds": [wav_seconds(bytes(c)) for c in frame["head"]]})

    return files.select("path", F.substring("content", 1, header).alias("head")).mapInPandas(run, "path string, seconds double")


def matrices(spark: SparkSession, folder: str, pattern: str = "*.hf5", key: str = "data") -> DataFrame:
    """path, j, y (array of floats): the rows of each file's matrix; files without the key give none."""
    import importlib.util

    if importlib.util.find_spec("h5py") is None:
        raise ImportError("reading HDF5 needs h5py; store matrices as Parquet rows (j, y) instead")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import h5py

        for frame in frames:
            for path, content in frame[["path", "content"]].itertuples(index=False):
                with h5py.File(io.BytesIO(bytes(content)), "r") as f:
                    if key in f:
                        for a in range(0, len(f[key]), 256):
                            part = f[key][a : a + 256].astype("float32")
                            yield pd.DataFrame({"path": path, "j": range(a, a + len(part)), "y": list(part)})

    return files.select("path", "content").mapInPandas(run, "path string, j long, y array<float>")


def checked(spark: SparkSession, folder: str, pattern: str = "*") -> tuple[int, list[str]]:
    """How many files match and three names; raises if there is none."""
    files = listed(spark, folder, pattern)
    n = files.count()
    if not n:
        raise FileNotFoundError(f"no file matches {pattern} below {folder}")
    return n, [r["path"].rsplit("/", 1)[-1] for r in files.select("path").orderBy("path").limit(3).collect()]
