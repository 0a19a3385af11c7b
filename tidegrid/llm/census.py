"""Questions that chunks of documents ask of the whole corpus, as packed arrays.

Documents are dealt into chunks by a hash of their id. Each chunk sends its distinct 64-bit keys, sorted
and packed, to buckets by key range: one row for each chunk and bucket, so a key that a third of all
documents hold arrives once from each chunk, not once from each document. A bucket answers each chunk for
its keys in their order, and the answers meet the chunk's documents again, which derive the same keys once
more. Chunks and buckets follow the size of the input, so both fit into a task at any size. A row packs a
chunk's keys of one bucket: thousands at tens of gigabytes, a handful at a hundred terabytes, where this sends
about what a row for each key would send, less the repeats within a chunk. Chunks of more megabytes (`mb`), where
executors have the memory, pack more keys into a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

ASKS = "chunk long, bucket long, keys binary, extra binary"
ANSWERS = "chunk long, bucket long, answer binary"


def chunked(docs: DataFrame, mb: float = 2.0) -> tuple[DataFrame, int]:
    """doc_id, text (never null), chunk; and the number of chunks, of about mb stored megabytes."""
    n = parts(docs, mb)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("chunk")), n


def deal(chunk: int, keys: np.ndarray, buckets: int, extra: np.ndarray | None = None) -> pd.DataFrame:
    """Rows of ASKS for sorted keys; extra: a value for each key."""
    edges = np.searchsorted(keys, (np.arange(1, buckets, dtype=np.uint64)) * np.uint64((1 << 64) // buckets))
    cuts = list(zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]))
    full = [(i, a, b) for i, (a, b) in enumerate(cuts) if b > a]
    return pd.DataFrame({"chunk": chunk, "bucket": np.array([i for i, _, _ in full], np.int64), "keys": [keys[a:b].tobytes() for _, a, b in full], "extra": [b"" if extra is None else extra[a:b].tobytes() for _, a, b in full]})


def answer(asks: DataFrame, reply: Callable[[np.ndarray, np.ndarray, list[bytes], np.ndarray], np.ndarray]) -> DataFrame:
    """reply(unique keys, place of each key sent in them, extras, chunk row of each key sent) gives a value for each key sent."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk", ignore_index=True)
        sent = [np.frombuffer(k, np.uint64) for k in frame["keys"]]
        sizes = np.array([len(k) for k in sent])
        unique, place = np.unique(np.concatenate(sent), return_inverse=True)
        out = reply(unique, place, list(frame["extra"]), np.repeat(np.arange(len(sent)), sizes))
        ends = np.cumsum(sizes)
        return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "answer": [out[b - n : b].tobytes() for b, n in zip(ends, sizes)]})

    return asks.groupBy("bucket").applyInPandas(run, ANSWERS)


def joined(frame: pd.DataFrame, dtype: type) -> np.ndarray:
    """A chunk's answers, in the order of its sorted keys."""
    frame = frame.sort_values("bucket")
    return np.frombuffer(b"".join(frame["answer"]), dtype)


def rows_of(frames: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    got = [f for f in frames if len(f)]
    return pd.concat(got, ignore_index=True) if got else pd.DataFrame({c: [] for c in columns})
