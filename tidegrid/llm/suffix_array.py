"""Substring removal by a sorted array of suffixes, in bytes.

Suffixes are range-partitioned by their leading bytes with splitters from a hash-drawn sample that grows with the
number of partitions; each partition sorts its own by multikey quicksort on eight-byte digits, looking only at
suffixes still tied, and takes the lengths of common prefixes of neighbours.
Suffixes whose GRAM leading bytes are equal are never parted by a splitter (a tie goes to the right), and the
windows of one anchor are equal only if those bytes are, so no comparison across a boundary is left over.
See repeats for which suffixes are sorted and how answers return.

Defined results: null text counts as empty; a text shorter than SPAN bytes loses nothing; copies of a text
lose all of it but for the smallest doc_id; rows with one doc_id never remove each other; a null doc_id
comes after all others. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .repeats import GRAM, SPAN, Partition, Tokens, anchors, remove, shared_with_last

#: Documents that the splitters are drawn from (expected): so many at least, and so many for each partition; and suffixes of each.
SAMPLE_DOCS, SAMPLE_DOCS_EACH = 2000, 1
SAMPLE_EACH = 32
_TABLE = np.random.default_rng(9).integers(1, 2**63, 256, dtype=np.uint64)


def read(texts: pd.Series) -> Tokens:
    arr, tok, offsets = words.as_arrow(texts.tolist()), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if len(arr):
        _, places, data = arr.buffers()
        offsets = np.frombuffer(places, np.int64)[arr.offset : arr.offset + len(arr) + 1]
        if offsets[-1] > offsets[0]:
            tok = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
    return Tokens(tok, offsets, _TABLE.__getitem__, lambda k, gone: tok[offsets[k] : offsets[k + 1]][~gone].tobytes())


def multikey(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and where a row differs from the one before it in that order."""
    order = np.argsort(digits[:, 0], kind="stable")
    first = digits[order, 0]
    new = np.r_[True, first[1:] != first[:-1]]
    for column in range(1, digits.shape[1]):
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(tied):
            break
        rows = order[tied]
        order[tied] = rows[np.lexsort((digits[rows, column], group[tied]))]
        value, own = digits[order[tied], column], group[tied]
        new[tied[1:]] |= (own[1:] == own[:-1]) & (value[1:] != value[:-1])
    return order, new


def sorted_suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and how many leading bytes each shares with the one before it."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    order, _ = multikey(wide.view(">u8").astype(np.uint64))
    return order, shared_with_last(rows, order)


def sample(docs: DataFrame, reader, width: int, count: int) -> np.ndarray:
    """Leading tokens of some anchors' suffixes: an expected number for each of `count` partitions."""
    chance = min(1.0, max(SAMPLE_DOCS, SAMPLE_DOCS_EACH * count) / max(1, docs.count()))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(chance * (1 << 30))).select(F.coalesce("text", F.lit("")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 64):
                t = reader(frame["text"].iloc[i : i + 64])
                _, _, a, key = anchors(t)
                doc = np.searchsorted(t.offsets, a, side="right") - 1
                order = np.lexsort((key, doc))
                own = doc[order]
                place = np.arange(len(own)) - np.searchsorted(own, own)
                at = a[order][place < SAMPLE_EACH]
                yield pd.DataFrame({"head": [t.tok[x : x + width].tobytes() for x in at.tolist()]})

    got = drawn.mapInPandas(run, "head binary").toPandas()["head"]
    return np.array([bytes(x) for x in got], dtype=object)


def partition(docs: DataFrame, count: int) -> Partition:
    heads = np.sort(sample(docs, read, GRAM, count).astype(f"S{GRAM}")) if count > 1 else np.zeros(0, f"S{GRAM}")
    splitters = np.unique(heads[np.arange(1, count) * len(heads) // count]) if len(heads) else heads

    def route(suffixes: np.ndarray) -> np.ndarray:
        lead = np.ascontiguousarray(suffixes[:, :GRAM]).view(f"S{GRAM}").ravel()
        return np.searchsorted(splitters, lead, side="right") if len(splitters) else np.zeros(len(lead), np.int64)

    return Partition(route, sorted_suffixes, len(splitters) + 1)


def finish(t: Tokens, k: int, gone: np.ndarray) -> tuple:
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return len(gone), int(gone.sum()), spans, hashlib.sha256(t.kept(k, gone)).hexdigest()


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row for each input row."""
    return remove(docs, read, partition, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", finish, mb=1.0)


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id and the text that is left (bytes: a removed run may cut a character)."""
    return remove(docs, read, partition, "kept binary", lambda t, k, gone: (t.kept(k, gone),))


__all__ = ["SPAN", "cleaned", "dedup", "multikey", "partition", "sample", "sorted_suffixes"]
