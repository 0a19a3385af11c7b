"""Substring removal by prefix-partitioned suffix trees, in words [^\\x20\\x09-\\x0D]+.

Suffixes go to groups by prefixes of variable length: a prefix that a hash-drawn sample, which grows with the number
of groups, shows to be too frequent for a group is split by its next word, and so on, so groups stay of a size. A
group's suffix tree is held as its sorted suffixes with the lengths of their common prefixes: an internal node is an
interval of suffixes whose neighbours all share its depth. A second tree holds what stands before the suffixes, read
backwards. A window is a repeat where it lies below a node at least as deep as its part of the suffix in the first
tree and one as deep as the rest in the second, together SPAN words; the smallest doc_id below both is the window's
first document. Words are compared by 64-bit SipHash, whole sequences word by word. See repeats for which suffixes
enter and how answers return.

Defined results: null text has no words; a text of fewer than SPAN words loses nothing; copies of a text lose
all of it but for the smallest doc_id; rows with one doc_id never remove each other; a null doc_id comes after
all others. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import words
from .jaccard import mixed, word_hashes
from .repeats import GRAM, SPAN, Partition, Tokens, below, remove, shared_with_last
from .suffix_array import multikey, sample

#: Words that a prefix may have.
DEEPEST = 8


def read(texts: pd.Series) -> Tokens:
    distinct, code, per = words.split(words.as_arrow(texts.tolist()))
    hashes = word_hashes(distinct)
    offsets = np.r_[0, np.cumsum(per)]

    def kept(k: int, gone: np.ndarray) -> bytes:
        return " ".join(distinct.take(code[offsets[k] : offsets[k + 1]][~gone]).to_pylist()).encode("utf-8", "surrogatepass")

    return Tokens(hashes[code] if len(code) else np.zeros(0, np.uint64), offsets, lambda x: x, kept)


def subtree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order, and how many leading words each shares with the one before it."""
    order, _ = multikey(rows)
    return order, shared_with_last(rows, order)


def nodes(shared: np.ndarray) -> list[tuple[int, int, int]]:
    """All internal nodes (depth, first, last) of a subtree: maximal intervals of suffixes with a common prefix of that depth."""
    out, stack = [], [(0, 0)]
    for i, depth in enumerate([*shared[1:].tolist(), -1], start=1):
        left = i - 1
        while stack and stack[-1][0] > depth:
            d, left = stack.pop()
            if d:
                out.append((d, left, i - 1))
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))
    return out


def partition(docs: DataFrame, count: int) -> Partition:
    heads = sample(docs, read, DEEPEST, count)
    heads = np.stack([np.frombuffer(h, np.uint64, DEEPEST) for h in heads if len(h) >= 8 * DEEPEST]) if len(heads) else np.zeros((0, DEEPEST), np.uint64)
    most, split, prefix = max(8, len(heads) // (4 * count)), [], np.full(len(heads), 3, np.uint64)
    for depth in range(DEEPEST - 1):
        prefix = mixed(prefix, heads[: len(prefix), depth]) if len(prefix) else prefix
        value, n = np.unique(prefix, return_counts=True)
        split.append(value[n > most])
        stay = np.isin(prefix, split[-1])
        heads, prefix = heads[: len(stay)][stay], prefix[stay]

    def route(suffixes: np.ndarray) -> np.ndarray:
        prefix = mixed(np.full(len(suffixes), 3, np.uint64), suffixes[:, 0])
        going = np.arange(len(suffixes))
        for depth, values in enumerate(split):
            going = going[np.isin(prefix[going], values)]
            if not len(going):
                break
            prefix[going] = mixed(prefix[going], suffixes[going, depth + 1])
        return (prefix % np.uint64(count)).astype(np.int64)

    return Partition(route, subtree, count)


def finish(t: Tokens, k: int, gone: np.ndarray) -> tuple:
    return len(gone), int(gone.sum()), hashlib.sha256(t.kept(k, gone)).hexdigest()


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; one row for each input row."""
    return remove(docs, read, partition, "n_words long, n_removed long, kept_sha256 string", finish, mb=1.0)


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id and the words that are left, joined by one space."""
    return remove(docs, read, partition, "kept string", lambda t, k, gone: (t.kept(k, gone).decode("utf-8", "surrogatepass"),))


__all__ = ["GRAM", "SPAN", "below", "cleaned", "dedup", "nodes", "partition", "subtree"]
