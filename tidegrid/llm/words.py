"""Words of a batch of texts by Arrow kernels: distinct words once, and a code for each occurrence."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def as_arrow(texts) -> pa.Array:
    """A string array without nulls (null: empty)."""
    arr = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string(), from_pandas=True)
    return pc.fill_null(arr.cast(pa.large_string()), "")


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words [^\\x20\\x09-\\x0D]+ of all texts, each occurrence's code, and each text's number of words."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    per = np.diff(np.r_[0, np.cumsum(real)][offsets]) if len(offsets) > 1 else np.zeros(0, np.int64)
    if not real.all():
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), per.astype(np.int64)


def blocks(texts: pa.Array, most_bytes: int) -> list[tuple[int, int]]:
    """Row ranges of about most_bytes each, one row at least."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // most_bytes
    edges = np.r_[np.flatnonzero(np.r_[True, np.diff(group) > 0]), len(sizes)] if len(sizes) else np.zeros(1, int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def release() -> None:
    """Gives a worker's freed memory back to the machine, which its next group may not need."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
