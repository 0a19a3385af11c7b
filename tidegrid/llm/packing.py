"""Packing documents into fixed windows by order-preserving dynamic programming.

Within a partition, documents stand in row order as one stream of token ids, each ended by END. Cuts may
fall at document ends (free), at sentence ends (a small penalty) and, inside sentences longer than
LONG ids, anywhere on a grid (a larger one). The programme chooses the cuts that minimise padding plus
penalties: f(e) = penalty(e) + size - p(e) + min(f(s) + p(s)) over cuts s at most `size` ids before e,
the minimum held in a monotone queue, so each cut is looked at once. A window left open at the end of
a block of the stream goes into the next block; a partition leaves at most one short window.

White space always separates this vocabulary's pre-tokens, and marks end a run of letters, so each distinct
blank-separated string, without the marks behind it, is encoded once and reused; ids equal those of encoding
the whole text.

Defined results: null and empty texts are the END id alone; repeated rows are documents of their own;
an empty table gives no piece. Extra columns are ignored. A partition's windows depend on its rows and
their order only; sequence_id is the partition's number * 2^40 + the window's number in it.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import words

SIZE = 4096
END = 2
SENTENCE_PENALTY = 4
WORD_PENALTY = 64
LONG = 256
GRID = 32
#: Ids of a stream that are cut at a time.
BLOCK = 1_000_000
#: Distinct strings whose ids a worker keeps.
CACHE = 1_000_000
#: Words of ASCII letters with such marks behind them: the vocabulary's pre-tokeniser cuts between the two.
TAILED, MARKS, LETTERS = r"^[a-z]+[.,!?;:]+$", ".,!?;:", "abcdefghijklmnopqrstuvwxyz"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Coder:
    """Ids of texts, by ids of their distinct blank-separated strings."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        ends = [self.tokenizer.token_to_id(f"{x}</w>") for x in (".", "!", "?", "...", "!!", "??", '."', '!"', '?"')]
        self.stop = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.stop[[x for x in ends if x is not None]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = [np.zeros(0, np.uint32)]
        self.sizes = [np.zeros(0, np.int64)]

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each unit's place among the batch's distinct ones, and theirs in the cache; new ones are encoded."""
        index, known, coded = self.index, len(self.index), units.dictionary_encode()
        spoken = coded.dictionary.to_pylist()
        local = list(map(index.get, spoken))
        fresh = [i for i, x in enumerate(local) if x is None]
        if fresh:
            new = [spoken[i] for i in fresh]
            index.update(zip(new, range(known, known + len(new))))
            for i, x in zip(fresh, range(known, known + len(new))):
                local[i] = x
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            self.sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            self.flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(self.sizes[-1].sum())))
            self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        return coded.indices.to_numpy().astype(np.int64), np.array(local, np.int64)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text ended by END, and the number of each text."""
        if len(self.index) > CACHE:
            self.clear()
        distinct, code, words_in = words.split(words.as_arrow(texts))
        low = pc.if_else(pc.string_is_ascii(distinct), pc.ascii_lower(distinct), distinct)
        plain = pc.match_substring_regex(low, TAILED)
        stem, stems = self._units(pc.if_else(plain, pc.utf8_rtrim(low, MARKS), low))
        tail, tails = self._units(pc.if_else(plain, pc.utf8_ltrim(low, LETTERS), pa.scalar("", pa.large_string())))
        both = np.stack([stems[stem], tails[tail]], 1).ravel() if len(distinct) else np.zeros(0, np.int64)
        all_size, all_ids = self.sizes[0], self.flat[0]
        all_first = np.cumsum(all_size) - all_size
        n = all_size[both]
        ids = all_ids[np.repeat(all_first[both] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        size = n.reshape(-1, 2).sum(1)
        first = np.cumsum(size) - size
        n = size[code]
        doc = np.repeat(np.arange(len(texts)), words_in)
        per = np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64) + 1
        out = np.full(int(per.sum()), END, np.uint32)
        ends = np.cumsum(per) - 1
        fill = np.ones(len(out), bool)
        fill[ends] = False
        out[fill] = ids[np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return out, per


def cuts(ids: np.ndarray, ends: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut (positions after an id, ascending), and the penalty of each."""
    cost = np.full(len(ids) + 1, -1, np.int32)
    cost[1:][stop[ids]] = SENTENCE_PENALTY
    cost[ends] = 0
    at = np.r_[0, np.flatnonzero(cost[1:] >= 0) + 1, len(ids)]
    for a in np.flatnonzero(np.diff(at) > LONG):
        grid = np.arange(at[a] + GRID, at[a + 1], GRID)
        cost[grid] = WORD_PENALTY
    cost[len(ids)] = max(0, cost[len(ids)])
    at = np.flatnonzero(cost >= 0)
    at = at[at > 0]
    return at, cost[at]


def windows(at: np.ndarray, cost: np.ndarray, size: int = SIZE) -> list[int]:
    """Ends of all windows but the last, open one (which ends at at[-1]) of the cheapest packing."""
    p, pen = [0, *at.tolist()], [0, *cost.tolist()]
    f, back, queue = [0] * len(p), [0] * len(p), deque([(0, 0)])
    for e in range(1, len(p)):
        low = p[e] - size
        while p[queue[0][1]] < low:
            queue.popleft()
        best, s = queue[0]
        f[e] = pen[e] + size - p[e] + best
        back[e] = s
        value = f[e] + p[e]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, e))
    last = len(p) - 1
    low = next(i for i in range(last, -1, -1) if i == 0 or p[i - 1] < p[last] - size)
    s, out = min(range(low, last), key=lambda i: (f[i], -i)), []
    while s:
        out.append(p[s])
        s = back[s]
    return out[::-1]


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """A row for each piece of a document that lies in one window; see PIECES. Without a path, each executor asks
    its own installation for the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of short-lived lists without cycles
        coder, base, made = Coder(path or vocabulary()), TaskContext.get().partitionId() << 40, 0
        ids, doc, pos, total = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        null = np.zeros(0, bool)

        def seal(ends: list[int]) -> pa.RecordBatch:
            """Pieces of the windows that end at `ends`; what follows them stays open."""
            nonlocal ids, doc, pos, total, null, made
            stop = ends[-1]
            first = np.cumsum(left := np.where(total - pos > 0, total - pos, 0)) - left
            edges = np.unique(np.r_[0, ends, first[first < stop]])
            a, b = edges[:-1], edges[1:]
            d = np.searchsorted(first, a, side="right") - 1
            w = np.searchsorted(ends, a, side="right")
            begin = np.r_[0, ends][w]
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())]
            columns = [pa.array(doc[d], mask=null[d]), *map(pa.array, (a - first[d] + pos[d], b - a, np.array(crc, np.int64), total[d], base + made + w, a - begin))]
            out = pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            made += len(ends)
            pos = pos + np.clip(stop - first, 0, left)
            ids, open_ = ids[stop:], pos < total
            doc, pos, total, null = doc[open_], pos[open_], total[open_], null[open_]
            return out

        def cut(final: bool) -> Iterator[pa.RecordBatch]:
            if len(ids):
                ends = windows(*cuts(ids, np.cumsum(total - pos), coder.stop), size)
                if final:
                    ends.append(len(ids))
                if ends:
                    yield seal(ends)

        for batch in batches:
            texts = words.as_arrow(batch.column("text"))
            for a, b in words.blocks(texts, 8 * BLOCK):
                more, per = coder.encode(texts.slice(a, b - a))
                new = batch.column("doc_id").slice(a, b - a).cast(pa.int64())
                ids, pos, total = np.r_[ids, more], np.r_[pos, np.zeros(b - a, np.int64)], np.r_[total, per]
                doc, null = np.r_[doc, pc.fill_null(new, 0).to_numpy(zero_copy_only=False)], np.r_[null, new.is_null().to_numpy(zero_copy_only=False)]
                if len(ids) >= BLOCK:
                    yield from cut(False)
        yield from cut(True)
        coder.clear()
        gc.enable()
        words.release()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
