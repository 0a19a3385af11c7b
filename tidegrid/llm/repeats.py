"""The common ground of the two substring removers: which windows of SPAN tokens start in an earlier document.

A token is a byte or a word. Every window has an anchor, the GRAM tokens in it whose hash is smallest
(leftmost if tied); equal windows have equal anchors at equal places, and neighbouring windows mostly share
one, so about one suffix in fourteen, the one at each anchor, stands for all suffixes.
1. A census of anchor hashes drops anchors that occur in one document only; a collision merely keeps one.
2. What is left is sent as real tokens: the suffix from the anchor (up to SPAN tokens, behind it what lies
   before the anchor in its windows). Each chunk of documents sends a distinct one once, with the smallest
   doc_id it has there, to the partition that the suffix's leading tokens name.
3. A partition sorts its suffixes, and what stands before them read backwards, each once, with the lengths of
   their common prefixes. A window that begins f tokens before its anchor occurs again where the suffix shares
   SPAN - f tokens forwards and f backwards: below one node of that depth in each of the two trees. The smallest
   doc_id there is the window's.
4. Each chunk takes its answers and removes the windows that a smaller doc_id has.
Rows with a text that an earlier doc_id has whole are left out of this: all their windows go.

`Partition` is what the two operators differ in: where suffixes go, and how equal windows are found there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import census
from .common import salted_join
from .words import release

SPAN = 50
GRAM = 24
#: Places of GRAM in SPAN.
PLACES = SPAN - GRAM + 1
#: Tokens hashed at a time; positions must fit into the low bits of a hash.
BLOCK_BITS = 18
_LAST = np.iinfo(np.int64).max
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


@dataclass
class Tokens:
    """A chunk's tokens one after the other, the places where documents begin (and the end), and their hashes."""

    tok: np.ndarray
    offsets: np.ndarray
    hashed: Callable[[np.ndarray], np.ndarray]
    kept: Callable[[int, np.ndarray], bytes]  # a document's text without its removed tokens


@dataclass
class Partition:
    route: Callable[[np.ndarray], np.ndarray]  # suffixes (rows of SPAN tokens) -> partition
    tree: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]  # rows of tokens -> their order, and the tokens each shares with the one before
    count: int


def shared_with_last(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading tokens each row in order shares with the one before it; 0 for the first."""
    if len(order) < 2:
        return np.zeros(len(order), np.int64)
    same = rows[order[1:]] == rows[order[:-1]]
    return np.r_[0, np.where(same.all(1), rows.shape[1], same.argmin(1))].astype(np.int64)


def below(tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """For each row, the number of the highest node of that depth or more above it (or of its own leaf)."""
    order, shared = tree
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.r_[True, shared[1:] < depth])[: len(order)] - 1
    return out


def _grams(h: np.ndarray) -> np.ndarray:
    """Hash of the GRAM = 16 + 8 tokens from each place on, by doubling."""
    size, kept = 1, {}
    for i in range(4):
        h = h[:-size] * _C[i] + (h[size:] ^ (h[size:] >> np.uint64(31)))
        size *= 2
        kept[size] = h
    a, b = kept[16], kept[8]
    g = a[: len(b) - 16] * _C[4] + (b[16:] ^ (b[16:] >> np.uint64(29)))
    g = (g ^ (g >> np.uint64(32))) * _C[5]
    return g ^ (g >> np.uint64(29))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if width > size else v


def _blocks(offsets: np.ndarray) -> list[np.ndarray]:
    """Boundaries of blocks: documents together, or a long document's parts with SPAN - 1 tokens in common."""
    most, out, held = 1 << BLOCK_BITS, [], [int(offsets[0])]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - held[0] > most and len(held) > 1:
            out.append(np.array(held))
            held = [a]
        while b - a > most:
            out.append(np.array([a, a + most]))
            a += most - SPAN + 1
            held = [a]
        held.append(b)
    if len(held) > 1:
        out.append(np.array(held))
    return out


def anchors(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one anchor: first and last window start, the anchor, and its hash."""
    found = []
    for edges in _blocks(t.offsets):
        base, n = int(edges[0]), int(edges[-1] - edges[0])
        if n < SPAN:
            continue
        g = _grams(t.hashed(t.tok[base : base + n]))
        low = np.uint64((1 << BLOCK_BITS) - 1)
        least = _least((g & ~low) | np.arange(len(g), dtype=np.uint64), PLACES)
        end = np.repeat(edges[1:], np.diff(edges))[: len(least)] - base
        p = np.flatnonzero(np.arange(SPAN, SPAN + len(least)) <= end)
        if not len(p):
            continue
        at = (least[p] & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(p)] - 1
        a = at[first]
        found.append((p[first] + base, p[last] + base, a + base, g[a] * _C[0] ^ (g[a] >> np.uint64(17))))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    lo, hi, a, key = (np.concatenate(x) for x in zip(*found))
    return lo, hi, a, key


def _census(ids: np.ndarray, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, whether each occurs in several documents here, and the place of each anchor's key."""
    keys, place = np.unique(key, return_inverse=True)
    lo, hi = np.full(len(keys), len(ids)), np.full(len(keys), -1)
    np.minimum.at(lo, place, doc)
    np.maximum.at(hi, place, doc)
    return keys, lo != hi, place


def _suffixes(t: Tokens, lo: np.ndarray, hi: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Rows of SPAN tokens from the anchor on, then PLACES - 1 before it, then the two counts that tell where
    the windows lie; tokens outside the run's windows are 0."""
    before = PLACES - 1
    padded = np.concatenate([np.zeros(before, t.tok.dtype), t.tok, np.zeros(SPAN, t.tok.dtype)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, before + SPAN)[a]
    out = np.empty((len(a), SPAN + before + 2), t.tok.dtype)
    out[:, :SPAN], out[:, SPAN:-2] = rows[:, before:], rows[:, :before]
    off, n = a - lo, hi - lo + 1
    out[:, :SPAN][np.arange(SPAN)[None] >= (hi + SPAN - a)[:, None]] = 0
    out[:, SPAN:-2][np.arange(before)[None] < (before - off)[:, None]] = 0
    out[:, -2], out[:, -1] = off, n
    return out


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first of each distinct row, and each row's number among them."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * rows.dtype.itemsize))).ravel()
    _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
    return first, inverse


def _settle(rows: np.ndarray, doc: np.ndarray, tree: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For each row its number of answers and all answers: the smallest doc of each of its windows, or one if all agree."""
    order, shared = tree(rows)
    heads = np.flatnonzero(np.r_[True, shared[1:] < rows.shape[1]])
    cls = below((order, shared), rows.shape[1])
    least = np.full(len(heads), _LAST)
    np.minimum.at(least, cls, doc)
    # distinct rows, numbered in order; the suffix comes first in a row, so this is the suffixes' order too
    kinds, ahead = rows[order[heads]], (np.arange(len(heads)), shared[heads])
    gram = below(ahead, GRAM)
    many = np.flatnonzero(np.bincount(gram)[gram] > 1)
    size = np.ones(len(heads), np.int64)
    answer = {}
    if len(many):
        off, n = kinds[many, -2].astype(np.int64), kinds[many, -1].astype(np.int64)
        behind = tree(np.ascontiguousarray(kinds[many, SPAN:-2][:, ::-1]))
        begin = np.cumsum(n) - n
        got = np.empty(int(n.sum()), np.int64)
        # equal windows lie equally far before their anchors, so each distance is a question of its own
        for far in range(PLACES):
            own = np.flatnonzero((far <= off) & (far > off - n))
            if not len(own):
                continue
            node = below(ahead, SPAN - far)[many][own] * len(many) + below(behind, far)[own]
            _, place = np.unique(node, return_inverse=True)
            w_least = np.full(int(place.max()) + 1, _LAST)
            np.minimum.at(w_least, place, least[many][own])
            got[begin[own] + off[own] - far] = w_least[place]
        flat = np.minimum.reduceat(got, begin) == np.maximum.reduceat(got, begin)
        size[many] = np.where(flat, 1, n)
        answer = {int(m): got[b : b + (1 if f else k)] for m, b, k, f in zip(many, begin, n, flat)}
    begin = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.int64)
    out[begin] = least
    for m, got in answer.items():
        out[begin[m] : begin[m] + len(got)] = got
    n = size[cls]
    return n, out[np.repeat(begin[cls] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def remove(docs: DataFrame, read: Callable[[pd.Series], Tokens], partition: Callable[[DataFrame, int], Partition], schema: str, finish: Callable[[Tokens, int, np.ndarray], tuple], mb: float = 2.0) -> DataFrame:
    """doc_id and what finish gives for each document from its removed tokens (a mask), as schema says."""
    dealt, chunks = census.chunked(docs, mb)
    dealt = dealt.repartition(chunks, "chunk")
    buckets = max(8, chunks // 2)
    part = partition(docs, max(8, chunks))
    hashed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).where(F.col("size") >= SPAN)
    # rows without doc_id are copies of a text that some doc_id has, never of each other
    first = hashed.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("sha", "first")
    copies = salted_join(hashed, first, "sha", "doc_id").where("doc_id > first OR doc_id IS NULL").select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"), F.lit(0).cast("long").alias("kind"), F.col("doc_id").alias("bucket"), F.unhex("sha").alias("answer"))

    def begin(frame: pd.DataFrame, told: pd.DataFrame) -> tuple:
        """Rows in a fixed order, which of them are copies, ids, tokens of the rest and their anchors."""
        frame = frame.assign(_null=frame["doc_id"].isna()).sort_values(["_null", "doc_id", "text"], ignore_index=True)
        known = {(None if pd.isna(d) else int(d), bytes(s)) for d, s in told.loc[told["kind"] == 0, ["bucket", "answer"]].itertuples(index=False)}
        names = {d for d, _ in known}
        ids = np.array([_LAST if x else int(d) for d, x in zip(frame["doc_id"].tolist(), frame["_null"].tolist())], np.int64)
        keys = [None if x else int(d) for d, x in zip(frame["doc_id"].tolist(), frame["_null"].tolist())]
        copy = np.array([k in names and (k, hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()) in known for k, t in zip(keys, frame["text"])], bool)
        t = read(frame.loc[~copy, "text"])
        lo, hi, a, key = anchors(t)
        doc = np.searchsorted(t.offsets, lo, side="right") - 1
        # empty documents share an offset; the last of equal offsets is the one that has tokens
        return frame, copy, ids[~copy], t, lo, hi, a, key, doc

    def ask(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"chunk": [], "bucket": [], "keys": [], "extra": []})
        _, _, ids, _, _, _, _, hashes, doc = begin(frame, told)
        keys, several, _ = _census(ids, doc, hashes)
        release()
        return census.deal(int(frame["chunk"].iloc[0]), keys, buckets, several.astype(np.uint8))

    def reply(unique: np.ndarray, place: np.ndarray, extras: list[bytes], _: np.ndarray) -> np.ndarray:
        several = np.frombuffer(b"".join(extras), np.uint8)
        count = np.bincount(place, weights=1 + several, minlength=len(unique))
        return (count > 1).astype(np.uint8)[place]

    def pick(told: pd.DataFrame, ids: np.ndarray, t: Tokens, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> tuple:
        """Anchors kept by the census, their distinct suffixes in sending order, partitions and each anchor's suffix."""
        _, _, place = _census(ids, doc, hashes)
        use = np.flatnonzero(census.joined(told[told["kind"] == 1], np.uint8)[place]) if len(place) else np.zeros(0, np.int64)
        rows = _suffixes(t, lo[use], hi[use], a[use])
        first, inverse = distinct_rows(rows)
        kinds = rows[first]
        to = part.route(kinds[:, :SPAN]) if len(kinds) else np.zeros(0, np.int64)
        order = np.argsort(to, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return use, kinds[order], to[order], rank[inverse]

    def send(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"chunk": [], "bucket": [], "keys": [], "extra": []})
        _, _, ids, t, lo, hi, a, hashes, doc = begin(frame, told)
        use, kinds, to, rank = pick(told, ids, t, lo, hi, a, hashes, doc)
        least = np.full(len(kinds), _LAST)
        np.minimum.at(least, rank, ids[doc[use]])
        release()
        heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, int)
        ends = np.r_[heads[1:], len(to)] if len(to) else heads
        return pd.DataFrame({"chunk": int(frame["chunk"].iloc[0]), "bucket": to[heads], "keys": [kinds[x:y].tobytes() for x, y in zip(heads, ends)], "extra": [least[x:y].tobytes() for x, y in zip(heads, ends)]})

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk", ignore_index=True)
        doc = [np.frombuffer(x, np.int64) for x in frame["extra"]]
        width = SPAN + PLACES + 1
        kind = np.uint8 if len(frame["keys"].iloc[0]) == len(doc[0]) * width else np.uint64
        rows = np.concatenate([np.frombuffer(x, kind).reshape(-1, width) for x in frame["keys"]])
        n, values = _settle(rows, np.concatenate(doc), part.tree)
        row_end = np.cumsum([len(d) for d in doc])
        value_end = np.r_[0, np.cumsum(n)][row_end]
        row_at, value_at = np.r_[0, row_end[:-1]], np.r_[0, value_end[:-1]]
        out = [n[x:y].astype(np.uint8).tobytes() + values[v:w].tobytes() for x, y, v, w in zip(row_at, row_end, value_at, value_end)]
        return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "answer": out})

    def end(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        if not len(frame):
            return pd.DataFrame({c: [] for c in ["doc_id", *names]})
        frame, copy, ids, t, lo, hi, a, hashes, doc = begin(frame, told)
        use, kinds, to, rank = pick(told, ids, t, lo, hi, a, hashes, doc)
        counts, values = [], []
        sent = np.bincount(to, minlength=0) if len(to) else np.zeros(0, int)
        for b, raw in told.loc[told["kind"] == 2, ["bucket", "answer"]].sort_values("bucket").itertuples(index=False):
            m = int(sent[int(b)])
            counts.append(np.frombuffer(raw, np.uint8, m).astype(np.int64))
            values.append(np.frombuffer(raw, np.int64, offset=m))
        gone = np.zeros(len(t.tok), bool)
        if counts:
            counts, values = np.concatenate(counts), np.concatenate(values)
            begin_at = np.cumsum(counts) - counts
            n = hi[use] - lo[use] + 1
            own = np.repeat(np.arange(len(use)), n)
            step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            r = rank[own]
            earlier = values[begin_at[r] + np.where(counts[r] > 1, step, 0)] < ids[doc[use]][own]
            at = (lo[use][own] + step)[earlier]
            change = np.bincount(at, minlength=len(t.tok) + 1)[: len(t.tok) + 1] - np.bincount(at + SPAN, minlength=len(t.tok) + 1)[: len(t.tok) + 1]
            gone = np.cumsum(change)[:-1] > 0
        out, k = [], 0
        whole = read(frame.loc[copy, "text"])
        j = 0
        for i, c in enumerate(copy.tolist()):
            if c:
                size = int(whole.offsets[j + 1] - whole.offsets[j])
                out.append(finish(whole, j, np.full(size, size >= SPAN)))
                j += 1
            else:
                out.append(finish(t, k, gone[t.offsets[k] : t.offsets[k + 1]]))
                k += 1
        release()
        made = pd.DataFrame(out, columns=names)
        made.insert(0, "doc_id", frame["doc_id"].astype("Int64"))
        return made

    by = lambda told: dealt.groupBy("chunk").cogroup(told.groupBy("chunk"))
    named = lambda df, kind: df.select("chunk", F.lit(kind).cast("long").alias("kind"), "bucket", "answer")
    flags = named(census.answer(by(copies).applyInPandas(ask, census.ASKS), reply), 1)
    once = copies.unionByName(flags)
    asks = by(once).applyInPandas(send, census.ASKS)
    settled = named(asks.groupBy("bucket").applyInPandas(settle, census.ANSWERS), 2)
    return by(once.unionByName(settled)).applyInPandas(end, f"doc_id long, {schema}")
