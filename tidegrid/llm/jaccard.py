"""N-gram Jaccard self-join by adaptive multi-match prefixes, and the components of its links.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets form a class;
the class's smallest doc_id stands for it. Shingles have one global order: those of a part of the hash space,
twice as large as a prefix, by ascending document frequency (exact, from a census over all documents), then
the others by hash.
Two sets of similarity t or more share at least m of the first n - ceil(t n) + m shingles of each. m is
each document's own choice: the prefix is lengthened, and more shared shingles are asked for, while the
estimated cost of its lists and candidates falls. A pair is a candidate when it shares min(m, m').

All candidates are looked at, so no link is lost: pairs of short lists one by one; documents that long lists tie
together as a cluster, in pairs of blocks, where a product of the blocks' incidence matrices gives every
intersection at once. Pairs inside a cluster are never spelled out: a block sends on each document's number of
links and a spanning forest of them. Verification compares whole sets: 100 * intersection >= percent * union.

Defined results: null texts, empty texts and texts without words have no shingle and link with nothing;
fewer words than the shingle length make one shingle of the whole sequence; a doc_id that occurs in several
rows gets a row each, judged by the row's own text; a row without doc_id gets the component and the links of an
equal set, or null and none. Links are counted in documents (rows): equal sets link with each other. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import census, words
from .common import cut, salted_join
from .components import components

#: How many times the longest share of a set that a prefix for one match takes is ordered by document frequency.
RANKED = 2.1
MOST_MATCHES = 4
#: Lists up to this length have their pairs spelled out.
SHORT = 16
#: Members of a cluster's block, and shingles of all its sets, expected at most; two blocks meet in a task.
CLUSTER_BLOCK, CLUSTER_SHINGLES = 2500, 1_500_000
#: Shingles whose columns of two blocks' incidence matrices are multiplied at a time.
COLUMNS = 2048
#: Ids (with a 32-letter signature each, some 30 MB in all) that are broadcast at most.
SENT = 200_000
BLOCK_BYTES = 6_000_000
_M = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray, v: np.ndarray | int) -> np.ndarray:
    x = (h ^ (np.asarray(v, np.uint64) + np.uint64(0x9E3779B97F4A7C15) + (h << np.uint64(6)) + (h >> np.uint64(2)))) * _M
    return (x ^ (x >> np.uint64(32))) * _M


def word_hashes(distinct: pa.Array) -> np.ndarray:
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(distinct) else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of every distinct shingle, sorted by both."""
    distinct, code, per = words.split(pc.ascii_lower(texts))
    h = word_hashes(distinct)[code] if len(code) else np.zeros(0, np.uint64)
    first = np.cumsum(per) - per
    doc = np.repeat(np.arange(len(per)), per)
    left = np.repeat(first + per, per) - np.arange(len(h))
    whole = (left >= k) | ((left == per[doc]) & (left > 0))
    s = np.full(len(h), 77, np.uint64)
    for i in range(k):
        there = left > i
        s[there] = mixed(s[there], h[np.flatnonzero(there) + i])
    doc, s = doc[whole], s[whole]
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])] if len(s) else np.zeros(0, bool)
    return doc[new], s[new]


def _sets(frame: pd.DataFrame, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of a block, and the block's shingle sets with row numbers."""
    texts = words.as_arrow(frame["text"].tolist())
    for a, b in words.blocks(texts, BLOCK_BYTES):
        doc, s = shingle_sets(texts.slice(a, b - a), k)
        yield np.arange(a, b), doc + a, s


def _sums(doc: np.ndarray, s: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = doc - rows[0]
    n = np.bincount(at, minlength=len(rows))
    ends = np.cumsum(n)
    total = lambda v: (lambda c: c[ends] - c[ends - n])(np.r_[np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
    return n, total(mixed(s, 1)), total(mixed(s, 2))


def sized(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n, sig: the set's size and a 128-bit sum over its shingles (null where empty), row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = pd.DataFrame({"text": batch.column("text").to_pylist()})
            ids, hashed = batch.column("doc_id").cast(pa.int64()), batch.column("text_hash")
            for rows, doc, s in _sets(frame, k):
                n, x, y = _sums(doc, s, rows)
                sig = [f"{a:016x}{b:016x}" if c else None for a, b, c in zip(x.tolist(), y.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([ids.slice(int(rows[0]), len(rows)), hashed.slice(int(rows[0]), len(rows)), pa.array(n, pa.int64()), pa.array(sig, pa.string())], ["doc_id", "text_hash", "n", "sig"])
        words.release()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n long, sig string")


def _prefixes(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the shortest prefix that must share one shingle."""
    return n - -(-n * percent // 100) + 1


def choose(doc: np.ndarray, df: np.ndarray, n_docs: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For shingles in prefix order, sorted by doc: which lie in their document's prefix, and each document's m."""
    n = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(n) - n
    lists = np.r_[0.0, np.cumsum(np.maximum(df.astype(float) - 1, 0))]
    base = _prefixes(n, percent)
    best, m = np.full(n_docs, np.inf), np.ones(n_docs, np.int64)
    for i in range(1, MOST_MATCHES + 1):
        length = base + i - 1
        ok = (length <= n) & (n > 0)
        cost = np.where(ok, lists[np.minimum(first + length, len(lists) - 1)] - lists[np.minimum(first, len(lists) - 1)], np.inf)
        cost = cost * (1 + (n / 16) / i / 2 ** (i - 1))
        better = cost < best
        best, m = np.where(better, cost, best), np.where(better, i, m)
    place = np.arange(len(doc)) - first[doc]
    return place < (base + m - 1)[doc], m


def postings(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """token, doc_id, n, m for the prefixes of the documents that stand for a class (classes: doc_id, sig),
    without the shingles known to occur in one document only."""
    dealt, chunks = census.chunked(docs)
    buckets = max(8, chunks // 4)
    share = min(256, int(np.ceil(256 * RANKED * (100 - percent) / 100)))
    ranked = lambda s: (s & np.uint64(255)) < share

    def ask(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        got = [np.unique(s[ranked(s)], return_counts=True) for _, _, s in _sets(frame, k)]
        keys, inverse = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        count = np.bincount(inverse, weights=np.concatenate([g[1] for g in got]), minlength=len(keys)).astype(np.uint32)
        words.release()
        return census.deal(key[0], keys, buckets, count)

    def reply(unique: np.ndarray, place: np.ndarray, extras: list[bytes], _: np.ndarray) -> np.ndarray:
        count = np.bincount(place, weights=np.frombuffer(b"".join(extras), np.uint32), minlength=len(unique))
        return np.minimum(count, 65535).astype(np.uint16)[place]

    answers = census.answer(dealt.groupBy("chunk").applyInPandas(ask, census.ASKS), reply)
    chosen = classes.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"), F.col("doc_id").alias("bucket"), F.encode("sig", "US-ASCII").alias("answer"), F.lit(True).alias("stands"))

    def emit(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        stands = {(d, bytes(s)) for d, s in told.loc[told["stands"], ["bucket", "answer"]].itertuples(index=False)}
        df_all = census.joined(told[~told["stands"]], np.uint16)
        blocks = list(_sets(frame, k))
        keys = np.unique(np.concatenate([np.unique(s[ranked(s)]) for _, _, s in blocks])) if blocks else np.zeros(0, np.uint64)
        ids, out = frame["doc_id"].to_numpy(), []
        for rows, doc, s in blocks:
            n, x, y = _sums(doc, s, rows)
            keep = np.zeros(len(rows), bool)
            for i, (a, b, c) in enumerate(zip(x.tolist(), y.tolist(), n.tolist())):
                if c and (mine := (ids[rows[i]], f"{a:016x}{b:016x}".encode())) in stands:
                    keep[i] = True
                    stands.discard(mine)
            use = keep[doc - rows[0]]
            d, t = doc[use] - rows[0], s[use]
            rank = ranked(t)
            df = np.ones(len(t), np.int64)
            df[rank] = df_all[np.searchsorted(keys, t[rank])]
            order = np.lexsort((t, df, ~rank, d))
            d, t, df, rank = d[order], t[order], df[order], rank[order]
            within, m = choose(d, df, len(rows), percent)
            within &= ~rank | (df > 1)
            d = d[within]
            out.append(pd.DataFrame({"token": t[within].view(np.int64), "doc_id": ids[rows[d]], "n": n[d], "m": m[d]}))
        words.release()
        return census.rows_of(iter(out), ["token", "doc_id", "n", "m"])

    told = answers.withColumn("stands", F.lit(False)).unionByName(chosen)
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(emit, "token long, doc_id long, n long, m long")


def _near_size(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def held_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """doc_id, shingles (packed, sorted) of the wanted class representatives. Their ids are broadcast while
    there are at most SENT of them, so that texts stay where they are; more are joined by shuffling."""
    wanted = cut(wanted.distinct().join(classes.select("doc_id", "sig"), "doc_id"))
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sigs = batch.column("doc_id"), batch.column("sig").to_pylist()
            for rows, doc, s in _sets(pd.DataFrame({"text": batch.column("text").to_pylist()}), k):
                n, x, y = _sums(doc, s, rows)
                ends = np.cumsum(n)
                own = [f"{a:016x}{b:016x}" == sigs[r] for a, b, r in zip(x.tolist(), y.tolist(), rows.tolist())]
                raw = [s[e - c : e].tobytes() for e, c in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([ids.slice(int(rows[0]), len(rows)), pa.array(raw, pa.binary())], ["doc_id", "shingles"]).filter(pa.array(own))

    return docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "sig").mapInArrow(sets, "doc_id long, shingles binary")


def verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of held sets that link."""
    both = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(held.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(test, "a long, b long").distinct()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    same = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return 100 * same >= percent * (len(x) + len(y) - same)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the smallest node each can reach along them."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    sets = left + right
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]  # a shingle of one set alone meets nothing
    row, number = row[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        part = slice(*np.searchsorted(number, [a, a + COLUMNS]))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[part], number[part] - a] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def meet(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of two blocks (or one with itself): rows (doc, null, number of documents linked) and a forest of links (a, b, 0)."""
    frame = frame.drop_duplicates(["doc_id", "block"]).sort_values(["block", "doc_id"], ignore_index=True)
    ids, block, weight = frame["doc_id"].to_numpy(np.int64), frame["block"].to_numpy(), frame["weight"].to_numpy(np.int64)
    sets = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
    n = np.array([len(x) for x in sets], np.int64)
    left = np.flatnonzero(block == block[0])
    alone = block[-1] == block[0]
    right = left if alone else np.flatnonzero(block != block[0])
    same = intersections([sets[i] for i in left], [sets[i] for i in right]).astype(np.int64)
    linked = 100 * same >= percent * (n[left][:, None] + n[right][None] - same)
    if alone:
        np.fill_diagonal(linked, False)
    i, j = np.nonzero(linked)
    count = np.bincount(left[i], weights=weight[right[j]], minlength=len(ids))
    if not alone:
        count += np.bincount(right[j], weights=weight[left[i]], minlength=len(ids))
    some = np.flatnonzero(count)
    nodes, low = forest(ids[left[i]], ids[right[j]])
    nodes, low = nodes[nodes != low], low[nodes != low]
    words.release()
    return pd.DataFrame({"a": np.r_[ids[some], nodes], "b": pd.array([None] * len(some) + low.tolist(), "Int64"), "links": np.r_[count[some].astype(np.int64), np.zeros(len(nodes), np.int64)]})


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, text_hash (xxhash64); one row for each input row."""
    sets = cut(sized(docs, k))
    docs = docs.where("doc_id IS NOT NULL")
    classes = cut(sets.where("sig IS NOT NULL").groupBy("sig", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight")).where("doc_id IS NOT NULL"))
    listed = cut(postings(docs, classes, k, percent))
    lists = listed.groupBy("token").agg(F.count("*").alias("size"), F.min("doc_id").alias("hub")).where("size > 1")
    listed = cut(listed.join(lists, "token"))
    # documents that long lists tie together form a cluster, looked through in pairs of blocks
    tied = components(listed.where((F.col("size") > SHORT) & (F.col("doc_id") != F.col("hub"))).select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct())
    weights = classes.groupBy("doc_id").agg(F.sum("weight").alias("weight"), F.max("n").alias("n"))
    tied = tied.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "cluster").join(weights, "doc_id")
    blocks = F.greatest(F.ceil(F.count("*") / CLUSTER_BLOCK), F.ceil(F.sum("n") / CLUSTER_SHINGLES))
    count = tied.groupBy("cluster").agg(blocks.alias("blocks"))
    members = cut(salted_join(tied, count, "cluster", "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks")))
    # short lists: their pairs are spelled out, and must share as many shingles as both prefixes ask
    short = listed.where(F.col("size") <= SHORT)
    left = short.select("token", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"))
    right = short.select("token", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    pairs = left.join(right, "token").where((F.col("a") < F.col("b")) & _near_size("na", "nb", percent))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.least(F.min("ma"), F.min("mb")).alias("m")).where("shared >= m").select("a", "b")
    of = lambda end: members.select(F.col("doc_id").alias(end), F.col("cluster").alias(f"c{end}"))
    pairs = cut(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("NOT coalesce(ca = cb, false)").select("a", "b"))
    held = cut(held_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(members.select("doc_id")), docs, classes, k))
    found = cut(verified(pairs, held, percent))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = members.join(held, "doc_id").withColumn("other", other).select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc_id", "weight", "shingles")
    met = cut(dealt.groupBy("cluster", "lo", "hi").applyInPandas(lambda frame: meet(frame, percent), "a long, b long, links long"))
    joined = components(found.unionByName(met.where("b IS NOT NULL").select("a", "b")))
    weigh = lambda one, two: found.select(F.col(one).alias("node"), F.col(two).alias("doc_id")).join(weights.select("doc_id", "weight"), "doc_id").select("node", F.col("weight").alias("links"))
    counted = weigh("a", "b").unionByName(weigh("b", "a")).unionByName(met.where("b IS NULL").select(F.col("a").alias("node"), "links")).groupBy("node").agg(F.sum("links").alias("links"))
    reached = classes.withColumnRenamed("doc_id", "node").join(joined, "node", "left").join(counted, "node", "left")
    reached = reached.select("sig", F.coalesce("component", "node").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = salted_join(sets, reached, "sig", "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "text_hash")
