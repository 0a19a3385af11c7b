"""Near-duplicate vectors by hierarchical navigable small-world graphs, one graph per shard.

Only vectors of one label are compared. Equal vectors form a class, and classes are dealt into shards of
about SHARD by a hash; each shard gets its own layered graph, written once. Every class then queries every
shard of its label, in blocks of about BLOCK queries that meet one graph at a time. A query walks down the
layers, holds a beam on the lowest one and, from what it finds, spreads to all nodes near the limit. A
block's audit compares a hash-drawn part of its queries with the whole shard, and more of them until it has
seen TRUE_LINKS true links or all queries; while fewer than RECALL of the true links are found, beams double, at
last to the whole shard. Links are verified by cosine in double precision, after scaling each vector by a power
of two. A block sends on, for each query, its number of links and a spanning forest of what they join, so pairs
inside a group of copies are never spelled out.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors
without a label, link with nothing; vectors of different lengths are not compared; equal vectors link with
each other; repeated rows count as vectors of their own; a row without vec_id links as any other, its component
is the smallest vec_id it reaches, null if there is none (it is then kept); a label may have any type that has a
text form; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join
from .components import components
from .jaccard import forest

SHARD = 8192
BLOCK = 4096
LINKS = 16
BEAM = 48
RECALL = 0.99
#: Queries audited at first, and true links that an audit wants to see.
AUDIT = 192
TRUE_LINKS = 100
#: Spreading goes on through nodes this far below the limit.
SLOPE = 0.04
STEP = 256
GRAPH = "label string, dim int, shard long, ids binary, weights binary, vectors binary, levels binary, edges binary"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    """Layer 0 has 2 * LINKS neighbours a node, those above LINKS; -1 pads."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, edges: list[np.ndarray] | None = None):
        self.x, self.levels = x, levels
        self.top = int(np.argmax(levels)) if len(levels) else 0
        if edges is None:
            self.edges = [np.full((len(x), 2 * LINKS if i == 0 else LINKS), -1, np.int32) for i in range(int(levels.max(initial=0)) + 1)]
            self._build()
        else:
            self.edges = edges

    @staticmethod
    def levels_of(ids: np.ndarray) -> np.ndarray:
        h = pd.util.hash_array(ids.astype(np.int64))
        return np.minimum(-np.log((h >> np.uint64(11)).astype(float) / 2**53 + 1e-16) / np.log(LINKS), 8).astype(np.int8)

    def beam(self, q: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `width` nodes found for each query (-1 pads) and their similarities, best first."""
        edges, n = self.edges[layer], len(q)
        row = np.arange(n)
        seen = np.zeros((n, len(self.x) + 1), bool)
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -np.inf)
        done = np.ones((n, width), bool)
        start = start[:, :width]
        k = start.shape[1]
        ids[:, :k] = start
        sims[:, :k] = np.where(start >= 0, np.einsum("ijk,ik->ij", self.x[start], q), -np.inf)
        done[:, :k] = start < 0
        seen[row[:, None], start] = True
        active = row
        while len(active):
            open_ = np.where(done[active], -np.inf, sims[active])
            best = open_.argmax(1)
            going = open_[np.arange(len(active)), best] > -np.inf
            active, best = active[going], best[going]
            if not len(active):
                break
            done[active, best] = True
            near = edges[ids[active, best]].astype(np.int64)
            near[seen[active[:, None], near]] = -1
            seen[active[:, None], near] = True
            s = np.where(near >= 0, np.einsum("ijk,ik->ij", self.x[near], q[active]), -np.inf)
            all_i, all_s = np.concatenate([ids[active], near], 1), np.concatenate([sims[active], s], 1)
            all_d = np.concatenate([done[active], near < 0], 1)
            keep = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            at = np.arange(len(active))[:, None]
            ids[active], sims[active], done[active] = all_i[at, keep], all_s[at, keep], all_d[at, keep]
        order = np.argsort(-sims, axis=1, kind="stable")
        return ids[row[:, None], order], sims[row[:, None], order]

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        at = np.full((len(q), 1), self.top, np.int64)
        for layer in range(len(self.edges) - 1, to, -1):
            at = self.beam(q, at, layer, 4)[0][:, :1]
        return at

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates (best first), those nearer to the node than to any chosen one; then the best of the rest."""
        n, k = ids.shape
        v = self.x[ids]
        among = np.einsum("ijk,ilk->ijl", v, v)
        picked = np.zeros((n, k), bool)
        closest = np.full((n, k), -np.inf)
        count = np.zeros(n, int)
        for j in range(k):
            take = (ids[:, j] >= 0) & (sims[:, j] > closest[:, j]) & (count < most)
            picked[:, j] = take
            count += take
            closest = np.where(take[:, None], np.maximum(closest, among[:, j]), closest)
        rank = np.where(picked, 0, 1) * k + np.arange(k) + np.where(ids < 0, 4 * k, 0)
        order = np.argsort(rank, axis=1)[:, :most]
        return np.take_along_axis(ids, order, 1)

    def _join(self, layer: int, new: np.ndarray, chosen: np.ndarray) -> None:
        edges = self.edges[layer]
        most = edges.shape[1]
        edges[new, : chosen.shape[1]] = chosen
        src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        heads = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, int)
        for a, b in zip(heads, np.r_[heads[1:], len(dst)]):
            node = dst[a]
            held = edges[node][edges[node] >= 0]
            every = np.unique(np.concatenate([held, src[a:b]]))
            every = every[every != node]
            if len(every) > most:
                s = self.x[every] @ self.x[node]
                order = np.argsort(-s, kind="stable")
                every = self._choose(every[order][None], s[order][None], most)[0]
                every = every[every >= 0]
            edges[node] = -1
            edges[node, : len(every)] = every

    def _build(self) -> None:
        order = np.argsort(-self.levels, kind="stable")  # high nodes first: the entry stands from the start
        at = 1
        while at < len(order):
            new = order[at : at + min(max(1, at), STEP)]
            for layer in range(int(self.levels[new].max()), -1, -1):
                own = new[self.levels[new] >= layer]
                ids, sims = self.beam(self.x[own], self.descend(self.x[own], layer), layer, BEAM)
                # nodes of one batch see each other too, so copies that come together link
                mates = self.x[own] @ self.x[own].T
                np.fill_diagonal(mates, -np.inf)
                k = min(len(own), LINKS)
                best = np.argpartition(-mates, k - 1, axis=1)[:, :k]
                s = np.take_along_axis(mates, best, 1)
                ids = np.concatenate([ids, np.where(s > -np.inf, own[best], -1)], 1)
                sims = np.concatenate([sims, s], 1)
                o = np.argsort(-sims, axis=1, kind="stable")
                self._join(layer, own, self._choose(np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1), LINKS))
            at += len(new)

    def within(self, q: np.ndarray, limit: float, width: int) -> list[np.ndarray]:
        """For each query, the nodes found with similarity of limit or more."""
        out = []
        for a in range(0, len(q), STEP):
            part = q[a : a + STEP]
            ids, sims = self.beam(part, self.descend(part, 0), 0, min(width, max(1, len(self.x))))
            for i, v in enumerate(part):
                front = ids[i][(sims[i] >= limit - SLOPE) & (ids[i] >= 0)]
                if not len(front):
                    out.append(front)
                    continue
                known = np.zeros(len(self.x), bool)
                known[ids[i][ids[i] >= 0]] = True
                found = [front[self.x[front] @ v >= limit]]
                while len(front):
                    near = self.edges[0][front].ravel()
                    near = np.unique(near[near >= 0])
                    near = near[~known[near]]
                    known[near] = True
                    s = self.x[near] @ v
                    front = near[s >= limit - SLOPE]
                    found.append(near[s >= limit])
                out.append(np.concatenate(found))
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    """The vectors in double precision, each scaled by a power of two so that no square overflows or vanishes."""
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("node", ignore_index=True)
    x, ids = _matrix(frame["embedding"]), frame["node"].to_numpy(np.int64)
    graph = Graph(_unit(x), Graph.levels_of(ids))
    return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "ids": [ids.tobytes()], "weights": [frame["weight"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "levels": [graph.levels.tobytes()], "edges": [b"".join(e.tobytes() for e in graph.edges)]})


def _load(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    ids, weights, levels = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("weights", np.int64), ("levels", np.int8)))
    x = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
    flat, edges, at = np.frombuffer(row["edges"], np.int32), [], 0
    for layer in range(int(levels.max(initial=0)) + 1):
        m = 2 * LINKS if layer == 0 else LINKS
        edges.append(flat[at : at + len(ids) * m].reshape(len(ids), m))
        at += len(ids) * m
    return ids, weights, x, Graph(_unit(x), levels, edges)


def search(graph: Graph, q: np.ndarray, ids: np.ndarray, limit: float) -> list[np.ndarray]:
    """Nodes linked with each query; beams widen until the audit of hash-drawn queries passes."""
    order, drawn = np.argsort(pd.util.hash_array(ids), kind="stable"), AUDIT
    truth = q[order[:drawn]] @ graph.x.T >= limit
    while truth.sum() < TRUE_LINKS and drawn < len(q):
        truth = np.concatenate([truth, q[order[drawn : 2 * drawn]] @ graph.x.T >= limit])
        drawn *= 2
    width = BEAM
    while True:
        found = graph.within(q, limit - 1e-12, width)
        hit = sum(int(truth[i, found[d]].sum()) for i, d in enumerate(order[:drawn]))
        if hit >= RECALL * truth.sum() or width >= len(graph.x):
            return found
        width = min(2 * width, len(graph.x))


def link(vectors: DataFrame, limit: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row for each input row."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    fine = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & some, F.lit(False))
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding", fine.alias("fine"))
    classes = rows.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    # a class that only rows without vec_id hold gets a number far below any id
    classes = cut(classes.withColumn("node", F.coalesce("rep", F.lit(-(2**63)) + F.monotonically_increasing_id())).withColumn("dim", F.size("embedding")))
    count = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.ceil(F.col("n") / SHARD).alias("shards"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    dealt = classes.join(count, ["label", "dim"])
    key = ["label", "dim", "shard"]
    graphs = cut(dealt.withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards"))).groupBy(*key).applyInPandas(_build, GRAPH))
    asked = graphs.join(count.select("label", "dim", "blocks"), ["label", "dim"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    asks = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).select(*key, "block", "node", "embedding")

    def run(graph_rows: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        if not len(graph_rows) or not len(frame):
            return pd.DataFrame({"node": [], "low": [], "links": []}).astype("int64")
        ids, weights, x, graph = _load(graph_rows.iloc[0])
        frame = frame.sort_values("node", ignore_index=True)
        own, q = frame["node"].to_numpy(np.int64), _matrix(frame["embedding"])
        norm, norms = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        links, a, b = np.zeros(len(own), np.int64), [], []
        for i, near in enumerate(search(graph, _unit(q), own, limit)):
            near = near[ids[near] != own[i]]
            near = near[x[near] @ q[i] / (norms[near] * norm[i]) >= limit]
            links[i] = weights[near].sum()
            a.append(np.full(len(near), own[i]))
            b.append(ids[near])
        a, b = np.concatenate(a), np.concatenate(b)
        # a link that only its other end found counts for both, if both are queries here and lie in this shard
        m = np.minimum(np.searchsorted(own, b), len(own) - 1)
        there = (own[m] == b) & np.isin(a, ids)
        q, m = np.searchsorted(own, a[there]), m[there]
        late = np.setdiff1d(m * len(own) + q, q * len(own) + m)
        np.add.at(links, late // len(own), weights[np.searchsorted(ids, own[late % len(own)])])
        nodes, low = forest(a, b)
        return pd.DataFrame({"node": np.r_[own, nodes], "low": np.r_[own, low], "links": np.r_[links, np.zeros(len(nodes), np.int64)]})

    told = cut(asked.groupBy(*key, "block").cogroup(asks.groupBy(*key, "block")).applyInPandas(lambda g, f: run(g, f), "node long, low long, links long"))
    counted = told.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(told.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    by_class = classes.join(counted, "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # a component is named by its smallest vec_id; its classes are added up before they are dealt
    names = by_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = salted_join(by_class, names, "component", "node").select("label", "embedding", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    whole = rows.where("fine").join(by_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


__all__ = ["Graph", "forest", "link", "search"]
