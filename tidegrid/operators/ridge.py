"""Group-blocked ridge regression over many targets, from sufficient statistics.

Data is read once: per group, X'X and X'Y and the targets' squares. Every fold and penalty is then a solve in
the number of features. Targets are dealt into blocks; X'X is small and goes to each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.config import ALPHAS, FOLDS


def folds(sizes: dict[str, int], k: int = FOLDS) -> dict[str, int]:
    """Groups to folds, largest first into the lightest fold; min(k, groups) folds, two at least."""
    k = min(k, len(sizes))
    if k < 2:
        raise ValueError("two groups at least are needed for validation by groups")
    load, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = int(np.argmin(load))
        out[g], load[f] = f, load[f] + n
    return out


def gram(x: DataFrame, group: str, features: list[str]) -> dict[str, np.ndarray]:
    """X'X of each group: features squared in number, whatever the rows."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    sums = x.groupBy(group).agg(*[F.sum(F.col(features[i]).cast("double") * F.col(features[j])).alias(f"_{i}_{j}") for i, j in pairs])
    out = {}
    for r in sums.collect():
        g = np.zeros((len(features), len(features)))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"_{i}_{j}"]
        out[r[group]] = g
    return out


#: Targets that meet a group's features in one matrix product, and values of targets in a part of a group.
BLOCK, PART = 256, 2_000_000


def cross(x: DataFrame, y: DataFrame, keys: list[str], group: str, features: list[str], target: str = "target", value: str = "y", block: int = BLOCK) -> DataFrame:
    """group, target, b (X'y), q (y'y): a row for each group and target. y is long: keys, target (a whole number from 0),
    y. A group's features meet a block of targets in one product, so they travel once for each block. Rows are dealt over
    parts by their keys, as many as keep a part's values below PART, and the parts' sums are added."""
    last = y.agg(F.max(target).alias("n")).first()["n"]
    parts = x.count() * min(block, int(last or 0) + 1) // PART + 1
    kinds = dict(x.dtypes)
    part = F.pmod(F.xxhash64(*[F.col(c).cast(kinds[c]) for c in keys]), F.lit(parts)).alias("_part")
    ids = list(dict.fromkeys([*keys, group]))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(last or 0) // block).cast("long")))
    left = x.select(*ids, F.array(*[F.col(c).cast("double") for c in features]).alias("_x"), part).withColumn("_block", blocks)
    right = y.where(F.col(value).isNotNull()).select(*keys, F.col(target).cast("long").alias("_target"), F.col(value).cast("double").alias("_y"), F.floor(F.col(target) / block).alias("_block"), part)
    if group not in keys:
        right = right.join(x.select(*keys, group), keys)
    kind = dict(x.dtypes)[group]
    # both may come from one table: columns of their own keep them apart
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        both = b.merge(a[[*keys, "_x"]].assign(_row=np.arange(len(a))), on=keys)
        if not len(both):
            return pd.DataFrame({group: [], target: [], "b": [], "q": []})
        names, column = np.unique(both["_target"].to_numpy(), return_inverse=True)
        v = np.zeros((len(a), len(names)))
        np.add.at(v, (both["_row"].to_numpy(), column), both["_y"].to_numpy())
        b_ = np.stack(a["_x"].to_numpy()).T @ v
        return pd.DataFrame({group: key[0], target: names, "b": b_.T.tolist(), "q": (v * v).sum(0)})

    by = [group, "_block", "_part"]
    sums = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, f"`{group}` {kind}, `{target}` {dict(y.dtypes)[target]}, b array<double>, q double")
    return sums.groupBy(group, target).agg(F.array(*[F.sum(F.col("b")[i]) for i in range(len(features))]).alias("b"), F.sum("q").alias("q"))


def chosen(g: dict[str, np.ndarray], stats: DataFrame, group: str, fold: dict[str, int], alphas: tuple[float, ...] = ALPHAS, use: list[int] | None = None, target: str = "target") -> DataFrame:
    """target, alpha, w: for each target the penalty with the best mean validation R2 against 0, refitted on all groups."""
    names = sorted(fold)
    n = len(next(iter(g.values())))
    use = list(range(n)) if use is None else use
    sub = {k: m[np.ix_(use, use)] for k, m in g.items() if k in fold}
    whole = sum(sub[k] for k in names)
    n_folds = max(fold.values()) + 1
    held = [sum(sub[k] for k in names if fold[k] == f) for f in range(n_folds)]
    eye = np.eye(len(use))
    inverse = [[np.linalg.inv(whole - h + a * eye) for a in alphas] for h in held]
    final = [np.linalg.inv(whole + a * eye) for a in alphas]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame[group].isin(names)]
        b = np.zeros((n_folds, len(use)))
        q = np.zeros(n_folds)
        for k, x, s in zip(frame[group], frame["b"], frame["q"]):
            b[fold[k]] += np.asarray(x, float)[use]
            q[fold[k]] += s
        score = np.zeros(len(alphas))
        for f in range(n_folds):
            rest = b.sum(0) - b[f]
            for i in range(len(alphas)):
                w = inverse[f][i] @ rest
                score[i] += 1 - (q[f] - 2 * w @ b[f] + w @ held[f] @ w) / q[f] if q[f] > 0 else 0.0
        best = int(score.argmax())
        return pd.DataFrame({target: [frame[target].iloc[0]], "alpha": [alphas[best]], "score": [score[best] / n_folds], "w": [(final[best] @ b.sum(0)).tolist()]})

    kind = dict(stats.dtypes)[target]
    return stats.groupBy(target).applyInPandas(run, f"{target} {kind}, alpha double, score double, w array<double>")


def bands(sizes: list[int]) -> list[list[int]]:
    """The numbers of each group's features, one group after the other."""
    ends = np.cumsum([0, *sizes]).tolist()
    return [list(range(a, b)) for a, b in zip(ends[:-1], ends[1:])]


def banded(features: list[list[int]], scales: list[float]) -> np.ndarray:
    """Penalty scales per feature for groups of features with a scale each: multiply X's columns by their roots."""
    out = np.ones(sum(map(len, features)))
    for group, s in zip(features, scales):
        out[group] = np.sqrt(s)
    return out


def searched(g: dict[str, np.ndarray], stats: DataFrame, group: str, fold: dict[str, int], features: list[list[int]], alphas: tuple[float, ...] = ALPHAS, draws: int = 20, seed: int = 42, target: str = "target") -> DataFrame:
    """target, draw, alpha, score, w: banded ridge by random search. Each draw weighs the groups of features by a seeded
    Dirichlet sample (the first weighs them alike); for each target the draw and penalty of the best mean validation
    R2 are refitted on all groups. w belongs to the features as they are. Draws only scale the sums; nothing is read again."""
    rng, best = np.random.default_rng(seed), None
    weight = np.vstack([np.full(len(features), 1 / len(features)), rng.dirichlet(np.ones(len(features)), max(0, draws - 1))])
    for i, scales in enumerate(weight):
        root = banded(features, (scales * len(features)).tolist())
        scaled = {k: m * root[:, None] * root[None] for k, m in g.items()}
        roots = F.array(*[F.lit(float(r)) for r in root])
        one = chosen(scaled, stats.withColumn("b", F.zip_with("b", roots, lambda b, r: b * r)), group, fold, alphas, target=target)
        one = one.select(target, F.lit(i).alias("draw"), "alpha", "score", F.zip_with("w", roots, lambda w, r: w * r).alias("w"))
        best = one if best is None else best.unionByName(one)
    top = best.groupBy(target).agg(F.max(F.struct("score", (-F.col("draw")).alias("first"), "draw", "alpha", "w")).alias("t"))
    return top.select(target, "t.draw", "t.alpha", "t.score", "t.w")


#: Bytes of the held-out matrix that every task gets a copy of at most.
SENT = 256_000_000


def predicted(x: DataFrame, weights: DataFrame, features: list[str], order: str, target: str = "target") -> DataFrame:
    """target, p: the predictions of each target for all rows of x, an array in their order. The held-out matrix (rows of
    one story times features) is sent to the weights after its size is checked; nothing is shuffled."""
    n = x.count()
    if 8 * n * len(features) > SENT:
        raise ValueError(f"{n} held-out rows of {len(features)} features are more than {SENT} bytes: predict them in parts")
    held = np.array([list(r)[1:] for r in x.select(order, *features).orderBy(order).collect()], float).reshape(n, len(features))
    sent = x.sparkSession.sparkContext.broadcast(held)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                w = np.stack([np.asarray(v, float) for v in frame["w"]])
                yield pd.DataFrame({target: frame[target], "p": (w @ sent.value.T).tolist()})

    return weights.select(target, "w").mapInPandas(run, f"`{target}` {dict(weights.dtypes)[target]}, p array<double>")
