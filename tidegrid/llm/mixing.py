"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Sources in code-point order (null last) weigh 5, 2, 1,
repeating; targets are shares of all words, stopped at `max_repeat` times the source's size, the
excess shared out again by weight. A source is taken whole as often as fits into its target; the
rest of the budget is a subset sum over document sizes: sizes are counted, a proportional count of
each is taken, and a bounded knapsack over the sizes still free closes the gap, so the words taken
hit the budget exactly wherever some subset of the remaining documents does. Which documents of a
size are taken follows a seeded hash of their id.

Defined results: null and empty texts have size 0 and take 0; a source of size 0 has target 0; equal
hashes are ordered by doc_id; a repeated row counts as a document of its own; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, running

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
SEED = 20
#: Budget in words that the knapsack table closes at the end.
TABLE = 20_000
#: Documents of one size and source that one task orders at most (expected).
CELL = 250


def knapsack(sizes: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take for the largest sum that is at most budget."""
    taken = np.zeros(len(sizes), np.int64)
    if budget <= 0:
        return taken
    full, reach, steps = (1 << (budget + 1)) - 1, 1, []
    for i in np.argsort(-sizes, kind="stable"):
        size, left, k = int(sizes[i]), int(min(free[i], budget // sizes[i])) if 0 < sizes[i] <= budget else 0, 1
        while left > 0 and not reach >> budget & 1:
            k = min(k, left)
            steps.append((reach, i, k))
            reach |= reach << size * k & full
            left, k = left - k, k * 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    for before, i, k in reversed(steps):
        if not before >> at & 1:
            taken[i] += k
            at -= int(sizes[i]) * k
    return taken


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE) -> np.ndarray:
    """How many documents of each size to take: the sum comes as near to budget from below as can be found."""
    total = int((sizes * counts).sum())
    budget = min(int(budget), total)
    if budget <= 0:
        return np.zeros(len(sizes), np.int64)
    bulk = max(0, budget - table)  # what is left lets the knapsack choose
    take = np.array([int(c) * bulk // total for c in counts], np.int64)
    take[sizes == 0] = 0
    left = budget - int((take * sizes).sum())
    order = np.argsort(-sizes, kind="stable")
    for i in order:
        if left <= table:
            break
        if sizes[i] > 0:
            more = min(int(counts[i] - take[i]), 1 if left > 4 * table else (left - table) // int(sizes[i]), left // int(sizes[i]))
            take[i] += more
            left -= more * int(sizes[i])
    for i in order:
        if left <= 2 * table:
            break
        if sizes[i] > 0:
            more = min(int(counts[i] - take[i]), left // int(sizes[i]))
            take[i] += more
            left -= more * int(sizes[i])
    # more than 4 * table is left only where every document that fits is taken already
    return take + knapsack(sizes, counts - take, min(left, 4 * table))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """From no_source, source_key, size: a row for each source with source_size and target. The level at
    which uncapped sources share the rest is found over sources ordered by cap against weight."""
    by_source = sized.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    ranked = running(by_source, ["no_source", "source_key"], {"rank": F.lit(1)})
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(max_repeat)).withColumn("fill", F.col("cap") / F.col("weight"))
    # if all sources that fill up sooner are full, the others share the rest at this level; it holds where no other fills up
    ranked = cut(running(ranked, ["fill", "rank"], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}))
    whole = ranked.agg(F.sum("source_size").cast("double").alias("_size"), F.sum("weight").alias("_weight")).withColumn("_one", F.lit(1))
    level = (F.col("_size") - F.col("cap_before")) / (F.col("_weight") - F.col("weight_before"))
    levelled = ranked.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one").withColumn("level", level)
    share = levelled.agg(F.max(F.when(F.col("fill") >= F.col("level"), F.col("level"))).alias("share")).withColumn("_one", F.lit(1))
    done = levelled.join(F.broadcast(share), "_one")
    return done.select("no_source", "source_key", "source_size", F.when(F.col("share").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("share") * F.col("weight"))).alias("target"))


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("size", ignore_index=True)
    whole, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
    goal = int(round(target))
    repeats = min(goal // whole, MAX_REPEAT) if whole else 0
    frame["repeats"] = repeats
    frame["more"] = 0 if not whole or repeats == MAX_REPEAT else fit_budget(frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), goal - repeats * whole)
    return frame


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, source; one row for each input row."""
    sized = cut(docs.select("doc_id", "source", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    key = ["no_source", "source_key"]
    counted = sized.groupBy(*key, "size").agg(F.count("*").alias("n"))
    goal = targets(counted.select(*key, (F.col("size") * F.col("n")).alias("size")))
    # a row for each source and size: bounded by the distinct sizes, whatever the number of documents
    plan = counted.join(goal, key).groupBy(*key).applyInPandas(_plan, "no_source boolean, source_key string, size long, n long, source_size long, target double, repeats long, more long")
    rows = sized.join(plan, [*key, "size"]).withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / CELL))))
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed + 1), "doc_id"))
    open_ = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    cells = rows.where(open_).groupBy(*key, "size", "cell").agg(F.count("*").alias("in_cell"), F.first("more").alias("more"))
    before = Window.partitionBy(*key, "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*key, "size", "cell", (F.col("more") - F.coalesce(F.sum("in_cell").over(before), F.lit(0))).alias("quota"))
    chosen = rows.where(open_).join(cells, [*key, "size", "cell"]).withColumn("nth", F.row_number().over(Window.partitionBy(*key, "size", "cell").orderBy("draw", "doc_id")))
    out = lambda df, extra: df.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("repeats") + extra)).cast("long").alias("taken"), "source")
    return out(rows.where(~open_), (F.col("more") > 0).cast("long")).unionByName(out(chosen, (F.col("nth") <= F.col("quota")).cast("long")))
