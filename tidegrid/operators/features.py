"""The feature spaces of words, phones and annotated tokens. Each function adds its columns; grid.project does the rest.

Which spaces overwrite with zeros: lexical, syntactic and semantic do; phonological, categorical and tense do not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidegrid.config import PHONE_CLASSES
from tidegrid.sources.store import settled

#: Spaces whose all-zero rows do not overwrite an earlier interval's samples.
ZERO_KEEPS = ("phonological", "categorical", "tense")


def phonological(phones: DataFrame) -> DataFrame:
    """Fourteen 0/1 columns from the phone's letters (stress digits and marks dropped)."""
    phone = F.upper(F.regexp_replace(F.upper("text"), "[^A-Z]", ""))
    return phones.withColumns({name: phone.isin(*members.split()).cast("tinyint") for name, members in PHONE_CLASSES.items()})


def lexical(words: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Presence, frequency (frequencies: word, zipf; unknown words 0), length and duration."""
    out = words.join(frequencies.select("word", "zipf"), "word", "left")
    return out.select(*words.columns, F.lit(1.0).alias("word_presence"), F.coalesce("zipf", F.lit(0.0)).alias("lexical_frequency"), F.length("word").cast("double").alias("word_length_chars"), (F.col("t1") - F.col("t0")).alias("word_duration_secs"))


def categorical(tokens: DataFrame) -> DataFrame:
    """Eight 0/1 columns by part of speech; finite verbs have none."""
    p = F.col("pos")
    flags = {
        "noun": p.isin("NOUN", "PROPN"),
        "adjective": p == "ADJ",
        "adverb": p == "ADV",
        "pronoun": p == "PRON",
        "preposition": p == "ADP",
        "conjunction": p.isin("CCONJ", "SCONJ"),
        "determiner": p == "DET",
        "non_finite_verb": p.isin("VERB", "AUX") & F.col("tag").isin("VB", "VBG", "VBN"),
    }
    return tokens.withColumns({k: v.cast("tinyint") for k, v in flags.items()})


def tense(tokens: DataFrame, text: str = "text") -> DataFrame:
    """Four 0/1 columns for finite forms; modals and the contraction 'd count for none."""
    word = F.lower(F.col(text))
    finite = F.col("pos").isin("VERB", "AUX") & (F.col("tag") != "MD") & (word != "'d")
    past = finite & (F.col("tag") == "VBD")
    flags = {
        "past_regular": past & word.endswith("ed"),
        "past_irregular": past & ~word.endswith("ed"),
        "non_past_marked_3sg": finite & (F.col("tag") == "VBZ"),
        "non_past_unmarked": finite & (F.col("tag") == "VBP"),
    }
    out = tokens.withColumns({k: v.cast("tinyint") for k, v in flags.items()})
    totals = {"past_total": F.col("past_regular").bitwiseOR(F.col("past_irregular")), "non_past_total": F.col("non_past_marked_3sg").bitwiseOR(F.col("non_past_unmarked"))}
    return out.withColumns(totals)


def depths(nodes: DataFrame, group: str, node: str, parent: str) -> DataFrame:
    """Adds depth: steps to the root (a node that is its own parent, or has none); null for nodes that lead to no root.
    Pointers are doubled until all stand still, so the number of joins is the logarithm of the deepest path; each
    round is written to the shared folder. Cycles end it once pointers have gone as far as a group has nodes."""
    root = F.col(parent).isNull() | (F.col(parent) == F.col(node))
    state = settled(nodes.select(group, node, F.when(root, F.col(node)).otherwise(F.col(parent)).alias("_up"), F.when(root, 0).otherwise(1).alias("_steps")))
    most, hops = state.groupBy(group).count().agg(F.max("count").alias("n")).first()["n"] or 0, 1
    while hops < most:
        above = state.select(group, F.col(node).alias("_up"), F.col("_up").alias("_next"), F.col("_steps").alias("_more"))
        moved = settled(state.join(above, [group, "_up"]).select(group, node, "_up", F.col("_next"), (F.col("_steps") + F.col("_more")).alias("_steps")))
        state, still = moved.select(group, node, F.col("_next").alias("_up"), "_steps"), moved.where("_up <> _next").isEmpty()
        hops *= 2
        if still:
            break
    ends = nodes.where(root).select(group, F.col(node).alias("_up"))
    return nodes.join(state.join(ends, [group, "_up"]).select(group, node, F.col("_steps").alias("depth")), [group, node], "left")


#: Tokens that lie side by side in NumPy, one story's apart.
SPREAD = 1_000_000


def _within(row: np.ndarray, i: pa.Array, head: pa.Array) -> np.ndarray:
    """Steps to the root of each node, -1 where there is none; nodes of one row (row: ascending) form a tree of their own."""
    code = pc.dictionary_encode(pa.concat_arrays([i, head])).indices.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    n, wide = len(row), int(code.max(initial=0)) + 1
    own, up = code[:n], code[n:]
    order = np.argsort(row * wide + own, kind="stable")
    order = order[own[order] >= 0]
    key = (row * wide + own)[order]
    place = np.searchsorted(key, row * wide + up)
    there = (up >= 0) & (np.r_[key, -1][place] == row * wide + up)
    root = (own >= 0) & ((up < 0) | (up == own))
    # node n stands for "nowhere"
    to = np.r_[np.where(root, np.arange(n), np.where(there, np.r_[order, n][place], n)), n]
    steps, hops = np.r_[np.where(root, 0, 1), 0], 1
    while hops <= n:
        after = to[to]
        if (after == to).all():
            break
        steps, to, hops = steps + steps[to], after, 2 * hops
    return np.where((own >= 0) & np.r_[root, False][to[:n]], steps[:n], -1)


@F.arrow_udf(ArrayType(IntegerType()))
def depths_within(i: pa.Array, head: pa.Array) -> pa.Array:
    """As depths, of a story's nodes and parents held as two arrays: pointers are doubled in NumPy, some stories at once."""
    n = pc.list_value_length(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds, a, out = np.r_[0, np.cumsum(n)], 0, [np.zeros(0, np.int64)]
    nodes, parents = i.flatten(), head.flatten()
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SPREAD, "right")) - 1)
        size = int(bounds[b] - bounds[a])
        out.append(_within(np.repeat(np.arange(b - a), n[a:b]), nodes.slice(bounds[a], size), parents.slice(bounds[a], size)))
        a = b
    depth = np.concatenate(out).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(depth, mask=depth < 0))


def syntactic(tokens: DataFrame) -> DataFrame:
    """Distance to the head, number of ancestors, root flag. tokens: story, i, head_i. A story's tokens are gathered in one
    row. Node i of a story comes once; without story or i there is no depth."""
    return syntactic_within(tokens.groupBy("story").agg(F.collect_list(F.struct("i", *[c for c in tokens.columns if c not in ("story", "i")])).alias("tokens")))


def syntactic_within(stories: DataFrame) -> DataFrame:
    """As syntactic, of stories that are a row each: story, tokens (array of i, head_i, ...). Nothing is shuffled."""
    depth = stories.select("story", "tokens", depths_within(F.col("tokens.i"), F.col("tokens.head_i")).alias("syntactic_depth"))
    out = depth.select("story", F.explode(F.arrays_zip("tokens", "syntactic_depth")).alias("_t")).select("story", "_t.tokens.*", F.when(F.col("story").isNotNull(), F.col("_t.syntactic_depth")).alias("syntactic_depth"))
    return out.withColumn("dependency_distance", F.abs(F.col("i") - F.col("head_i"))).withColumn("is_root", (F.col("i") == F.col("head_i")).cast("smallint"))
