"""Ordered interval streams: pauses, punctuation, text with offsets, clauses.

Intervals have story, ord, t0, t1, text; order is `ord` within the story. Windows partition by story, so
stories run side by side and nothing is sorted across them.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tidegrid.config import COMMA_PAUSE, PERIOD_PAUSE
from tidegrid.functions import text as T


def _by(key: str, order: str) -> Window:
    return Window.partitionBy(key).orderBy(order)


def running(flag: Column, key: str, order: str) -> Column:
    """How many rows up to and with this one have the flag."""
    return F.sum(flag.cast("long")).over(_by(key, order).rowsBetween(Window.unboundedPreceding, 0))


def classified(intervals: DataFrame) -> DataFrame:
    """Adds word (cleaned), is_pause, is_word; tokens that clean to nothing are neither."""
    out = intervals.withColumn("word", T.clean_word(T.strip(F.col("text")))).withColumn("is_pause", T.is_pause(F.col("text")))
    return out.withColumn("is_word", ~F.col("is_pause") & (F.col("word") != ""))


def punctuated(intervals: DataFrame, comma: float = COMMA_PAUSE, period: float = PERIOD_PAUSE) -> DataFrame:
    """story, ord, t0, t1, word, mark: the mark after each word, from the longest single pause before the next."""
    rows = classified(intervals).withColumn("nth", running(F.col("is_word"), "story", "ord"))
    gaps = F.max(F.when(F.col("is_pause"), F.col("t1") - F.col("t0"))).over(Window.partitionBy("story", "nth"))
    rows = rows.withColumn("gap", gaps).where("is_word")
    mark = F.when(F.col("gap") >= period, ".").when(F.col("gap") >= comma, ",").otherwise("")
    return rows.select("story", "ord", "t0", "t1", "word", mark.alias("mark"))


def offsets(words: DataFrame) -> DataFrame:
    """Adds char_start and char_end (exclusive) in the text of words and marks joined by blanks."""
    before = F.sum(F.length("word") + F.length("mark") + 1).over(_by("story", "ord").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0))
    return words.withColumn("char_start", start).withColumn("char_end", start + F.length("word"))


@F.arrow_udf(ArrayType(IntegerType()))
def starts(words: pa.Array) -> pa.Array:
    """As offsets, of words held as an array without marks: where each begins in the text of all, joined by blanks."""
    n = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.utf8_length(words.flatten()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    at, bounds = np.cumsum(size) - size, np.r_[0, np.cumsum(n)]
    own = at - np.repeat(np.r_[at, 0][bounds[:-1]], n)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(own.astype(np.int32)))


def text_of(words: DataFrame) -> DataFrame:
    """story, text."""
    piece = F.struct("ord", F.concat("word", "mark").alias("s"))
    return words.groupBy("story").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["s"]), " ").alias("text"))


def strict_offsets(words: DataFrame) -> DataFrame:
    """As offsets, but each word is searched for, between word boundaries, from the end of the one before it:
    words that begin or end with an apostrophe are lost, or found later, in a left-to-right search."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord", ignore_index=True)
        whole, at, found = " ".join(frame["word"] + frame["mark"]), 0, []
        for i, word in enumerate(frame["word"]):
            m = re.compile(rf"\b{re.escape(word)}\b").search(whole[at:])
            if m:
                found.append((i, at + m.start(), at + m.end()))
                at += m.end()
        out = frame.iloc[[i for i, _, _ in found]].copy()
        out["char_start"], out["char_end"] = [a for _, a, _ in found], [b for _, _, b in found]
        return out[["story", "ord", "t0", "t1", "word", "mark", "char_start", "char_end"]]

    return words.groupBy("story").applyInPandas(run, "story string, ord long, t0 double, t1 double, word string, mark string, char_start int, char_end int")


def clauses_by_pause(intervals: DataFrame, period: float = PERIOD_PAUSE) -> DataFrame:
    """Words with their clause: a single pause of `period` or more closes one (the fitting rule); 0 splits at any pause."""
    rows = classified(intervals)
    cut = F.col("is_pause") & (F.col("t1") - F.col("t0") >= period)
    rows = rows.withColumn("island", running(cut, "story", "ord")).where("is_word")
    return rows.withColumn("clause", F.dense_rank().over(_by("story", "island")) - 1).drop("island", "text", "is_pause", "is_word")


def clauses_by_gap(words: DataFrame, period: float = PERIOD_PAUSE) -> DataFrame:
    """Words with their clause: time since the word before of `period` or more opens one (the projecting rule)."""
    gap = F.col("t0") - F.lag("t1").over(_by("story", "ord"))
    return words.withColumn("_opens", F.coalesce(gap >= period, F.lit(False))).withColumn("clause", running(F.col("_opens"), "story", "ord")).drop("_opens")


def spans(clauses: DataFrame) -> DataFrame:
    """story, clause, t0, t1, words: from the first word's start to the last word's end."""
    return clauses.groupBy("story", "clause").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count("*").alias("words"))


def first_of_each(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first row of each distinct combination of columns."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*columns).orderBy(order))).where("_n = 1").drop("_n")


