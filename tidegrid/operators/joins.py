"""Joins that are more than an equality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def char_to_token(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each word with every token that covers its middle character. words: story, char_start, char_end; tokens: story,
    idx, text. Both are gathered by story, a row each, and meet there. The tokens' text is named token."""
    token = tokens.withColumnRenamed("text", "token").drop("story").columns
    w = words.where("story IS NOT NULL").groupBy("story").agg(F.collect_list(F.struct(*[c for c in words.columns if c != "story"])).alias("words"))
    t = tokens.withColumnRenamed("text", "token").where("story IS NOT NULL").groupBy("story").agg(F.collect_list(F.struct(*token)).alias("tokens"))
    return matched(w.join(t, "story"))


#: Words and tokens that lie side by side in NumPy at most, one story's apart.
SPREAD = 200_000


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's stories, views of SPREAD words and tokens or one story."""
    n = sum(pc.list_value_length(batch[c]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("words", "tokens"))
    ends, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SPREAD, "right")))
        yield batch.slice(a, b - a)
        a = b


def matched(stories: DataFrame) -> DataFrame:
    """As char_to_token, of stories that are a row each: story, words (array of char_start, char_end, ...), tokens (array of
    idx, token, ...). Nothing is shuffled; the stories of a batch lie one behind the other on one line of places, and a
    search finds the tokens begun by a word's middle (where tokens overlap: as far back as the longest reaches)."""
    fields = [stories.schema[c].dataType.elementType.fields for c in ("words", "tokens")]
    kind = T.StructType([stories.schema["story"], *fields[0], *fields[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            words, tokens = batch["words"], batch["tokens"]
            of = lambda x: np.repeat(np.arange(len(x)), pc.list_value_length(x).fill_null(0))
            row, on, w, t = of(words), of(tokens), words.flatten(), tokens.flatten()
            number = lambda x, c: x.field(c).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            size = pc.utf8_length(t.field("token")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            idx, a, b = number(t, "idx"), number(w, "char_start"), number(w, "char_end")
            use = np.flatnonzero((size > 0) & (idx >= 0))
            known = np.flatnonzero((a >= 0) & (b >= 0))
            middle, row = (a + b)[known] // 2, row[known]
            # a story's places begin after all of the one before it
            line = int(max((idx + size)[use].max(initial=0), middle.max(initial=0))) + 1
            use = use[np.argsort(on[use] * line + idx[use], kind="stable")]
            begin = on[use] * line + idx[use]
            end, at = begin + size[use], row * line + middle
            last = np.searchsorted(begin, at, "right")
            overlap = len(use) > 1 and (begin[1:] < end[:-1]).any()
            first = np.searchsorted(begin, at - size[use].max(initial=0), "right") if overlap else np.maximum(last - 1, 0)
            n = last - first
            word = np.repeat(np.arange(len(at)), n)
            token = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            hit = end[token] > at[word]
            word, token = word[hit], token[hit]
            w, t = w.take(pa.array(known[word])), t.take(pa.array(use[token]))
            yield pa.RecordBatch.from_arrays([batch["story"].take(pa.array(row[word])), *w.flatten(), *t.flatten()], kind.names)

    return stories.select("story", "words", "tokens").mapInArrow(run, kind)


#: Names that are sent to the files; more meet them in a shuffle.
FEW_NAMES = 1_000_000


def name_in_name(files: DataFrame, names: DataFrame, file: str, name: str) -> DataFrame:
    """Each file with the longest name that it contains, in either case (ties: the first in order); no match, no row.
    A name is looked for by its beginning, the largest power of two of its letters, at every place of a file: as many
    keys a place as there are such powers. Files that are alike are searched once."""
    keyed = names.select(name, F.lower(name).alias("_key")).where("_key <> ''").dropDuplicates([name])
    keyed = keyed.withColumn("_size", F.pow(F.lit(2), F.floor(F.log2(F.length("_key").cast("double")))).cast("int"))
    sizes = {r["_size"]: r["count"] for r in keyed.groupBy("_size").count().collect()}
    if not sizes:
        return files.withColumn(name, F.lit(None).cast("string")).where("false")
    keyed = keyed.withColumn("_head", F.expr("substring(_key, 1, _size)"))
    low = files.select(file).where(F.length(file) > 0).distinct().withColumn("_low", F.lower(file))
    places = low.select(file, "_low", F.explode(F.sequence(F.lit(1), F.length("_low"))).alias("_at"))
    heads = places.select(file, "_low", "_at", F.explode(F.array(*[F.substring("_low", F.col("_at"), F.lit(n)) for n in sorted(sizes)])).alias("_head"))
    found = heads.join(F.broadcast(keyed) if sum(sizes.values()) <= FEW_NAMES else keyed, "_head").where("substring(_low, _at, length(_key)) = _key")
    best = found.groupBy(file).agg(F.min(F.struct((-F.length(name)).alias("n"), F.col(name).alias("v"))).alias("_b"))
    return files.join(best.select(file, F.col("_b.v").alias(name)), file)


def covered(all_keys: DataFrame, counts: DataFrame, key: str, count: str) -> DataFrame:
    """Every key with its count, 0 where it has none; other columns stay null."""
    return all_keys.join(counts, key, "left").fillna(0, [count])


def preferred(sources: list[DataFrame], key: str) -> DataFrame:
    """One row for each key, from the first source that has it."""
    ranked = None
    for i, s in enumerate(sources):
        s = s.withColumn("_rank", F.lit(i))
        ranked = s if ranked is None else ranked.unionByName(s)
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_rank"))).where("_n = 1").drop("_n", "_rank")


def with_fallback(rows: DataFrame, known: DataFrame, key: str, prefix: str) -> DataFrame:
    """Each row's name among the known ones (a column like key): prefix + key where that is known, else key, else null."""
    names = known.select(F.col(key).alias("_name")).distinct()
    first = rows.join(names.withColumnRenamed("_name", "_long"), F.concat(F.lit(prefix), F.col(key)) == F.col("_long"), "left")
    return first.join(names.withColumnRenamed("_name", "_short"), F.col(key) == F.col("_short"), "left").withColumn("name", F.coalesce("_long", "_short")).drop("_long", "_short")


def not_done(work: DataFrame, done: DataFrame, key: str, part: str, needed: int) -> DataFrame:
    """Work items that have fewer than `needed` distinct finished parts."""
    complete = done.groupBy(key).agg(F.countDistinct(part).alias("_p")).where(F.col("_p") >= needed).select(key)
    return work.join(complete, key, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The newest row of each key: an upsert is this over the old rows and the new."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
