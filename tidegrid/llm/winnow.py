"""Document fingerprints by winnowing, with DataFrame functions only.

A text is its UTF-8 bytes. Every K-byte gram has a key: 40 bits of its hash above 24 bits that fall as its
position rises, so the least key of W neighbouring grams is the one with the smallest hash, rightmost if
tied, and tells its position. The fingerprint is the distinct least keys over all windows. Two texts that
share W + K - 1 bytes in a row share a selected hash. Window minima are found by doubling, so work is linear
in the text (log W passes).

An edited text shares its beginning with its text, so only windows that reach into what was replaced are
hashed again. The next document is the one that follows in ascending doc_id: documents are dealt into
ranges of ids, each range also holds the first document of the range after it, and a window function over
the range does the rest, so nothing is sorted in one place.

Defined results: null text counts as empty and has the empty fingerprint; a text shorter than a window is one
window, shorter than a gram one gram; two empty fingerprints have likeness 1, one empty one 0; rows with one
doc_id follow each other by text; a null doc_id comes first; a single document follows itself. Positions count
modulo 2^24. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts

K = 12
W = 16
#: Ranges of ids at most: their bounds are part of the plan, so larger tables have larger ranges, not more of them.
RANGES = 10_000
_POSITIONS = 0xFFFFFF
_FIRST = -(2**63)


def let(value: Column, body) -> Column:
    """body of value, which is computed once and never pulled into a loop."""
    return F.element_at(F.transform(F.array(value), body), 1)


def gram_keys(data: Column, size: Column, offset: Column, k: int) -> Column:
    one = lambda i: F.shiftleft(F.xxhash64(F.substring(data, i, F.lit(k))), 24) + (F.lit(_POSITIONS) - (i + offset).bitwiseAND(F.lit(_POSITIONS)))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - (k - 1))), one)


def window_minima(keys: Column, w: int) -> Column:
    """The least of each w neighbouring keys; of all keys if they are fewer."""

    def halve(shift: int):
        return lambda m: F.zip_with(m, F.slice(m, F.lit(shift + 1), F.greatest(F.lit(0), F.size(m) - shift)), lambda a, b: F.least(a, b))

    shifts, done = [], 1
    while done < w:
        shifts.append(min(done, w - done))
        done += shifts[-1]
    whole = reduce(lambda m, s: let(m, halve(s)), shifts, keys)
    return let(whole, lambda m: F.slice(m, F.lit(1), F.greatest(F.lit(1), F.size(m) - (w - 1))))


def minima_of(text: Column, offset: Column | None = None, k: int = K, w: int = W) -> Column:
    """Least keys of all windows of a text (as bytes), in order."""
    at = F.lit(0) if offset is None else offset
    return let(text, lambda b: window_minima(gram_keys(b, F.length(b), at, k), w))


def hashes(keys: Column) -> Column:
    return F.array_distinct(F.transform(keys, lambda x: F.shiftright(x, 24)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both))


def spoken(keys: Column) -> Column:
    """A fingerprint as text: a key in hexadecimal, hash (10 digits) then 2^24 - 1 - position (6 digits)."""
    return F.array_join(F.transform(keys, lambda x: F.hex(x)), ",")


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, keys: the fingerprint of each text."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<bigint>")
    return docs.select("doc_id", F.when(F.octet_length(text) == 0, none).otherwise(F.array_distinct(minima_of(text.cast("binary"), None, k, w))).alias("keys"))


def _ranges(docs: DataFrame, n: int) -> Column:
    """The number of the range of ids that a row lies in; bounds are looked up in two levels."""
    marks = docs.agg(F.percentile_approx("id", [i / n for i in range(1, n)], max(10_000, 8 * n)).alias("b")).first()["b"] if n > 1 else []
    bounds = sorted(set(marks or []))
    if not bounds:
        return F.lit(0).cast("long")
    width = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    longs = lambda xs: F.lit(xs).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("id")))
    group = below(longs([g[0] for g in groups]))
    inside = F.element_at(F.array(*[longs(g) for g in groups]), F.greatest(F.lit(1), group))
    return F.when(group == 0, 0).otherwise((group - 1) * width + below(inside)).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """range, seat, id, doc_id, text, next_text: seat 1 marks a row that only stands for the range after it."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(_FIRST)).alias("id"))
    base = base.withColumn("range", _ranges(base, min(RANGES, parts(docs, 2.0))))
    heads = base.groupBy("range").agg(F.min("id").alias("id"))
    line = Window.partitionBy(F.lit(0)).orderBy("range")
    last = F.max("range").over(Window.partitionBy(F.lit(0)))
    before = heads.select("id", F.coalesce(F.lag("range").over(line), last).alias("range"))
    ghosts = base.drop("range").join(before, "id").select("range", F.lit(1).alias("seat"), "id", "doc_id", "text")
    rows = base.select("range", F.lit(0).alias("seat"), "id", "doc_id", "text").unionByName(ghosts)
    return rows.withColumn("next_text", F.lead("text").over(Window.partitionBy("range").orderBy("seat", "id", "text")))


def compare(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row for each input row."""
    rows = with_next(docs).withColumn("n", F.length("text"))
    cut = F.floor(F.col("n") / 4).cast("int")
    head = F.substring(F.col("text"), F.lit(1), F.col("n") - cut)
    rows = rows.withColumn("head_bytes", F.octet_length(head)).withColumn("edited", F.concat(head, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut)))
    # windows before this one lie wholly in what was not replaced
    same = F.greatest(F.lit(0), F.col("head_bytes") - (k + w - 1))
    tail = F.substring(F.col("edited").cast("binary"), same + 1, F.greatest(F.lit(0), F.octet_length("edited") - same))
    none = F.array().cast("array<bigint>")
    own = minima_of(F.col("text").cast("binary"), None, k, w)
    pair = let(
        F.when(F.col("n") == 0, none).otherwise(own),
        lambda m: F.struct(F.array_distinct(m).alias("keys"), F.when(F.col("seat") == 1, none).when(F.octet_length("edited") == 0, none).otherwise(F.array_distinct(F.concat(F.slice(m, F.lit(1), same), minima_of(tail, same, k, w)))).alias("edited_keys")),
    )
    made = rows.select("range", "seat", "id", "text", "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), pair.alias("p"))
    made = made.select("range", "seat", "id", "text", "doc_id", "n_chars", "edited_sha256", F.col("p.keys").alias("keys"), F.col("p.edited_keys").alias("edited_keys"), hashes(F.col("p.keys")).alias("hashes"))
    made = made.withColumn("next_hashes", F.lead("hashes").over(Window.partitionBy("range").orderBy("seat", "id", "text"))).where("seat = 0")
    return made.select("doc_id", "n_chars", "edited_sha256", spoken(F.col("keys")).alias("fingerprint"), spoken(F.col("edited_keys")).alias("edited_fingerprint"), likeness(F.col("hashes"), hashes(F.col("edited_keys"))).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))
