"""Intervals to the samples of a fixed grid, last writer wins.

A sample belongs to the latest row, by `ord`, whose interval covers it. A story is cut at the ends of its intervals
into stretches with one owner; an interval is spread over the few stretches it covers, never over its samples, and
`project` spreads stretches to samples last, where the rows are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import SAMPLE_RATE


def bounded(intervals: DataFrame, sizes: DataFrame, rate: float = SAMPLE_RATE) -> DataFrame:
    """Adds s and e, the first sample and the one after the last; intervals without a sample go. sizes: story, n."""
    s, e = F.greatest(F.lit(0).cast("long"), F.floor(F.col("t0") * float(rate))), F.least(F.ceil(F.col("t1") * float(rate)), F.col("n"))
    return intervals.join(sizes, "story").withColumn("s", s).withColumn("e", e).where("e > s").drop("n")


def sizes_of(intervals: DataFrame, rate: float = SAMPLE_RATE) -> DataFrame:
    """story, n: samples up to the end of the last interval."""
    return intervals.groupBy("story").agg(F.ceil(F.max("t1") * float(rate)).alias("n"))


def stretches(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """story, a, b (exclusive), ord: the whole grid of each story, cut where an interval begins or ends; ord is that of
    the last writer, null where nothing lies."""
    ends = cells.select("story", F.explode(F.array("s", "e")).alias("a")).union(sizes.where("n > 0").select("story", F.explode(F.array(F.lit(0).cast("long"), F.col("n").cast("long"))).alias("a"))).distinct()
    line = Window.partitionBy("story").orderBy("a")
    cuts = ends.select("story", "a", F.lead("a").over(line).alias("b"), F.row_number().over(line).alias("i"))
    place = lambda c: cuts.select("story", F.col("a").alias(c), F.col("i").alias(f"_{c}"))
    over = cells.select("story", "ord", "s", "e").join(place("s"), ["story", "s"]).join(place("e"), ["story", "e"])
    last = over.select("story", "ord", F.explode(F.sequence(F.col("_s"), F.col("_e") - 1)).alias("i")).groupBy("story", "i").agg(F.max("ord").alias("ord"))
    return cuts.where("b IS NOT NULL").join(last, ["story", "i"], "left").select("story", "a", "b", "ord")


def samples(sizes: DataFrame) -> DataFrame:
    return sizes.where("n > 0").select("story", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("k"))


def owned(intervals: DataFrame, sizes: DataFrame, features: list[str], rate: float = SAMPLE_RATE, zero_writes: bool = True) -> DataFrame:
    """story, a, b (exclusive), features by stretches: 0 where nothing lies. Rows whose features are all 0 overwrite
    only if zero_writes."""
    if not zero_writes:
        intervals = intervals.where(" OR ".join(f"coalesce(`{c}`, 0) <> 0" for c in features))
    cut = stretches(bounded(intervals, sizes, rate), sizes)
    return cut.join(intervals.select("story", "ord", *features), ["story", "ord"], "left").drop("ord").fillna(0, subset=features)


def project(intervals: DataFrame, sizes: DataFrame, features: list[str], rate: float = SAMPLE_RATE, zero_writes: bool = True) -> DataFrame:
    """story, k, features for every sample of the grid."""
    rows = owned(intervals, sizes, features, rate, zero_writes)
    return rows.select("story", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("k"), *features)


def runs(rows: DataFrame, features: list[str]) -> DataFrame:
    """story, a, b (exclusive), features: maximal runs of equal neighbours, from stretches (story, a, b) or from samples
    (story, k)."""
    if "k" in rows.columns:
        rows = rows.withColumn("a", F.col("k")).withColumn("b", F.col("k") + 1)
    line = Window.partitionBy("story").orderBy("a")
    same = F.lag("b").over(line) == F.col("a")
    for c in features:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(line))
    marked = rows.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("story", "_run", *features).agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_run")


def side_by_side(spaces: list[DataFrame]) -> DataFrame:
    """Spaces of equal grids on (story, k)."""
    out = spaces[0]
    for other in spaces[1:]:
        out = out.join(other, ["story", "k"], "full")
    return out


def active(projected: DataFrame, features: list[str]) -> DataFrame:
    return projected.where(" OR ".join(f"`{c}` <> 0" for c in features))
