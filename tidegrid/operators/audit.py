"""Counts, distributions and inventories, each one grouped aggregate with exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_subject(sessions: DataFrame, subject: str, item: str, seconds: str) -> DataFrame:
    out = sessions.groupBy(subject).agg(F.count(item).alias("total_sessions"), F.countDistinct(item).alias("unique_items"), F.sum(F.coalesce(F.col(seconds).cast("double"), F.lit(0.0))).alias("total_sec"))
    return out.withColumn("total_min", F.col("total_sec") / 60)


def by_item(sessions: DataFrame, item: str, subject: str, seconds: str) -> DataFrame:
    return sessions.groupBy(item).agg(F.count(subject).alias("total_plays"), F.countDistinct(subject).alias("unique_listeners"), F.max(seconds).alias("duration_sec"))


def joined_names(name: str, distinct: bool = True, order: str | None = None) -> Column:
    """Names as one string: sorted and distinct, or all in the order of a column."""
    if distinct:
        return F.array_join(F.array_sort(F.collect_set(name)), ", ")
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name]), ", ")


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles, maximum."""
    v = F.col(value).cast("double")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q.alias("_q"), F.max(v).alias("max"))
    return out.select(*keys, "n", "mean", "std", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("p75"), "max")


def inventory(tokens: DataFrame, columns: list[str]) -> DataFrame:
    """How often each combination occurs, most frequent first; ties by the columns."""
    return tokens.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def top(tokens: DataFrame, columns: list[str], n: int) -> DataFrame:
    return inventory(tokens, columns).limit(n)


def extremes(rows: DataFrame, by: str, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """The n smallest and the n largest rows; other columns break ties."""
    rest = [c for c in rows.columns if c != by]
    return rows.orderBy(by, *rest).limit(n), rows.orderBy(F.desc(by), *rest).limit(n)


def sampled(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows in a seeded random order."""
    return rows.orderBy(F.rand(seed)).limit(n)


def repeated(coverage: DataFrame, count: str) -> DataFrame:
    """subjects, without, single, multiple: how many have no, one or more presentations."""
    n = F.col(count)
    return coverage.agg(F.count("*").alias("subjects"), F.count_if(n == 0).alias("without"), F.count_if(n == 1).alias("single"), F.count_if(n > 1).alias("multiple"))


def validity(stories: DataFrame, story: str, valid: str) -> DataFrame:
    """stories, valid, invalid, and the invalid ones in order."""
    ok = F.coalesce(F.col(valid), F.lit(False))
    return stories.agg(F.count("*").alias("stories"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.array_join(F.array_sort(F.collect_list(F.when(~ok, F.col(story)))), ", ").alias("invalid_list"))
