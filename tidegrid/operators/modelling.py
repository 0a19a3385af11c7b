"""From feature and response series to tested results: assembly, the two fits, and everything told about each target.

Sessions are (session, story); responses are long (session, story, j, target, y), so targets spread over the
cluster and nothing is as wide as the number of targets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import ALPHAS, FDR_LEVEL, FOLDS, SHIFT_MARGIN
from tidegrid.operators import ridge, stats
from tidegrid.sources.store import settled

KEYS = ["session", "story", "j"]


def long_form(bold: DataFrame, values: str = "y") -> DataFrame:
    """Rows of arrays (session, story, j, y) as session, story, j, target, y."""
    return bold.select(*KEYS, F.posexplode(values).alias("target", "y"))


@dataclass
class Matrices:
    x_train: DataFrame
    y_train: DataFrame
    x_test: DataFrame
    y_test: DataFrame
    repeats: DataFrame
    features: list[str]


def assembled(series: DataFrame, responses: DataFrame, features: list[str], test_story: str) -> Matrices:
    """Features (story, j) meet responses by position, so both end where the shorter does; null, NaN and infinite
    values are made numbers; every column and target is standardised within its session, test sessions too. The test
    features are those of the first test session; test responses are averaged over the sessions, up to the shortest."""
    sessions = responses.select("session", "story").distinct()
    x = sessions.join(series.select("story", "j", *features), "story")
    x = x.join(responses.select(*KEYS).distinct(), KEYS, "left_semi")
    y = responses.join(series.select("story", "j"), ["story", "j"], "left_semi").select(*KEYS, "target", "y")
    # read by every later step, so both are written once
    x = settled(stats.standardised(x, ["session", "story"], features))
    y = settled(stats.standardised(y, ["session", "story", "target"], ["y"]))
    test = F.col("story") == test_story
    runs = x.where(test).groupBy("session").agg((F.max("j") + 1).alias("n"))
    first = runs.agg(F.min("session").alias("session"), F.min("n").alias("n"))
    x_test = x.where(test).join(F.broadcast(first), "session").where("j < n").select("j", *features)
    shortest = F.broadcast(first.select("n").withColumn("story", F.lit(test_story)))
    repeats = y.where(test).join(shortest, "story").where("j < n").select("session", "j", "target", "y")
    return Matrices(x.where(~test), y.where(~test), x_test, repeats.groupBy("j", "target").agg(F.avg("y").alias("y")), repeats, features)


def missing_features(responses: DataFrame, series: DataFrame) -> DataFrame:
    """session, story of the responses whose story has no features: they are left out of the fit."""
    return responses.select("session", "story").distinct().join(series.select("story").distinct(), "story", "left_anti")


def without_session(repeats: DataFrame) -> DataFrame:
    return repeats.select("target", "j", F.col("session").alias("repeat"), "y")


def encoded(m: Matrices, controls: list[str], alphas: tuple[float, ...] = ALPHAS, folds: int = FOLDS, margin: int = SHIFT_MARGIN) -> DataFrame:
    """The sixteen columns for each target: fits with all features and with the controls, their difference, its exhaustive
    circular-shift null, false-discovery rates and ceiling. Raises where there are too few stories or samples."""
    sizes = {r["story"]: r["count"] for r in m.x_train.groupBy("story").count().collect()}
    fold = ridge.folds(sizes, folds)
    gram = ridge.gram(m.x_train, "story", m.features)
    sums = settled(ridge.cross(m.x_train, m.y_train, KEYS, "story", m.features))
    n = m.x_test.count()
    lo, hi = stats.shifts(n, margin)
    use = [m.features.index(c) for c in controls]
    whole = ridge.chosen(gram, sums, "story", fold, alphas)
    less = ridge.chosen(gram, sums, "story", fold, alphas, use)
    y = m.y_test.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "y"))), lambda s: s["y"]).alias("y"))
    rows = y.join(ridge.predicted(m.x_test, whole, m.features, "j").withColumnRenamed("p", "full"), "target").join(ridge.predicted(m.x_test, less, controls, "j").withColumnRenamed("p", "less"), "target")
    fit = settled(stats.tested(rows, ["target"], "y", "full", "less", n, margin))
    top = stats.ceiling(without_session(m.repeats), ["target"], "j", "repeat", "y")
    out = fit.join(top, "target", "left").withColumn("_one", F.lit(1))
    out = stats.adjusted(stats.adjusted(out, ["_one"], "p_value", "p_fdr"), ["_one"], "p_value_sensitivity", "p_fdr_sensitivity")
    share = {c: stats.over_ceiling(F.col(c), F.col("ceiling")) for c in ("r2_global", "r2_restricted")}
    f = lambda c, name: c.cast("float").alias(name)
    return out.select(
        F.col("target").cast("long").alias("voxel_idx"), f(F.col("r2_global"), "r2_global"), f(F.col("r2_restricted"), "r2_restricted"), f(F.col("delta"), "delta_r2_tense"), f(F.col("p_value"), "p_value_raw"), f(F.col("p_fdr"), "p_value_fdr"),
        F.lit(hi - lo + 1).alias("n_exhaustive_shifts"), F.lit(1.0 / (hi - lo + 2)).alias("p_resolution_min"), f(F.col("ceiling"), "r2_noise_ceiling"), f(share["r2_global"], "r2_global_normalized"), f(share["r2_restricted"], "r2_restricted_normalized"),
        f(share["r2_global"] - share["r2_restricted"], "delta_r2_tense_normalized"), f(F.col("p_value_sensitivity"), "p_value_raw_sensitivity"), f(F.col("p_fdr_sensitivity"), "p_value_fdr_sensitivity"),
        F.col("n_shifts_sensitivity").cast("int").alias("n_exhaustive_shifts_sensitivity"), F.when(F.col("n_shifts_sensitivity") > 0, 1.0 / (F.col("n_shifts_sensitivity") + 1)).alias("p_resolution_min_sensitivity"),
    )


def for_report(results: DataFrame) -> DataFrame:
    """The names that report.metrics and report.layers read."""
    return results.withColumnsRenamed({"delta_r2_tense": "delta_r2", "delta_r2_tense_normalized": "delta_r2_normalized"})


def scaled_by_training(train: DataFrame, test: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables standardised by the training table's moments."""
    moments = train.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]).withColumn("_one", F.lit(1))

    def one(df: DataFrame) -> DataFrame:
        z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
        return df.withColumn("_one", F.lit(1)).join(F.broadcast(moments), "_one").withColumns(z).select(*df.columns)

    return one(train), one(test)


def simulation_summary(fits: DataFrame) -> DataFrame:
    """targets, valid (r2_global above 0), their mean r2_global and delta_r2, and the largest delta_r2 of all; the means
    and the largest are null where no target is valid. fits: r2_global, delta_r2."""
    good = F.col("r2_global") > 0
    out = fits.agg(F.count("*").alias("targets"), F.count_if(good).alias("valid"), F.avg(F.when(good, F.col("r2_global"))).alias("mean_r2_global"), F.avg(F.when(good, F.col("delta_r2"))).alias("mean_delta_r2"), F.max("delta_r2").alias("_top"))
    return out.withColumn("max_delta_r2", F.when(F.col("valid") > 0, F.col("_top"))).drop("_top")


def significance_summary(tests: DataFrame, level: float = FDR_LEVEL) -> DataFrame:
    """targets, significant, and the mean and the largest delta_r2 of those (null without one). tests: p_fdr, delta_r2."""
    sig = stats.significant(F.col("p_fdr"), level)
    return tests.agg(F.count("*").alias("targets"), F.count_if(sig).alias("significant"), F.avg(F.when(sig, F.col("delta_r2"))).alias("mean_delta_r2"), F.max(F.when(sig, F.col("delta_r2"))).alias("max_delta_r2"))


def simulated(spark, rows: int, features: int, targets: int, seed: int = 10) -> tuple[DataFrame, DataFrame]:
    """Unrelated normal features (story, j, x...) and responses (session, story, j, y), for checks that expect no effect."""
    base = spark.range(rows).select(F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("story"), "id")
    line = Window.partitionBy("story").orderBy("id")
    base = base.select("story", (F.row_number().over(line) - 1).cast("long").alias("j"))
    x = base.select("*", *[F.randn(seed + i).alias(f"x{i}") for i in range(features)])
    y = base.select(F.lit("ses-1").alias("session"), "story", "j", F.array(*[F.randn(seed + 1000 + i) for i in range(targets)]).alias("y"))
    return x, y
