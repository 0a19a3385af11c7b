"""Standardising, fit measures, noise ceiling, circular-shift null and false-discovery rate.

"Not estimable" is null. Divisions are guarded, because Spark raises on x / 0 and NaN compares as large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import CEILING_FLOOR, FDR_LEVEL, SENSITIVITY_MARGIN, SHIFT_MARGIN
from tidegrid.functions import vectors as V


def standardised(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each column minus its group's mean over the group's population deviation (0 counts as 1); null and NaN are 0."""
    rows = rows.withColumns({c: V.clean_number(F.col(c)) for c in columns})
    moments = [x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    out = rows.join(rows.groupBy(*keys).agg(*moments), keys)
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return out.withColumns(scaled).select(*rows.columns)


def r2(ss_res: Column, ss_tot: Column) -> Column:
    """1 - res / tot; without variance 1 if nothing is missed, else 0."""
    return F.when(ss_tot > 0, 1 - ss_res / F.nullif(ss_tot, F.lit(0.0))).when(ss_res == 0, 1.0).otherwise(0.0)


def r2_by(rows: DataFrame, keys: list[str], y: str, p: str, name: str = "r2") -> DataFrame:
    """R2 of predictions p of y by keys, from sums alone: one shuffle, partial sums first."""
    y_, p_ = F.col(y).cast("double"), F.col(p).cast("double")
    sums = rows.groupBy(*keys).agg(F.sum((y_ - p_) * (y_ - p_)).alias("_res"), (F.count(y_) * F.var_pop(y_)).alias("_tot"))
    return sums.select(*keys, r2(F.col("_res"), F.col("_tot")).alias(name))


def ceiling(repeats: DataFrame, keys: list[str], time: str, repeat: str, value: str) -> DataFrame:
    """Share of variance of the mean over repeats that is signal, corrected for noise: variance of the mean minus
    noise / R, never below 0, over the variance of the mean, held to 0..1; null with one repeat or no variance."""
    v = F.col(value).cast("double")
    by_time = repeats.groupBy(*keys, time).agg(F.avg(v).alias("m"), F.var_pop(v).alias("w"), F.count(v).alias("r"))
    out = by_time.groupBy(*keys).agg(F.var_pop("m").alias("var"), F.avg("w").alias("within"), F.max("r").alias("r"))
    noise = F.col("within") * F.col("r") / (F.col("r") - 1)
    signal = F.greatest(F.lit(0.0), F.col("var") - noise / F.col("r"))
    value_ = F.least(F.lit(1.0), F.greatest(F.lit(0.0), signal / F.col("var")))
    return out.select(*keys, F.when((F.col("r") >= 2) & (F.col("var") > 0), value_).alias("ceiling"))


def over_ceiling(value: Column, top: Column, floor: float = CEILING_FLOOR) -> Column:
    return F.when(top > floor, value / top)


def shifts(n: int, margin: int = SHIFT_MARGIN) -> tuple[int, int]:
    """First and last admissible circular shift: margin to n - margin - 1."""
    if n - 2 * margin < 1:
        raise ValueError(f"{n} samples leave no circular shift with a margin of {margin}")
    return margin, n - margin - 1


def sensitive(s: Column, n: Column | int, margin: int = SENSITIVITY_MARGIN) -> Column:
    return (s >= margin) & (s <= F.lit(n) - margin)


def shift_null(rows: DataFrame, keys: list[str], y: str, full: str, less: str, n: int, margin: int = SHIFT_MARGIN) -> DataFrame:
    """keys, shift, delta: R2 of the full minus that of the restricted prediction, both turned by each shift.
    rows: a vector of each kind per key. A shift changes the cross product only; sums of squares stay."""
    lo, hi = shifts(n, margin)
    yy, pp, qq = V.dot(F.col(y), F.col(y)), V.dot(F.col(full), F.col(full)), V.dot(F.col(less), F.col(less))
    mean = V.total(F.col(y)) / n
    base = rows.select(*keys, y, full, less, yy.alias("_yy"), pp.alias("_pp"), qq.alias("_qq"), mean.alias("_mean"), F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("shift"))
    tot = F.col("_yy") - n * F.col("_mean") * F.col("_mean")
    res = lambda ss, p: F.col("_yy") + F.col(ss) - 2 * V.dot(F.col(y), V.rotate(F.col(p), F.col("shift")))
    return base.select(*keys, "shift", (r2(res("_pp", full), tot) - r2(res("_qq", less), tot)).alias("delta"))


def empirical_p(null: DataFrame, observed: DataFrame, keys: list[str], n: int, margin: int = SENSITIVITY_MARGIN) -> DataFrame:
    """(null >= observed, counted, plus 1) over (shifts plus 1), for all shifts and for those far from either end."""
    both = null.join(observed.select(*keys, F.col("delta").alias("_obs")), keys)
    hit, far = F.col("delta") >= F.col("_obs"), sensitive(F.col("shift"), n, margin)
    out = both.groupBy(*keys).agg(F.count("*").alias("n_shifts"), F.count_if(hit).alias("_h"), F.count_if(far).alias("n_shifts_sensitivity"), F.count_if(hit & far).alias("_hf"))
    share = lambda h, m: (F.col(h) + 1) / (F.col(m) + 1)
    return out.select(*keys, "n_shifts", "n_shifts_sensitivity", share("_h", "n_shifts").alias("p_value"), F.when(F.col("n_shifts_sensitivity") > 0, share("_hf", "n_shifts_sensitivity")).alias("p_value_sensitivity"))


def _turned(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums of y[t] * p[(t - s) mod n] for every shift s, row by row, by one Fourier transform each."""
    return np.fft.irfft(np.fft.rfft(y, axis=1) * np.conj(np.fft.rfft(p, axis=1)), y.shape[1], axis=1)


def _r2_rows(res: np.ndarray, tot: np.ndarray) -> np.ndarray:
    return np.where(tot > 0, 1 - res / np.where(tot > 0, tot, 1), np.where(res == 0, 1.0, 0.0))


def tested(rows: DataFrame, keys: list[str], y: str, full: str, less: str, n: int, margin: int = SHIFT_MARGIN, far: int = SENSITIVITY_MARGIN, places: int | None = None) -> DataFrame:
    """keys, r2_global, r2_restricted, delta, n_shifts, n_shifts_sensitivity, p_value, p_value_sensitivity of rows that
    hold a vector of each kind (all of length n). All admissible shifts of a batch of rows are one Fourier transform,
    and only counts leave it. places: decimals that differences are compared in (all, if None)."""
    lo, hi = shifts(n, margin)
    shift = np.arange(lo, hi + 1)
    distant = (shift >= far) & (shift <= n - far)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            a, p, q = (np.stack([np.asarray(v, float) for v in frame[c]]) for c in (y, full, less))
            yy, tot = (a * a).sum(1), ((a - a.mean(1, keepdims=True)) ** 2).sum(1)
            observed = [_r2_rows(((a - x) ** 2).sum(1), tot) for x in (p, q)]
            null = [_r2_rows((yy + (x * x).sum(1))[:, None] - 2 * _turned(a, x)[:, lo : hi + 1], tot[:, None]) for x in (p, q)]
            delta, turned = observed[0] - observed[1], null[0] - null[1]
            if places is not None:
                delta, turned = np.round(delta, places), np.round(turned, places)
            hit = turned >= delta[:, None]
            out = frame[keys].copy()
            out["r2_global"], out["r2_restricted"], out["delta"] = *observed, delta
            out["n_shifts"], out["n_shifts_sensitivity"] = len(shift), int(distant.sum())
            out["p_value"] = (hit.sum(1) + 1) / (len(shift) + 1)
            out["p_value_sensitivity"] = (hit[:, distant].sum(1) + 1) / (distant.sum() + 1) if distant.any() else None
            yield out

    kinds = dict(rows.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return rows.select(*keys, y, full, less).mapInPandas(run, f"{named}, r2_global double, r2_restricted double, delta double, n_shifts long, n_shifts_sensitivity long, p_value double, p_value_sensitivity double")


def adjusted(rows: DataFrame, keys: list[str], p: str, name: str = "p_fdr") -> DataFrame:
    """Benjamini-Hochberg: the window runs over distinct p-values of each key (few, as they come from counted
    shifts), never over all rows; null p stays null."""
    counted = rows.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*keys).orderBy(p)
    whole = Window.partitionBy(*keys)
    ranked = counted.withColumn("_rank", F.sum("_n").over(up)).withColumn("_m", F.sum("_n").over(whole))
    ranked = ranked.withColumn("_q", F.col(p) * F.col("_m") / F.col("_rank"))
    down = Window.partitionBy(*keys).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    q = ranked.select(*keys, p, F.least(F.lit(1.0), F.min("_q").over(down)).alias(name))
    return rows.join(q, [*keys, p], "left")


def significant(p: Column, level: float = FDR_LEVEL) -> Column:
    return F.coalesce(p < level, F.lit(False))
