"""Impulse responses, causal convolution, anti-aliased decimation and lag features.

Series are dense per story: k, then columns. The convolution of a story is one dense NumPy job (FFT) per
story and column block, so stories and columns spread; kernels are constants in the closure.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.config import KERNEL_SECONDS, SAMPLE_RATE, STEP_SECONDS


def _gamma_density(t: np.ndarray, shape: int) -> np.ndarray:
    return t ** (shape - 1) * np.exp(-t) / math.gamma(shape)


def double_gamma(rate: float = SAMPLE_RATE, seconds: float = KERNEL_SECONDS) -> np.ndarray:
    """Response peaking about 5 s with an undershoot about 15 s, scaled to sum 1."""
    t = np.arange(0, seconds, 1 / rate)[: int(round(rate * seconds))]
    h = _gamma_density(t, 6) - _gamma_density(t, 16) / 6
    return h / h.sum()


def single_gamma(rate: float = SAMPLE_RATE, seconds: float = KERNEL_SECONDS) -> np.ndarray:
    t = np.arange(0, seconds, 1 / rate)[: int(round(rate * seconds))]
    h = _gamma_density(t, 6)
    return h / h.sum()


def convolved(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Causal: the first len(x) values of the full convolution, column by column."""
    n = 1 << int(np.ceil(np.log2(len(x) + len(kernel) - 1))) if len(x) else 1
    return np.fft.irfft(np.fft.rfft(x, n, axis=0) * np.fft.rfft(kernel, n)[:, None], n, axis=0)[: len(x)]


def low_pass(down: int, half: int = 10, beta: float = 5.0) -> np.ndarray:
    """Windowed sinc of 2 * half * down + 1 taps with cut-off 1 / down, of unit gain at 0."""
    n = np.arange(-half * down, half * down + 1)
    h = np.sinc(n / down) * np.kaiser(len(n), beta)
    return h / h.sum()


def decimated(x: np.ndarray, down: int) -> np.ndarray:
    """Every down-th sample of the zero-phase filtered series, zeros beyond its ends; ceil(n / down) rows."""
    h = low_pass(down)
    half = len(h) // 2
    padded = np.concatenate([x, np.zeros((half, x.shape[1]))])
    return convolved(padded, h)[half : half + len(x)][::down]


def responses(series: DataFrame, columns: list[str], kernel: np.ndarray | None = None, rate: float = SAMPLE_RATE, step: float = STEP_SECONDS, decimate: bool = True, block: int = 16, kind: str = "float") -> DataFrame:
    """story, j, columns: the series convolved with the kernel and brought to one row per step, as floats or doubles."""
    h, down = double_gamma(rate) if kernel is None else np.asarray(kernel, float), int(rate * step)
    blocks = [columns[i : i + block] for i in range(0, len(columns), block)]

    def one(names: list[str]) -> DataFrame:
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("k")
            y = convolved(frame[names].to_numpy(float), h)
            y = decimated(y, down) if decimate else y
            out = pd.DataFrame(y.astype(np.float32 if kind == "float" else float), columns=names)
            out.insert(0, "j", np.arange(len(y), dtype=np.int64))
            out.insert(0, "story", frame["story"].iloc[0])
            return out

        columns_ = ", ".join(f"`{c}` {kind}" for c in names)
        return series.select("story", "k", *names).groupBy("story").applyInPandas(run, f"story {dict(series.dtypes)['story']}, j long, {columns_}")

    out = one(blocks[0])
    for names in blocks[1:]:
        out = out.join(one(names), ["story", "j"])
    return out


def taps(series: DataFrame, key: str, order: str, column: str, kernel: list[float], name: str, every: int = 1) -> DataFrame:
    """A short causal kernel as a sum of lags, then every `every`-th row from the first; gap-free order numbers."""
    line = Window.partitionBy(key).orderBy(order)
    parts = [F.lag(F.col(column).cast("double"), d, 0.0).over(line) * float(w) for d, w in enumerate(kernel)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole + p
    return series.withColumn(name, whole).where(F.col(order) % every == 0)


def lagged(series: DataFrame, key: str, order: str, columns: list[str], delays: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Adds column_lagD, 0 before the beginning."""
    line = Window.partitionBy(key).orderBy(order)
    return series.withColumns({f"{c}_lag{d}": F.lag(F.col(c).cast("double"), d, 0.0).over(line) for c in columns for d in delays})


def responses_of_lags(series: DataFrame, columns: list[str], rate: float = SAMPLE_RATE, step: float = STEP_SECONDS, delays: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Decimated without an impulse response, with lagged copies instead."""
    return lagged(responses(series, columns, [1.0], rate, step), "story", "j", columns, delays)
