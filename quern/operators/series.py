"""Windows, lags and recurrences over keyed, ordered rows, and block transforms of short windows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import fresh


def order(key: str, by: Sequence[str]):
    return Window.partitionBy(key).orderBy(*by)


def sliding(df: DataFrame, key: str, by: Sequence[str], value: str, size: int, horizon: int | None = None, include_last: bool = False) -> DataFrame:
    """Windows of ``size`` values that begin at each row, as arrays ``window``; n - size of a key (the last full one is left out unless
    ``include_last``). With ``horizon`` also ``target``, the value ``size + horizon - 1`` rows on, for all n - size - horizon + 1."""
    w, left = order(key, by), fresh("left", df.columns)
    out = df.withColumn("window", F.collect_list(value).over(w.rowsBetween(0, size - 1))).withColumn(left, F.count("*").over(Window.partitionBy(key)) - F.row_number().over(w) + 1)
    if horizon is not None:
        return out.withColumn("target", F.lead(value, size + horizon - 1).over(w)).where(F.col(left) >= size + horizon).drop(left)
    return out.where(F.col(left) >= size + (not include_last)).drop(left)


def lagged(df: DataFrame, key: str, by: Sequence[str], states: Sequence[str], inputs: Sequence[str] = (), lags: int = 0) -> DataFrame:
    """For delay 0 to ``lags`` the states, then the inputs (``x_lag0``, ...), and the next states (``x_next``); complete rows only."""
    if lags < 0:
        raise ValueError("lags is 0 or more")
    w, seq, n = order(key, by), fresh("seq", df.columns), fresh("n", df.columns)
    names = {f"{c}_lag{k}": F.lag(c, k).over(w) for k in range(lags + 1) for c in (*states, *inputs)} | {f"{c}_next": F.lead(c, 1).over(w) for c in states}
    return df.withColumns(names | {seq: F.row_number().over(w), n: F.count("*").over(Window.partitionBy(key))}).where((F.col(seq) > lags) & (F.col(seq) < F.col(n))).drop(seq, n)


def hankel(df: DataFrame, key: str, by: Sequence[str], value: str, depth: int) -> DataFrame:
    """h0, h1, ...: the value and its ``depth`` - 1 successors, complete rows only."""
    w, left = order(key, by), fresh("left", df.columns)
    own = {f"h{i}": F.lead(value, i).over(w) for i in range(depth)} | {left: F.count("*").over(Window.partitionBy(key)) - F.row_number().over(w)}
    return df.withColumns(own).where(F.col(left) >= depth - 1).drop(left)


def blocks(df: DataFrame, key: str, by: Sequence[str], value: str, size: int) -> DataFrame:
    """(key, block, x): all values of a key in order, cut into arrays of ``size``; the last block of a key has what is left."""
    place = df.select(key, *by, F.col(value).cast("double").alias("x_")).withColumn("seq_", F.row_number().over(order(key, by)) - 1)
    own = place.groupBy(key, F.floor(F.col("seq_") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("seq_", "x_"))).alias("a_"))
    return own.select(key, "block", F.transform("a_", lambda v: v["x_"]).alias("x"))


def integrated(df: DataFrame, key: str, by: Sequence[str], rate: str, dt: float) -> DataFrame:
    """``integral``: the sum of rate * dt over all earlier rows of the key."""
    w = order(key, by).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("integral", F.coalesce(F.sum(F.col(rate) * dt).over(w), F.lit(0.0)))


def gradient(df: DataFrame, key: str, by: Sequence[str], value: str, dt: float) -> DataFrame:
    """Central differences, one-sided at the ends; 0 for a single row."""
    w = order(key, by)
    a, b, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return df.withColumn("gradient", F.coalesce((b - a) / (2 * dt), (b - v) / dt, (v - a) / dt, F.lit(0.0)))


def ema(df: DataFrame, key: str, by: Sequence[str], value: str, alpha: float) -> DataFrame:
    """(key, by, ema): y = alpha x + (1 - alpha) y before; the first y is x. Linear in the rows of a key, a batch of them at a time."""
    from .filters import Ema, filtered

    return filtered(df, Ema(alpha), key, by, [value]).withColumnRenamed("y", "ema")


def taper(i: Column, n: Column, alpha: float = 0.5) -> Column:
    """The symmetric tapered-cosine window of ``n`` points at index ``i``."""
    edge = alpha * (n - 1) / 2
    near = F.least(i, n - 1 - i)
    return F.when(n == 1, 1.0).when(near < edge, 0.5 * (1 + F.cos(F.lit(math.pi) * (near / edge - 1)))).otherwise(1.0)


def tapered(df: DataFrame, array: str, alpha: float = 0.5) -> DataFrame:
    n = F.size(array).cast("double")
    return df.withColumn(array, F.transform(array, lambda v, i: v * taper(i.cast("double"), n, alpha)))


def spectrum(df: DataFrame, array: str) -> DataFrame:
    """``re`` and ``im`` of the real Fourier transform of each array: n / 2 + 1 bins. Arrow batches, NumPy inside."""

    @F.pandas_udf("re array<double>, im array<double>")
    def run(x: pd.Series) -> pd.DataFrame:
        found = [np.fft.rfft(np.asarray(v, float)) if v is not None and len(v) else np.zeros(0, complex) for v in x]
        return pd.DataFrame({"re": [f.real for f in found], "im": [f.imag for f in found]})

    f = fresh("f", df.columns)
    return df.withColumn(f, run(F.col(array))).withColumns({"re": F.col(f"{f}.re"), "im": F.col(f"{f}.im")}).drop(f)


def shape_features(x: np.ndarray) -> dict[str, float]:
    """Plain shape statistics of a series, NaN as 0: moments, autocorrelation, runs, crossings, spectrum."""
    x = np.asarray(x, float)
    n, m, s = len(x), x.mean() if len(x) else 0.0, x.std() if len(x) else 0.0
    z = (x - m) / s if s > 0 else np.zeros(n)
    ac = np.array([np.dot(z[: n - k], z[k:]) / n if n > k else 0.0 for k in range(0, min(n, 40))]) if n else np.zeros(1)
    below = np.flatnonzero(ac < 1 / math.e)
    flips = np.diff(np.signbit(z)) if n > 1 else np.zeros(0, bool)
    runs = np.diff(np.flatnonzero(np.concatenate(([True], flips, [True])))) if n else np.zeros(1)
    power = np.abs(np.fft.rfft(z)) ** 2 if n else np.zeros(1)
    out = {
        "mean": m, "std": s, "skew": (z**3).mean() if n else 0.0, "kurtosis": (z**4).mean() - 3 if s > 0 else 0.0,
        "ac_1": ac[1] if len(ac) > 1 else 0.0, "ac_e_time": float(below[0]) if len(below) else float(len(ac)), "ac_first_min": float(np.argmax(np.diff(ac) > 0)) if len(ac) > 2 else 0.0,
        "zero_crossings": flips.mean() if n > 1 else 0.0, "longest_run": float(runs.max()), "mean_abs_step": np.abs(np.diff(x)).mean() if n > 1 else 0.0,
        "time_reversal": (np.diff(z) ** 3).mean() if n > 1 else 0.0, "outlier_share": (np.abs(z) > 2).mean() if n else 0.0,
        "spectral_centroid": float((power * np.arange(len(power))).sum() / power.sum() / max(1, len(power) - 1)) if power.sum() > 0 else 0.0, "low_power": float(power[: max(1, len(power) // 5)].sum() / power.sum()) if power.sum() > 0 else 0.0,
    }
    return {k: 0.0 if not np.isfinite(v) else float(v) for k, v in out.items()}


def kernel_features(x: np.ndarray, kernels: int = 128, seed: int = 0) -> np.ndarray:
    """Shares of positive values under random dilated kernels of nine points, weights -1 and 2, with drawn quantiles as bias."""
    x = np.asarray(x, float)
    rng, out = np.random.default_rng(seed), np.zeros(kernels)
    if len(x) < 9:
        x = np.pad(x, (0, 9 - len(x)))
    for k in range(kernels):
        w = np.full(9, -1.0)
        w[rng.choice(9, 3, replace=False)] = 2.0
        dilation = int(2 ** rng.uniform(0, math.log2(max(1.0, (len(x) - 1) / 8))))
        y = sum(w[i] * x[i * dilation : len(x) - (8 - i) * dilation] for i in range(9))
        out[k] = (y > np.quantile(y, rng.random())).mean()
    return out


def features(df: DataFrame, array: str, kernels: int = 0, seed: int = 0) -> DataFrame:
    """``features`` array of each series: shape statistics, and ``kernels`` random-kernel shares."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: [*shape_features(v).values(), *(kernel_features(v, kernels, seed) if kernels else ())])

    return df.withColumn("features", run(F.col(array)))
