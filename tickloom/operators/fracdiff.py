"""Fractional differencing: weights, expanding and fixed-width forms, and the search for the least order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.contracts import require

KEYS = ("symbol",)


def weights(d: float, size: int) -> list[float]:
    """Oldest first; the newest has weight 1."""
    w = [1.0]
    for k in range(1, size):
        w.append(-w[-1] * (d - k + 1) / k)
    return w[::-1]


def weights_fixed(d: float, threshold: float) -> list[float]:
    """Weights down to the last one of at least ``threshold``, oldest first."""
    require(threshold > 0, "threshold must be positive")
    w = [1.0]
    while abs(x := -w[-1] * (d - len(w) + 1) / len(w)) >= threshold:
        w.append(x)
    return w[::-1]


def weight_curves(spark: SparkSession, orders: list[float], size: int) -> DataFrame:
    """(d, lag, weight), what a plot of weights shows."""
    rows = [(float(d), lag, w) for d in orders for lag, w in enumerate(weights(d, size)[::-1])]
    return spark.createDataFrame(rows, "d double, lag int, weight double")


def expanding(df: DataFrame, d: float, threshold: float = 0.01, value: str = "close", time: str = "ts", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, time, value): all history weighs in; rows whose lost weight share is above ``threshold`` are skipped, and
    rows without a finite value. A series is convolved in one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(time, kind="stable")
        raw = part[value].to_numpy(float)
        filled = part[value].ffill()
        solid = filled.notna().to_numpy()
        x, at = filled.to_numpy(float)[solid], np.flatnonzero(solid)
        if not len(x):
            return part.iloc[:0][[*keys, time, value]]
        w = np.array(weights(d, len(x)))
        lost = np.cumsum(np.abs(w))
        skip = int((lost / lost[-1] > threshold).sum())
        size = 1 << (2 * len(x) - 1).bit_length()
        y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(w[::-1], size), size)[: len(x)] if len(x) > 4096 else np.convolve(x, w[::-1])[: len(x)]
        keep = (np.arange(len(x)) >= skip) & np.isfinite(raw[at])
        return part.iloc[at[keep]][[*keys, time, value]].assign(**{value: y[keep]})

    rows = df.select(*keys, time, F.col(value).cast("double").alias(value))
    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


def fixed_width(df: DataFrame, d: float, threshold: float = 1e-5, value: str = "close", time: str = "ts", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, time, value): a sliding dot product with the weights of at least ``threshold``; expressions only."""
    w = weights_fixed(d, threshold)
    by = Window.partitionBy(*keys).orderBy(time)
    finite = F.when(F.abs(F.nanvl(value, F.lit(None).cast("double"))) < float("inf"), F.col(value))
    rows = df.select(*keys, time, F.col(value).cast("double").alias(value)).withColumn("__ok", finite.isNotNull())
    rows = rows.withColumn("__x", F.last(F.nanvl(value, F.lit(None).cast("double")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("__x is not null")
    rows = rows.withColumn("__v", F.collect_list("__x").over(by.rowsBetween(1 - len(w), 0))).where((F.size("__v") == len(w)) & F.col("__ok"))
    products = F.zip_with("__v", F.array(*map(F.lit, w)), lambda x, y: x * y)
    return rows.select(*keys, time, F.aggregate(products, F.lit(0.0), lambda a, x: a + x).alias(value))


#: MacKinnon's response surface for the unit-root test with a constant, one variable. Bounds of the statistic;
#: coefficients of the normal quantile for small and for large p; critical values at 1, 5 and 10 % in powers of 1/n.
_TAU_MAX, _TAU_MIN, _TAU_STAR = 2.74, -18.83, -1.61
_SMALL_P = (2.1659, 1.4412, 0.038269)
_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
_CRITICAL_5 = (-2.86154, -2.8903, -4.234, -40.04)


def adf_p_value(stat: float) -> float:
    if stat > _TAU_MAX:
        return 1.0
    if stat < _TAU_MIN:
        return 0.0
    z = sum(c * stat**i for i, c in enumerate(_SMALL_P if stat <= _TAU_STAR else _LARGE_P))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf(df: DataFrame, value: str = "close", time: str = "ts", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, stat, p_value, lags, n_obs, critical_5): unit-root test with a constant and one lag. The normal equations
    are aggregated; only their 3 x 3 sums of each key are solved in Python."""
    by = Window.partitionBy(*keys).orderBy(time)
    steps = df.select(*keys, time, F.lag(value).over(by).alias("l"), (F.col(value) - F.lag(value).over(by)).alias("dy"))
    steps = steps.withColumn("dl", F.lag("dy").over(by)).where("dl is not null and dy is not null")
    names = ["l", "dl", "one", "dy"]
    steps = steps.withColumn("one", F.lit(1.0))
    sums = steps.groupBy(*keys).agg(*(F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j))

    def solve(parts):
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                m = np.array([[row[f"s_{min(i, j)}_{max(i, j)}"] for j in range(4)] for i in range(4)])
                n = m[2, 2]
                inverse = np.linalg.pinv(m[:3, :3])
                beta = inverse @ m[:3, 3]
                left = max(m[3, 3] - beta @ m[:3, 3], 0.0)
                se = math.sqrt(left / (n - 3) * inverse[0, 0]) if n > 3 else 0.0
                stat = beta[0] / se if se > 0 else float("nan")
                critical = sum(c / n**i for i, c in enumerate(_CRITICAL_5))
                out.append({**{k: row[k] for k in keys}, "stat": stat, "p_value": adf_p_value(stat) if stat == stat else float("nan"), "lags": 1, "n_obs": int(n), "critical_5": critical})
            yield pd.DataFrame(out, columns=[*keys, "stat", "p_value", "lags", "n_obs", "critical_5"])

    schema = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(solve, f"{schema}, stat double, p_value double, lags long, n_obs long, critical_5 double")


def least_order(df: DataFrame, threshold: float = 0.01, orders: list[float] | None = None, value: str = "close", time: str = "ts", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, d, stat, p_value, lags, n_obs, critical_5, corr) of the fixed-width differences of log prices for each order."""
    logs = df.where(F.col(value) > 0).select(*keys, time, F.ln(value).alias("x"))
    out = None
    for d in orders if orders is not None else [i / 10 for i in range(11)]:
        diff = fixed_width(logs, d, threshold, "x", time, keys)
        corr = diff.withColumnRenamed("x", "y").join(logs, [*keys, time]).groupBy(*keys).agg(F.corr("x", "y").alias("corr"))
        row = adf(diff, "x", time, keys).join(corr, list(keys)).select(*keys, F.lit(float(d)).alias("d"), "stat", "p_value", "lags", "n_obs", "critical_5", "corr")
        out = row if out is None else out.unionByName(row)
    return out
