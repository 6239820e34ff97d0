"""Sharpe ratios and the probability of backtest overfitting from long returns (pos, strategy, ret)."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.contracts import require, require_none
from tickloom.functions.columns import ratio

Metric = Callable[[Column, Column, Column], Column]
SeriesMetric = Callable[[np.ndarray], float]


def sharpe_of(n: Column, total: Column, squares: Column, risk_free: float = 0.0, periods: float | None = 252) -> Column:
    """Sharpe ratio from a count, a sum and a sum of squares; null without deviation."""
    mean = ratio(total, n)
    variance = ratio(squares - total * mean, n - 1)
    deviation = F.when(variance > 1e-30, F.sqrt(variance))
    return ratio(mean - risk_free, deviation) * F.lit(1.0 if periods is None else math.sqrt(periods))


def sharpe_ratio(returns: DataFrame, keys: tuple[str, ...] = ("strategy",), risk_free: float | str = 0.0, periods: float | None = 252) -> DataFrame:
    """(keys, sharpe); ``risk_free`` a period's rate or a column of rates."""
    excess = F.col("ret") - (F.col(risk_free) if isinstance(risk_free, str) else F.lit(risk_free))
    scale = F.lit(1.0 if periods is None else math.sqrt(periods))
    return returns.withColumn("__x", excess).groupBy(*keys).agg((ratio(F.avg("__x"), F.stddev_samp("__x")) * scale).alias("sharpe"))


def sharpe_metric(annual_risk_free: float = 0.0, periods: float = 252) -> Metric:
    require(periods > 0, "periods must be positive")
    return lambda n, s, q: sharpe_of(n, s, q, annual_risk_free / periods, periods)


def mean_metric() -> Metric:
    return lambda n, s, q: ratio(s, n)


def check_returns(returns: DataFrame, partitions: int) -> int:
    require(partitions >= 2 and partitions % 2 == 0, "an even number of partitions, two at least")
    require_none(returns, F.col("ret").isNull() | F.isnan("ret") | (F.abs("ret") == float("inf")), "returns must be finite")
    row = returns.agg(F.count_distinct("strategy").alias("k"), F.count_distinct("pos").alias("n")).first()
    require(row["k"] >= 2, "two strategies at least")
    require(row["n"] >= partitions and row["n"] % partitions == 0, "rows must divide into the partitions")
    return row["n"]


def relative_rank(metric: str, by: list[str], total: Column) -> Column:
    """Average-tie rank in ascending order over (total + 1); null metrics have none."""
    w = Window.partitionBy(*by)
    rank = F.rank().over(w.orderBy(F.col(metric).asc_nulls_last())) + (F.count("*").over(Window.partitionBy(*by, metric)) - 1) / 2
    return F.when(F.col(metric).isNotNull(), rank / (total + 1))


def logit(x: Column) -> Column:
    return F.ln(ratio(x, 1 - x))


def _series_metrics(returns: DataFrame, partitions: int, n: int, metric: SeriesMetric) -> DataFrame:
    """(split, strategy, is_metric, oos_metric) by a function of a whole series of returns: a strategy is one task."""
    halves = [np.isin(np.arange(n) // (n // partitions), c) for c in combinations(range(partitions), partitions // 2)]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("pos")["ret"].to_numpy(float)
        told = [(i, part["strategy"].iloc[0], float(metric(x[inside])), float(metric(x[~inside]))) for i, inside in enumerate(halves)]
        return pd.DataFrame(told, columns=["split", "strategy", "is_metric", "oos_metric"])

    found = returns.select("pos", "strategy", "ret").groupBy("strategy").applyInPandas(run, "split int, strategy string, is_metric double, oos_metric double")
    known = [F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("is_metric", "oos_metric")]
    found = found.select("split", "strategy", *known)
    every = F.count("is_metric").over(Window.partitionBy("split"))
    broken = F.raise_error(F.lit("the metric knows no strategy")).cast("double")
    return found.withColumn("is_metric", F.when(every == 0, broken).otherwise(F.col("is_metric")))


def cscv(returns: DataFrame, partitions: int = 16, metric: Metric | None = None, series_metric: SeriesMetric | None = None) -> DataFrame:
    """(split, in_blocks, out_blocks, strategy, is_metric, oos_metric, relative_rank, logit): the best strategy of each
    half of the blocks and its standing in the other half. Returns are aggregated once to a block's count, sum and sum
    of squares; splits only add those up. Ties for the best go to the smallest name. A ``series_metric`` that these sums
    don't determine sees the returns of each half in order; a split in which it knows no strategy is an error."""
    metric = metric or sharpe_metric()
    n, spark = check_returns(returns, partitions), returns.sparkSession
    blocks = returns.groupBy(F.floor(F.col("pos") / (n // partitions)).cast("int").alias("block"), "strategy").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    half = [list(c) for c in combinations(range(partitions), partitions // 2)]
    rows = [(i, b, b in c) for i, c in enumerate(map(set, half)) for b in range(partitions)]
    splits = spark.createDataFrame(rows, "split int, block int, inside boolean")
    part = lambda c, flag: F.sum(F.when(F.col("inside") == flag, F.col(c)))
    if series_metric:
        sums = _series_metrics(returns, partitions, n, series_metric)
    else:
        sums = blocks.join(splits, "block").groupBy("split", "strategy").agg(metric(*(part(c, True) for c in "nsq")).alias("is_metric"), metric(*(part(c, False) for c in "nsq")).alias("oos_metric"))
    by = Window.partitionBy("split")
    ranked = sums.withColumn("relative_rank", relative_rank("oos_metric", ["split"], F.count("*").over(by)))
    best = ranked.withColumn("__r", F.row_number().over(by.orderBy(F.col("is_metric").desc_nulls_last(), "strategy"))).where("__r = 1 and is_metric is not null").drop("__r")
    named = spark.createDataFrame([(i, c, [b for b in range(partitions) if b not in c]) for i, c in enumerate(half)], "split int, in_blocks array<int>, out_blocks array<int>")
    return named.join(best, "split").withColumn("logit", logit(F.col("relative_rank")))


def overfitting_probability(results: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row (pbo): the share of splits whose logit is at most ``threshold``; an error if there are none."""
    known = F.count("logit")
    return results.agg(F.when(known > 0, F.avg(F.when(F.col("logit").isNotNull(), (F.col("logit") <= threshold).cast("double")))).otherwise(F.raise_error(F.lit("no valid split")).cast("double")).alias("pbo"))
