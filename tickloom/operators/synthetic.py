"""Trading rules on simulated Ornstein-Uhlenbeck paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.contracts import require
from tickloom.functions.columns import ratio


def simulate(forecast: float, half_life: float, sigma: float, paths: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    """paths x steps prices from 0, drawn step by step for all paths."""
    phi = 2.0 ** (-1.0 / half_life)
    out, price = np.empty((paths, steps)), np.zeros(paths)
    for k in range(steps):
        price = (1.0 - phi) * forecast + phi * price + rng.normal(0.0, sigma, paths)
        out[:, k] = price
    return out


def outcomes(paths: np.ndarray, take: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """take x stop x paths exit prices: the first price above take or below -stop, else the last. First passages of each
    level are found once and met in pairs."""
    n, steps = paths.shape
    high, low = np.maximum.accumulate(paths, axis=1), np.minimum.accumulate(paths, axis=1)
    first_high = np.stack([(high <= x).sum(axis=1) for x in take])
    first_low = np.stack([(low >= -x).sum(axis=1) for x in stop])
    at = np.minimum(np.minimum(first_high[:, None, :], first_low[None, :, :]), steps - 1)
    return paths[np.arange(n)[None, None, :], at]


def trading_rules(spark: SparkSession, forecasts: list[float], half_lives: list[float], take: list[float], stop: list[float], sigma: float = 1.0, paths: int = 10_000, steps: int = 100, seed: int = 0, blocks: int = 1) -> DataFrame:
    """(forecast, half_life, sigma, max_holding_period, profit_taking, stop_loss, mean, std, sharpe_ratio) for each pair
    of levels. All settings share random numbers. ``blocks`` > 1 deals paths to that many tasks a setting, each with its
    own stream; 1 draws as a single generator of ``seed`` does."""
    require(paths > 0 and steps > 0 and sigma >= 0, "paths and steps must be positive, sigma not negative")
    require(all(x > 0 for x in half_lives), "half-lives must be positive")
    require(all(x >= 0 for x in [*take, *stop]), "levels must not be negative")
    require(1 <= blocks <= paths, "blocks between 1 and paths")
    sizes = [len(x) for x in np.array_split(np.arange(paths), blocks)]
    grid = spark.createDataFrame([(float(f), float(h), b, sizes[b]) for f in forecasts for h in half_lives for b in range(blocks)], "forecast double, half_life double, block int, n int").repartition(max(1, len(forecasts) * len(half_lives) * blocks), "forecast", "half_life", "block")
    up, down = np.asarray(take, float), np.asarray(stop, float)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for forecast, half_life, block, n in part.itertuples(index=False):
                rng = np.random.default_rng(seed if blocks == 1 else np.random.SeedSequence(seed).spawn(blocks)[block])
                x = outcomes(simulate(forecast, half_life, sigma, n, steps, rng), up, down)
                mean = x.mean(axis=2)
                yield pd.DataFrame({"forecast": forecast, "half_life": half_life, "profit_taking": np.repeat(up, len(down)), "stop_loss": np.tile(down, len(up)), "n": n, "m": mean.ravel(), "q": ((x - mean[:, :, None]) ** 2).sum(axis=2).ravel()})

    parts = grid.mapInPandas(run, "forecast double, half_life double, profit_taking double, stop_loss double, n long, m double, q double")
    total = parts.groupBy("forecast", "half_life", "profit_taking", "stop_loss").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("q").alias("q"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") + F.col("b") - F.col("n") * mean * mean) / F.col("n")))
    return total.select("forecast", "half_life", F.lit(float(sigma)).alias("sigma"), F.lit(steps).alias("max_holding_period"), "profit_taking", "stop_loss", mean.alias("mean"), std.alias("std"), ratio(mean, F.when(std > 0, std)).alias("sharpe_ratio"))
