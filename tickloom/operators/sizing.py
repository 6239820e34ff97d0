"""Bet sizes from probabilities and from price divergence, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.contracts import require
from tickloom.functions.columns import normal_cdf, ratio
from tickloom.operators.joins import interval_sums

KEYS = ("symbol",)


def raw_signal(prob: Column, pred: Column, classes: int) -> Column:
    """pred * (2 Phi(z) - 1), z = (p - 1/n) / sqrt(p (1 - p)); full size at p = 0 or 1."""
    p = prob.cast("double")
    z = ratio(p - 1.0 / classes, F.sqrt(p * (1 - p)))
    edge = F.when(p > 1.0 / classes, 6.0).otherwise(-6.0)
    return pred * (2 * normal_cdf(F.coalesce(z, edge)) - 1)


def discretise(signal: Column, step: float) -> Column:
    """Round half to even to multiples of ``step``, clipped to [-1, 1]."""
    require(0 < step <= 1, "step in (0, 1]")
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.rint(signal / step) * step))


def average_active(signals: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, t, signal): at each start or end, the mean of signals with t0 <= t < t1 (no t1: for ever); none: 0."""
    times = signals.select(*keys, F.col("t0").alias("t")).union(signals.where(F.col("t1").isNotNull()).select(*keys, "t1")).distinct()
    return average_active_at(signals, times, keys)


def average_active_at(signals: DataFrame, times: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    sums = interval_sums(times, signals.where("t1 is null or t0 < t1"), keys, "t", "t0", "t1", {"n": "1", "s": "signal"}, closed=False)
    return sums.select(*keys, "t", F.when(F.col("n") > 0.5, ratio(F.col("s"), F.col("n"))).otherwise(0.0).alias("signal"))


def signal(events: DataFrame, step: float, classes: int = 2, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, t, signal) from events (keys, t0, t1, prob, pred[, side])."""
    raw = raw_signal(F.col("prob"), F.col("pred"), classes)
    sized = events.withColumn("signal", raw * F.col("side") if "side" in events.columns else raw)
    return average_active(sized, keys).withColumn("signal", discretise(F.col("signal"), step))


def bet_size(w: Column, divergence: Column) -> Column:
    return ratio(divergence, F.sqrt(w + divergence * divergence))


def target_position(w: Column, forecast: Column, price: Column, most: Column) -> Column:
    """Truncated toward zero."""
    return (bet_size(w, forecast - price) * most).cast("int")


def inverse_price(forecast: Column, w: Column, size: Column) -> Column:
    return forecast - size * F.sqrt(ratio(w, 1 - size * size))


def limit_price(target: Column, position: Column, forecast: Column, w: Column, most: Column) -> Column:
    """Mean break-even price of the unit steps from ``position`` to ``target``; null if equal; error at or beyond ``most``."""
    step = F.when(target >= position, 1).otherwise(-1)
    steps = F.sequence(position + step, target, step)
    prices = F.transform(steps, lambda p: inverse_price(forecast, w, p / most.cast("double")))
    total = F.aggregate(prices, F.lit(0.0), lambda a, x: a + x)
    beyond = F.greatest(F.abs(target), F.abs(position + step)) >= most
    return F.when(target == position, F.lit(None).cast("double")).when(beyond, F.raise_error(F.lit("position must stay within the maximum")).cast("double")).otherwise(total / F.size(steps))


def calibrate_w(divergence: Column, size: Column) -> Column:
    return divergence * divergence * (ratio(F.lit(1.0), size * size) - 1)
