"""Volatility targets, vertical barriers, triple-barrier events and labels, per key.

Tables are long: bars (keys, ts, close) with unique ts in a key, events (keys, t0, t1, trgt, side).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.contracts import require
from tickloom.functions.columns import ordered, quotient
from tickloom.operators.joins import asof, range_join

KEYS = ("symbol",)


def daily_returns(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Return of each bar over the last bar strictly before one day earlier; bars without one are left out. A null close on
    either side makes the return null."""
    back = bars.select(*keys, F.col("ts").alias("__ts"), F.col("close").alias("__close"), (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("ts"))
    found = asof(back, bars.select(*keys, "ts", F.struct("close").alias("close")), keys, "ts", "close", strict=True, alias="before")
    return found.where(F.col("before").isNotNull()).select(*keys, F.col("__ts").alias("ts"), (quotient(F.col("__close"), F.col("before.close")) - 1).alias("ret"))


def daily_volatility(bars: DataFrame, span: int = 100, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts, vol): exponentially weighted deviation of daily returns (bias corrected); the first one is null. Infinite
    returns count as missing: they age the others and repeat the last deviation."""
    returns = daily_returns(bars, keys)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts", kind="stable")
        return part.assign(vol=part["ret"].ewm(span=span).std())[[*keys, "ts", "vol"]]

    schema = returns.select(*keys, "ts", F.col("ret").alias("vol")).schema
    return returns.groupBy(*keys).applyInPandas(run, schema).withColumn("vol", F.nanvl("vol", F.lit(None).cast("double")))


def vertical_barriers(events: DataFrame, bars: DataFrame, num_bars: int = 1, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, t0, t1): the bar ``num_bars`` on; events that match no bar or lie too late are left out."""
    ahead = bars.select(*keys, F.col("ts").alias("t0"), F.lead("ts", num_bars).over(ordered(list(keys), "ts")).alias("t1"))
    return events.select(*keys, "t0").join(ahead, [*keys, "t0"]).where(F.col("t1").isNotNull())


def barrier_touches(bars: DataFrame, events: DataFrame, pt: float, sl: float, bucket_seconds: float | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``events`` plus first times ``sl`` and ``pt`` at which the path return passes -sl * trgt or pt * trgt.

    The path runs over [t0, t1], to the last bar if t1 is null; a multiplier of 0 or less switches a barrier off. Bars and
    events meet in time buckets, not over the whole key.
    """
    last = bars.groupBy(*keys).agg(F.max("ts").alias("__last"))
    spans = events.select(*keys, "t0", "t1", "trgt", "side").join(last, list(keys)).withColumn("__high", F.coalesce("t1", "__last"))
    start = bars.select(*keys, F.col("ts").alias("t0"), F.col("close").alias("__p0"))
    met = range_join(bars.select(*keys, "ts", "close"), spans.join(start, [*keys, "t0"]), keys, "ts", "t0", "__high", bucket_seconds)
    gain = (quotient(F.col("close"), F.col("__p0")) - 1) * F.coalesce("side", F.lit(1.0))
    never = F.lit(None).cast(bars.schema["ts"].dataType)
    low = F.min(F.when(gain < -sl * F.col("trgt"), F.col("ts"))) if sl > 0 else F.first(never)
    high = F.min(F.when(gain > pt * F.col("trgt"), F.col("ts"))) if pt > 0 else F.first(never)
    touched = met.groupBy(*keys, "t0").agg(low.alias("sl"), high.alias("pt"))
    return events.join(touched, [*keys, "t0"], "left")


def triple_barrier_events(bars: DataFrame, events: DataFrame, pt: float, sl: float, min_ret: float, bucket_seconds: float | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, t0, t1, trgt[, side]) from events (keys, t0, t1, trgt[, side]): those with trgt > min_ret, t1 the earliest of
    the three barriers. Without a side column the side is long and both barriers use ``pt``."""
    with_side = "side" in events.columns
    wanted = events.where(F.col("trgt") > min_ret)
    if not with_side:
        wanted, sl = wanted.withColumn("side", F.lit(1.0)), pt
    touched = barrier_touches(bars, wanted, pt, sl, bucket_seconds, keys)
    return touched.select(*keys, "t0", F.least("t1", "sl", "pt").alias("t1"), "trgt", *(["side"] if with_side else []))


def label_of(ret: Column, sided: bool) -> Column:
    """Sign of the return; with a side losses are 0. NaN (a path that starts at a price of 0) counts as a gain, as in Spark's order."""
    sign = F.when(F.isnan(ret), 1.0).otherwise(F.signum(ret))
    return F.when(ret <= 0, 0.0).otherwise(sign) if sided else sign


def bins(events: DataFrame, bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, t0, ret, bin) of events with a t1; prices are those of the first bar at or after t0 and t1."""
    done = events.where(F.col("t1").isNotNull())
    price = bars.select(*keys, "ts", "close")
    first = asof(done.withColumn("ts", F.col("t0")), price, keys, "ts", "close", forward=True, alias="p0").drop("ts")
    last = asof(first.withColumn("ts", F.col("t1")), price, keys, "ts", "close", forward=True, alias="p1")
    sided = "side" in events.columns
    ret = (quotient(F.col("p1"), F.col("p0")) - 1) * (F.col("side") if sided else F.lit(1.0))
    return last.withColumn("ret", ret).select(*keys, "t0", "ret", label_of(F.col("ret"), sided).alias("bin"))


def drop_labels(labels: DataFrame, min_share: float = 0.05) -> DataFrame:
    """Drop the rarest class again and again while its share is at most ``min_share`` and three classes are left. A row a
    class reaches the driver; more than 10,000 classes are an error."""
    counts = {r["bin"]: r["n"] for r in labels.where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("n")).limit(10_001).collect()}
    require(len(counts) <= 10_000, "more than 10,000 classes")
    gone = []
    while len(counts) > 2:
        rare = min(counts, key=lambda k: (counts[k], k))
        if counts[rare] / sum(counts.values()) > min_share:
            break
        gone.append(rare)
        del counts[rare]
    return labels.where(~F.col("bin").isin(gone)) if gone else labels
