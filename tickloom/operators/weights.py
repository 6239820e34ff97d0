"""Concurrency, uniqueness, return attribution, time decay and the sequential bootstrap.

Bars are (keys, ts[, close]) with unique ts; events (keys, t0, t1), t1 null: to the last bar.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.contracts import require
from tickloom.functions.columns import log, ordered, ratio, running
from tickloom.operators.joins import asof, interval_sums, range_join, with_position

KEYS = ("symbol",)


def concurrency(bars: DataFrame, events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts, concurrency) for the bars from the first t0 to the last t1: events with t0 <= ts <= t1."""
    last = bars.groupBy(*keys).agg(F.max("ts").alias("__last"))
    spans = events.join(last, list(keys)).select(*keys, "t0", F.coalesce("t1", "__last").alias("t1"))
    bounds = spans.groupBy(*keys).agg(F.min("t0").alias("__a"), F.max("t1").alias("__b"))
    inside = bars.select(*keys, "ts").join(bounds, list(keys)).where(F.col("ts").between(F.col("__a"), F.col("__b"))).select(*keys, "ts")
    counted = interval_sums(inside, spans, keys, "ts", "t0", "t1", {"concurrency": "1"})
    return counted.withColumn("concurrency", F.col("concurrency").cast("long"))


def _prefix_lookup(events: DataFrame, sums: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Events with the running values ``v`` up to t1 and before t0."""
    upto = asof(events.withColumn("ts", F.col("t1")), sums, keys, "ts", "v", alias="hi").drop("ts", "hi_at")
    return asof(upto.withColumn("ts", F.col("t0")), sums, keys, "ts", "v", strict=True, alias="lo").drop("ts", "lo_at")


def _interval_totals(bars: DataFrame, events: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, t0, t1, total, n) of a bar value (below 1e7 in size unless infinite) over [t0, t1]; nulls count as absent, and
    a total of nothing is null. Infinities and NaN are counted apart from the sums, so that they reach the totals of their
    own events only. Sums are decimals: of floating-point sums the difference would carry the rounding of all earlier bars."""
    w = running(list(keys), "ts")
    x, many = F.col(value).cast("double"), lambda c: F.count(F.when(c, 1)).over(w)
    odd = {"up": x == math.inf, "down": x == -math.inf, "nan": F.isnan(x)}
    finite = F.when(~(odd["up"] | odd["down"] | odd["nan"]), x).cast("decimal(27,20)")
    sums = bars.select(*keys, "ts", F.struct(F.count(value).over(w).alias("n"), F.coalesce(F.sum(finite).over(w), F.lit(0).cast("decimal(37,20)")).alias("s"), *(many(c).alias(k) for k, c in odd.items())).alias("v"))
    last = bars.groupBy(*keys).agg(F.max("ts").alias("__last"))
    spans = events.select(*keys, "t0", "t1").join(last, list(keys)).select(*keys, "t0", F.coalesce("t1", "__last").alias("t1"))
    met = _prefix_lookup(spans, sums, keys)
    less = lambda f: F.col(f"hi.{f}") - F.coalesce(F.col(f"lo.{f}"), F.lit(0))
    up, down = less("up") > 0, less("down") > 0
    total = F.when((less("nan") > 0) | (up & down), F.lit(math.nan)).when(up, F.lit(math.inf)).when(down, F.lit(-math.inf)).when(less("n") > 0, less("s").cast("double"))
    return met.select(*keys, "t0", "t1", total.alias("total"), less("n").alias("n"))


def average_uniqueness(bars: DataFrame, events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, t0, weight): mean of 1 / concurrency over the life of each event, by prefix sums."""
    shares = concurrency(bars, events, keys).withColumn("u", ratio(F.lit(1.0), F.col("concurrency")))
    totals = _interval_totals(shares, events, "u", keys)
    return totals.select(*keys, "t0", ratio(F.col("total"), F.col("n")).alias("weight"))


def return_attribution(bars: DataFrame, events: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, t0, weight): |sum of log returns / concurrency| over the life of each event."""
    step = log(F.col("close")) - F.lag(log(F.col("close"))).over(ordered(list(keys), "ts"))
    moves = bars.select(*keys, "ts", step.alias("r")).join(concurrency(bars, events, keys), [*keys, "ts"]).withColumn("x", ratio(F.col("r"), F.col("concurrency")))
    return _interval_totals(moves, events, "x", keys).select(*keys, "t0", F.abs("total").alias("weight"))


def time_decay(weights: DataFrame, last: float = 1.0, time: str = "t0", weight: str = "weight", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``weights`` plus ``decay``, linear in cumulated weight: 1 for the newest, ``last`` for the oldest if not negative;
    else the oldest share -last gets 0."""
    require(last > -1, "last must be above -1")
    total = F.sum(weight).over(Window.partitionBy(*keys))
    slope = ratio(F.lit(1.0 - last), total) if last >= 0 else ratio(F.lit(1.0), (last + 1) * total)
    return weights.withColumn("decay", F.greatest(F.lit(0.0), 1 - slope * total + slope * F.sum(weight).over(running(list(keys), time))))


def indicator_matrix(bars: DataFrame, events: DataFrame, bucket: float | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Sparse indicator matrix: (keys, ts, t0) of the bars within each event."""
    last = bars.groupBy(*keys).agg(F.max("ts").alias("__last"))
    spans = events.select(*keys, "t0", "t1").join(last, list(keys)).select(*keys, "t0", F.coalesce("t1", "__last").alias("t1"))
    return range_join(bars.select(*keys, "ts"), spans, keys, "ts", "t0", "t1", bucket).select(*keys, "ts", "t0")


def matrix_uniqueness(matrix: DataFrame, row: str = "ts", event: str = "t0", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, event, uniqueness): mean over an event's rows of 1 / number of events in the row."""
    rows = matrix.groupBy(*keys, row).agg(F.count("*").alias("__c"))
    return matrix.join(rows, [*keys, row]).groupBy(*keys, event).agg(F.avg(ratio(F.lit(1.0), F.col("__c"))).alias("uniqueness"))


def draw_sequential(start: np.ndarray, end: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    """Sequential bootstrap over events [start, end] (bar numbers): each draw weighs events by their uniqueness given those
    drawn so far. A draw changes the weights of the events that overlap it only; sums of blocks of weights find the next one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    n = len(start)
    if not n:
        return np.zeros(0, np.int64)
    longest, counts = int((end - start).max()) + 1, np.zeros(int(end.max()) + 2)
    block = max(1, math.isqrt(n))
    edges = np.arange(0, n, block)
    weight = np.ones(n)
    sums = np.add.reduceat(weight, edges)
    drawn = np.empty(length, np.int64)
    for k in range(length):
        upto = np.cumsum(sums)
        at = rng.random() * upto[-1]
        j = min(int(np.searchsorted(upto, at, side="right")), len(edges) - 1)
        inner = np.cumsum(weight[edges[j] : edges[j] + block])
        i = int(edges[j] + min(np.searchsorted(inner, at - (upto[j] - sums[j]), side="right"), len(inner) - 1))
        drawn[k] = i
        counts[start[i] : end[i] + 1] += 1
        low, high = np.searchsorted(start, [start[i] - longest, end[i] + 1])
        first, last = int(start[low]), int(end[low:high].max())
        mass = np.append(0.0, np.cumsum(1.0 / (1.0 + counts[first : last + 1])))
        weight[low:high] = (mass[end[low:high] + 1 - first] - mass[start[low:high] - first]) / (end[low:high] - start[low:high] + 1)
        touched = slice(low // block, (high - 1) // block + 1)
        sums[touched] = np.add.reduceat(weight[edges[touched][0] : min(n, edges[touched][-1] + block)], edges[touched] - edges[touched][0])
    return order[drawn]


def sample_uniqueness(start: np.ndarray, end: np.ndarray, drawn: np.ndarray) -> float:
    """Mean uniqueness of a drawn sample."""
    change = np.zeros(int(end.max()) + 2)
    np.add.at(change, start[drawn], 1)
    np.add.at(change, end[drawn] + 1, -1)
    counts = np.cumsum(change)
    sums = np.append(0.0, np.cumsum(np.divide(1.0, counts, out=np.zeros_like(counts), where=counts > 0)))
    return float(((sums[end[drawn] + 1] - sums[start[drawn]]) / (end[drawn] - start[drawn] + 1)).mean())


def random_events(count: int, bars: int, longest: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Random intervals, sorted, one for each start (a later one replaces an earlier one)."""
    chosen: dict[int, int] = {}
    for _ in range(count):
        start = int(rng.integers(0, bars))
        chosen[start] = start + int(rng.integers(1, longest))
    pairs = sorted(chosen.items())
    return np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])


def sequential_bootstrap(bars: DataFrame, events: DataFrame, samples: int = 1, length: int | None = None, seed: int = 0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, sample, draw, t0): independent sequential bootstraps of each key's events, of ``length`` draws (as many as it
    has events by default). Draws depend on all before them, so a sample of a key is one task that holds two numbers an
    event; events that begin or end off the bars count from the next bar on, up to the last one before."""
    last = bars.groupBy(*keys).agg(F.max("ts").alias("__last"))
    spans = events.join(last, list(keys)).select(*keys, "t0", F.coalesce("t1", "__last").alias("t1"))
    number = with_position(bars.select(*keys, "ts"), ["ts"], keys, "__n")
    begin = asof(spans.withColumn("ts", F.col("t0")), number, keys, "ts", "__n", forward=True, alias="s").drop("ts", "s_at")
    whole = asof(begin.withColumn("ts", F.col("t1")), number, keys, "ts", "__n", alias="e").where("s <= e").select(*keys, "t0", "s", "e")
    rows = whole.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).select(*keys, "sample", "t0", "s", "e")
    schema = rows.select(*keys, "sample", F.lit(0).cast("long").alias("draw"), "t0").schema

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["s", "t0"], kind="stable").reset_index(drop=True)
        sample = int(part["sample"].iloc[0])
        text = "|".join(str(part[k].iloc[0]) for k in keys)
        rng = np.random.default_rng([seed, sample, zlib.crc32(text.encode())])
        drawn = draw_sequential(part["s"].to_numpy(), part["e"].to_numpy(), length or len(part), rng)
        return part.loc[drawn, [*keys, "sample", "t0"]].assign(draw=np.arange(len(drawn)))[schema.names]

    return rows.groupBy(*keys, "sample").applyInPandas(run, schema)


def monte_carlo_jobs(spark: SparkSession, count: int = 10, bars: int = 100, longest: int = 5, trials: int = 1_000_000) -> DataFrame:
    """One row a trial."""
    require(longest > 1, "events last one bar at least")
    return spark.range(trials).select(F.col("id").alias("trial"), F.lit(count).alias("count"), F.lit(bars).alias("bars"), F.lit(longest).alias("longest"))


def monte_carlo_uniqueness(jobs: DataFrame, seed: int = 0) -> DataFrame:
    """(trial, standard, sequential): mean uniqueness of a plain and of a sequential bootstrap of random events."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for trial, count, bars, longest in part.itertuples(index=False):
                rng = np.random.default_rng([seed, int(trial)])
                start, end = random_events(count, bars, longest, rng)
                plain = sample_uniqueness(start, end, rng.integers(0, len(start), len(start)))
                out.append((trial, plain, sample_uniqueness(start, end, draw_sequential(start, end, len(start), rng))))
            yield pd.DataFrame(out, columns=["trial", "standard", "sequential"])

    return jobs.select("trial", "count", "bars", "longest").mapInPandas(run, "trial long, standard double, sequential double")
