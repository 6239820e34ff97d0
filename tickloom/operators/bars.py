"""Event-time bars. Folds whose state resets at data-dependent rows stream over sorted rows; the rest is windows.

A fold is sequential within ``keys`` (per symbol by default; add a session date to fold
days in parallel; an empty list folds the whole table as one series in one task).
Rows are ordered by timestamp and id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.contracts import require, require_columns
from tickloom.functions.columns import ordered, ratio, running

ORDER = ("timestamp", "id")


@dataclass(frozen=True)
class Bars:
    """``sample``: the rows that close a bar; ``ohlcv``: the bars."""

    sample: DataFrame
    ohlcv: DataFrame


def prepare_trades(df: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Tick rule (sign of the price change, 0 takes the last sign, leading ones +1) and signed measures."""
    require_columns(df, "timestamp", "price", "size")
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit("UNKNOWN"))
    if "id" not in df.columns:
        df = df.withColumn("id", F.lit(0).cast("long"))
    step = F.signum(F.col("price") - F.lag("price").over(ordered(list(keys), *ORDER)))
    sign = F.coalesce(F.last(F.nullif("__step", F.lit(0.0)), ignorenulls=True).over(running(list(keys), *ORDER)), F.lit(1.0))
    out = df.withColumns({"price": F.col("price").cast("double"), "size": F.col("size").cast("double")})
    out = out.withColumn("__step", step).withColumn("tick_sign", sign).drop("__step").withColumn("dollar_value", F.col("price") * F.col("size"))
    return out.withColumns({"signed_tick": F.col("tick_sign"), "signed_volume": F.col("tick_sign") * F.col("size"), "signed_dollar_value": F.col("tick_sign") * F.col("dollar_value")})


class ThresholdFold:
    """Closes a bar when the sum since the last end reaches the threshold; what goes beyond isn't carried over."""

    def __init__(self, threshold: float):
        require(threshold > 0, "threshold must be positive")
        self.threshold, self.total, self.init = threshold, 0.0, 0

    def step(self, x: float) -> bool:
        self.total += x
        if self.total < self.threshold:
            return False
        self.total = 0.0
        return True


class CusumFold:
    """Marks values at which the downward or (else) the upward cumulated change passes the threshold; unknown changes don't count."""

    def __init__(self, threshold: float):
        require(threshold > 0, "threshold must be positive")
        self.threshold, self.up, self.down, self.last, self.init = threshold, 0.0, 0.0, None, 0

    def step(self, x: float) -> bool:
        change, self.last = 0.0 if self.last is None else x - self.last, x
        if change != change:
            return False
        self.up, self.down = max(0.0, self.up + change), min(0.0, self.down + change)
        if self.down < -self.threshold:
            self.down = 0.0
            return True
        if self.up > self.threshold:
            self.up = 0.0
            return True
        return False


class _Ewma:
    """Exponentially weighted mean of the last ``window`` values, from the oldest of them on."""

    def __init__(self, window: int):
        self.window, self.a, self.held = window, 2.0 / (window + 1), []

    def add(self, x: float) -> float:
        self.held = [*self.held[1 - self.window :], x] if self.window > 1 else [x]
        y = self.held[0]
        for v in self.held[1:]:
            y = self.a * v + (1 - self.a) * y
        return y


class ImbalanceFold:
    """One step a value; ``step`` tells whether the value closes a bar. ``seed`` sees the first values beforehand."""

    def __init__(self, init: int = 1000, window: int = 20, least: float = 10, most: float = 100_000):
        self.init, self.window, self.least, self.most = init, window, least, most

    def seed(self, first: np.ndarray, n: int) -> None:
        moved = first[first != 0]
        self.mean = float(moved.mean()) if len(moved) else 1.0
        self.ticks = float(max(self.least, min(self.init, n)))
        self.sizes, self.means = _Ewma(self.window), _Ewma(self.window)
        self.theta = self.count = 0

    def step(self, x: float) -> bool:
        self.theta += x
        self.count += 1
        if abs(self.theta) < max(1e-12, self.ticks * abs(self.mean)):
            return False
        self.ticks = min(self.most, max(self.least, self.sizes.add(float(self.count))))
        self.mean = self.means.add(self.theta / self.count)
        if abs(self.mean) < 1e-12:
            self.mean = 1.0
        self.theta = self.count = 0
        return True


class RunFold:
    """Buy and sell sums grow side by side; the larger one closes the bar."""

    def __init__(self, init: int = 1000, window: int = 20, least: float = 10, most: float = 100_000):
        self.init, self.window, self.least, self.most = init, window, least, most

    def seed(self, first: np.ndarray, n: int) -> None:
        buys, sells = first[first > 0], -first[first < 0]
        self.share = float((first > 0).mean()) if len(first) else 0.5
        self.buy = float(buys.mean()) if len(buys) else 1.0
        self.sell = float(sells.mean()) if len(sells) else 1.0
        self.ticks = float(max(self.least, min(self.init, n)))
        self.sizes, self.shares, self.buys, self.sells = (_Ewma(self.window) for _ in range(4))
        self._clear()

    def _clear(self) -> None:
        self.sum_buy = self.sum_sell = 0.0
        self.n_buy = self.n_sell = self.count = 0

    def step(self, x: float) -> bool:
        self.count += 1
        if x > 0:
            self.sum_buy, self.n_buy = self.sum_buy + x, self.n_buy + 1
        elif x < 0:
            self.sum_sell, self.n_sell = self.sum_sell - x, self.n_sell + 1
        expected = self.ticks * max(self.share * self.buy, (1 - self.share) * self.sell)
        if max(self.sum_buy, self.sum_sell) < max(1e-12, expected):
            return False
        self.ticks = min(self.most, max(self.least, self.sizes.add(float(self.count))))
        self.share = self.shares.add(self.n_buy / self.count)
        self.buy = max(1e-12, self.buys.add(self.sum_buy / self.n_buy if self.n_buy else 0.0))
        self.sell = max(1e-12, self.sells.add(self.sum_sell / self.n_sell if self.n_sell else 0.0))
        self._clear()
        return True


def fold_ends(values: np.ndarray, fold) -> np.ndarray:
    """Places of a series at which a fold closes."""
    if fold.init:
        fold.seed(values[: fold.init], len(values))
    return np.array([i for i, x in enumerate(values.tolist()) if fold.step(x)], np.int64)


class _Series:
    """The fold of one key as its rows stream by; rows are held back until the fold has seen the values that seed it."""

    def __init__(self, fold, column: int):
        self.fold, self.column, self.number, self.held = fold, column, 0, []
        self.wanted = fold.init

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not self.wanted:
            yield self._marked(rows)
            return
        self.held.append(rows)
        if sum(x.num_rows for x in self.held) >= self.wanted:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        held, self.held = self.held, []
        if held and self.wanted:
            first = np.concatenate([self._values(x) for x in held])[: self.wanted]
            self.fold.seed(first, len(first))
            self.wanted = 0
        for rows in held:
            yield self._marked(rows)

    def _values(self, rows: pa.RecordBatch) -> np.ndarray:
        return rows.column(self.column).to_numpy(zero_copy_only=False).astype(float)

    def _marked(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        closes = np.array([self.fold.step(x) for x in self._values(rows).tolist()], bool)
        ends = np.cumsum(closes)
        ids = self.number + ends - closes
        self.number += int(ends[-1]) if len(ends) else 0
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.int64()), pa.array(closes)], [*rows.schema.names, "bar_id", "closes"])


def folded(rows: DataFrame, column: str, fold: Callable[[], object], keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """``rows`` with bar_id (from 0) and closes by a fresh fold for each key. Rows have to be clustered by ``keys``; they are
    sorted within partitions and stream through, a task holding a batch, the fold and the rows that seed it."""
    at, ids = rows.columns.index(column), [rows.columns.index(k) for k in keys]
    schema = rows.select("*", F.lit(0).cast("long").alias("bar_id"), F.lit(False).alias("closes")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, series = None, None
        for batch in batches:
            runs = [pc.run_end_encode(batch.column(i)).run_ends.to_numpy() for i in ids]
            edges = np.unique(np.concatenate([[0, batch.num_rows], *runs])).astype(int).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(batch.column(i)[a].as_py() for i in ids)
                if series is None or now != key:
                    if series is not None:
                        yield from series.end()
                    key, series = now, _Series(fold(), at)
                yield from series.add(batch.slice(a, b - a))
        if series is not None:
            yield from series.end()

    return rows.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _folded(prepared: DataFrame, col: str, fold: Callable[[], object], keys: tuple[str, ...]) -> DataFrame:
    """The windows that prepared the trades have clustered them by key."""
    return folded(prepared, col, fold, keys, ORDER)


def build_bars(marked: DataFrame, keys: tuple[str, ...] = ("symbol",), keep_open: bool = False) -> Bars:
    """OHLCV of rows with bar_id and closes; the last bar of a key is dropped unless a row closes it."""
    at = F.struct(*ORDER)
    aggregates = [
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.max_by("symbol", at).alias("last_symbol"),
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("size").alias("volume"),
        F.sum("dollar_value").alias("dollar_value"),
        F.count("*").alias("ticks"),
        F.sum(F.when(F.col("tick_sign") > 0, F.col("size")).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(F.col("tick_sign") < 0, F.col("size")).otherwise(0.0)).alias("sell_volume"),
        F.bool_or("closes").alias("whole"),
    ]
    bars = marked.groupBy(*keys, "bar_id").agg(*aggregates)
    bars = bars.withColumnRenamed("last_symbol", "symbol") if "symbol" not in keys else bars.drop("last_symbol")
    bars = (bars if keep_open else bars.where("whole")).drop("whole")
    return Bars(marked.where("closes").drop("closes"), bars.select(*dict.fromkeys((*keys, "bar_id", "start", "end", "symbol", "open", "high", "low", "close", "volume", "dollar_value", "ticks", "buy_volume", "sell_volume"))))


def tick_bars(df: DataFrame, threshold: float, keys: tuple[str, ...] = ("symbol",)) -> Bars:
    """Bars of ceil(threshold) trades: a window, no fold."""
    require(threshold > 0, "threshold must be positive")
    n = math.ceil(threshold)
    number = F.row_number().over(ordered(list(keys), *ORDER))
    marked = prepare_trades(df, keys).withColumn("__n", number)
    marked = marked.withColumns({"bar_id": F.floor((F.col("__n") - 1) / n).cast("long"), "closes": F.col("__n") % n == 0}).drop("__n")
    return build_bars(marked, keys)


def _threshold_bars(df: DataFrame, col: str, threshold: float, keys: tuple[str, ...]) -> Bars:
    require(threshold > 0, "threshold must be positive")
    return build_bars(_folded(prepare_trades(df, keys), col, lambda: ThresholdFold(threshold), keys), keys)


def volume_bars(df: DataFrame, threshold: float, keys: tuple[str, ...] = ("symbol",)) -> Bars:
    return _threshold_bars(df, "size", threshold, keys)


def dollar_bars(df: DataFrame, threshold: float, keys: tuple[str, ...] = ("symbol",)) -> Bars:
    return _threshold_bars(df, "dollar_value", threshold, keys)


#: Measure of a bar family: the signed column its fold runs over.
MEASURES = {"tick": "signed_tick", "volume": "signed_volume", "dollar": "signed_dollar_value"}


def imbalance_bars(df: DataFrame, measure: str, init: int = 1000, window: int = 20, keys: tuple[str, ...] = ("symbol",), least: float = 10, most: float = 100_000) -> Bars:
    """Tick, volume or dollar imbalance bars."""
    return build_bars(_folded(prepare_trades(df, keys), MEASURES[measure], lambda: ImbalanceFold(init, window, least, most), keys), keys)


def run_bars(df: DataFrame, measure: str, init: int = 1000, window: int = 20, keys: tuple[str, ...] = ("symbol",), least: float = 10, most: float = 100_000) -> Bars:
    """Tick, volume or dollar run bars."""
    return build_bars(_folded(prepare_trades(df, keys), MEASURES[measure], lambda: RunFold(init, window, least, most), keys), keys)


def cusum_events(df: DataFrame, threshold: float, value: str = "close", time: str = "timestamp", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, time) of the events of the symmetric CUSUM filter."""
    require(threshold > 0, "threshold must be positive")
    rows = df.select(*keys, time, F.col(value).cast("double").alias(value))
    rows = rows.repartition(*keys) if keys else rows.repartition(1)
    return folded(rows, value, lambda: CusumFold(threshold), keys, (time,)).where("closes").select(*keys, time)


def etf_trick(prices: DataFrame, weights: DataFrame, initial: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Net asset value of long tables (ts, asset, price) and (ts, asset, weight): weights are carried forward over price
    dates, a date earns the weights of the date before. Assets without a weight don't count; no common asset is an error."""
    require(initial > 0, "initial value must be positive")
    common = prices.select("asset").distinct().join(weights.select("asset").distinct(), "asset", "left_semi")
    require(not common.isEmpty(), "prices and weights share no asset")
    prices = prices.join(weights.select("asset").distinct(), "asset", "left_semi").select(prices.columns)
    by = Window.partitionBy(*keys, "asset").orderBy("ts")
    before = by.rowsBetween(Window.unboundedPreceding, 0)
    both = prices.join(weights.select(*keys, "ts", "asset", "weight"), [*keys, "ts", "asset"], "left")
    both = both.withColumn("price", F.last("price", ignorenulls=True).over(before)).withColumn("held", F.coalesce(F.last("weight", ignorenulls=True).over(before), F.lit(0.0)))
    gain = F.coalesce(ratio(F.col("price"), F.lag("price").over(by)) - 1, F.lit(0.0)) * F.coalesce(F.lag("held").over(by), F.lit(0.0))
    daily = both.withColumn("g", gain).groupBy(*keys, "ts").agg(F.sum("g").alias("g"))
    return daily.select(*keys, "ts", (F.product(1 + F.col("g")).over(running(list(keys), "ts")) * initial).alias("nav"))


def covariance(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sample covariance of columns by one aggregation."""
    row = df.agg(*(F.covar_samp(a, b).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j)).first()
    return np.array([[row[f"{min(i, j)}_{max(i, j)}"] for j in range(len(columns))] for i in range(len(columns))], float)


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in descending order and their vectors, the largest component of each positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)


def pca_weights(cov: np.ndarray, risk: np.ndarray | None = None, target: float = 1.0) -> np.ndarray:
    """Weights whose risk is dealt over the principal components as ``risk`` says (all on the smallest by default)."""
    cov = np.asarray(cov, float)
    require(cov.ndim == 2 and cov.shape[0] == cov.shape[1], "covariance must be square")
    require(target > 0, "risk target must be positive")
    values, vectors = eigen(cov)
    require(bool((values > 0).all()), "covariance must be positive definite")
    risk = np.eye(len(cov))[-1] if risk is None else np.asarray(risk, float)
    require(risk.shape == values.shape, "one share of risk for each component")
    return vectors @ (target * np.sqrt(risk / values))
