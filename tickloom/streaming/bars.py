"""Streaming twins of the bar folds and the CUSUM filter, and watermarked time bars.

A key's trades must arrive in order across micro-batches (within one they are sorted).
The state of a key is its fold and its open bar, a few numbers; imbalance and run bars
first hold back ``init`` trades, from which they seed their expectations. A batch fold
whose series is longer than ``init`` gives the same bars.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.bars import CusumFold, ImbalanceFold, RunFold, ThresholdFold

_BAR = "symbol string, bar_id long, start timestamp, end timestamp, open double, high double, low double, close double, volume double, dollar_value double, ticks long, buy_volume double, sell_volume double"


class _Series:
    """State of one key."""

    def __init__(self, fold, measure: str):
        self.fold, self.measure = fold, measure
        self.price, self.sign, self.held, self.bar, self.number = None, 1.0, [], None, 0
        self.seeded = not getattr(fold, "init", 0)

    def add(self, row: tuple) -> list[dict]:
        time, price, size = row
        if self.price is not None and price != self.price:
            self.sign = 1.0 if price > self.price else -1.0
        self.price = price
        trade = (time, price, size, self.sign)
        if self.seeded:
            return self._take(trade)
        self.held.append(trade)
        if len(self.held) < self.fold.init:
            return []
        values = np.array([self._value(t) for t in self.held])
        self.fold.seed(values, len(values))
        self.seeded, held, self.held = True, self.held, []
        return [bar for t in held for bar in self._take(t)]

    def _value(self, trade: tuple) -> float:
        _, price, size, sign = trade
        return {"one": 1.0, "size": size, "dollar_value": price * size, "signed_tick": sign, "signed_volume": sign * size, "signed_dollar_value": sign * price * size}[self.measure]

    def _take(self, trade: tuple) -> list[dict]:
        time, price, size, sign = trade
        b = self.bar or {"start": time, "open": price, "high": price, "low": price, "volume": 0.0, "dollar_value": 0.0, "ticks": 0, "buy_volume": 0.0, "sell_volume": 0.0}
        b.update(end=time, close=price, high=max(b["high"], price), low=min(b["low"], price), volume=b["volume"] + size, dollar_value=b["dollar_value"] + price * size, ticks=b["ticks"] + 1)
        b["buy_volume" if sign > 0 else "sell_volume"] += size
        self.bar = b
        if not self.fold.step(self._value(trade)):
            return []
        done, self.bar = {**b, "bar_id": self.number}, None
        self.number += 1
        return [done]


def stream_bars(trades: DataFrame, fold: Callable[[], object], measure: str) -> DataFrame:
    """Closed bars of a stream of (timestamp, symbol, price, size, id). ``fold`` makes a fresh fold for a key; ``measure``
    is one, size, dollar_value, signed_tick, signed_volume or signed_dollar_value."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        series = pickle.loads(state.get[0]) if state.exists else _Series(fold(), measure)
        rows = pd.concat(list(parts)).sort_values(["timestamp", "id"], kind="stable")
        done = [bar for row in rows[["timestamp", "price", "size"]].itertuples(index=False, name=None) for bar in series.add(row)]
        state.update((pickle.dumps(series),))
        names = [x.split()[0] for x in _BAR.split(", ")]
        yield pd.DataFrame([{"symbol": key[0], **b} for b in done], columns=names)

    source = trades.select(F.col("timestamp").cast("timestamp").alias("timestamp"), "symbol", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"), "id")
    return source.groupBy("symbol").applyInPandasWithState(run, _BAR, "series binary", "append", GroupStateTimeout.NoTimeout)


def stream_threshold_bars(trades: DataFrame, threshold: float, measure: str = "dollar_value") -> DataFrame:
    return stream_bars(trades, lambda: ThresholdFold(threshold), measure)


def stream_imbalance_bars(trades: DataFrame, measure: str = "signed_tick", init: int = 1000, window: int = 20) -> DataFrame:
    return stream_bars(trades, lambda: ImbalanceFold(init, window), measure)


def stream_run_bars(trades: DataFrame, measure: str = "signed_tick", init: int = 1000, window: int = 20) -> DataFrame:
    return stream_bars(trades, lambda: RunFold(init, window), measure)


def stream_cusum(closes: DataFrame, threshold: float) -> DataFrame:
    """(symbol, timestamp, close) of the events of a stream of (timestamp, symbol, close)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = pickle.loads(state.get[0]) if state.exists else CusumFold(threshold)
        rows = pd.concat(list(parts)).sort_values("timestamp", kind="stable")
        hit = [fold.step(x) for x in rows["close"]]
        state.update((pickle.dumps(fold),))
        yield rows[hit][["symbol", "timestamp", "close"]]

    source = closes.select("symbol", F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("close").cast("double").alias("close"))
    return source.groupBy("symbol").applyInPandasWithState(run, "symbol string, timestamp timestamp, close double", "fold binary", "append", GroupStateTimeout.NoTimeout)


def time_bars(trades: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling OHLCV bars of a batch or, with a watermark, of a stream."""
    rows = trades.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("at", F.struct("timestamp", "id"))
    rows = rows.withWatermark("timestamp", late) if trades.isStreaming else rows
    out = rows.groupBy("symbol", F.window("timestamp", width)).agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("size").alias("volume"), F.count("*").alias("ticks"))
    return out.select("symbol", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "open", "high", "low", "close", "volume", "ticks")
