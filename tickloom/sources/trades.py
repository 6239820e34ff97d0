"""Trade sources and sinks: credentials, normalisation, file names, Parquet, CSV, an offline fetcher."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tickloom.contracts import require, require_columns

#: Environment variables read for credentials, in order, the preferred columns and (below) the file name.
CREDENTIALS = (("ALPACA_API_KEY", "ALPACA_SECRET_KEY"), ("APCA_API_KEY_ID", "APCA_API_SECRET_KEY"))
REQUIRED = ("timestamp", "symbol", "price", "size")
PREFERRED = ("timestamp", "symbol", "price", "size", "id", "exchange")


def credentials() -> tuple[str, str]:
    for key, secret in CREDENTIALS:
        if os.environ.get(key) and os.environ.get(secret):
            return os.environ[key], os.environ[secret]
    raise ValueError("no credentials in the environment")


def normalise_trades(df: DataFrame, sort: bool = True) -> DataFrame:
    """Required columns cast, preferred ones kept, ordered by time, symbol and id."""
    require_columns(df, *REQUIRED)
    kinds = {"timestamp": "timestamp", "symbol": "string", "price": "double", "size": "double"}
    out = df.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in PREFERRED if c in df.columns))
    return out.orderBy("timestamp", "symbol", *(["id"] if "id" in out.columns else [])) if sort else out


def output_path(asset_class: str, symbols: list[str], start: str, end: str, folder: str) -> str:
    slug = "_".join(x.replace("/", "-").replace(":", "-").replace(" ", "") for x in symbols).lower()
    return f"{folder.rstrip('/')}/{asset_class}_{slug}_trades_{start}_{end}.parquet"


class _Partition(InputPartition):
    def __init__(self, symbol: str):
        super().__init__(symbol)


class _TradesReader(DataSourceReader):
    """One partition a symbol; ``fetcher`` names a module-level generator 'module:function' that yields the rows."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Partition(x) for x in self.options["symbols"].split(",")]

    def read(self, partition) -> Iterator[tuple]:
        import importlib

        module, _, name = self.options["fetcher"].partition(":")
        yield from getattr(importlib.import_module(module), name)(partition.value, self.options["start"], self.options["end"], self.options.get("feed"))


class HistoricalTrades(DataSource):
    @classmethod
    def name(cls) -> str:
        return "historical_trades"

    def schema(self) -> str:
        return "timestamp timestamp, symbol string, price double, size double, id string, exchange string"

    def reader(self, schema):
        return _TradesReader(dict(self.options))


def fetch_trades(spark: SparkSession, symbols: list[str], start: str, end: str, asset_class: str, fetcher: str, stock_feed: str = "iex", crypto_feed: str = "us") -> DataFrame:
    """Historical trades of "stock" (needs credentials) or "crypto" through the data source; the client is ``fetcher``."""
    require(asset_class in ("stock", "crypto"), "asset_class is stock or crypto")
    if asset_class == "stock":
        credentials()
    spark.dataSource.register(HistoricalTrades)
    feed = stock_feed if asset_class == "stock" else crypto_feed
    return spark.read.format("historical_trades").options(symbols=",".join(symbols), start=start, end=end, feed=feed, fetcher=fetcher).load()


def save_trades(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    writer = normalise_trades(df, sort=not partition_by).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def save_historical_trades(spark: SparkSession, symbols: list[str], start: str, end: str, asset_class: str, fetcher: str, folder: str = "data", path: str | None = None, **feeds: str) -> str:
    """Fetch, normalise and write; returns the path, made from the request unless given."""
    trades = fetch_trades(spark, symbols, start, end, asset_class, fetcher, **feeds)
    return save_trades(trades, path or output_path(asset_class, symbols, start, end, folder))


def read_trades(spark: SparkSession, path: str, sort: bool = True) -> DataFrame:
    """The four columns that bars need, in order of time."""
    out = spark.read.parquet(path).select("timestamp", "symbol", "price", "size")
    return out.orderBy("timestamp") if sort else out


def save_statistics(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def trades_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: the ``events`` table as trades."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = F.get_json_object("props", "$.k").cast("double") + 1
    return events.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), size.alias("size"), F.col("event_id").alias("id"))
