import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom import queries
from tickloom.contracts import require_columns
from tickloom.operators import bars, fracdiff, joins, labeling, overfitting, sizing, synthetic, validation, weights
from tickloom.sources.trades import CREDENTIALS, PREFERRED, credentials, normalise_trades, output_path, read_trades, save_historical_trades

DAY = dt.datetime(2024, 1, 1)


def trades(spark, rows):
    return spark.createDataFrame([(DAY + dt.timedelta(seconds=i), "a", float(p), float(s), i) for i, (p, s) in enumerate(rows)], "timestamp timestamp, symbol string, price double, size double, id long")


def test_tick_rule_and_threshold_bars(spark):
    df = trades(spark, [(1, 1), (1, 2), (2, 3), (2, 4), (1, 5), (1, 9)])
    signs = [r.tick_sign for r in bars.prepare_trades(df).orderBy("id").collect()]
    assert signs == [1, 1, 1, 1, -1, -1]
    got = bars.volume_bars(df, 6).ohlcv.orderBy("bar_id").collect()
    assert [(r.ticks, r.volume, r.open, r.close) for r in got] == [(3, 6, 1, 2), (2, 9, 2, 1), (1, 9, 1, 1)]
    assert [r.ticks for r in bars.tick_bars(df, 4).ohlcv.collect()] == [4]
    with pytest.raises(ValueError):
        bars.dollar_bars(df, 0)


def test_empty_trades(spark):
    assert bars.dollar_bars(trades(spark, []), 10).ohlcv.count() == 0
    assert normalise_trades(trades(spark, [])).count() == 0
    with pytest.raises(ValueError):
        require_columns(trades(spark, []), "nope")


def test_output_path():
    assert output_path("crypto", ["BTC/USD"], "a", "b", "/x/") == "/x/crypto_btc-usd_trades_a_b.parquet"


def test_cusum():
    assert bars.fold_ends(np.array([0, 1, 2, 3, 0, -3.0]), bars.CusumFold(2)).tolist() == [3, 4, 5]


def test_folds_are_contiguous(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    for fold in (bars.ImbalanceFold(100), bars.RunFold(100)):
        ends = bars.fold_ends(x, fold)
        assert len(ends) and (np.diff(ends) > 0).all()


def test_streamed_folds_are_folds_of_each_key(spark):
    """Many keys of a few rows to many, over small Arrow batches: bars as from each series alone."""
    rng = np.random.default_rng(3)
    series = {k: rng.normal(100, 5, n).round(2) for k, n in (("a", 1), ("b", 40), ("c", 99), ("d", 100), ("e", 700), (None, 150))}
    rows = [(DAY + dt.timedelta(seconds=i), k, float(p), float(1 + i % 5), i) for k, xs in series.items() for i, p in enumerate(xs)]
    df = spark.createDataFrame(rows, "timestamp timestamp, symbol string, price double, size double, id long").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    prepared = bars.prepare_trades(df).orderBy("timestamp").toPandas()
    kinds = {"imbalance": (bars.imbalance_bars(df, "volume", 100, 5), "signed_volume", lambda: bars.ImbalanceFold(100, 5)), "run": (bars.run_bars(df, "dollar", 100, 5), "signed_dollar_value", lambda: bars.RunFold(100, 5)), "volume": (bars.volume_bars(df, 17), "size", lambda: bars.ThresholdFold(17))}
    for found, column, fold in kinds.values():
        got = {(r.symbol, r.bar_id): r.ticks for r in found.ohlcv.collect()}
        want = {}
        for k in series:
            mine = prepared[prepared.symbol.isna() if k is None else prepared.symbol == k]
            ends = bars.fold_ends(mine[column].to_numpy(), fold())
            want |= {(k, i): int(n) for i, n in enumerate(np.diff(ends, prepend=-1))}
        assert got == want and len(want) >= 10
    closes = df.select("symbol", F.col("timestamp").alias("ts"), F.col("price").alias("close"))
    got = bars.cusum_events(closes, 8.0, time="ts").groupBy("symbol").count().collect()
    assert {r.symbol: r["count"] for r in got} == {k: n for k, xs in series.items() if (n := len(bars.fold_ends(xs, bars.CusumFold(8.0))))}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    alone = bars.volume_bars(df.where("symbol is not null"), 17, ()).ohlcv
    assert alone.agg(F.sum("ticks")).first()[0] > 900


def test_etf_trick(spark):
    p = spark.createDataFrame([(1, "a", 10.0), (2, "a", 11.0), (4, "a", 22.0), (1, "b", 4.0), (2, "b", 2.0), (3, "b", 2.0), (4, "b", 3.0), (3, "c", 1.0), (3, "a", None)], "ts int, asset string, price double")
    w = spark.createDataFrame([(1, "a", 0.5), (2, "b", 1.0), (9, "d", 1.0)], "ts int, asset string, weight double")
    got = [r.nav for r in bars.etf_trick(p, w, 2.0).orderBy("ts").collect()]
    assert got == pytest.approx([2.0, 2 * 1.05, 2 * 1.05, 2 * 1.05 * (1 + 0.5 * 1.0 + 1.0 * 0.5)])
    for other in (w.where("asset = 'd'"), w.limit(0)):
        with pytest.raises(ValueError):
            bars.etf_trick(p, other)
    with pytest.raises(ValueError):
        bars.etf_trick(p, w, 0)


def test_pca_weights():
    cov = np.array([[2.0, 0.3], [0.3, 1.0]])
    w = bars.pca_weights(cov)
    assert w @ cov @ w == pytest.approx(1.0)
    with pytest.raises(ValueError):
        bars.pca_weights(np.array([[1.0, 2.0], [2.0, 1.0]]))


def test_asof_against_search(spark):
    rng = np.random.default_rng(1)
    left, right = sorted(rng.integers(0, 50, 40).tolist()), sorted(set(rng.integers(0, 50, 20).tolist()))
    l = spark.createDataFrame([("k", i, t) for i, t in enumerate(left)], "k string, i int, t int")  # noqa: E741
    r = spark.createDataFrame([("k", t, t) for t in right], "k string, t int, v int")
    for forward in (False, True):
        for strict in (False, True):
            got = {x.i: x.v for x in joins.asof(l, r, ("k",), "t", "v", forward, strict).collect()}
            for i, t in enumerate(left):
                ok = [x for x in right if (x > t if strict else x >= t)] if forward else [x for x in right if (x < t if strict else x <= t)]
                assert got[i] == ((min(ok) if forward else max(ok)) if ok else None)


def test_concurrency_and_uniqueness(spark):
    rng = np.random.default_rng(2)
    b = spark.createDataFrame([("a", t, float(t + 1)) for t in range(60)], "symbol string, ts int, close double")
    ev = sorted({int(s): int(s + rng.integers(0, 9)) for s in rng.integers(0, 50, 25)}.items())
    e = spark.createDataFrame([("a", s, t) for s, t in ev], "symbol string, t0 int, t1 int")
    got = {r.ts: r.concurrency for r in weights.concurrency(b, e).collect()}
    want = {t: sum(s <= t <= z for s, z in ev) for t in range(ev[0][0], max(z for _, z in ev) + 1)}
    assert got == want
    u = {r.t0: r.weight for r in weights.average_uniqueness(b, e).collect()}
    for s, z in ev:
        assert u[s] == pytest.approx(np.mean([1 / want[t] for t in range(s, z + 1)]))


def test_sequential_bootstrap(spark):
    """Draws are those of the plain computation of every weight at every draw; repeated tasks draw the same."""
    rng = np.random.default_rng(6)

    def plain(start, end, length, rng):
        counts, out = np.zeros(int(end.max()) + 2), []
        for _ in range(length):
            share = 1.0 / (1.0 + counts)
            mean = np.array([share[a : b + 1].mean() for a, b in zip(start, end)])
            total = np.cumsum(mean)
            out.append(min(int(np.searchsorted(total, rng.random() * total[-1], side="right")), len(mean) - 1))
            counts[start[out[-1]] : end[out[-1]] + 1] += 1
        return out

    for seed in range(5):
        start = np.sort(rng.integers(0, 40, 30))
        end = start + rng.integers(0, 9, 30)
        assert weights.draw_sequential(start, end, 45, np.random.default_rng(seed)).tolist() == plain(start, end, 45, np.random.default_rng(seed))
    b = spark.createDataFrame([(k, t) for k in "ab" for t in range(0, 100, 2)], "symbol string, ts int")
    e = spark.createDataFrame([(k, t, None if t > 90 else t + 7) for k in "ab" for t in range(1, 99, 3)], "symbol string, t0 int, t1 int")
    got = weights.sequential_bootstrap(b, e, samples=3, length=10)
    rows = got.collect()
    assert got.columns == ["symbol", "sample", "draw", "t0"] and len(rows) == 60 and sorted(map(tuple, rows)) == sorted(map(tuple, got.repartition(9).collect()))
    assert {r.t0 for r in rows} <= set(range(1, 99, 3)) and len({(r.symbol, r.sample, r.draw) for r in rows}) == 60
    assert weights.sequential_bootstrap(b, e.limit(0)).count() == 0


def test_infinite_returns_stay_in_their_events(spark):
    b = spark.createDataFrame([("a", t, float(p)) for t, p in enumerate([4, 2, 0, 0, 8, 2, 4])], "symbol string, ts int, close double")
    e = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 4), ("a", 4, 5), ("a", 5, 6)], "symbol string, t0 int, t1 int")
    got = {r.t0: r.weight for r in weights.return_attribution(b, e).collect()}
    assert got[1] == math.inf and math.isnan(got[2]) and got[5] == pytest.approx(abs(math.log(0.25) / 2 + math.log(2)))
    ends = spark.createDataFrame([("a", 0, 2, 0.1, 1.0), ("a", 2, 4, 0.1, 1.0), ("a", 2, 3, 0.1, -1.0)], "symbol string, t0 int, t1 int, trgt double, side double")
    told = sorted((r.t0, str(r.ret), r.bin) for r in labeling.bins(ends, b).collect())
    assert told == [(0, "-1.0", 0.0), (2, "inf", 1.0), (2, "nan", 1.0)]


def test_rounding_is_that_of_the_sql(spark):
    x = [1.0171875, 4.0453125, -1.0171875, 0.5e-6, -0.5e-6, 1.5e-6, 2.5e-6, -2.5e-7, 0.49999999999999994e-6, 0.1234565, 8191.0000005, 123456789.1234565, 1e17, 1e305, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in [*x, math.nan, None]], "x double")
    got = [r.x for r in queries._round(df).collect()]
    away = lambda y: math.copysign(math.floor(abs(y)) + (abs(y) % 1 >= 0.5), y)
    assert got[: len(x)] == [away(v * 1e6) / 1e6 if abs(v) < 1e300 else v for v in x]
    assert got[0] == 1.017187 and math.isnan(got[-2]) and got[-1] is None
    assert queries._round(df.where("x = 1.0171875").withColumn("y", F.col("x")), y=3).first() == (1.017187, 1.017)


def test_daily_returns_over_null_closes(spark):
    at = lambda h: DAY + dt.timedelta(hours=h)
    b = spark.createDataFrame([("a", at(0), 2.0), ("a", at(1), None), ("a", at(25), 3.0), ("a", at(26), 4.0), ("a", at(27), None)], "symbol string, ts timestamp_ntz, close double")
    got = sorted((r.ts, r.ret) for r in labeling.daily_returns(b).collect())
    assert got == [(at(25), 0.5), (at(26), None), (at(27), None)]


def test_totals_carry_no_rounding_of_earlier_bars(spark):
    prices = [1e150, 1e-150, 0.0] * 300 + [3.0, 3.1, 3.1, 2.9, 2.9000001]
    n = len(prices)
    b = spark.createDataFrame([("a", t, p) for t, p in enumerate(prices)] + [("b", t, None if t in (1, 2) else 2.0 + t) for t in range(5)], "symbol string, ts int, close double")
    e = spark.createDataFrame([("a", 1, 1), *(("a", t, t) for t in range(n - 4, n)), ("b", 1, 2), ("b", 4, 4)], "symbol string, t0 int, t1 int")
    got = {(r.symbol, r.t0): r.weight for r in weights.return_attribution(b, e).collect()}
    for t in range(n - 4, n):
        assert got["a", t] == pytest.approx(abs(math.log(prices[t]) - math.log(prices[t - 1])), abs=1e-15)
    assert got["a", 1] == pytest.approx(300 * math.log(10)) and got["b", 1] is None and got["b", 4] == pytest.approx(math.log(6 / 5))


def test_time_decay(spark):
    w = spark.createDataFrame([("a", i, 1.0) for i in range(4)], "symbol string, t0 int, weight double")
    assert [r.decay for r in weights.time_decay(w, 1.0).orderBy("t0").collect()] == pytest.approx([1, 1, 1, 1])
    assert [r.decay for r in weights.time_decay(w, -0.5).orderBy("t0").collect()] == pytest.approx([0, 0, 0.5, 1])
    with pytest.raises(ValueError):
        weights.time_decay(w, -1.0)


def test_fracdiff_goldens(spark):
    assert fracdiff.weights(0.4, 8) == pytest.approx([-0.0184, -0.0230, -0.0300, -0.0416, -0.0640, -0.1200, -0.4, 1], abs=5e-5)
    assert fracdiff.weights_fixed(0.4, 0.05) == pytest.approx([-0.064, -0.12, -0.4, 1])
    df = spark.createDataFrame([("a", i, float(i + 1)) for i in range(479)], "symbol string, ts int, close double")
    assert fracdiff.expanding(df, 0.4, 0.01).count() == 248
    assert fracdiff.fixed_width(df, 0.4, 1e-3).count() == 425
    assert fracdiff.adf_p_value(-3.21) == pytest.approx(0.019, abs=2e-3)
    with pytest.raises(ValueError):
        fracdiff.weights_fixed(0.4, 0)


def test_purged_kfold_goldens(spark):
    labels = validation.intervals(spark.createDataFrame([(i, min(i + 5, 179)) for i in range(180)], "t0 int, t1 int"))
    got = validation.purged_kfold(labels, 4, 0.03).groupBy("split", "role").count().collect()
    assert {(r.split, r.role): r["count"] for r in got} == {(0, "train"): 126, (1, "train"): 122, (2, "train"): 122, (3, "train"): 131, **{(i, "test"): 45 for i in range(4)}}
    test = labels.where("pos between 60 and 89").agg(F.min("t0").alias("low"), F.max("t1").alias("high"))
    assert validation.train_times(labels, test).count() == 140  # all but positions 55 to 94, which touch [60, 94]


def test_cpcv_goldens(spark):
    days, d = [], dt.date(2024, 1, 2)
    while len(days) < 36:
        if d.weekday() < 5:
            days.append(d)
        d += dt.timedelta(days=1)
    rows = [(x, x + dt.timedelta(days=[2, 4, 3, 5, 2, 6][i % 6])) for i, x in enumerate(days)]
    labels = validation.intervals(spark.createDataFrame(rows, "t0 date, t1 date"))
    splits = validation.combinatorial_splits(labels, 6, 2, 0.03)
    got = {r.split: r.n for r in splits.where("role = 'train'").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert [got[i] for i in range(15)] == [20, 14, 13, 14, 18, 17, 11, 11, 15, 17, 12, 15, 17, 16, 22]
    paths = validation.backtest_paths(validation.split_table(splits, 6, 2), 6)
    assert paths.select("path").distinct().count() == 5


def test_interval_checks(spark):
    with pytest.raises(ValueError):
        validation.intervals(spark.createDataFrame([(2, 1)], "t0 int, t1 int"))
    with pytest.raises(ValueError):
        validation.intervals(spark.createDataFrame([], "t0 int, t1 int"))


def test_series_metric(spark):
    """A metric of sums gives what the block statistics give; others see the series."""
    rng = np.random.default_rng(9)
    rows = [(i, f"s{k}", float(rng.normal(0.01 * k, 1))) for i in range(24) for k in range(4)]
    returns = spark.createDataFrame(rows, "pos long, strategy string, ret double")
    by_sums = overfitting.cscv(returns, 4, overfitting.mean_metric()).orderBy("split").collect()
    by_series = overfitting.cscv(returns, 4, series_metric=np.mean).orderBy("split").collect()
    for a, b in zip(by_sums, by_series, strict=True):
        assert (a.strategy, a.relative_rank) == (b.strategy, b.relative_rank) and a.is_metric == pytest.approx(b.is_metric)
    worst = overfitting.cscv(returns, 4, series_metric=lambda x: x.min()).collect()
    x = {k: np.array([r for _, s, r in rows if s == k]) for k in {s for _, s, _ in rows}}
    for r in worst:
        inside = np.isin(np.arange(24) // 6, r.in_blocks)
        assert r.strategy == max(x, key=lambda k: x[k][inside].min()) and r.oos_metric == x[r.strategy][~inside].min()
    with pytest.raises(Exception, match="knows no strategy"):
        overfitting.cscv(returns, 4, series_metric=lambda x: float("nan")).collect()


def fake_client(symbol, start, end, feed):
    for i in (2, 1):
        yield (DAY + dt.timedelta(days=i), symbol, 10.0 + i, 1.0, f"{feed}-{i}", "V")


def test_saved_trades(spark, tmp_path, monkeypatch):
    call = dict(start="a", end="b", fetcher="tests.test_operators:fake_client", folder=str(tmp_path))
    path = save_historical_trades(spark, ["BTC/USD", "ETH/USD"], asset_class="crypto", **call)
    assert path == f"{tmp_path}/crypto_btc-usd_eth-usd_trades_a_b.parquet"
    got = read_trades(spark, path).collect()
    assert [r.price for r in got] == [11.0, 11.0, 12.0, 12.0] and {r.symbol for r in got} == {"BTC/USD", "ETH/USD"}
    assert spark.read.parquet(path).columns == list(PREFERRED) and spark.read.parquet(path).where("id like 'us-%'").count() == 4
    with pytest.raises(ValueError):
        save_historical_trades(spark, ["A"], asset_class="bond", **call)
    for pair in CREDENTIALS:
        for name in pair:
            monkeypatch.delenv(name, raising=False)
    with pytest.raises(ValueError):
        save_historical_trades(spark, ["A"], asset_class="stock", **call)
    monkeypatch.setenv(CREDENTIALS[1][0], "k")
    monkeypatch.setenv(CREDENTIALS[1][1], "s")
    assert credentials() == ("k", "s")
    assert read_trades(spark, save_historical_trades(spark, ["A"], asset_class="stock", path=f"{tmp_path}/x", **call)).count() == 2


def test_bet_sizes(spark):
    w = sizing.calibrate_w(F.lit(10.0), F.lit(0.95))
    row = spark.range(1).select(w.alias("w"), sizing.target_position(w, F.lit(115.0), F.lit(100.0), F.lit(100)).alias("t"), sizing.limit_price(F.lit(97), F.lit(0), F.lit(115.0), w, F.lit(100)).alias("p"), sizing.discretise(F.lit(0.25), 0.1).alias("d")).first()
    assert row.w == pytest.approx(10.803324099723) and row.t == 97 and row.p == pytest.approx(112.36573855883361) and row.d == pytest.approx(0.2)
    p = spark.createDataFrame([(x,) for x in (0.0, 0.5, 0.8, 1.0)], "p double").select(sizing.raw_signal(F.col("p"), F.lit(1.0), 2).alias("s")).collect()
    assert [r.s for r in p] == pytest.approx([-1, 0, math.erf(0.75 / math.sqrt(2)), 1], abs=1e-8)


def test_trading_rules_match_plain_loop(spark):
    levels = [0.5, 2.0]
    got = {(r.profit_taking, r.stop_loss): (r["mean"], r.std) for r in synthetic.trading_rules(spark, [0.0], [5.0], levels, levels, 1.0, 50, 20, 7).collect()}
    paths = synthetic.simulate(0.0, 5.0, 1.0, 50, 20, np.random.default_rng(7))
    for (up, down), (mean, std) in got.items():
        x = [next((v for v in p if v > up or v < -down), p[-1]) for p in paths]
        assert mean == pytest.approx(np.mean(x)) and std == pytest.approx(np.std(x))


def test_triple_barriers(spark):
    b = spark.createDataFrame([("a", DAY + dt.timedelta(hours=i), p) for i, p in enumerate([100.0, 103.0, 98.0, 110.0, 90.0])], "symbol string, ts timestamp, close double")
    e = spark.createDataFrame([("a", DAY, DAY + dt.timedelta(hours=4), 0.05, 1.0), ("a", DAY + dt.timedelta(hours=1), None, 0.05, -1.0)], "symbol string, t0 timestamp, t1 timestamp, trgt double, side double")
    got = labeling.triple_barrier_events(b, e, 1.0, 1.0, 0.0).orderBy("t0").collect()
    assert [r.t1 for r in got] == [DAY + dt.timedelta(hours=3), DAY + dt.timedelta(hours=3)]
    bins = labeling.bins(labeling.triple_barrier_events(b, e, 1.0, 1.0, 0.0), b).orderBy("t0").collect()
    assert [r.bin for r in bins] == [1.0, 0.0]


def test_stream_equals_batch(spark, tmp_path):
    from tickloom.streaming.bars import stream_threshold_bars

    df = trades(spark, [(1 + i % 7, 1 + i % 3) for i in range(200)])
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run = stream_threshold_bars(source, 40.0).writeStream.format("memory").queryName("bars_out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    cols = ["bar_id", "open", "high", "low", "close", "volume", "ticks", "buy_volume", "sell_volume"]
    assert spark.table("bars_out").select(cols).orderBy("bar_id").collect() == bars.dollar_bars(df, 40.0).ohlcv.select(cols).orderBy("bar_id").collect()


@pytest.mark.parametrize("kind", ["imbalance", "run", "cusum"])
def test_other_streams_equal_batch(spark, tmp_path, kind):
    from tickloom.streaming import bars as streams

    rng = np.random.default_rng(11)
    df = trades(spark, [(float(p), 1 + i % 4) for i, p in enumerate(np.round(100 + np.cumsum(rng.normal(0, 1, 600)), 2))])
    for part in range(3):  # in order over micro-batches
        df.where(f"id div 200 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    if kind == "cusum":
        out = streams.stream_cusum(source.select("symbol", "timestamp", F.col("price").alias("close")), 3.0)
        want, cols = bars.cusum_events(df.withColumnRenamed("price", "close"), 3.0), ["symbol", "timestamp"]
    else:
        make = streams.stream_imbalance_bars if kind == "imbalance" else streams.stream_run_bars
        out = make(source, "signed_volume", 100, 5)
        want, cols = (bars.imbalance_bars if kind == "imbalance" else bars.run_bars)(df, "volume", 100, 5).ohlcv, ["bar_id", "open", "close", "volume", "ticks", "buy_volume"]
    run = out.writeStream.format("memory").queryName(f"out_{kind}").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table(f"out_{kind}").select(cols).orderBy(cols[-2], cols[0]).collect()
    assert got == want.select(cols).orderBy(cols[-2], cols[0]).collect() and len(got) > 3


def write_events(spark, folder, series):
    rows = [(i * 10_000 + j, DAY + dt.timedelta(hours=j), 1, k, float(x), "{\"k\": 1}") for i, (k, xs) in enumerate(series.items()) for j, x in enumerate(xs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")


def test_least_difference_order_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    series = {k: np.exp(4 + np.cumsum(rng.normal(0, 0.05, 150))) for k in "ab"}
    write_events(spark, tmp_path, series)
    got = {(r.symbol, round(r.d, 6)): r for r in queries.queries()["least_difference_order"](spark, str(tmp_path)).collect()}
    assert set(got) == {(k, i / 10) for k in "ab" for i in range(11)}
    for (k, d), r in got.items():
        w = [1.0]
        while abs(x := -w[-1] * (d - len(w) + 1) / len(w)) >= 0.01:
            w.append(x)
        y = np.log(series[k])
        z = np.array([np.dot(w, y[i - len(w) + 1 : i + 1][::-1]) for i in range(len(w) - 1, len(y))])
        dz = np.diff(z)
        x = np.column_stack([z[1:-1], dz[:-1], np.ones(len(dz) - 1)])
        beta = np.linalg.lstsq(x, dz[1:], rcond=None)[0]
        se = math.sqrt(((dz[1:] - x @ beta) ** 2).sum() / (len(x) - 3) * np.linalg.inv(x.T @ x)[0, 0])
        assert (r.n_obs, r.stat, r.corr) == (len(x), pytest.approx(beta[0] / se, abs=1e-4), pytest.approx(np.corrcoef(z, y[len(w) - 1 :])[0, 1], abs=1e-5))


@pytest.mark.parametrize("n", [0, 1, 100_000, 2_000_000])
def test_positions_are_dense(spark, n):
    key = F.xxhash64("id") if n > 100_000 else F.col("id")
    df = spark.range(n).select(F.col("id").alias("was"), key.alias("k"), F.lit("other").alias("__c"))
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    got = joins.with_position(df, ["k"])
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got.columns == ["was", "k", "__c", "pos"]
    row = got.agg(F.count("*").alias("n"), F.count_distinct("was").alias("rows"), F.count_distinct("pos").alias("d"), F.max("pos").alias("m")).first()
    assert (row.n, row.rows, row.d, row.m) == (n, n, n, n - 1 if n else None)
    steps = got.selectExpr("pos p", "k").join(got.selectExpr("pos + 1 p", "k before"), "p")
    assert steps.where("before >= k").count() == 0 and steps.count() == max(0, n - 1)


def test_positions_with_ties(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)] + [(None, 30)], "k int, i int")
    got = sorted((r.pos, -1 if r.k is None else r.k) for r in joins.with_position(df, ["k"]).collect())
    assert [p for p, _ in got] == list(range(31)) and [k for _, k in got] == [-1] + [0] * 10 + [1] * 10 + [2] * 10


def test_train_times_and_splits_against_search(spark):
    rng = np.random.default_rng(8)
    starts = sorted(rng.choice(400, 80, replace=False).tolist())
    rows = [(t, t + int(rng.integers(0, 40))) for t in starts]
    labels = validation.intervals(spark.createDataFrame(rows, "t0 int, t1 int"))
    tests = [(50, 60), (55, 90), (200, 199), (300, 301), (380, 900)]
    got = {(r.t0, r.t1) for r in validation.train_times(labels, spark.createDataFrame(tests, "low int, high int")).collect()}
    assert got == {(a, b) for a, b in rows if not any(lo <= hi and a <= hi and b >= lo for lo, hi in tests)}
    found = {(r.split, r.pos): r.role for r in validation.combinatorial_splits(labels, 5, 2, 0.02).collect()}
    group = [min(i // 16, 4) for i in range(80)]
    for split, chosen in enumerate((a, b) for a in range(5) for b in range(a + 1, 5)):
        held = [rows[i] for i in range(80) if group[i] in chosen]
        late = {i for g in chosen for i in range(16 * (g + 1), 16 * (g + 1) + 2)}
        for i, (a, b) in enumerate(rows):
            free = not any(a <= y and b >= x for x, y in held) and i not in late
            assert found.get((split, i)) == ("test" if group[i] in chosen else "train" if free else None)
