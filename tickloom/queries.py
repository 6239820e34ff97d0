"""Registered queries of the engine's own operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import ordered, quotient, rounded
from tickloom.operators import bars, fracdiff, joins, labeling, overfitting, sizing, synthetic, validation, weights
from tickloom.plans import models
from tickloom.sources.trades import normalise_trades, trades_from_events
from tickloom.streaming.bars import time_bars as time_bars_of

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in _REGISTRY.items() if q}


def _round(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    return df.select(*(rounded(F.col(c), other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_from_events(spark, sf_dir).groupBy("symbol", F.col("timestamp").alias("ts")).agg(F.max("price").alias("close"))


def _events(closes: DataFrame) -> DataFrame:
    """Every bar that has one five bars before, ten bars long; the return since then gives the target (up to 1.05) and the side."""
    w = ordered(["symbol"], "ts")
    rows = closes.withColumns({"t1": F.lead("ts", 10).over(w), "was": F.lag("close", 5).over(w)})
    ret = quotient(F.col("close"), F.col("was")) - 1
    target = F.least(F.abs(ret), F.lit(4.0)) / 4 + 0.05
    return rows.where("was is not null").select("symbol", F.col("ts").alias("t0"), "t1", target.alias("trgt"), F.when(ret >= 0, 1.0).otherwise(-1.0).alias("side"))


_TRADES = """trades AS (SELECT ts AS timestamp, event_type AS symbol, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS size, event_id AS id FROM events)"""
_PREPARED = f"""{_TRADES},
steps AS (SELECT *, sign(price - lag(price) OVER w) AS st FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY timestamp, id)),
prepared AS (SELECT timestamp, symbol, price, size, id,
    coalesce(last_value(CAST(nullif(st, 0) AS DOUBLE) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING), 1.0) AS tick_sign, price * size AS dollar_value,
    row_number() OVER (PARTITION BY symbol ORDER BY timestamp, id) AS rn FROM steps)"""
_OHLCV = """SELECT symbol, CAST(bar_id AS BIGINT) AS bar_id, min(timestamp) AS start, max(timestamp) AS "end", round(arg_min(price, rn), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low,
    round(arg_max(price, rn), 6) AS close, round(sum(size), 6) AS volume, round(sum(dollar_value), 4) AS dollar_value, count(*) AS ticks,
    round(coalesce(sum(size) FILTER (tick_sign > 0), 0), 6) AS buy_volume, round(coalesce(sum(size) FILTER (tick_sign < 0), 0), 6) AS sell_volume"""


def _threshold_sql(measure: str, threshold: float) -> str:
    return f"""WITH RECURSIVE {_PREPARED},
fold AS (
    SELECT symbol, rn, CAST({measure} AS DOUBLE) AS total, 0 AS bar_id, {measure} >= {threshold} AS closes FROM prepared WHERE rn = 1
    UNION ALL
    SELECT p.symbol, p.rn, CASE WHEN f.closes THEN 0 ELSE f.total END + p.{measure}, f.bar_id + CAST(f.closes AS INT), CASE WHEN f.closes THEN 0 ELSE f.total END + p.{measure} >= {threshold}
    FROM fold f JOIN prepared p ON p.symbol = f.symbol AND p.rn = f.rn + 1
)
{_OHLCV} FROM fold JOIN prepared USING (symbol, rn) GROUP BY symbol, bar_id HAVING bool_or(closes)"""


_CLOSES = "closes AS (SELECT event_type AS symbol, ts, max(value) AS close FROM events GROUP BY ALL)"
_EVENTS = f"""{_CLOSES},
placed AS (SELECT *, row_number() OVER w AS n, lead(ts, 10) OVER w AS t1, lag(close, 5) OVER w AS was FROM closes WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
ev AS (SELECT symbol, n, ts AS t0, t1, least(abs(close / was - 1), 4) / 4 + 0.05 AS trgt, CASE WHEN close / was - 1 >= 0 THEN 1.0::DOUBLE ELSE -1.0 END AS side, close AS p0 FROM placed WHERE was IS NOT NULL)"""
_SPANS = f"""{_EVENTS},
span AS (SELECT e.symbol, e.t0, e.trgt, e.side, e.p0, p.ts, p.close FROM (SELECT *, unnest(range(11)) AS k FROM ev) e JOIN placed p ON p.symbol = e.symbol AND p.n = e.n + e.k)"""
_COUNTED = f"""{_SPANS},
conc AS (SELECT symbol, ts, count(*) AS concurrency FROM span GROUP BY ALL)"""
_TOUCHED = f"""{_SPANS},
path AS (SELECT symbol, t0, trgt, ts, (close / p0 - 1) * side AS gain FROM span WHERE trgt > 0.1),
touched AS (SELECT symbol, t0, min(ts) FILTER (gain < -2 * trgt) AS sl, min(ts) FILTER (gain > 1.5 * trgt) AS pt FROM path GROUP BY ALL),
done AS (SELECT ev.symbol, ev.t0, least(ev.t1, sl, pt) AS t1, ev.trgt, ev.side FROM ev LEFT JOIN touched USING (symbol, t0) WHERE ev.trgt > 0.1)"""


@query(f"WITH {_TRADES} SELECT timestamp, symbol, price, size, id FROM trades")
def normalised_trades(spark, sf_dir):
    return normalise_trades(trades_from_events(spark, sf_dir))


@query(f"WITH {_PREPARED} SELECT timestamp, symbol, price, size, id, tick_sign, round(dollar_value, 6) AS dollar_value, tick_sign AS signed_tick, tick_sign * size AS signed_volume, round(tick_sign * dollar_value, 6) AS signed_dollar_value FROM prepared")
def prepared_trades(spark, sf_dir):
    return _round(bars.prepare_trades(trades_from_events(spark, sf_dir)))


def _bars(found: bars.Bars) -> DataFrame:
    return _round(found.ohlcv, dollar_value=4)


@query(f"WITH {_PREPARED} {_OHLCV} FROM (SELECT *, (rn - 1) // 25 AS bar_id FROM prepared) GROUP BY symbol, bar_id HAVING count(*) = 25")
def tick_bars(spark, sf_dir):
    return _bars(bars.tick_bars(trades_from_events(spark, sf_dir), 25))


@query(_threshold_sql("size", 1000))
def volume_bars(spark, sf_dir):
    return _bars(bars.volume_bars(trades_from_events(spark, sf_dir), 1000))


@query(_threshold_sql("dollar_value", 50000))
def dollar_bars(spark, sf_dir):
    return _bars(bars.dollar_bars(trades_from_events(spark, sf_dir), 50_000))


_EWMA = "list_reduce({0}, lambda y, v: v * 2 / 21.0 + y * (1 - 2 / 21.0))"
_LAST = "list_append(CASE WHEN len({0}) >= 20 THEN {0}[len({0}) - 18:] ELSE {0} END, {1})"
_SEEDED = """{prepared},
m AS (SELECT symbol, rn, CAST(tick_sign * {measure} AS DOUBLE) AS x FROM prepared),
seed AS (SELECT symbol, CAST(greatest(10, count(*)) AS DOUBLE) AS ticks, coalesce(avg(x) FILTER (x <> 0), 1.0) AS mean, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS share,
    coalesce(avg(x) FILTER (x > 0), 1.0) AS buy, coalesce(avg(-x) FILTER (x < 0), 1.0) AS sell FROM m WHERE rn <= 100 GROUP BY symbol)"""


def _imbalance_sql(measure: str) -> str:
    """State before each row: the open bar's sum and count, the expectations and the last 20 sizes and means of closed bars."""
    return f"""WITH RECURSIVE {_SEEDED.format(prepared=_PREPARED, measure=measure)},
fold AS (
    SELECT symbol, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS theta, 0.0::DOUBLE AS n, ticks, mean, CAST([] AS DOUBLE[]) AS sizes, CAST([] AS DOUBLE[]) AS means, CAST(0 AS BIGINT) AS bar_id, CAST(0 AS BIGINT) AS of_bar, false AS closes FROM seed
    UNION ALL
    SELECT symbol, rn, CASE WHEN hit THEN 0 ELSE theta END, CASE WHEN hit THEN 0 ELSE n END, CASE WHEN hit THEN least(100000, greatest(10, {_EWMA.format("new_sizes")})) ELSE ticks END,
        CASE WHEN NOT hit THEN mean WHEN abs({_EWMA.format("new_means")}) < 1e-12 THEN 1.0 ELSE {_EWMA.format("new_means")} END, new_sizes, new_means, bar_id + CAST(hit AS BIGINT), bar_id, hit
    FROM (SELECT *, CASE WHEN hit THEN {_LAST.format("sizes", "n")} ELSE sizes END AS new_sizes, CASE WHEN hit THEN {_LAST.format("means", "theta / n")} ELSE means END AS new_means
        FROM (SELECT *, abs(theta) >= greatest(1e-12, ticks * abs(mean)) AS hit
            FROM (SELECT f.symbol, m.rn, f.theta + m.x AS theta, f.n + 1 AS n, f.ticks, f.mean, f.sizes, f.means, f.bar_id FROM fold f JOIN m ON m.symbol = f.symbol AND m.rn = f.rn + 1)))
)
{_OHLCV} FROM (SELECT symbol, rn, of_bar AS bar_id, closes FROM fold WHERE rn > 0) JOIN prepared USING (symbol, rn) GROUP BY symbol, bar_id HAVING bool_or(closes)"""


def _run_sql(measure: str) -> str:
    """As for imbalance bars, with sums and counts of either side."""
    return f"""WITH RECURSIVE {_SEEDED.format(prepared=_PREPARED, measure=measure)},
fold AS (
    SELECT symbol, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS sb, 0.0::DOUBLE AS ss, 0.0::DOUBLE AS nb, 0.0::DOUBLE AS ns, 0.0::DOUBLE AS n, ticks, share, buy, sell,
        CAST([] AS DOUBLE[]) AS sizes, CAST([] AS DOUBLE[]) AS shares, CAST([] AS DOUBLE[]) AS buys, CAST([] AS DOUBLE[]) AS sells, CAST(0 AS BIGINT) AS bar_id, CAST(0 AS BIGINT) AS of_bar, false AS closes FROM seed
    UNION ALL
    SELECT symbol, rn, CASE WHEN hit THEN 0 ELSE sb END, CASE WHEN hit THEN 0 ELSE ss END, CASE WHEN hit THEN 0 ELSE nb END, CASE WHEN hit THEN 0 ELSE ns END, CASE WHEN hit THEN 0 ELSE n END,
        CASE WHEN hit THEN least(100000, greatest(10, {_EWMA.format("l1")})) ELSE ticks END, CASE WHEN hit THEN {_EWMA.format("l2")} ELSE share END,
        CASE WHEN hit THEN greatest(1e-12, {_EWMA.format("l3")}) ELSE buy END, CASE WHEN hit THEN greatest(1e-12, {_EWMA.format("l4")}) ELSE sell END, l1, l2, l3, l4, bar_id + CAST(hit AS BIGINT), bar_id, hit
    FROM (SELECT *, CASE WHEN hit THEN {_LAST.format("sizes", "n")} ELSE sizes END AS l1, CASE WHEN hit THEN {_LAST.format("shares", "nb / n")} ELSE shares END AS l2,
            CASE WHEN hit THEN {_LAST.format("buys", "CASE WHEN nb > 0 THEN sb / nb ELSE 0 END")} ELSE buys END AS l3, CASE WHEN hit THEN {_LAST.format("sells", "CASE WHEN ns > 0 THEN ss / ns ELSE 0 END")} ELSE sells END AS l4
        FROM (SELECT *, greatest(sb, ss) >= greatest(1e-12, ticks * greatest(share * buy, (1 - share) * sell)) AS hit
            FROM (SELECT f.symbol, m.rn, f.sb + greatest(m.x, 0) AS sb, f.ss + greatest(-m.x, 0) AS ss, f.nb + CAST(m.x > 0 AS INT) AS nb, f.ns + CAST(m.x < 0 AS INT) AS ns, f.n + 1 AS n, f.ticks, f.share, f.buy, f.sell, f.sizes, f.shares, f.buys, f.sells, f.bar_id
                FROM fold f JOIN m ON m.symbol = f.symbol AND m.rn = f.rn + 1)))
)
{_OHLCV} FROM (SELECT symbol, rn, of_bar AS bar_id, closes FROM fold WHERE rn > 0) JOIN prepared USING (symbol, rn) GROUP BY symbol, bar_id HAVING bool_or(closes)"""


def _adaptive(make, measure: str, name: str, sql: str | None):
    def run(spark, sf_dir):
        return _bars(make(trades_from_events(spark, sf_dir), measure, init=100, window=20))

    run.__name__ = name
    query(sql)(run)


# The first expectation equals the sum over the rows that seed it, so dollar bars hang on the last bit of a mean: no SQL for them.
for _measure, _amount in (("tick", "1"), ("volume", "size"), ("dollar", None)):
    _adaptive(bars.imbalance_bars, _measure, f"{_measure}_imbalance_bars", _amount and _imbalance_sql(_amount))
    _adaptive(bars.run_bars, _measure, f"{_measure}_run_bars", _amount and _run_sql(_amount))


@query("""SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
    sum(CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1) AS volume, count(*) AS ticks FROM events GROUP BY ALL""")
def time_bars(spark, sf_dir):
    out = time_bars_of(trades_from_events(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(f"""WITH RECURSIVE {_CLOSES},
moved AS (SELECT symbol, ts, close - lag(close) OVER w AS d, row_number() OVER w AS rn FROM closes WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
fold AS (
    SELECT symbol, ts, rn, 0::DOUBLE AS up, 0::DOUBLE AS down, false AS hit FROM moved WHERE rn = 1
    UNION ALL
    SELECT symbol, ts, rn, CASE WHEN NOT lo AND u > 300 THEN 0 ELSE u END, CASE WHEN lo THEN 0 ELSE v END, lo OR u > 300 FROM (
        SELECT m.symbol, m.ts, m.rn, greatest(0, f.up + m.d) AS u, least(0, f.down + m.d) AS v, least(0, f.down + m.d) < -300 AS lo FROM fold f JOIN moved m ON m.symbol = f.symbol AND m.rn = f.rn + 1)
) SELECT symbol, ts FROM fold WHERE hit""")
def cusum_events(spark, sf_dir):
    return bars.cusum_events(_closes(spark, sf_dir), 300.0, time="ts")


def _daily(spark, sf_dir):
    return trades_from_events(spark, sf_dir).groupBy(F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("ts"), F.col("symbol").alias("asset")).agg(F.avg("price").alias("price"), F.count("*").alias("n"))


@query("""WITH daily AS (SELECT date_trunc('day', ts) AS ts, event_type AS asset, avg(value) AS price, count(*) AS n FROM events GROUP BY ALL),
moved AS (SELECT ts, asset, price / lag(price) OVER w - 1 AS r, lag(n) OVER w / 1000.0 AS held FROM daily WINDOW w AS (PARTITION BY asset ORDER BY ts)),
g AS (SELECT ts, sum(coalesce(r, 0) * coalesce(held, 0)) AS g FROM moved GROUP BY ts)
SELECT CAST(ts AS TIMESTAMP) AS ts, round(product(1 + g) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS nav FROM g""")
def etf_trick(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    return _round(bars.etf_trick(daily.select("ts", "asset", "price"), daily.select("ts", "asset", (F.col("n") / 1000).alias("weight"))))


@query()
def pca_weights(spark, sf_dir):
    wide = _daily(spark, sf_dir).groupBy("ts").pivot("asset").agg(F.first("price")).na.drop()
    names = sorted(c for c in wide.columns if c != "ts")
    w = bars.pca_weights(bars.covariance(wide, names))
    return spark.createDataFrame([(a, round(float(x), 9)) for a, x in zip(names, w, strict=True)], "asset string, weight double")


@query(f"""WITH {_CLOSES} SELECT a.symbol, a.ts, round(a.close / b.close - 1, 6) AS ret FROM closes a ASOF JOIN closes b ON a.symbol = b.symbol AND a.ts - INTERVAL 1 DAY > b.ts""")
def daily_returns(spark, sf_dir):
    return _round(labeling.daily_returns(_closes(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_CLOSES},
rets AS (SELECT a.symbol, a.ts, a.close / b.close - 1 AS x, row_number() OVER (PARTITION BY a.symbol ORDER BY a.ts) AS rn FROM closes a ASOF JOIN closes b ON a.symbol = b.symbol AND a.ts - INTERVAL 1 DAY > b.ts),
fold AS (
    SELECT symbol, ts, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS w, 0.0::DOUBLE AS ww, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS spread, CAST(0 AS BIGINT) AS n FROM rets WHERE rn = 1
    UNION ALL
    SELECT symbol, ts, rn, nw, ww * q * q + CAST(ok AS INT), CASE WHEN ok THEN mean + (x - mean) / nw ELSE mean END, spread * q + CASE WHEN ok THEN (x - mean) * (x - mean) * (1 - 1 / nw) ELSE 0 END, n + CAST(ok AS INT)
    FROM (SELECT r.symbol, r.ts, r.rn, r.x, isfinite(r.x) AS ok, f.ww, f.mean, f.spread, f.n, 1 - 2 / 51.0 AS q, f.w * (1 - 2 / 51.0) + CAST(isfinite(r.x) AS INT) AS nw FROM fold f JOIN rets r ON r.symbol = f.symbol AND r.rn = f.rn + 1)
) SELECT symbol, ts, CASE WHEN n > 1 THEN round(sqrt(spread / w * (w * w) / (w * w - ww)), 6) END AS vol FROM fold WHERE rn > 0""")
def daily_volatility(spark, sf_dir):
    return _round(labeling.daily_volatility(_closes(spark, sf_dir), 50))


@query(f"WITH {_EVENTS} SELECT symbol, t0, t1 FROM ev WHERE t1 IS NOT NULL")
def vertical_barriers(spark, sf_dir):
    closes = _closes(spark, sf_dir)
    return labeling.vertical_barriers(_events(closes).select("symbol", "t0"), closes, 10)


@query(f"WITH {_TOUCHED} SELECT symbol, t0, t1, round(trgt, 6) AS trgt, side FROM done")
def triple_barrier_events(spark, sf_dir):
    closes = _closes(spark, sf_dir)
    return _round(labeling.triple_barrier_events(closes, _events(closes), 1.5, 2.0, 0.1))


@query(f"""WITH {_TOUCHED} SELECT d.symbol, d.t0, round((b.close / a.close - 1) * side, 6) AS ret, CASE WHEN (b.close / a.close - 1) * side <= 0 THEN 0.0::DOUBLE ELSE 1.0 END AS bin
FROM done d JOIN closes a ON a.symbol = d.symbol AND a.ts = d.t0 JOIN closes b ON b.symbol = d.symbol AND b.ts = d.t1""")
def label_bins(spark, sf_dir):
    closes = _closes(spark, sf_dir)
    return _round(labeling.bins(labeling.triple_barrier_events(closes, _events(closes), 1.5, 2.0, 0.1), closes))


@query("""WITH l AS (SELECT vec_id, CAST(CASE WHEN label < 6 THEN 0 WHEN label < 9 THEN 1 ELSE -1 END AS DOUBLE) AS bin FROM embeddings),
c AS (SELECT bin, count(*) AS n FROM l GROUP BY bin) SELECT vec_id, bin FROM l WHERE bin NOT IN (SELECT bin FROM c WHERE (SELECT count(*) FROM c) > 2 AND n = (SELECT min(n) FROM c) AND n / (SELECT sum(n) FROM c) <= 0.2)""")
def dropped_labels(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.when(F.col("label") < 6, 0.0).when(F.col("label") < 9, 1.0).otherwise(-1.0).alias("bin"))
    return labeling.drop_labels(rows, 0.2)


@query(f"WITH {_COUNTED} SELECT symbol, ts, concurrency FROM conc")
def concurrency(spark, sf_dir):
    closes = _closes(spark, sf_dir)
    return weights.concurrency(closes, _events(closes))


@query(f"""WITH {_COUNTED} SELECT s.symbol, s.t0, round(avg(1.0 / c.concurrency), 6) AS weight FROM span s JOIN conc c USING (symbol, ts) GROUP BY ALL""")
def average_uniqueness(spark, sf_dir):
    closes = _closes(spark, sf_dir)
    return _round(weights.average_uniqueness(closes, _events(closes)))


@query(f"""WITH {_COUNTED}, r AS (SELECT symbol, ts, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY ts) AS r FROM closes)
SELECT s.symbol, s.t0, round(abs(sum(r.r / c.concurrency)), 6) AS weight FROM span s JOIN conc c USING (symbol, ts) JOIN r USING (symbol, ts) GROUP BY ALL""")
def return_attribution(spark, sf_dir):
    closes = _closes(spark, sf_dir)
    return _round(weights.return_attribution(closes, _events(closes)))


@query(f"""WITH {_EVENTS}, s AS (SELECT symbol, t0, trgt, sum(trgt) OVER (PARTITION BY symbol) AS total, sum(trgt) OVER (PARTITION BY symbol ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS upto FROM ev)
SELECT symbol, t0, round(trgt, 9) AS weight, round(greatest(0, 1 - 0.5 / total * total + 0.5 / total * upto), 9) AS decay FROM s""")
def time_decay(spark, sf_dir):
    return _round(weights.time_decay(_events(_closes(spark, sf_dir)).select("symbol", "t0", F.col("trgt").alias("weight")), 0.5), 9)


@query(f"WITH {_SPANS} SELECT symbol, ts, t0 FROM span")
def indicator_matrix(spark, sf_dir):
    closes = _closes(spark, sf_dir)
    return weights.indicator_matrix(closes, _events(closes))


@query(f"""WITH {_SPANS}, m AS (SELECT symbol, ts, t0, count(*) OVER (PARTITION BY symbol, ts) AS c FROM span)
SELECT symbol, t0, round(avg(1.0 / c), 6) AS uniqueness FROM m GROUP BY ALL""")
def matrix_uniqueness(spark, sf_dir):
    closes = _closes(spark, sf_dir)
    return _round(weights.matrix_uniqueness(weights.indicator_matrix(closes, _events(closes))))


@query()
def sequential_bootstrap(spark, sf_dir):
    closes = _closes(spark, sf_dir)
    return weights.sequential_bootstrap(closes, _events(closes))


@query()
def monte_carlo_uniqueness(spark, sf_dir):
    return weights.monte_carlo_uniqueness(weights.monte_carlo_jobs(spark, 25, 250, 10, 50).repartition(8))


@query("""WITH RECURSIVE d AS (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0])::DOUBLE AS d), w AS (SELECT d, 0 AS lag, 1.0::DOUBLE AS weight FROM d UNION ALL SELECT d, lag + 1, -weight * (d - lag) / (lag + 1) FROM w WHERE lag < 7)
SELECT d, lag, round(weight, 9) AS weight FROM w""")
def fracdiff_weights(spark, sf_dir):
    return _round(fracdiff.weight_curves(spark, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], 8), 9)


@query(f"""WITH RECURSIVE {_CLOSES}, w AS (SELECT 0 AS k, 1.0::DOUBLE AS w UNION ALL SELECT k + 1, -w * (0.4 - k) / (k + 1) FROM w WHERE abs(w * (0.4 - k) / (k + 1)) >= 0.01),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM closes)
SELECT a.symbol, a.ts, round(sum(w.w * b.close), 6) AS close FROM p a JOIN w ON true JOIN p b ON b.symbol = a.symbol AND b.rn = a.rn - w.k WHERE a.rn > (SELECT max(k) FROM w) GROUP BY ALL""")
def fracdiff_fixed_width(spark, sf_dir):
    return _round(fracdiff.fixed_width(_closes(spark, sf_dir), 0.4, 0.01))


@query(f"""WITH RECURSIVE {_CLOSES}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM closes),
w AS (SELECT 0 AS k, 1.0::DOUBLE AS w UNION ALL SELECT k + 1, -w * (0.4 - k) / (k + 1) FROM w WHERE k + 1 < (SELECT max(n) FROM p)),
s AS (SELECT n.symbol, n.n, w.k, sum(abs(w.w)) OVER (PARTITION BY n.symbol ORDER BY w.k DESC) / sum(abs(w.w)) OVER (PARTITION BY n.symbol) AS lost FROM (SELECT DISTINCT symbol, n FROM p) n JOIN w ON w.k < n.n),
skip AS (SELECT symbol, count(*) FILTER (lost > 0.05) AS skip FROM s GROUP BY symbol)
SELECT a.symbol, a.ts, round(sum(w.w * b.close), 4) AS close FROM p a JOIN skip USING (symbol) JOIN p b ON b.symbol = a.symbol AND b.rn <= a.rn JOIN w ON w.k = a.rn - b.rn WHERE a.rn > skip.skip GROUP BY ALL""")
def fracdiff_expanding(spark, sf_dir):
    return _round(fracdiff.expanding(_closes(spark, sf_dir), 0.4, 0.05), 4)


_PHI = "(0.5 + exp(-x * x) * list_sum(list_transform(range(0, 121), lambda i: CASE WHEN x = 0 THEN 0 ELSE sign(x) * exp(i * ln(2.0) + (2 * i + 1) * ln(abs(x)) - (lgamma(2 * i + 2.0) - i * ln(2.0) - lgamma(i + 1.0))) END)) / sqrt(pi()))"

#: Unit-root regression with a constant and one lag from centred sums, and its p-value by the response surface (fixed values).
_ADF = f"""WITH RECURSIVE {_CLOSES}, logs AS (SELECT symbol, ln(close) AS y, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM closes WHERE close > 0),
w AS (SELECT CAST(unnest(range(11)) AS DOUBLE) / 10 AS d, 0 AS k, 1.0::DOUBLE AS w UNION ALL SELECT d, k + 1, -w * (d - k) / (k + 1) FROM w WHERE abs(w * (d - k) / (k + 1)) >= 0.01),
f AS (SELECT w.d, a.symbol, a.rn, a.y, sum(w.w * b.y) AS x FROM w JOIN (SELECT d, max(k) AS m FROM w GROUP BY d) USING (d) JOIN logs a ON a.rn > m JOIN logs b ON b.symbol = a.symbol AND b.rn = a.rn - w.k GROUP BY ALL),
s AS (SELECT *, lag(x) OVER o AS l, x - lag(x) OVER o AS dy FROM f WINDOW o AS (PARTITION BY d, symbol ORDER BY rn)),
t AS (SELECT *, lag(dy) OVER (PARTITION BY d, symbol ORDER BY rn) AS dl FROM s),
m AS (SELECT d, symbol, count(*) AS n, covar_pop(l, l) AS a, covar_pop(l, dl) AS b, covar_pop(dl, dl) AS c, covar_pop(l, dy) AS u, covar_pop(dl, dy) AS v, covar_pop(dy, dy) AS q FROM t WHERE dl IS NOT NULL GROUP BY d, symbol),
e AS (SELECT *, (u * c - v * b) / (a * c - b * b) AS b0, (v * a - u * b) / (a * c - b * b) AS b1 FROM m),
z AS (SELECT d, symbol, n, b0 / sqrt((q - b0 * u - b1 * v) / (n - 3) * c / (a * c - b * b)) AS stat FROM e),
p AS (SELECT *, greatest(-6, least(6, CASE WHEN stat <= -1.61 THEN 2.1659 + 1.4412 * stat + 0.038269 * stat * stat ELSE 1.7339 + 0.93202 * stat - 0.12745 * stat * stat - 0.010368 * stat * stat * stat END)) / sqrt(2.0) AS x FROM z),
k AS (SELECT d, symbol, corr(x, y) AS corr FROM f GROUP BY d, symbol)
SELECT symbol, round(d, 6) AS d, round(stat, 6) AS stat, round(CASE WHEN stat > 2.74 THEN 1.0 WHEN stat < -18.83 THEN 0.0 ELSE PHI END, 6) AS p_value, CAST(1 AS BIGINT) AS lags, n AS n_obs,
    round(-2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.04 / (n * n * n), 6) AS critical_5, round(corr, 6) AS corr FROM p JOIN k USING (d, symbol)"""


@query(_ADF.replace("PHI", _PHI))
def least_difference_order(spark, sf_dir):
    return _round(fracdiff.least_order(_closes(spark, sf_dir)))


def _dates(spark, sf_dir):
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").alias("t0")).distinct()
    placed = joins.with_position(days, ["t0"])
    last = placed.agg(F.max("t0").alias("last"))
    ahead = placed.select((F.col("pos") - 5).alias("pos"), F.col("t0").alias("t1"))
    spans = placed.join(ahead, "pos", "left").join(F.broadcast(last)).select("t0", F.coalesce("t1", "last").alias("t1"))
    return validation.intervals(spans).select("pos", "t0", "t1").cache()


_LABELS = """d AS (SELECT DISTINCT o_orderdate AS t0 FROM orders), labels AS (SELECT row_number() OVER (ORDER BY t0) - 1 AS pos, t0, coalesce(lead(t0, 5) OVER (ORDER BY t0), max(t0) OVER ()) AS t1, count(*) OVER () AS n FROM d)"""


@query(f"WITH {_LABELS} SELECT pos, t0, t1 FROM labels")
def label_intervals(spark, sf_dir):
    return _dates(spark, sf_dir)


@query(f"WITH {_LABELS}, test AS (SELECT min(t0) AS low, max(t1) AS high FROM labels WHERE pos BETWEEN 300 AND 399) SELECT pos, t0, t1 FROM labels, test WHERE NOT (t0 <= high AND t1 >= low)")
def train_times(spark, sf_dir):
    labels = _dates(spark, sf_dir)
    test = labels.where("pos between 300 and 399").agg(F.min("t0").alias("low"), F.max("t1").alias("high"))
    return validation.train_times(labels, test)


@query(f"WITH {_LABELS} SELECT t0, coalesce(lead(t0, CAST(floor(n * 0.05) AS INT)) OVER (ORDER BY t0), max(t0) OVER ()) AS embargo FROM labels")
def embargo_times(spark, sf_dir):
    return validation.embargo_times(_dates(spark, sf_dir), 0.05)


@query(f"""WITH {_LABELS}, f AS (SELECT k AS split, k * (n // 4) + least(k, n % 4) AS low, (k + 1) * (n // 4) + least(k + 1, n % 4) AS high, n FROM (SELECT unnest(range(4)) AS k), (SELECT max(n) AS n FROM labels)),
b AS (SELECT f.*, min(t0) AS s, max(t1) AS e FROM f JOIN labels l ON l.pos >= low AND l.pos < high GROUP BY ALL),
c AS (SELECT b.*, (SELECT count(*) FROM labels WHERE t0 < e) AS first FROM b)
SELECT CAST(split AS INT) AS split, pos, CASE WHEN pos >= low AND pos < high THEN 'test' ELSE 'train' END AS role FROM labels l, c
WHERE (pos >= low AND pos < high) OR t1 <= s OR (first < c.n AND pos >= first + CAST(floor(c.n * 0.03) AS INT))""")
def purged_kfold(spark, sf_dir):
    return validation.purged_kfold(_dates(spark, sf_dir), 4, 0.03)


_CPCV = f"""{_LABELS}, g AS (SELECT *, least(pos // (n // 5), 4) AS g FROM labels),
c AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS split FROM (SELECT unnest(range(5)) AS a), (SELECT unnest(range(5)) AS b) WHERE a < b),
t AS (SELECT c.split, g.* FROM c JOIN g ON g.g IN (c.a, c.b)),
spans AS (SELECT split, g, min(t0) AS low, max(t1) AS high, max(pos) AS last FROM t GROUP BY ALL)"""


@query(f"""WITH {_CPCV} SELECT CAST(split AS INT) AS split, pos, 'test' AS role FROM t UNION ALL
SELECT CAST(c.split AS INT), g.pos, 'train' FROM c JOIN g ON g.g NOT IN (c.a, c.b)
WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.split = c.split AND g.t0 <= s.high AND g.t1 >= s.low)
  AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.split = c.split AND g.pos > s.last AND g.pos <= s.last + CAST(ceil(g.n * 0.01) AS INT))""")
def combinatorial_splits(spark, sf_dir):
    return validation.combinatorial_splits(_dates(spark, sf_dir), 5, 2, 0.01)


@query("""WITH c AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split, [a, b] AS t FROM (SELECT unnest(range(5)) AS a), (SELECT unnest(range(5)) AS b) WHERE a < b), x AS (SELECT split, unnest(t) AS grp FROM c)
SELECT CAST(row_number() OVER (PARTITION BY grp ORDER BY split) - 1 AS INT) AS path, CAST(grp AS INT) AS grp, CAST(split AS INT) AS split FROM x""")
def backtest_paths(spark, sf_dir):
    splits = validation.combinatorial_splits(_dates(spark, sf_dir), 5, 2, 0.01)
    return validation.backtest_paths(validation.split_table(splits, 5, 2), 5)


def _returns(spark, sf_dir):
    daily = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.date_trunc("month", "o_orderdate").alias("m"), F.col("o_orderpriority").alias("strategy")).agg(F.sum("o_totalprice").alias("x"))
    by = ordered(["strategy"], "m")
    moved = daily.withColumn("ret", quotient(F.col("x"), F.lag("x").over(by)) - 1).withColumn("pos", F.row_number().over(by) - 2).where("ret is not null")
    return moved.select("pos", "strategy", "ret")


def _blocks(returns: DataFrame, blocks: int) -> DataFrame:
    """Blocks are equally long: the oldest rows beyond a multiple of their number go (fewer than ``blocks`` of them)."""
    spare = returns.agg((F.count_distinct("pos") % blocks).alias("spare"))
    return returns.join(F.broadcast(spare)).where("pos >= spare").select((F.col("pos") - F.col("spare")).alias("pos"), "strategy", "ret")


_RETURNS = """m AS (SELECT date_trunc('month', o_orderdate) AS m, o_orderpriority AS strategy, sum(o_totalprice) AS x FROM orders GROUP BY ALL),
r AS (SELECT * FROM (SELECT strategy, x / lag(x) OVER w - 1 AS ret, row_number() OVER w - 2 AS pos FROM m WINDOW w AS (PARTITION BY strategy ORDER BY m)) WHERE ret IS NOT NULL)"""


@query(f"WITH {_RETURNS} SELECT strategy, round(avg(ret - 0.001) / stddev_samp(ret - 0.001) * sqrt(12), 6) AS sharpe FROM r GROUP BY strategy")
def sharpe_ratio(spark, sf_dir):
    return _round(overfitting.sharpe_ratio(_returns(spark, sf_dir), risk_free=0.001, periods=12))


_CSCV = f"""{_RETURNS}, z AS (SELECT count(DISTINCT pos) AS n FROM r), b AS (SELECT (pos - n % 6) // (n // 6) AS block, r.* FROM r, z WHERE pos >= n % 6),
c AS (SELECT row_number() OVER (ORDER BY x, y, z) - 1 AS split, [x, y, z] AS t FROM (SELECT unnest(range(6)) AS x), (SELECT unnest(range(6)) AS y), (SELECT unnest(range(6)) AS z) WHERE x < y AND y < z),
s AS (SELECT split, strategy, avg(ret) FILTER (list_contains(t, block)) / stddev_samp(ret) FILTER (list_contains(t, block)) * sqrt(252) AS i, avg(ret) FILTER (NOT list_contains(t, block)) / stddev_samp(ret) FILTER (NOT list_contains(t, block)) * sqrt(252) AS o FROM b, c GROUP BY ALL),
k AS (SELECT *, (rank() OVER (PARTITION BY split ORDER BY o) + (count(*) OVER (PARTITION BY split, o) - 1) / 2.0) / (count(*) OVER (PARTITION BY split) + 1) AS q, row_number() OVER (PARTITION BY split ORDER BY i DESC, strategy) AS n FROM s)"""


@query(f"WITH {_CSCV} SELECT CAST(split AS INT) AS split, strategy, round(i, 6) AS is_metric, round(o, 6) AS oos_metric, round(q, 6) AS relative_rank, round(ln(q / (1 - q)), 6) AS logit FROM k WHERE n = 1")
def symmetric_cross_validation(spark, sf_dir):
    return _round(overfitting.cscv(_blocks(_returns(spark, sf_dir), 6), 6).drop("in_blocks", "out_blocks"))


@query(f"WITH {_CSCV} SELECT round(avg(CASE WHEN ln(q / (1 - q)) <= 0 THEN 1.0 ELSE 0.0 END), 6) AS pbo FROM k WHERE n = 1")
def overfitting_probability(spark, sf_dir):
    return _round(overfitting.overfitting_probability(overfitting.cscv(_blocks(_returns(spark, sf_dir), 6), 6)))


def _bets(spark, sf_dir):
    events = _events(_closes(spark, sf_dir))
    prob = 0.5 + F.least(F.col("trgt"), F.lit(0.9)) / 2
    return events.select("symbol", "t0", "t1", prob.alias("prob"), F.lit(1.0).alias("pred"), "side")


_BETS = f"""{_EVENTS}, p AS (SELECT symbol, n, 0.5 + least(trgt, 0.9) / 2 AS p, side FROM ev), z AS (SELECT *, greatest(-6, least(6, (p - 0.5) / sqrt(p * (1 - p)))) / sqrt(2.0) AS x FROM p),
sig AS (SELECT symbol, n, side * (2 * {_PHI} - 1) AS s FROM z),
act AS (SELECT p.symbol, p.ts AS t, avg(s) AS s FROM (SELECT *, unnest(range(10)) AS k FROM sig) g JOIN placed p ON p.symbol = g.symbol AND p.n = g.n + g.k GROUP BY ALL)"""


@query(f"WITH {_BETS} SELECT symbol, t, round(s, 6) AS signal FROM act")
def average_active_signals(spark, sf_dir):
    bets = _bets(spark, sf_dir)
    signals = bets.withColumn("signal", sizing.raw_signal(F.col("prob"), F.col("pred"), 2) * F.col("side"))
    return _round(sizing.average_active(signals))


@query(f"WITH {_BETS} SELECT symbol, t, round(greatest(-1, least(1, round_even(s / 0.1, 0) * 0.1)), 6) AS signal FROM act")
def bet_signal(spark, sf_dir):
    return _round(sizing.signal(_bets(spark, sf_dir), 0.1))


@query("""WITH w AS (SELECT 100 * (1 / (0.95 * 0.95) - 1) AS w), p AS (SELECT p_partkey, p_retailprice AS f, p_retailprice - p_size + 20 AS m, w FROM part, w),
t AS (SELECT *, CAST(trunc((f - m) / sqrt(w + (f - m) * (f - m)) * 100) AS INT) AS target FROM p)
SELECT p_partkey, round((f - m) / sqrt(w + (f - m) * (f - m)), 6) AS bet_size, target AS target_position,
  round(CASE WHEN target = 0 THEN NULL ELSE (SELECT avg(f - (sign(target) * j / 100.0) * sqrt(w / (1 - (j / 100.0) * (j / 100.0)))) FROM (SELECT unnest(range(1, abs(target) + 1)) AS j)) END, 6) AS limit_price FROM t""")
def position_sizes(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = parts.select("p_partkey", F.col("p_retailprice").alias("f"), (F.col("p_retailprice") - F.col("p_size") + 20).alias("m"), sizing.calibrate_w(F.lit(10.0), F.lit(0.95)).alias("w"))
    rows = rows.withColumn("target_position", sizing.target_position(F.col("w"), F.col("f"), F.col("m"), F.lit(100)))
    price = sizing.limit_price(F.col("target_position"), F.lit(0), F.col("f"), F.col("w"), F.lit(100))
    return _round(rows.select("p_partkey", sizing.bet_size(F.col("w"), F.col("f") - F.col("m")).alias("bet_size"), "target_position", price.alias("limit_price")))


@query()
def trading_rules(spark, sf_dir):
    levels = [0.5 + i * 6.5 / 19 for i in range(20)]
    return synthetic.trading_rules(spark, [0.0, 5.0, -5.0], [5.0, 25.0, 100.0], levels, levels, 1.0, 1500, 100, 42)


@query("""WITH x AS (SELECT event_id, user_id, ts, value FROM events), o AS (SELECT user_id, ts AS ots, value AS v FROM events WHERE event_type = (SELECT min(event_type) FROM events))
SELECT event_id, round(v, 6) AS before FROM x ASOF LEFT JOIN o ON x.user_id = o.user_id AND x.ts > o.ots""")
def asof_join(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = events.agg(F.min("event_type").alias("k"))
    right = events.join(F.broadcast(kind), F.col("event_type") == F.col("k")).select("user_id", "ts", "value")
    return _round(joins.asof(events.select("event_id", "user_id", "ts"), right, ("user_id",), "ts", "value", strict=True, alias="before").select("event_id", "before"))


def _features(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """A column for each component of the vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    names = [f"f{i}" for i in range(rows.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    out = rows.select(F.col("vec_id").alias("id"), (F.col("label") > 4).cast("int").alias("label"), F.lit(1.0).alias("weight"), *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)))
    out = joins.with_position(out, ["id"])
    last = out.agg(F.max("pos").alias("m")).first()["m"] or 0
    return out.withColumns({"t0": F.col("pos"), "t1": F.least(F.col("pos") + 3, F.lit(last))}).drop("id"), names


@query()
def cross_validation_scores(spark, sf_dir):
    df, names = _features(spark, sf_dir)
    scores = models.cross_validate(models.random_forest(10, seed=1), models.assemble(df, names), "accuracy", 3, 0.01)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "fold int, score double")


@query()
def hyperparameter_search(spark, sf_dir):
    df, names = _features(spark, sf_dir)
    return models.search(models.assemble(df, names), lambda reg: models.scaled_logistic(reg), {"reg": (0.01, 1.0)}, 2, 0.01, draws=2)[2]


@query()
def boosted_trees(spark, sf_dir):
    df, names = _features(spark, sf_dir)
    data = models.assemble(df, names)
    return models.predict(models.Boosting(rounds=3).fit(data), data).select("pos", "label", "prediction", "p1")


@query()
def importance_mdi(spark, sf_dir):
    df, names = _features(spark, sf_dir)
    return models.feature_importance(df, names, 10, 2, method="MDI")[0]


@query()
def importance_mda(spark, sf_dir):
    df, names = _features(spark, sf_dir)
    return models.mda(models.random_forest(5), df, names, 2)[0]


@query()
def importance_sfi(spark, sf_dir):
    df, names = _features(spark, sf_dir)
    return models.sfi(models.random_forest(5), df, names, 2)


@query()
def orthogonal_features(spark, sf_dir):
    df, names = _features(spark, sf_dir)
    return models.orthogonal_features(df, names, 0.9)
