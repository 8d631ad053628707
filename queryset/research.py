"""Queries over the research measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import bars as B, quotes as P, research as R, trades as T
from tapeloom.operators.ordered import by_length
from tapeloom.plans.exits import pnl_pct

from . import quotes as QQ, views as V
from .core import query
from .views import with_views

S = V.BAR_SERIES
RETS = "SELECT *, (close - lag(close) OVER w) / lag(close) OVER w AS ret, ln(close / lag(close) OVER w) AS lr FROM {0} WINDOW w AS (PARTITION BY ticker ORDER BY ts)"


@query("res_flow_imbalance", with_views("quotes", f"""SELECT ticker, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
    CASE WHEN sum(up_volume + down_volume) > 0 THEN (sum(up_volume) - sum(down_volume)) / sum(up_volume + down_volume) END AS imbalance
    FROM (SELECT ticker, ts, {QQ.split_sql()} FROM deltas) GROUP BY ticker, time_bucket(INTERVAL 1 HOUR, ts)""", deltas=QQ.DELTA),
       stamps="window_start", doubles="imbalance")
def res_flow_imbalance(spark, sf):
    return R.flow_imbalance(P.classify_ticks(V.quotes(spark, sf), V.QUOTE_SERIES))


@query("res_amihud", with_views("bars_calm", """SELECT ticker, ts, avg(abs(ret) / (close * volume)) OVER (PARTITION BY ticker ORDER BY ts
    ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) * 1000000 AS illiquidity FROM r""", r=RETS.format("bars_calm")), stamps="ts", doubles="illiquidity")
def res_amihud(spark, sf):
    out = R.amihud(V.bars_calm(spark, sf), S)
    return out.select("ticker", "ts", (F.col("illiquidity") * 1_000_000).alias("illiquidity"))


RSI = {
    "moved": """SELECT ticker, ts, row_number() OVER w - 2 AS j, greatest(close - lag(close) OVER w, 0) AS g, greatest(lag(close) OVER w - close, 0) AS l
        FROM bars_calm WINDOW w AS (PARTITION BY ticker ORDER BY ts)""",
    "wilder": """WITH RECURSIVE seed AS (SELECT ticker, avg(g) AS g, avg(l) AS l FROM moved WHERE j BETWEEN 0 AND 13 GROUP BY ticker),
        step AS (SELECT m.ticker, m.j, s.g, s.l FROM moved m JOIN seed s USING (ticker) WHERE m.j = 13 UNION ALL
          SELECT m.ticker, m.j, (p.g * 13 + m.g) / 14, (p.l * 13 + m.l) / 14 FROM step p JOIN moved m ON m.ticker = p.ticker AND m.j = p.j + 1)
        SELECT * FROM step""",
}


@query("res_rsi", with_views("bars_calm", """SELECT m.ticker, m.ts, CASE WHEN w.g + w.l > 0 THEN 100 * w.g / (w.g + w.l) WHEN w.j IS NOT NULL THEN 50e0 END AS rsi
    FROM moved m LEFT JOIN wilder w ON w.ticker = m.ticker AND w.j = m.j""", **RSI), stamps="ts", doubles="rsi")
def res_rsi(spark, sf):
    bars = V.stored(V.bars_calm(spark, sf).select("ticker", "ts", "close"), "bars")
    return by_length(bars, S, B.rsi).select("ticker", "ts", "rsi")


@query("res_realized_vol", with_views("quote_bars", """SELECT ticker, CAST(ts AS DATE) AS day, sqrt(sum(lr * lr)) AS realized_vol FROM r GROUP BY ALL""",
                                      r=RETS.format("quote_bars")), dates="day", doubles="realized_vol")
def res_realized_vol(spark, sf):
    return R.realized_vol_daily(V.quote_bars(spark, sf))


@query("res_realized_vol_rolling", with_views("bars_calm", """SELECT ticker, ts, sqrt(sum(lr * lr) OVER (PARTITION BY ticker ORDER BY ts
    ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS realized_vol FROM r""", r=RETS.format("bars_calm")), stamps="ts", doubles="realized_vol")
def res_realized_vol_rolling(spark, sf):
    return R.realized_vol_rolling(V.bars_calm(spark, sf), S).select("ticker", "ts", "realized_vol")


@query("res_intraday_profile", with_views("quote_bars", f"""SELECT CAST(hour({QQ.NY}) AS INTEGER) AS hour, avg(ret) AS mean_ret, avg(abs(ret)) AS mean_abs_ret,
    avg(volume) AS mean_volume FROM r GROUP BY 1""", r=RETS.format("quote_bars")), doubles="mean_ret mean_abs_ret mean_volume")
def res_intraday_profile(spark, sf):
    return R.intraday_profile(V.quote_bars(spark, sf))


@query("res_momentum_rank", with_views("bars_calm", """SELECT CAST(decile AS INTEGER) AS decile, avg(momentum) AS mean_momentum, avg(forward) AS mean_forward, count(*) AS n
    FROM (SELECT *, ntile(10) OVER (PARTITION BY ts ORDER BY momentum, ticker) AS decile FROM (SELECT ticker, ts, (close - p) / p AS momentum, (f - close) / close AS forward
    FROM (SELECT *, lag(close, 5) OVER w AS p, lead(close, 3) OVER w AS f FROM bars_calm WINDOW w AS (PARTITION BY ticker ORDER BY ts))
    WHERE p > 0 AND f IS NOT NULL AND close > 0)) GROUP BY decile"""), doubles="mean_momentum mean_forward")
def res_momentum_rank(spark, sf):
    return R.momentum_deciles(V.bars_calm(spark, sf), S)


@query("res_event_study", with_views("quote_bars news_tickers", """SELECT CAST(h AS INTEGER) AS horizon, avg((CASE h WHEN 1 THEN h1 WHEN 5 THEN h5 ELSE h10 END - close) / close) AS mean_return,
    count(CASE h WHEN 1 THEN h1 WHEN 5 THEN h5 ELSE h10 END) AS events FROM (SELECT b.* FROM news_tickers n ASOF JOIN (
    SELECT *, lead(close, 1) OVER w AS h1, lead(close, 5) OVER w AS h5, lead(close, 10) OVER w AS h10 FROM quote_bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)) b
    ON n.ticker = b.ticker AND n.created_at < b.ts WHERE b.close > 0), (VALUES (1), (5), (10)) t(h) GROUP BY h"""), doubles="mean_return")
def res_event_study(spark, sf):
    n = V.news_once(spark, sf).select("id", F.explode("symbols").alias("ticker"), "created_at")
    return R.event_study(n, V.quote_bars(spark, sf))


INTENSITY = {
    "gaps": """SELECT event_id, ticker, row_number() OVER w AS rn,
        exp(-(epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000e0 / 3600) AS d FROM polls WINDOW w AS (PARTITION BY ticker ORDER BY ts)""",
    "walked": """WITH RECURSIVE walk AS (SELECT event_id, ticker, rn, 0e0 AS intensity FROM gaps WHERE rn = 1 UNION ALL
        SELECT g.event_id, g.ticker, g.rn, g.d * (w.intensity + 1) FROM walk w JOIN gaps g ON g.ticker = w.ticker AND g.rn = w.rn + 1)
        SELECT event_id, intensity FROM walk""",
}


@query("res_event_intensity", with_views("polls", "SELECT event_id, intensity FROM walked", **INTENSITY), doubles="intensity")
def res_event_intensity(spark, sf):
    polls = V._polls(spark, sf).select("event_id", "ticker", "ts")
    return R.event_intensity(polls, V.QUOTE_SERIES, 1.0 / 3600).select("event_id", "intensity")


TRIPS = """SELECT e.event_id, e.ts AS entry_time, e.price AS entry_price, (x.price - e.price) / e.price * 100 AS pnl_pct, x.price - e.price AS pnl_usd
    FROM (SELECT * FROM trade_events WHERE event = 'ENTRY') e ASOF JOIN (SELECT * FROM trade_events WHERE event = 'EXIT') x ON e.ticker = x.ticker AND e.ts < x.ts"""
SPLIT = """SELECT *, CASE WHEN q < 0.6 THEN 'train' WHEN q < 0.8 THEN 'validation' ELSE 'test' END AS split FROM (
    SELECT *, (row_number() OVER (ORDER BY entry_time, event_id) - 1) / (SELECT count(*) FROM trips) AS q FROM trips)"""


def trips(spark, sf):
    t = T.round_trips(V.trade_events(spark, sf).withColumnRenamed("event_id", "log_id"), tie=["log_id"])
    t = t.filter(F.col("exit_time").isNotNull()).withColumnRenamed("log_id", "event_id")
    return t.select("event_id", "entry_time", "entry_price", pnl_pct(F.col("exit_price"), F.col("entry_price")).alias("pnl_pct"),
                    (F.col("exit_price") - F.col("entry_price")).alias("pnl_usd"))


@query("res_cost_adjusted", with_views("trade_events", """SELECT count(*) AS trades, avg(pnl_pct) AS gross_pct, avg(pnl_pct - 0.3e0) AS net_pct,
    avg(CASE WHEN pnl_pct > 0 THEN 1e0 ELSE 0 END) AS share_positive_gross, avg(CASE WHEN pnl_pct - 0.3e0 > 0 THEN 1e0 ELSE 0 END) AS share_positive_net FROM trips""",
                                       trips=TRIPS), doubles="gross_pct net_pct share_positive_gross share_positive_net")
def res_cost_adjusted(spark, sf):
    return R.cost_adjusted(trips(spark, sf))


@query("res_temporal_split", with_views("trade_events", "SELECT event_id, split FROM s", trips=TRIPS, s=SPLIT))
def res_temporal_split(spark, sf):
    return R.temporal_split(trips(spark, sf), ("entry_time", "event_id")).select("event_id", "split")


@query("res_parameter_sweep", with_views("trade_events", """SELECT threshold, train_pnl, validation_pnl, CASE WHEN is_best THEN test_pnl END AS test_pnl, trades, is_best FROM (
    SELECT *, row_number() OVER (ORDER BY validation_pnl DESC, threshold DESC) = 1 AS is_best FROM (SELECT t AS threshold,
    avg(pnl_pct) FILTER (split = 'train' AND entry_price >= t) AS train_pnl, avg(pnl_pct) FILTER (split = 'validation' AND entry_price >= t) AS validation_pnl,
    avg(pnl_pct) FILTER (split = 'test' AND entry_price >= t) AS test_pnl, count(*) FILTER (entry_price >= t) AS trades
    FROM s, (VALUES (1e0), (10e0), (50e0), (100e0), (200e0)) v(t) GROUP BY t))""", trips=TRIPS, s=SPLIT), doubles="train_pnl validation_pnl test_pnl")
def res_parameter_sweep(spark, sf):
    split = R.temporal_split(trips(spark, sf), ("entry_time", "event_id"))
    return R.parameter_sweep(split, "entry_price", [1.0, 10.0, 50.0, 100.0, 200.0])


@query("res_winner_concentration", with_views("trade_events", """SELECT *, top_pnl / total_pnl AS top_share FROM (SELECT sum(pnl_usd) AS total_pnl, count(*) AS trades,
    (SELECT sum(pnl_usd) FROM (SELECT pnl_usd FROM trips ORDER BY pnl_usd DESC LIMIT 10)) AS top_pnl FROM trips)""", trips=TRIPS), doubles="total_pnl top_pnl top_share")
def res_winner_concentration(spark, sf):
    return R.winner_concentration(trips(spark, sf))
