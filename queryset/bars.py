"""Queries over bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import bars as B
from tapeloom.operators.ordered import tail_rows

from . import views as V
from .core import query
from .views import with_views

S = V.BAR_SERIES
W = "WINDOW w AS (PARTITION BY ticker ORDER BY ts)"
OBV = f"""SELECT *, coalesce(sum(sv) OVER (PARTITION BY ticker ORDER BY ts), 0) AS obv FROM (
    SELECT *, coalesce(sign(close - lag(close) OVER w) * volume, 0) AS sv FROM bars_calm {W})"""
SWINGS = f"""SELECT *, close > max(close) OVER l AND close > max(close) OVER r AND count(*) OVER l = 2
    AND count(*) OVER r = 2 AS hi, close < min(close) OVER l AND close < min(close) OVER r
    AND count(*) OVER l = 2 AND count(*) OVER r = 2 AS lo FROM obv
    WINDOW l AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING),
           r AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)"""
RANKED = "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS swing_rank FROM swings WHERE hi"
TAIL = "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS rn FROM bars_calm"
BAR_COLS = ["ticker", "ts", "open", "high", "low", "close", "volume"]


@query("bars_from_ticks", with_views("bars_wild", "SELECT * FROM bars_wild"), stamps="ts",
       doubles="open high low close volume")
def bars_from_ticks(spark, sf):
    return V.bars_wild(spark, sf)


@query("agg_session_vwap", with_views("bars_wild", """SELECT ticker, year(ts) AS session,
    CASE WHEN sum(volume) > 0 THEN sum(close * volume) / sum(volume) END AS vwap
    FROM bars_wild GROUP BY ALL"""), doubles="vwap")
def session_vwap(spark, sf):
    bars = V.bars_wild(spark, sf).withColumn("session", F.year("ts").cast("bigint"))
    return B.session_vwap(bars)


@query("agg_cvd_significance", with_views("bars_calm", """SELECT ticker,
    coalesce(sum(volume) FILTER (c >= 0), 0) AS up_volume, coalesce(sum(volume) FILTER (c < 0), 0) AS down_volume,
    CASE WHEN sum(volume) FILTER (c IS NOT NULL) > 0 THEN (coalesce(sum(volume) FILTER (c >= 0), 0)
      - coalesce(sum(volume) FILTER (c < 0), 0)) / sum(volume) FILTER (c IS NOT NULL) ELSE 0 END AS net_cvd_ratio,
    count(*) >= 2 AND net_cvd_ratio <= -0.5 AS significant
    FROM (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS c FROM t WHERE rn <= 6)
    GROUP BY ticker""", t=TAIL), doubles="up_volume down_volume net_cvd_ratio")
def cvd_significance(spark, sf):
    return B.cvd_significance(V.bars_calm(spark, sf), S)


@query("win_obv", with_views("bars_calm", "SELECT ticker, ts, close, volume, obv FROM obv", obv=OBV),
       stamps="ts", doubles="close volume obv")
def win_obv(spark, sf):
    return B.obv(V.bars_calm(spark, sf), S).select("ticker", "ts", "close", "volume", "obv")


@query("win_cvd", with_views("bars_wild", """SELECT ticker, ts, coalesce(sum(sv) OVER (
    PARTITION BY ticker ORDER BY ts), 0) AS cvd FROM (SELECT *, coalesce(sign(close - lag(close) OVER w) * volume, 0)
    AS sv FROM bars_wild WINDOW w AS (PARTITION BY ticker ORDER BY ts))"""), stamps="ts", doubles="cvd")
def win_cvd(spark, sf):
    return B.cvd(V.bars_wild(spark, sf), S).select("ticker", "ts", "cvd")


@query("win_swing_highs", with_views("bars_calm", "SELECT ticker, ts, close FROM swings WHERE hi",
                                     obv=OBV, swings=SWINGS), stamps="ts", doubles="close")
def win_swing_highs(spark, sf):
    return B.swing_highs(V.bars_calm(spark, sf), S).select("ticker", "ts", "close")


@query("win_swing_lows", with_views("bars_calm", "SELECT ticker, ts, close FROM swings WHERE lo",
                                    obv=OBV, swings=SWINGS), stamps="ts", doubles="close")
def win_swing_lows(spark, sf):
    return B.swing_lows(V.bars_calm(spark, sf), S).select("ticker", "ts", "close")


@query("win_last_swing_low", with_views("bars_calm", """SELECT ticker, max_by(close, ts) FILTER (lo)
    AS swing_low_price FROM swings GROUP BY ticker""", obv=OBV, swings=SWINGS), doubles="swing_low_price")
def win_last_swing_low(spark, sf):
    return B.last_swing_low(V.bars_calm(spark, sf), S)


@query("win_swing_divergence", with_views("bars_calm", """SELECT ticker, coalesce(
    max(close) FILTER (swing_rank = 1) > max(close) FILTER (swing_rank = 2)
    AND max(obv) FILTER (swing_rank = 1) < max(obv) FILTER (swing_rank = 2), false) AS divergence
    FROM (SELECT DISTINCT ticker FROM bars_calm) LEFT JOIN ranked USING (ticker) GROUP BY ticker""",
                                          obv=OBV, swings=SWINGS, ranked=RANKED))
def win_swing_divergence(spark, sf):
    return B.swing_divergence(V.bars_calm(spark, sf), S).select("ticker", "divergence")


@query("win_true_range", with_views("true_range", "SELECT ticker, ts, tr AS true_range FROM true_range"),
       stamps="ts", doubles="true_range")
def win_true_range(spark, sf):
    return B.true_range(V.bars_calm(spark, sf), S).select("ticker", "ts", "true_range")


@query("win_atr", with_views("atr", "SELECT ticker, ts, atr FROM atr"), stamps="ts", doubles="atr")
def win_atr(spark, sf):
    return B.atr(V.bars_calm(spark, sf), S).select("ticker", "ts", "atr")


@query("agg_entry_stop", with_views("atr", """SELECT ticker, entry_price, atr, stop_pct, stop_capped,
    entry_price * (1 - stop_pct) AS stop_price FROM (SELECT *, greatest(0.02e0, least(implied, 0.1e0)) AS stop_pct,
    implied >= 0.1e0 AS stop_capped FROM (SELECT *, CASE WHEN atr IS NOT NULL AND entry_price > 0
      THEN 2.5e0 * atr / entry_price ELSE 0.1e0 END AS implied FROM (SELECT ticker, last(close ORDER BY ts) AS entry_price,
      last(atr ORDER BY ts) AS atr FROM atr GROUP BY ticker)))"""), doubles="entry_price atr stop_pct stop_price")
def agg_entry_stop(spark, sf):
    return B.stop_per_ticker(V.bars_calm(spark, sf), S)


@query("win_peak_pnl", with_views("positions bars_calm", """SELECT ticker, entry_time, ts,
    greatest(entry_price, max(close) OVER (PARTITION BY ticker, entry_time ORDER BY ts)) AS peak_price,
    (close - entry_price) / entry_price * 100 AS pnl_pct
    FROM (SELECT b.*, p.entry_time, p.entry_price FROM bars_calm b ASOF JOIN positions p ON b.ticker = p.ticker AND b.ts >= p.entry_time)"""),
       stamps="entry_time ts", doubles="peak_price pnl_pct")
def win_peak_pnl(spark, sf):
    from tapeloom.plans.exits import peak_pnl
    bars = V.stored(V.bars_calm(spark, sf), "bars")
    positions = V.positions(spark, sf, bars).select("ticker", "entry_time", "entry_price")
    return peak_pnl(bars, positions, S).select("ticker", "entry_time", "ts", "peak_price", "pnl_pct")


@query("top_tail_n", with_views("bars_calm", """SELECT ticker, ts, open, high, low, close, volume FROM t
    WHERE rn <= 20""", t=TAIL), stamps="ts", doubles="open high low close volume")
def top_tail_n(spark, sf):
    return tail_rows(V.bars_calm(spark, sf), S, 20).select(*BAR_COLS)


@query("top_last_row", with_views("bars_calm", """SELECT ticker, max_by(close, ts) AS last_close,
    max(ts) AS last_ts FROM bars_calm GROUP BY ticker"""), stamps="last_ts", doubles="last_close")
def top_last_row(spark, sf):
    return B.last_row(V.bars_calm(spark, sf), S)


@query("top_last_two_swings", with_views("bars_calm", """SELECT ticker, ts, close, obv, swing_rank FROM ranked
    WHERE swing_rank <= 2""", obv=OBV, swings=SWINGS, ranked=RANKED), stamps="ts", doubles="close obv")
def top_last_two_swings(spark, sf):
    return B.last_two_swings(V.bars_calm(spark, sf), S).select(
        "ticker", "ts", "close", "obv", F.col("swing_rank").cast("bigint").alias("swing_rank"))


