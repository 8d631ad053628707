"""Queries over quote polls and the joins around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import clock, quotes as Q
from tapeloom.operators import quotes as P, trades as T

from . import views as V
from .core import micros, query
from .views import with_views

S = V.QUOTE_SERIES
NY = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
PT = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles')"
ELAPSED = f"greatest(60e0, (epoch_us({NY}) - 14400000000 + 86400000000 * 40000) % 86400000000 / 1000000e0)"
METRICS = f"""SELECT q.*, a.adv, CASE WHEN last <> 0 AND previous_close > 0 THEN
    (last - previous_close) / previous_close * 100 END AS gap_pct, {ELAPSED} AS elapsed,
    CASE WHEN adv > 0 THEN adv * ({ELAPSED} / 23400e0) END AS baseline,
    CASE WHEN adv > 0 THEN total_volume / (adv * ({ELAPSED} / 23400e0)) ELSE 0 END AS rvol
    FROM quotes q LEFT JOIN adv a USING (ticker)"""
TIER = "SELECT * FROM metrics WHERE gap_pct >= 10 AND rvol >= 0.5 AND total_volume >= 1000"
SCANS = """SELECT * FROM metrics_scan WHERE gap_pct >= 10 AND rvol >= 0.5 AND total_volume >= 1000"""
METRICS_SCAN = METRICS.replace("FROM quotes q", """FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS scan_ts
    FROM quotes QUALIFY row_number() OVER (PARTITION BY ticker, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts DESC) = 1) q""")
DELTA = """SELECT *, CASE WHEN total_volume IS NOT NULL AND pm IS NOT NULL THEN greatest(total_volume - pm, 0e0) END AS delta
    FROM (SELECT *, max(total_volume) OVER p AS pm, last_value(CASE WHEN total_volume IS NOT NULL THEN last END IGNORE NULLS) OVER p AS pl
    FROM quotes WINDOW p AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def split_sql(delta: str = "delta", prev: str = "pl") -> str:
    def side(first: str, second: str, up: str, down: str) -> str:
        return (f"CASE WHEN {delta} IS NULL OR {delta} <= 0 THEN 0e0 WHEN last >= ask THEN {first} WHEN last <= bid "
                f"THEN {second} WHEN last > {prev} THEN {up} WHEN last < {prev} THEN {down} ELSE {delta} / 2 END")
    return (f"{side(delta, '0e0', delta, '0e0')} AS up_volume, {side('0e0', delta, '0e0', delta)} AS down_volume")


CONFIRM = {
    "sig": "SELECT signal_id, ticker, ts FROM quote_signals",
    "pairs": """SELECT s.signal_id, s.ts AS t0, q.ts, q.event_id, q.last, q.bid, q.ask, q.total_volume, a.adv
        FROM sig s JOIN quotes q ON q.ticker = s.ticker AND q.ts BETWEEN s.ts AND s.ts + INTERVAL 21600 SECOND
        LEFT JOIN adv a ON a.ticker = s.ticker""",
    "deltas": """SELECT *, CASE WHEN total_volume IS NOT NULL AND pm IS NOT NULL THEN greatest(total_volume - pm, 0e0) END AS delta
        FROM (SELECT *, max(total_volume) OVER p AS pm,
        last_value(CASE WHEN total_volume IS NOT NULL THEN last END IGNORE NULLS) OVER p AS pl FROM pairs
        WINDOW p AS (PARTITION BY signal_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "splits": f"SELECT *, {split_sql()} FROM deltas",
    "sums": """SELECT signal_id, t0, ts, event_id, adv * 21600 / 23400 AS baseline, sum(up_volume) OVER w AS up, sum(down_volume) OVER w AS down,
        count(total_volume) OVER w AS ok, count(*) FILTER (total_volume IS NULL) OVER w AS failed FROM splits
        WINDOW w AS (PARTITION BY signal_id ORDER BY ts, event_id)""",
    "states": """SELECT *, coalesce(baseline > 0 AND (up + down) / baseline >= 0.2 AND up + down > 0 AND up / (up + down) >= 0.6, false)
        AS passed FROM sums""",
    "picked": """SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY signal_id
        ORDER BY passed DESC, CASE WHEN passed THEN epoch_us(ts) ELSE -epoch_us(ts) END,
        CASE WHEN passed THEN event_id ELSE -event_id END) = 1""",
    "confirmed": """SELECT s.signal_id, s.ticker, s.ts, coalesce(passed, false) AS passed, coalesce(up + down, 0e0) AS volume_since,
        coalesce(up, 0e0) AS up_volume, coalesce(down, 0e0) AS down_volume,
        CASE WHEN up + down > 0 THEN up / (up + down) ELSE 0e0 END AS up_ratio, a.adv * 21600 / 23400 AS baseline,
        CASE WHEN a.adv > 0 THEN coalesce(up + down, 0e0) / (a.adv * 21600 / 23400) ELSE 0e0 END AS rvol,
        CASE WHEN passed THEN (epoch_us(p.ts) - epoch_us(t0)) / 1000000e0 ELSE 21600e0 END AS elapsed_sec,
        coalesce(ok, 0) AS polls_ok, coalesce(failed, 0) AS polls_failed,
        CASE WHEN coalesce(ok, 0) = 0 THEN 'NO_DATA' WHEN failed > 0 THEN 'PARTIAL' ELSE 'OK' END AS data_quality
        FROM sig s LEFT JOIN picked p USING (signal_id) LEFT JOIN adv a ON a.ticker = s.ticker""",
}


def _metrics(spark, sf):
    return P.scan_metrics(V.quotes(spark, sf), V.adv(spark, sf), V.SCAN)


@query("prj_gap_pct", with_views("quotes adv", "SELECT event_id, gap_pct, coalesce(gap_pct, 0) AS halt_gap_pct FROM metrics",
                                 metrics=METRICS), doubles="gap_pct halt_gap_pct")
def prj_gap_pct(spark, sf):
    gap = Q.gap_pct(F.col("last"), F.col("previous_close"))
    return V.quotes(spark, sf).select("event_id", gap.alias("gap_pct"), F.coalesce(gap, F.lit(0.0)).alias("halt_gap_pct"))


@query("prj_volume_baseline", with_views("adv", """SELECT ticker, adv * 60 / 23400 AS baseline FROM adv"""), doubles="baseline")
def prj_volume_baseline(spark, sf):
    return V.adv(spark, sf).select("ticker", Q.volume_baseline(F.col("adv"), 60.0).alias("baseline"))


@query("prj_rvol", with_views("quotes adv", "SELECT event_id, rvol, coalesce(rvol >= 0.5, false) AS passed FROM metrics", metrics=METRICS),
       doubles="rvol")
def prj_rvol(spark, sf):
    return _metrics(spark, sf).select("event_id", "rvol", Q.rvol_pass(
        F.col("total_volume"), F.col("baseline"), V.SCAN.rvol_min).alias("passed"))


@query("prj_session_elapsed", f"SELECT event_id, {ELAPSED} AS elapsed_sec FROM events", doubles="elapsed_sec")
def prj_session_elapsed(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select("event_id", clock.session_elapsed(F.col("ts").cast("timestamp")).alias("elapsed_sec"))


@query("flt_gap_rvol_tier", with_views("quotes adv", "SELECT event_id, ticker, ts, gap_pct, rvol, total_volume FROM tier",
                                       metrics=METRICS, tier=TIER), stamps="ts", doubles="gap_pct rvol total_volume")
def flt_gap_rvol_tier(spark, sf):
    return P.gap_rvol_tier(V.quotes(spark, sf), V.adv(spark, sf), V.SCAN).select(
        "event_id", "ticker", "ts", "gap_pct", "rvol", "total_volume")


@query("flt_liquidity", with_views("quotes", """SELECT event_id, bid, ask FROM quotes WHERE bid > 0 AND ask > 0
    AND (ask - bid) / ((bid + ask) / 2) <= 0.03"""), doubles="bid ask")
def flt_liquidity(spark, sf):
    q = V.quotes(spark, sf).filter(Q.is_liquid(F.col("bid"), F.col("ask")))
    return q.select("event_id", "bid", "ask")


@query("prj_is_halted", with_views("quotes", """SELECT event_id, coalesce(lower(trim(security_status)) = 'halted', false)
    AS is_halted FROM quotes"""))
def prj_is_halted(spark, sf):
    return V.quotes(spark, sf).select("event_id", Q.is_halted(F.col("security_status")).alias("is_halted"))


@query("prj_pre_session_flag", f"SELECT event_id, hour({NY}) < 7 AS pre_session FROM events")
def prj_pre_session_flag(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select("event_id", clock.is_pre_session(F.col("ts").cast("timestamp")).alias("pre_session"))


@query("win_halt_reopen", with_views("quotes", """SELECT event_id, ticker, ts, last FROM (SELECT *,
    lag(security_status) OVER (PARTITION BY ticker ORDER BY ts) AS was FROM quotes)
    WHERE was = 'Halted' AND security_status <> 'Halted'"""), stamps="ts", doubles="last")
def win_halt_reopen(spark, sf):
    return P.halt_reopen(V.quotes(spark, sf), S).select("event_id", "ticker", "ts", "last")


HIGHS = """SELECT event_id, ticker, ts, last, prior_high FROM (SELECT *, max(last) OVER (PARTITION BY ticker ORDER BY ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_high FROM quotes WHERE last <> 0) WHERE last > prior_high"""


@query("win_session_high_break", with_views("quotes", HIGHS), stamps="ts", doubles="last prior_high")
def win_session_high_break(spark, sf):
    return P.session_high_break(V.quotes(spark, sf), S).select("event_id", "ticker", "ts", "last", "prior_high")


@query("win_volume_delta", with_views("quotes", "SELECT event_id, total_volume, delta FROM deltas", deltas=DELTA),
       doubles="total_volume delta")
def win_volume_delta(spark, sf):
    return P.with_volume_delta(V.quotes(spark, sf), S).select("event_id", "total_volume", "delta")


@query("win_tick_classify", with_views("quotes", f"SELECT event_id, {split_sql()} FROM deltas", deltas=DELTA),
       doubles="up_volume down_volume")
def win_tick_classify(spark, sf):
    return P.classify_ticks(V.quotes(spark, sf), S).select("event_id", "up_volume", "down_volume")


def _confirmed(spark, sf):
    sig = V.quote_signals(spark, sf).select("signal_id", "ticker", "ts")
    quotes = V.stored(V.quotes(spark, sf), "quotes")
    return P.confirm_volume(sig, quotes, V.adv(spark, sf), signal_id="signal_id",
                            cfg=V.CONFIRM, tie=["event_id"])


@query("agg_tick_confirmation", with_views("quotes adv quote_signals", "SELECT * EXCLUDE (polls_ok, polls_failed, data_quality) FROM confirmed",
                                           **CONFIRM), stamps="ts",
       doubles="volume_since up_volume down_volume up_ratio baseline rvol elapsed_sec")
def agg_tick_confirmation(spark, sf):
    return _confirmed(spark, sf).drop("polls_ok", "polls_failed", "data_quality")


@query("agg_poll_quality", with_views("quotes adv quote_signals", "SELECT signal_id, polls_ok, polls_failed, data_quality FROM confirmed",
                                      **CONFIRM))
def agg_poll_quality(spark, sf):
    return _confirmed(spark, sf).select("signal_id", "polls_ok", "polls_failed", "data_quality")


def _scan(spark, sf):
    return P.market_scan(V.quotes(spark, sf), V.adv(spark, sf), V.SCAN, tie=["event_id"])


NEW = """SELECT ticker, scan_ts, gap_pct, rvol FROM scans s WHERE NOT EXISTS (SELECT 1 FROM scans p
    WHERE p.ticker = s.ticker AND p.scan_ts = s.scan_ts - INTERVAL 1 HOUR)"""


@query("win_newly_added", with_views("quotes adv", NEW, metrics_scan=METRICS_SCAN, scans=SCANS), stamps="scan_ts",
       doubles="gap_pct rvol")
def win_newly_added(spark, sf):
    from tapeloom.operators.ordered import Series
    return P.newly_added(_scan(spark, sf), V.SCAN, Series(order=("scan_ts",))).select("ticker", "scan_ts", "gap_pct", "rvol")


@query("set_scan_diff", with_views("quotes adv", NEW, metrics_scan=METRICS_SCAN, scans=SCANS), stamps="scan_ts",
       doubles="gap_pct rvol")
def set_scan_diff(spark, sf):
    return P.scan_difference(_scan(spark, sf), V.SCAN).select("ticker", "scan_ts", "gap_pct", "rvol")


# ---------------------------------------------------------------- joins

@query("join_quote_adv", with_views("quotes adv", "SELECT event_id, q.ticker, adv FROM quotes q LEFT JOIN adv USING (ticker)"),
       doubles="adv")
def join_quote_adv(spark, sf):
    return V.quotes(spark, sf).join(V.adv(spark, sf), "ticker", "left").select("event_id", "ticker", "adv")


def _tagged(spark, sf):
    n = V.news_once(spark, sf)
    return n.select("id", F.explode("symbols").alias("ticker"), "created_at")


@query("join_asof_quote", with_views("quotes news_tickers", """SELECT n.id, n.ticker, CAST(q.event_id AS DOUBLE) AS event_id, q.last FROM news_tickers n
    ASOF LEFT JOIN quotes q ON n.ticker = q.ticker AND n.created_at >= q.ts"""), doubles="last")
def join_asof_quote(spark, sf):
    hit = T.asof_quote(_tagged(spark, sf), V.quotes(spark, sf), ["event_id", "last"], ts="created_at", tie=["event_id"])
    return hit.select("id", "ticker", F.col("event_id").cast("double").alias("event_id"), "last")


@query("join_prenews_bars", with_views("quote_bars news_tickers", """SELECT id, ticker, bar_ts, bar_close, bar_volume FROM (
    SELECT n.id, n.ticker, b.ts AS bar_ts, b.close AS bar_close, b.volume AS bar_volume,
    row_number() OVER (PARTITION BY n.id, n.ticker ORDER BY b.ts DESC) AS rn
    FROM news_tickers n JOIN quote_bars b ON b.ticker = n.ticker AND b.ts < n.created_at) WHERE rn <= 20"""),
       stamps="bar_ts", doubles="bar_close bar_volume")
def join_prenews_bars(spark, sf):
    return T.prenews_bars(_tagged(spark, sf), V.quote_bars(spark, sf)).select(
        "id", "ticker", "bar_ts", "bar_close", "bar_volume")


@query("join_fundamentals_ttl", with_views("quotes fundamentals_snapshots", """SELECT q.event_id, CASE WHEN epoch_us(q.ts) - epoch_us(f.fetched_at) < 3600000000
    THEN f.float_shares END AS float_shares FROM quotes q ASOF LEFT JOIN fundamentals_snapshots f
    ON q.ticker = f.ticker AND q.ts >= f.fetched_at"""), doubles="float_shares")
def join_fundamentals_ttl(spark, sf):
    snap = V.fundamentals_snapshots(spark, sf).withColumnRenamed("event_id", "snap_id")
    return T.fresh_fundamentals(V.quotes(spark, sf), snap, ["float_shares"], tie=["snap_id"]).select("event_id", "float_shares")


@query("join_bars_since_entry", with_views("positions bars_calm", """SELECT ticker, entry_time, ts, close FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker, entry_time ORDER BY ts DESC) AS rn,
    count(*) OVER (PARTITION BY ticker, entry_time) AS n FROM (SELECT p.ticker, p.entry_time, b.ts, b.close
    FROM positions p JOIN bars_calm b ON b.ticker = p.ticker AND b.ts >= p.entry_time)) WHERE rn <= 30 AND n >= 2"""),
       stamps="entry_time ts", doubles="close")
def join_bars_since_entry(spark, sf):
    return T.bars_since_entry(V.bars_calm(spark, sf), V.positions(spark, sf).select("ticker", "entry_time"), V.BAR_SERIES) \
        .select("ticker", "entry_time", "ts", "close")


@query("anti_open_positions", with_views("quote_signals holdings", """SELECT signal_id, ticker, ts FROM quote_signals s
    WHERE NOT EXISTS (SELECT 1 FROM holdings h WHERE h.ticker = s.ticker AND h.entry_time <= s.ts AND s.ts < h.exit_time)"""),
       stamps="ts")
def anti_open_positions(spark, sf):
    return T.without_open_position(V.quote_signals(spark, sf), V.holdings(spark, sf)).select("signal_id", "ticker", "ts")


@query("join_round_trips", with_views("trade_events", """SELECT e.event_id, e.ticker, e.ts AS entry_time, e.price AS entry_price,
    CAST(epoch_us(x.ts) AS DOUBLE) AS exit_time, x.price AS exit_price FROM (SELECT * FROM trade_events WHERE event = 'ENTRY') e
    ASOF LEFT JOIN (SELECT * FROM trade_events WHERE event = 'EXIT') x ON e.ticker = x.ticker AND e.ts < x.ts"""),
       stamps="entry_time", doubles="entry_price exit_price")
def join_round_trips(spark, sf):
    trips = T.round_trips(V.trade_events(spark, sf).withColumnRenamed("event_id", "log_id"), tie=["log_id"])
    return trips.select(F.col("log_id").alias("event_id"), "ticker", "entry_time", "entry_price", micros("exit_time"), "exit_price")


