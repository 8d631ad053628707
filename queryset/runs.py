"""Queries over whole runs: signals, pool, one position at a time, fills, exits, report and log as one job."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tapeloom.config import Entry
from tapeloom.plans import portfolio as B, trading_run as R
from tapeloom.session import fresh_folder, materialise
from tapeloom.sources import orders as O
from tapeloom.streaming.run import file_stream

from . import plans as QP, views as V
from .core import micros, query
from .views import with_views

PER_SLOT = 500.0
ENTRY = replace(Entry(), price_ceiling=1700.0, vwap_window_sec=200 * V.DAY)

_STEP = QP.USED.format(left="{left}", fails="{paused} OR n.gate IS NOT NULL OR NOT n.filled").replace("need", "n.need").replace(
    "request", "n.request").replace("is_fda", "n.is_fda")
_FREE = "CASE WHEN {used} > 0 THEN coalesce(n.exit_time, TIMESTAMP '9999-12-31') ELSE {free} END"


def _walk() -> str:
    """One signal after the other: slots left, until when the run is busy, slots the signal uses."""
    first, next_left = _STEP.format(left="10", paused="false"), "(w.slots_left - w.slots_used)"
    paused = "(n.ts < w.free)"
    used = _STEP.format(left=next_left, paused=paused)
    return f"""WITH RECURSIVE w AS (SELECT n.*, 10 AS slots_left, false AS paused, {first} AS slots_used,
        {_FREE.format(used=f"({first})", free="TIMESTAMP '1900-01-01'")} AS free FROM signals_in_order n WHERE rn = 1
        UNION ALL SELECT n.*, {next_left}, {paused}, {used}, {_FREE.format(used=f"({used})", free="w.free")}
        FROM w JOIN signals_in_order n ON n.run = w.run AND n.rn = w.rn + 1) SELECT * FROM w"""


RUN = {
    "run_vwaps": """SELECT s.ticker, s.ts, sum(close * volume) / sum(volume) AS vwap FROM new_highs s JOIN bars_calm b ON b.ticker = s.ticker
        AND b.ts BETWEEN s.ts - INTERVAL 200 DAY AND s.ts GROUP BY s.ticker, s.ts""",
    "fills": """SELECT ticker, ts, CASE WHEN has_legs THEN (q1 * px + q2 * (px * 1.01e0)) / (q1 + q2) WHEN has_price THEN px END AS fill
        FROM (SELECT *, row_number() OVER (PARTITION BY ticker, ts ORDER BY attempt) AS k FROM trade_orders WHERE is_filled AND attempt <= 5) WHERE k = 1""",
    "wanted": """SELECT s.*, f.fill AS entry_fill, f.ticker IS NOT NULL AS filled, coalesce(f.fill, price) AS entry_price,
        list_min(list_filter(range(1, 11), lambda k: k * 500e0 >= price)) AS need,
        CASE WHEN NOT is_fda AND price > 1700 THEN 'ABORT_PRICE_CEILING' WHEN NOT is_fda AND NOT coalesce(price > vwap, true) THEN 'ABORT_VWAP' END AS gate
        FROM new_highs s LEFT JOIN run_vwaps v USING (ticker, ts) LEFT JOIN fills f USING (ticker, ts)""",
    "stopped": """SELECT *, entry_price * (1 - greatest(0.02e0, least(CASE WHEN atr IS NOT NULL AND entry_price > 0 THEN 2.5e0 * atr / entry_price ELSE 0.1e0 END, 0.1e0)))
        AS stop_price FROM wanted""",
    "positions": "SELECT ticker, ts AS entry_time, entry_price, 1e0 AS quantity, stop_price FROM stopped WHERE gate IS NULL AND filled AND need IS NOT NULL",
    **{k: v for k, v in QP.EXIT.items() if k != "exits"},
    "tried": """SELECT f.*, x.ticker IS NOT NULL AS sold, x.fill AS exit_fill FROM fired f LEFT JOIN fills x USING (ticker, ts) WHERE exit_reason IS NOT NULL""",
    "ends": """SELECT ticker, entry_time, ts AS exit_time, close AS exit_price, exit_reason, exit_fill FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker, entry_time ORDER BY ts) AS k FROM tried WHERE sold) WHERE k = 1""",
    "signals_in_order": """SELECT s.*, e.exit_time, e.exit_price, e.exit_reason, e.exit_fill, row_number() OVER (PARTITION BY run ORDER BY ts, s.ticker) AS rn
        FROM stopped s LEFT JOIN ends e ON e.ticker = s.ticker AND e.entry_time = s.ts""",
    "walk": _walk(),
    "trades": """SELECT * REPLACE (CASE WHEN slots_used > 0 THEN exit_time END AS exit_time), coalesce(exit_fill, exit_price) AS sold_at, CASE WHEN slots_used > 0 THEN 'ENTER' WHEN paused THEN 'SKIP_PAUSED'
        WHEN slots_left <= 0 THEN 'SKIP_NO_SLOTS' WHEN gate IS NOT NULL THEN gate WHEN need IS NULL OR need > slots_left THEN 'ABORT_NO_SHARE' ELSE 'ENTRY_ATTEMPT_UNFILLED' END AS outcome,
        CASE WHEN slots_used > 0 THEN round((slots_used * 500e0 - (slots_used * 500e0) % price) / price) END AS quantity FROM walk""",
}
VIEWS = "bars_calm new_highs trade_orders"


def _inputs(spark, sf):
    bars = V.stored(V.bars_calm(spark, sf), "bars")
    rows = B.trailing_vwap(V.stored(V.new_highs(spark, sf, bars), "new-highs"), bars, window_sec=ENTRY.vwap_window_sec, stored=True)
    gate = (F.when(~B.under_ceiling(F.col("price"), F.col("is_fda"), ENTRY), "ABORT_PRICE_CEILING")
            .when(~B.over_vwap(F.col("price"), F.col("vwap"), F.col("is_fda")), "ABORT_VWAP"))
    return rows.withColumn("gate", gate), bars, V.stored(V.trade_orders(spark, sf), "orders")


def _trades(spark, sf):
    signals, bars, orders = _inputs(spark, sf)
    return R.trade(signals, bars, orders, PER_SLOT, V.BAR_SERIES, ENTRY), bars, orders


@query("pipe_trading_run", with_views(VIEWS, """SELECT run, ticker, ts, outcome, CAST(slots_left AS INTEGER) AS slots_left, CAST(slots_used AS INTEGER) AS slots_used, quantity,
    CASE WHEN outcome = 'ENTER' THEN entry_price END AS entry_price, CAST(epoch_us(exit_time) AS DOUBLE) AS exit_time FROM trades""", **RUN),
       dates="run", stamps="ts", doubles="entry_price quantity")
def pipe_trading_run(spark, sf):
    """Every signal of every run: what became of it, and why."""
    rows = _trades(spark, sf)[0]
    return rows.select("run", "ticker", "ts", "outcome", F.col("left").alias("slots_left"), "slots_used", "quantity",
                       F.when(F.col("outcome") == "ENTER", F.col("entry_price")).alias("entry_price"), micros("exit_time"))


@query("pipe_round_trips", with_views(VIEWS, """SELECT ticker, ts AS entry_time, exit_reason, CASE WHEN entry_price <> 0 THEN (sold_at - entry_price) / entry_price * 100 ELSE 0e0 END AS pnl_pct,
    (sold_at - entry_price) * quantity AS pnl_usd, (epoch_us(exit_time) - epoch_us(ts)) / 1000000e0 AS holding_sec FROM trades WHERE slots_used > 0""", **RUN),
       stamps="entry_time", doubles="pnl_pct pnl_usd holding_sec")
def pipe_round_trips(spark, sf):
    """The trades that the runs took, from entry fill to exit fill."""
    trips = B.report(_trades(spark, sf)[0].filter("slots_used > 0").withColumnRenamed("ts", "entry_time"))
    return trips.select("ticker", "entry_time", "exit_reason", F.when(F.col("sold_at").isNotNull(), F.col("pnl_pct")).alias("pnl_pct"), "pnl_usd", "holding_sec")


@query("agg_run_complete", with_views(VIEWS, """SELECT run, CAST(sum(slots_used) AS BIGINT) AS slots_spent, count(*) FILTER (slots_used > 0 AND exit_time IS NULL) AS still_open,
    sum(slots_used) >= 10 AND count(*) FILTER (slots_used > 0 AND exit_time IS NULL) = 0 AS is_complete FROM trades GROUP BY run""", **RUN), dates="run")
def agg_run_complete(spark, sf):
    return R.run_state(_trades(spark, sf)[0], ENTRY)


LOG = """SELECT 'ENTRY' AS event, ticker, ts AS time, entry_price AS price, 'qty=' || CAST(CAST(quantity AS BIGINT) AS VARCHAR) AS value, 'SIGNAL' AS reason FROM trades WHERE slots_used > 0
    UNION ALL SELECT 'ENTRY_ATTEMPT_UNFILLED', ticker, ts, price, 'unfilled', 'SIGNAL' FROM trades WHERE outcome = 'ENTRY_ATTEMPT_UNFILLED'
    UNION ALL SELECT 'EXIT', ticker, exit_time, sold_at, format('{:+.2f}', (sold_at - entry_price) / entry_price * 100), exit_reason FROM trades WHERE slots_used > 0 AND exit_time IS NOT NULL
    UNION ALL SELECT 'EXIT_ATTEMPT_UNFILLED', t.ticker, f.ts, f.close, 'unfilled', f.exit_reason FROM trades t JOIN tried f ON f.ticker = t.ticker AND f.entry_time = t.ts
    WHERE t.slots_used > 0 AND NOT f.sold AND (t.exit_time IS NULL OR f.ts < t.exit_time)"""


@query("sink_trades_log", with_views(VIEWS, """SELECT event, CAST(ticker AS VARCHAR) AS ticker, strftime(time, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS time,
    format('{:.4f}', price) AS price, value, reason, '' AS headline FROM log""", **RUN, log=LOG))
def sink_trades_log(spark, sf):
    """The events of the runs, appended to the log by a stream in several batches, one of them delivered twice; read back."""
    trades, bars, orders = _trades(spark, sf)
    trades = materialise(trades, "trades")
    events = materialise(R.log_events(trades, bars, orders, V.BAR_SERIES, ENTRY).repartition(4, "ticker"), "events")
    path = fresh_folder(spark, "trade-log")

    def write(batch, number):
        for _ in range(2 if number == 1 else 1):
            O.append_trade_log(batch, path, number)

    stream = file_stream(spark, events.inputFiles()[0].rsplit("/", 1)[0], events.schema, files_per_trigger=1)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return O.read_trade_log(spark, path)
