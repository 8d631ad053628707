"""Queries over the composed plans: scores, signals, entries, portfolio, exits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tapeloom.config import Entry
from tapeloom.functions import scores as C
from tapeloom.operators import news as N, quotes as P, trades as T
from tapeloom.plans import exits as X, portfolio as B, signals as G, sizing
from tapeloom.sources import orders as O

from . import news as QN, quotes as QQ, views as V
from .core import micros, query
from .views import with_views

# ---------------------------------------------------------------- scores

MOVES = """SELECT n.id, n.ticker, first(b.close ORDER BY b.ts) AS start_close, last(b.close ORDER BY b.ts) AS end_close, count(b.ts) AS bar_rows
    FROM news_tickers n LEFT JOIN (SELECT n.id, n.ticker, b.ts, b.close, row_number() OVER (PARTITION BY n.id, n.ticker ORDER BY b.ts DESC) AS rn
    FROM news_tickers n JOIN quote_bars b ON b.ticker = n.ticker AND b.ts < n.created_at) b ON n.id = b.id AND n.ticker = b.ticker AND b.rn <= 20
    GROUP BY n.id, n.ticker"""
PRICE = """SELECT *, CASE WHEN pct IS NULL THEN 0.5e0 ELSE (greatest(-10e0, least(10e0, pct)) + 10) / 20 END AS price_action_score
    FROM (SELECT *, CASE WHEN bar_rows >= 2 AND start_close > 0 THEN (end_close - start_close) / start_close * 100 END AS pct FROM moves)"""
SHARES = """SELECT id, n.ticker, CASE WHEN epoch_us(n.created_at) - epoch_us(f.fetched_at) < 3600000000 THEN f.float_shares END AS float_shares
    FROM news_tickers n ASOF LEFT JOIN fundamentals_snapshots f ON n.ticker = f.ticker AND n.created_at >= f.fetched_at"""
FLOAT = "CASE WHEN float_shares > 0 THEN greatest(0e0, least(1e0, 1 - float_shares / 1e7)) ELSE 0.5e0 END"
# the reasoning of every usable verdict is "one short sentence": three words
VSCORE = """(0.7e0 * CASE confidence WHEN 'high' THEN 1e0 WHEN 'medium' THEN 0.6e0 ELSE 0.3e0 END + 0.3e0 *
    least(CASE WHEN reasoning IS NULL THEN 0 ELSE 3 END / 40e0, 1e0))"""
MAGNITUDE = f"""SELECT *, round_even(greatest(1e0, least(10e0, 1 + composite * 9)), 0) AS slots FROM (SELECT *,
    greatest(0e0, least(1e0, 0.25e0 * {FLOAT} + 0.25e0 * price_action_score + 0.3e0 * {VSCORE} + 0.2e0 * {QN.CATEGORY_SCORE})) AS composite
    FROM (SELECT n.id, n.ticker, {QN.CATEGORY} AS category, v.confidence, v.reasoning, s.float_shares, p.price_action_score
    FROM (SELECT *, lower(headline || ' ' || summary) AS body FROM news_tickers) n LEFT JOIN verdicts v USING (id)
    LEFT JOIN shares s ON s.id = n.id AND s.ticker = n.ticker LEFT JOIN price p ON p.id = n.id AND p.ticker = n.ticker))"""
MAG = {"moves": MOVES, "price": PRICE, "shares": SHARES, "verdicts": QN.VERDICTS, "magnitude": MAGNITUDE}


def _sized(spark, sf):
    rows = QN.tagged(spark, sf).withColumn("ts", F.col("created_at")).drop("symbols")
    snaps = V.fundamentals_snapshots(spark, sf).drop("event_id")
    rows = T.fresh_fundamentals(rows, snaps, ["float_shares"])
    rows = T.prenews_move(rows, V.quote_bars(spark, sf))
    verdicts = N.parse_verdicts(V.verdicts_raw(spark, sf)).select("id", "verdict.confidence", "verdict.reasoning")
    return sizing.magnitude(rows.join(verdicts, "id", "left"))


@query("score_price_action", with_views("quote_bars news_tickers", "SELECT id, ticker, pct AS price_action_pct, price_action_score FROM price",
                                        moves=MOVES, price=PRICE), doubles="price_action_pct price_action_score")
def score_price_action(spark, sf):
    rows = T.prenews_move(QN.tagged(spark, sf).select("id", "ticker", "created_at"), V.quote_bars(spark, sf))
    pct = C.move_pct(F.col("start_close"), F.col("end_close"), F.coalesce("bar_rows", F.lit(0)))
    rows = rows.withColumn("price_action_pct", pct)
    return rows.select("id", "ticker", "price_action_pct", C.price_action_score(F.col("price_action_pct")).alias("price_action_score"))


@query("score_magnitude", with_views("quote_bars news_tickers fundamentals_snapshots verdicts_raw",
                                     "SELECT id, ticker, category, composite FROM magnitude", **MAG), doubles="composite")
def score_magnitude(spark, sf):
    return _sized(spark, sf).select("id", "ticker", "category", "composite")


@query("score_slots", with_views("quote_bars news_tickers fundamentals_snapshots verdicts_raw",
                                 "SELECT id, ticker, CAST(slots AS INTEGER) AS slots FROM magnitude", **MAG))
def score_slots(spark, sf):
    return _sized(spark, sf).select("id", "ticker", "slots")


CONF = "greatest(0e0, least(1e0, 0.5e0 * CASE WHEN baseline > 0 THEN greatest(0e0, least(volume_since / baseline, 0.2e0 * 3)) / (0.2e0 * 3) ELSE 0.5e0 END" \
       " + 0.5e0 * CASE WHEN up_ratio >= 0.6 THEN (up_ratio - 0.6e0) / (1 - 0.6e0) ELSE 0 END))"
GAP = "greatest(0e0, least(1e0, 0.5e0 * greatest(0e0, least(gap_pct, 50e0)) / 50 + 0.5e0 * greatest(0e0, least({rvol}, 10e0)) / 10))"


@query("score_confirmation", with_views("quotes adv quote_signals", f"SELECT signal_id, {CONF} AS confirmation_score FROM confirmed", **QQ.CONFIRM),
       doubles="confirmation_score")
def score_confirmation(spark, sf):
    rows = QQ._confirmed(spark, sf)
    score = C.confirmation_score(F.col("volume_since"), F.col("baseline"), F.col("up_ratio"), V.CONFIRM)
    return rows.select("signal_id", score.alias("confirmation_score"))


@query("score_gap_scanner", with_views("quotes adv", f"SELECT event_id, {GAP.format(rvol='rvol')} AS gap_scanner_score FROM tier",
                                       metrics=QQ.METRICS, tier=QQ.TIER), doubles="gap_scanner_score")
def score_gap_scanner(spark, sf):
    tier = P.gap_rvol_tier(V.quotes(spark, sf), V.adv(spark, sf), V.SCAN)
    return tier.select("event_id", C.gap_scanner_score(F.col("gap_pct"), F.col("rvol")).alias("gap_scanner_score"))


def confirm_from(source: str) -> dict[str, str]:
    return {**QQ.CONFIRM, "sig": source}


def breakout_sql(events: str, rvol: str) -> str:
    return f"""SELECT *, round_even(greatest(1e0, least(10e0, 1 + composite * 9)), 0) AS slots FROM (
        SELECT e.*, greatest(0e0, least(1e0, 0.5e0 * {CONF} + 0.5e0 * {GAP.format(rvol=rvol)})) AS composite
        FROM {events} e JOIN (SELECT signal_id, volume_since, baseline AS baseline, up_ratio FROM confirmed WHERE passed) c ON c.signal_id = e.event_id)"""


@query("score_breakout", with_views("quotes adv", "SELECT event_id, composite, CAST(slots AS INTEGER) AS slots FROM scored",
                                    metrics=QQ.METRICS.replace(" AS baseline", " AS session_base"), tier=QQ.TIER,
                                    **confirm_from("SELECT event_id AS signal_id, ticker, ts FROM tier"), scored=breakout_sql("tier", "rvol")),
       doubles="composite")
def score_breakout(spark, sf):
    quotes, adv = _feeds(spark, sf)
    tier = P.gap_rvol_tier(quotes, adv, V.SCAN).withColumnRenamed("rvol", "scan_rvol").drop("adv", "baseline")
    won = G._confirmed(tier, quotes, adv, "event_id", V.ENGINE, ["event_id"])
    return sizing.breakout(won, V.ENGINE.sizing, V.CONFIRM).select("event_id", "composite", "slots")


# ---------------------------------------------------------------- signals

BULLISH = f"""SELECT id, ticker, created_at AS ts FROM (SELECT n.*, lower(headline) AS low FROM news_tickers n
    WHERE created_at BETWEEN TIMESTAMP '2024-01-31' - INTERVAL 18 DAY AND TIMESTAMP '2024-01-31'
    AND ticker IN (SELECT ticker FROM tier) AND id NOT IN (SELECT doc_id FROM labels)) n JOIN verdicts v USING (id)
    WHERE v.ok AND v.catalyst = 'positive' AND NOT v.is_secondhand AND NOT {QN.any_of('low', QN.K.STALE_RECAP_PHRASES)}"""
TIERS = {"metrics": QQ.METRICS.replace(" AS baseline", " AS session_base"), "tier": QQ.TIER, "verdicts": QN.VERDICTS, "bullish": BULLISH}


def _feeds(spark, sf):
    return V.stored(V.quotes(spark, sf), "quotes"), V.stored(V.adv(spark, sf), "adv")


def _bullish(spark, sf, quotes=None, adv=None):
    if quotes is None:
        quotes, adv = V.quotes(spark, sf), V.adv(spark, sf)
    tier = P.gap_rvol_tier(quotes, adv, V.SCAN)
    scored = V.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return G.bullish_tier(tier.select("ticker"), V.news_once(spark, sf), N.parse_verdicts(V.verdicts_raw(spark, sf)), scored,
                          "2024-01-31", V.ENGINE)


@query("pipe_bullish_tier", with_views("quotes adv news_tickers verdicts_raw", "SELECT id, ticker, ts FROM bullish", **TIERS), stamps="ts")
def pipe_bullish_tier(spark, sf):
    return _bullish(spark, sf).select("id", "ticker", "ts")


@query("join_recent_bullish", with_views("quotes adv news_tickers verdicts_raw quote_signals", """SELECT signal_id, ticker, CASE WHEN bullish_ts >= ts - INTERVAL 18 DAY
    THEN CAST(epoch_us(bullish_ts) AS DOUBLE) END AS bullish_ts FROM (SELECT s.signal_id, s.ticker, s.ts, n.ts AS bullish_ts FROM quote_signals s
    ASOF LEFT JOIN bullish n ON s.ticker = n.ticker AND s.ts >= n.ts)""", **TIERS))
def join_recent_bullish(spark, sf):
    tier = _bullish(spark, sf, *_feeds(spark, sf)).select("ticker", "ts")
    return T.recent_bullish(V.quote_signals(spark, sf), tier).select("signal_id", "ticker", micros("bullish_ts"))


BREAKS = """SELECT * FROM (SELECT b.*, n.ts AS bullish_ts FROM (SELECT * FROM (SELECT *, max(last) OVER (PARTITION BY ticker ORDER BY ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_high FROM tier WHERE last <> 0) WHERE last > prior_high) b
    ASOF LEFT JOIN bullish n ON b.ticker = n.ticker AND b.ts >= n.ts) WHERE bullish_ts >= ts - INTERVAL 18 DAY"""


@query("pipe_rolling_high", with_views("quotes adv news_tickers verdicts_raw", """SELECT event_id, ticker, ts, bullish_ts, composite,
    CAST(slots AS INTEGER) AS slots, 'ROLLING_HIGH_BREAKOUT' AS reason FROM won""", **TIERS, breaks=BREAKS,
                                       **confirm_from("SELECT event_id AS signal_id, ticker, ts FROM breaks"), won=breakout_sql("breaks", "rvol")),
       stamps="ts bullish_ts", doubles="composite")
def pipe_rolling_high(spark, sf):
    quotes, adv = _feeds(spark, sf)
    out = G.rolling_high(quotes, adv, V.stored(_bullish(spark, sf, quotes, adv), "bullish"), V.QUOTE_SERIES, V.ENGINE)
    return out.select("event_id", "ticker", "ts", "bullish_ts", "composite", "slots", "reason")


OPENED = """SELECT *, coalesce(gap0, 0) AS gap_pct, CASE WHEN session_base > 0 THEN coalesce(total_volume, 0) / session_base ELSE 0 END AS open_rvol
    FROM (SELECT * RENAME (gap_pct AS gap0) FROM (SELECT *, lag(security_status) OVER (PARTITION BY ticker ORDER BY ts) AS was FROM metrics)
    WHERE was = 'Halted' AND security_status <> 'Halted' AND last <> 0)"""


@query("pipe_halt_reopen", with_views("quotes adv", """SELECT event_id, ticker, ts, gap_pct, composite, CAST(slots AS INTEGER) AS slots,
    'HALT_REOPEN_CONFIRMED' AS reason FROM won""", metrics=TIERS["metrics"], opened=OPENED,
                                      **confirm_from("SELECT event_id AS signal_id, ticker, ts FROM opened"), won=breakout_sql("opened", "open_rvol")),
       stamps="ts", doubles="gap_pct composite")
def pipe_halt_reopen(spark, sf):
    quotes, adv = _feeds(spark, sf)
    out = G.halt_reopen(quotes, adv, V.QUOTE_SERIES, V.ENGINE)
    return out.select("event_id", "ticker", "ts", "gap_pct", "composite", "slots", "reason")


NEWS_SQL = {
    **QN.TONE, "verdicts": QN.VERDICTS, "w": QN.WATCH,
    "watched": "SELECT * FROM news_tickers WHERE ticker IN (SELECT ticker FROM w)",
    "anchored": QN.ANCHORED.replace("news_tickers", "watched"), "relevant": QN.RELEVANT,
    "decided": QN.DECIDED.format(source="relevant"),
    **confirm_from("SELECT id || '|' || ticker AS signal_id, ticker, created_at AS ts FROM decided WHERE decision LIKE 'PASS%'"),
    **{k: v for k, v in MAG.items() if k != "verdicts"},
}


def _news_signals(spark, sf, check_recycled):
    quotes, adv = _feeds(spark, sf)
    return G.news_signals(V.news(spark, sf), QN.watchlist(spark, sf), N.parse_verdicts(V.verdicts_raw(spark, sf)), V.lexicon(spark),
                          quotes, adv, V.stored(V.quote_bars(spark, sf), "bars"),
                          V.fundamentals_snapshots(spark, sf).drop("event_id"), V.ENGINE, tie=["event_id"],
                          check_recycled=check_recycled).select("id", "ticker", "ts", "reason", "composite", "slots")


@query("pipe_news_signals", with_views("quotes adv quote_bars news_tickers lexicon verdicts_raw fundamentals_snapshots", """
    SELECT d.id, d.ticker, d.created_at AS ts, 'FDA_APPROVAL_FASTPATH' AS reason, CAST(NULL AS DOUBLE) AS composite, 10 AS slots FROM decided d
    WHERE decision = 'FDA_APPROVAL_FASTPATH' UNION ALL
    SELECT d.id, d.ticker, d.created_at, 'SENTIMENT_AND_TICK_VOLUME_CONFIRMED', m.composite, CAST(m.slots AS INTEGER) FROM decided d
    JOIN confirmed c ON c.signal_id = d.id || '|' || d.ticker AND c.passed JOIN magnitude m ON m.id = d.id AND m.ticker = d.ticker
    WHERE decision LIKE 'PASS%'""", **NEWS_SQL), stamps="ts", doubles="composite")
def pipe_news_signals(spark, sf):
    return _news_signals(spark, sf, check_recycled=False)


@query("pipe_news_signals_recycled")
def pipe_news_signals_recycled(spark, sf):
    """With the headline history switched on (the similarity ratio has no SQL form)."""
    return _news_signals(spark, sf, check_recycled=True)


# ---------------------------------------------------------------- entries and capital

#: Slots a signal keeps of those left, in the order of a recursive walk over its run.
USED = "CASE WHEN {fails} OR need IS NULL OR need > {left} THEN 0 WHEN is_fda THEN {left} ELSE greatest(least(request, {left}), need) END"
ENTRY = {
    "opened": """SELECT s.*, EXISTS (SELECT 1 FROM holdings h WHERE h.ticker = s.ticker AND h.entry_time <= s.ts AND s.ts < h.exit_time) AS is_open FROM quote_signals s""",
    "quoted": """SELECT s.*, q.last, q.bid, q.ask FROM opened s ASOF LEFT JOIN quotes q ON s.ticker = q.ticker AND s.ts >= q.ts""",
    "priced": """SELECT s.*, coalesce(nullif(s.last, 0), nullif(b.close, 0)) AS price FROM quoted s ASOF LEFT JOIN quote_bars b ON s.ticker = b.ticker AND s.ts >= b.ts""",
    "vwaps": """SELECT s.signal_id, CASE WHEN sum(volume) > 0 THEN sum(close * volume) / sum(volume) END AS vwap FROM quote_signals s
        LEFT JOIN quote_bars b ON b.ticker = s.ticker AND b.ts BETWEEN s.ts - INTERVAL 1 DAY AND s.ts GROUP BY s.signal_id""",
    "sized": """SELECT p.*, v.vwap, list_min(list_filter(range(1, 11), lambda k: k * 100e0 >= price)) AS need FROM priced p JOIN vwaps v USING (signal_id)""",
    "gated": f"""SELECT *, {QQ.NY} AS ny, row_number() OVER (PARTITION BY run ORDER BY ts, signal_id) AS rn,
        CASE WHEN NOT is_fda AND NOT coalesce(bid > 0 AND ask > 0 AND (ask - bid) / ((bid + ask) / 2) <= 0.03, false) THEN 'GATE_LIQUIDITY'
        WHEN price IS NULL THEN 'ABORT_NO_PRICE' WHEN NOT is_fda AND price > 1000000 THEN 'ABORT_PRICE_CEILING'
        WHEN NOT is_fda AND NOT coalesce(price > vwap, true) THEN 'ABORT_VWAP' END AS gate FROM sized""",
    "walk": f"""WITH RECURSIVE w AS (SELECT g.*, 10 AS slots_left, {USED.format(left='10', fails='gate IS NOT NULL OR is_open')} AS slots_used FROM gated g WHERE rn = 1
        UNION ALL SELECT n.*, w.slots_left - w.slots_used, {USED.format(left='(w.slots_left - w.slots_used)', fails='n.gate IS NOT NULL OR n.is_open')
        .replace('is_fda', 'n.is_fda').replace('need', 'n.need').replace('request', 'n.request')} FROM w JOIN gated n ON n.run = w.run AND n.rn = w.rn + 1) SELECT * FROM w""",
    "labelled": """SELECT *, CASE WHEN is_open THEN 'SKIP_OPEN_POSITION' WHEN slots_left <= 0 THEN 'SKIP_NO_SLOTS' WHEN gate IS NOT NULL THEN gate
        WHEN slots_used < 1 THEN 'ABORT_NO_SHARE' ELSE 'ENTER' END AS outcome, CASE WHEN is_fda THEN slots_left ELSE least(request, slots_left) END AS slots,
        CASE WHEN slots_used > 0 THEN CAST(round(((slots_used * 100e0) - (slots_used * 100e0) % price) / price) AS BIGINT) ELSE 0 END AS quantity FROM walk""",
}
ENTRY_VIEWS = "quotes quote_bars holdings quote_signals"


def _entries(spark, sf):
    return B.entry_gates(V.quote_signals(spark, sf), V.stored(V.quotes(spark, sf), "quotes"), V.stored(V.quote_bars(spark, sf), "bars"), V.holdings(spark, sf), 100.0, tie=("event_id",))


@query("pipe_entry_gates", with_views(ENTRY_VIEWS, """SELECT signal_id, outcome, CAST(slots_left AS INTEGER) AS slots_left, CAST(slots AS INTEGER) AS slots,
    CAST(slots_used AS INTEGER) AS slots_used, quantity, hour(ny) < 7 AS pre_session FROM labelled""", **ENTRY))
def pipe_entry_gates(spark, sf):
    """Signals of a day share a pool: partial claims, slots given back, and none left, as the day goes."""
    return _entries(spark, sf).select("signal_id", "outcome", F.col("left").alias("slots_left"), "slots", "slots_used", "quantity", "pre_session")


@query("prj_entry_price", with_views(ENTRY_VIEWS, "SELECT signal_id, price FROM priced", **ENTRY), doubles="price")
def prj_entry_price(spark, sf):
    return B.entry_price(V.quote_signals(spark, sf), V.quotes(spark, sf), V.quote_bars(spark, sf), tie=("event_id",)).select("signal_id", "price")


@query("flt_price_ceiling", with_views("quote_signals quotes", """SELECT signal_id, last AS price FROM quote_signals s
    ASOF JOIN quotes q ON s.ticker = q.ticker AND s.ts >= q.ts WHERE is_fda OR last <= 60""", ), doubles="price")
def flt_price_ceiling(spark, sf):
    rows = T.asof_quote(V.quote_signals(spark, sf), V.quotes(spark, sf), ["last"], tie=["event_id"])
    kept = B.under_ceiling(F.col("last"), F.col("is_fda"), replace(Entry(), price_ceiling=60.0))
    return rows.filter(kept).select("signal_id", F.col("last").alias("price"))


@query("flt_vwap_gate", with_views(ENTRY_VIEWS, "SELECT signal_id, price, vwap FROM sized WHERE is_fda OR coalesce(price > vwap, true)", **ENTRY), doubles="price vwap")
def flt_vwap_gate(spark, sf):
    rows = B.entry_price(V.quote_signals(spark, sf), V.quotes(spark, sf), V.quote_bars(spark, sf), tie=("event_id",))
    rows = B.trailing_vwap(rows, V.quote_bars(spark, sf))
    return rows.filter(B.over_vwap(F.col("price"), F.col("vwap"), F.col("is_fda"))).select("signal_id", "price", "vwap")


@query("prj_slot_request", "SELECT o_orderkey AS seq, CAST(greatest(1, least(10, coalesce(nullif(o_orderkey % 15, 0), 1))) AS INTEGER) AS slots FROM orders")
def prj_slot_request(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), B.slot_request(F.col("o_orderkey") % 15).alias("slots"))


@query("prj_limit_ladder", """SELECT o_orderkey AS seq, CAST(k AS INTEGER) AS attempt,
    CAST(format('{:.2f}', o_totalprice * (1 + (0.01e0 + 0.01e0 * (k - 1)))) AS DOUBLE) AS buy_limit,
    CAST(format('{:.2f}', o_totalprice * (1 - (0.01e0 + 0.01e0 * (k - 1)))) AS DOUBLE) AS sell_limit
    FROM orders, range(1, 6) r(k)""", doubles="buy_limit sell_limit")
def prj_limit_ladder(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("ref_price"))
    buy = B.limit_ladder(o).withColumnRenamed("limit_price", "buy_limit")
    sell = B.limit_ladder(o, side="SELL").select("seq", "attempt", F.col("limit_price").alias("sell_limit"))
    return buy.join(sell, ["seq", "attempt"]).select("seq", "attempt", "buy_limit", "sell_limit")


SHARE = """SELECT seq, slots_used, CAST(round((slots_used * 50000e0 - (slots_used * 50000e0) % price) / price) AS BIGINT) AS quantity FROM (
    SELECT seq, price, CAST(CASE WHEN is_fda THEN request ELSE coalesce(list_min(list_filter(range(request, 11), lambda k: k * 50000e0 >= price)), 10) END AS INTEGER) AS slots_used FROM signals)"""


@query("prj_share_quantity", with_views("signals", SHARE))
def prj_share_quantity(spark, sf):
    rows = V.signals(spark, sf).withColumn("slots", F.col("request")).withColumn("remaining", 10 - F.col("slots"))
    return B.share_quantity(rows, F.lit(50_000.0)).select("seq", "slots_used", "quantity")


@query("pipe_slot_allocation", with_views("signals", """SELECT run, seq, requested, CAST(least(requested, greatest(10 - coalesce(before, 0), 0)) AS INTEGER) AS allocated
    FROM (SELECT *, sum(requested) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM (SELECT run, seq, CAST(CASE WHEN is_fda THEN 10 ELSE request END AS INTEGER) AS requested FROM signals))"""), dates="run")
def pipe_slot_allocation(spark, sf):
    return B.allocate_slots(V.signals(spark, sf)).select("run", "seq", "requested", "allocated")


SPANS = """SELECT event_id AS seq, ticker AS run, ts AS entry_time, ts + to_seconds(CAST(k AS BIGINT) * 120) AS exit_time FROM polls"""


def spans(spark, sf):
    p = V._polls(spark, sf)
    return p.select(F.col("event_id").alias("seq"), F.col("ticker").alias("run"), F.col("ts").alias("entry_time"),
                    F.timestamp_micros(F.unix_micros("ts") + F.col("k").cast("bigint") * 120_000_000).alias("exit_time"))


@query("pipe_single_position", with_views("polls", """SELECT s.seq, s.run, w.seq IS NOT NULL AS accepted FROM spans s LEFT JOIN chain w USING (run, seq)""",
                                          spans=SPANS, ranked="SELECT *, row_number() OVER (PARTITION BY run ORDER BY entry_time, seq) AS rn FROM spans",
                                          chain="""WITH RECURSIVE walk AS (SELECT run, rn, seq, exit_time FROM ranked WHERE rn = 1 UNION ALL
    SELECT run, rn, seq, exit_time FROM (SELECT w.run, n.rn, n.seq, n.exit_time, row_number() OVER (PARTITION BY w.run ORDER BY n.rn) AS k
    FROM walk w JOIN ranked n ON n.run = w.run AND n.rn > w.rn AND n.entry_time >= w.exit_time) WHERE k = 1) SELECT run, seq FROM walk"""))
def pipe_single_position(spark, sf):
    return B.single_position(spans(spark, sf)).select("seq", "run", "accepted")


# ---------------------------------------------------------------- orders

@query("src_orders_flatten", with_views("orders_raw", """SELECT order_id, status, q1 AS leg_qty, p1 AS leg_px FROM orders_raw WHERE has_legs UNION ALL
    SELECT order_id, status, q2, p2 FROM orders_raw WHERE has_legs UNION ALL SELECT order_id, status, NULL, NULL FROM orders_raw WHERE NOT has_legs"""),
       doubles="leg_qty leg_px")
def src_orders_flatten(spark, sf):
    return O.order_legs(V.orders_raw(spark, sf))


@query("agg_fill_vwap", with_views("orders_raw", """SELECT order_id, status, coalesce(filled, 0e0) AS filled_quantity, CASE WHEN has_legs THEN
    (q1 * p1 + q2 * p2) / (q1 + q2) WHEN status = 'FILLED' AND price <> 0 THEN price END AS avg_fill_price FROM orders_raw"""), doubles="filled_quantity avg_fill_price")
def agg_fill_vwap(spark, sf):
    return O.order_fills(V.orders_raw(spark, sf))


ATTEMPTS = """SELECT l_orderkey AS signal_id, l_linenumber AS attempt, CASE l_returnflag WHEN 'A' THEN 'FILLED' WHEN 'R' THEN 'CANCELED' ELSE 'WORKING' END AS status,
    l_extendedprice AS price FROM lineitem"""


@query("agg_order_outcome", f"""SELECT signal_id, CAST(min(attempt) FILTER (status = 'FILLED') AS DOUBLE) AS fill_attempt,
    min_by(price, {{'a': attempt, 'p': price}}) FILTER (status = 'FILLED') AS fill_price, max(attempt) AS attempts,
    CASE WHEN count(*) FILTER (status = 'FILLED') > 0 THEN 'ENTRY' ELSE 'ENTRY_ATTEMPT_UNFILLED' END AS outcome FROM ({ATTEMPTS}) GROUP BY signal_id""", doubles="fill_price")
def agg_order_outcome(spark, sf):
    line = V.table(spark, sf, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "FILLED").when(F.col("l_returnflag") == "R", "CANCELED").otherwise("WORKING")
    attempts = line.select(F.col("l_orderkey").alias("signal_id"), F.col("l_linenumber").alias("attempt"), status.alias("status"),
                           F.col("l_extendedprice").alias("price"))
    out = O.order_outcome(attempts, tie=("price",))
    return out.withColumn("fill_attempt", F.col("fill_attempt").cast("double"))


# ---------------------------------------------------------------- exits

EXIT = {
    "since": """SELECT p.ticker, p.entry_time, p.entry_price, p.quantity, p.stop_price, b.ts, b.close, b.volume, row_number() OVER w AS r,
        lag(b.close) OVER w AS pc, b.close > max(b.close) OVER l AND b.close > max(b.close) OVER f AND count(*) OVER l = 2 AND count(*) OVER f = 2 AS hi
        FROM positions p JOIN bars_calm b ON b.ticker = p.ticker AND b.ts >= p.entry_time
        WINDOW w AS (PARTITION BY p.ticker, p.entry_time ORDER BY b.ts),
          l AS (PARTITION BY p.ticker, p.entry_time ORDER BY b.ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING),
          f AS (PARTITION BY p.ticker, p.entry_time ORDER BY b.ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)""",
    "flow": """SELECT *, sum(coalesce(sign(close - pc) * volume, 0)) OVER w AS obv,
        coalesce(sum(CASE WHEN close - pc >= 0 THEN volume END) OVER five, 0) AS up, coalesce(sum(CASE WHEN close - pc < 0 THEN volume END) OVER five, 0) AS down
        FROM since WINDOW w AS (PARTITION BY ticker, entry_time ORDER BY ts), five AS (PARTITION BY ticker, entry_time ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "swung": """SELECT c.ticker, c.entry_time, c.r, s.close, s.obv, row_number() OVER (PARTITION BY c.ticker, c.entry_time, c.r ORDER BY s.r DESC) AS k
        FROM flow c JOIN flow s ON s.ticker = c.ticker AND s.entry_time = c.entry_time AND s.hi AND s.r <= c.r - 2 AND s.r >= greatest(1, c.r - 29) + 2""",
    "diverged": """SELECT ticker, entry_time, r FROM swung WHERE k <= 2 GROUP BY ticker, entry_time, r
        HAVING max(close) FILTER (k = 1) > max(close) FILTER (k = 2) AND max(obv) FILTER (k = 1) < max(obv) FILTER (k = 2)""",
    "fired": f"""SELECT f.*, CASE WHEN close <= stop_price THEN 'STOP' WHEN NOT (hour({QQ.PT}) >= 6 OR abs(close - entry_price) / entry_price * 100 >= 5) THEN NULL
        WHEN f.r >= 2 AND d.r IS NOT NULL THEN 'SWING_DIVERGENCE'
        WHEN f.r >= 2 AND CASE WHEN up + down > 0 THEN (up - down) / (up + down) ELSE 0 END <= -0.5 THEN 'BEARISH_VOLUME' END AS exit_reason
        FROM flow f LEFT JOIN diverged d ON d.ticker = f.ticker AND d.entry_time = f.entry_time AND d.r = f.r""",
    "exits": """SELECT p.ticker, p.entry_time, p.entry_price, p.quantity, x.exit_time, x.exit_price, x.exit_reason FROM positions p LEFT JOIN (
        SELECT ticker, entry_time, min(ts) AS exit_time, min_by(close, ts) AS exit_price, min_by(exit_reason, ts) AS exit_reason
        FROM fired WHERE exit_reason IS NOT NULL GROUP BY ticker, entry_time) x USING (ticker, entry_time)""",
}


def _exits(spark, sf):
    bars = V.stored(V.bars_calm(spark, sf), "bars")
    return X.exit_signals(bars, V.stored(V.positions(spark, sf, bars), "positions"), V.BAR_SERIES)


@query("pipe_exit_signal", with_views("positions bars_calm", """SELECT ticker, entry_time, CAST(epoch_us(exit_time) AS DOUBLE) AS exit_time, exit_price,
    exit_reason FROM exits""", **EXIT), stamps="entry_time", doubles="exit_price")
def pipe_exit_signal(spark, sf):
    return _exits(spark, sf).select("ticker", "entry_time", micros("exit_time"), "exit_price", "exit_reason")


@query("prj_secondary_armed", with_views("positions bars_calm", f"""SELECT ticker, entry_time, ts, hour({QQ.PT}) >= 6 OR abs(close - entry_price) / entry_price * 100 >= 5 AS armed
    FROM since""", since=EXIT["since"]), stamps="entry_time ts")
def prj_secondary_armed(spark, sf):
    pairs = V.positions(spark, sf).select("ticker", "entry_time", "entry_price").join(
        V.bars_calm(spark, sf).select("ticker", "ts", "close"), "ticker").filter("ts >= entry_time")
    return pairs.select("ticker", "entry_time", "ts", X.secondary_armed(F.col("ts"), F.col("close"), F.col("entry_price")).alias("armed"))


@query("prj_pnl", with_views("positions bars_calm", """SELECT ticker, entry_time, (exit_price - entry_price) / entry_price * 100 AS pnl_pct,
    (exit_price - entry_price) * quantity AS pnl_usd FROM exits WHERE exit_time IS NOT NULL""", **EXIT), stamps="entry_time", doubles="pnl_pct pnl_usd")
def prj_pnl(spark, sf):
    rows = _exits(spark, sf).filter(F.col("exit_time").isNotNull())
    return rows.select("ticker", "entry_time", X.pnl_pct(F.col("exit_price"), F.col("entry_price")).alias("pnl_pct"),
                       ((F.col("exit_price") - F.col("entry_price")) * F.col("quantity")).alias("pnl_usd"))
