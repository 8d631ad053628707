"""Analytics over quote polls: ``ticker, ts, last, bid, ask, total_volume, previous_close, security_status``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Confirm, Scan
from ..functions import quotes as Q
from ..functions.rounding import truthy
from .ordered import Running, Series, running, uncut
from .record_paths import decide


def halt_reopen(quotes: DataFrame, s: Series = Series()) -> DataFrame:
    """Polls at which a halted ticker trades again; a ticker without history counts as not halted."""
    rows = quotes.withColumn("_now", Q.is_halted(F.col("security_status")))
    rows = running(rows, s, [Running("_was", "last", F.col("_now"), inclusive=False)])
    return uncut(rows.filter(F.coalesce("_was", F.lit(False)) & ~F.col("_now"))).drop("_now", "_was")


def session_high_break(quotes: DataFrame, s: Series = Series()) -> DataFrame:
    """Polls strictly above every earlier price of the key; the first price only seeds the high."""
    rows = quotes.withColumn("_px", truthy(F.col("last")))
    rows = running(rows, s, [Running("prior_high", "max", F.col("_px"), inclusive=False)],
                   keep=F.col("_px").isNotNull())
    return uncut(rows.filter(F.col("_px") > F.col("prior_high"))).drop("_px")


def with_volume_delta(quotes: DataFrame, s: Series = Series()) -> DataFrame:
    """New volume since the highest cumulative volume seen; null on the first usable poll and on failed
    polls. Adds the previous usable price for the tick rule."""
    usable = F.col("total_volume").isNotNull()
    rows = running(quotes, s, [
        Running("prior_total", "max", F.col("total_volume"), inclusive=False),
        Running("_prev", "last", F.when(usable, F.struct("last")), inclusive=False)])
    rows = rows.withColumn("prev_last", F.col("_prev.last")).drop("_prev")
    delta = F.greatest(F.col("total_volume") - F.col("prior_total"), F.lit(0.0))
    known = usable & F.col("prior_total").isNotNull()
    return uncut(rows.withColumn("delta", F.when(known, delta)))


def classify_ticks(quotes: DataFrame, s: Series = Series()) -> DataFrame:
    rows = with_volume_delta(quotes, s)
    split = Q.classify_volume(*[F.col(c) for c in ("last", "bid", "ask", "prev_last", "delta")])
    return (rows.withColumn("_split", split).withColumn("up_volume", F.col("_split.up"))
            .withColumn("down_volume", F.col("_split.down")).drop("_split"))


def scan_metrics(quotes: DataFrame, adv: DataFrame, cfg: Scan = Scan()) -> DataFrame:
    """Gap, session baseline and relative volume per poll, with the tier-1 verdict.

    The lookup join carries no hint: Spark broadcasts the averages while they are measured small and
    splits a hot ticker of the shuffled join (AQE skew join) when they are not.
    """
    rows = quotes.join(adv, "ticker", "left")
    rows = (rows.withColumn("gap_pct", Q.gap_pct(F.col("last"), F.col("previous_close")))
            .withColumn("baseline", Q.session_baseline(F.col("ts"), F.col("adv"), cfg))
            .withColumn("rvol", Q.rvol(F.col("total_volume"), F.col("baseline"))))
    tier = ((F.col("gap_pct") >= cfg.gap_pct_min)
            & Q.rvol_pass(F.col("total_volume"), F.col("baseline"), cfg.rvol_min)
            & (F.col("total_volume") >= cfg.min_volume))
    return rows.withColumn("in_tier", F.coalesce(tier, F.lit(False)))


def gap_rvol_tier(quotes: DataFrame, adv: DataFrame, cfg: Scan = Scan()) -> DataFrame:
    return scan_metrics(quotes, adv, cfg).filter("in_tier").drop("in_tier")


def market_scan(quotes: DataFrame, adv: DataFrame, cfg: Scan = Scan(), tie: Sequence[str] = ()) -> DataFrame:
    """Tier-1 candidates per scan: the last poll of each ticker in each scan interval, then the tier."""
    every = [c for c in quotes.columns if c != "ticker"]
    last = quotes.groupBy("ticker", F.window("ts", f"{cfg.scan_interval_sec} seconds").alias("_w")).agg(
        F.max_by(F.struct(*every), F.struct("ts", *tie)).alias("_q"))
    polls = last.select("ticker", F.col("_w.start").alias("scan_ts"), "_q.*")
    return gap_rvol_tier(polls, adv, cfg)


def newly_added(candidates: DataFrame, cfg: Scan = Scan(), s: Series = Series(order=("scan_ts",))) -> DataFrame:
    """Candidates of a scan that were not candidates in the scan just before it."""
    rows = running(candidates, s, [Running("_prev", "last", F.col("scan_ts"), inclusive=False)])
    gap = F.unix_seconds("scan_ts") - F.unix_seconds("_prev")
    return uncut(rows.filter(F.col("_prev").isNull() | (gap > cfg.scan_interval_sec))).drop("_prev")


def scan_difference(candidates: DataFrame, cfg: Scan = Scan()) -> DataFrame:
    """The same set as an anti-join of each scan with the scan before it."""
    shifted = candidates.select(
        "ticker", (F.col("scan_ts") + F.expr(f"INTERVAL {cfg.scan_interval_sec} SECONDS")).alias("scan_ts"))
    return candidates.join(shifted, ["ticker", "scan_ts"], "left_anti")


CONFIRM_COLUMNS = ("passed", "volume_since", "up_volume", "down_volume", "up_ratio", "rvol", "baseline",
                   "elapsed_sec", "polls_ok", "polls_failed", "data_quality")


def quote_side(last: Column, bid: Column, ask: Column) -> Column:
    """What the quote rule says: 1 up, -1 down, 0 left to the tick rule."""
    return F.when(last >= ask, 1).when(last <= bid, -1).otherwise(0)


def _windows(cfg: Confirm):
    """The (ticker, piece) step of :func:`confirm_volume`: decide all windows that open in the piece."""
    span = cfg.window_sec * 1_000_000

    def step(spans: pd.DataFrame, polls: pd.DataFrame) -> pd.DataFrame:
        p = polls.sort_values(["_in", "_n"]) if len(spans) else polls.iloc[:0]
        ts, volume = p["_pt"].to_numpy(np.int64), p["total_volume"].to_numpy(np.float64)
        tied = p.groupby(["_in", "_tie"])["_n"].transform("size").to_numpy(np.int64) if len(p) else ts
        tie_end = np.arange(len(p)) - (p["_n"].to_numpy(np.int64) - p["_tie"].to_numpy(np.int64)) + tied
        at = spans["_at"].to_numpy(np.int64)
        first, end = np.searchsorted(ts, at), np.searchsorted(ts, at + span, side="right")
        d = decide(volume, p["last"].to_numpy(np.float64), p["_side"].to_numpy(np.int64), first, end,
                   spans["_base"].to_numpy(np.float64), cfg.tick_multiple, cfg.up_ratio_min)
        won = d.row >= 0
        until = np.where(won, np.append(tie_end, 0)[d.row], end)
        ok = np.append(0, np.cumsum(~np.isnan(volume)))
        times = spans["_times"].to_numpy(np.int64)
        good = (ok[until] - ok[first]) * times
        return spans[["_sid", "_ticker", "_at"]].assign(
            passed=won, up_volume=d.up, down_volume=d.down, polls_ok=good, polls_failed=(until - first) * times - good,
            elapsed_sec=(np.where(won, np.append(ts, 0)[d.row], at) - at) / 1e6)

    return step


def confirm_volume(signals: DataFrame, quotes: DataFrame, adv: DataFrame, *, signal_id: str,
                   cfg: Confirm = Confirm(), tie: Sequence[str] = ()) -> DataFrame:
    """Volume and buying pressure in the window after each signal, decided at the first poll where both
    suffice, else at the deadline. Adds :data:`CONFIRM_COLUMNS`; every signal is kept.

    Only polls inside the window exist for a signal: the first usable one sets the start volume. Signals
    and polls meet in groups of a ticker and a piece of time as long as a window, each poll in the two
    pieces whose windows can hold it; there all windows are decided at once (``record_paths``), so no poll is
    paired with a signal. Equal signal rows count the polls of their window once each.
    """
    width = F.lit(float(max(cfg.window_sec, 1) * 1_000_000))
    polls = quotes.select("ticker", "ts", *tie, "last", "bid", "ask", "total_volume").filter(
        F.col("ticker").isNotNull() & F.col("ts").isNotNull())
    polls = polls.withColumn("_pt", F.unix_micros("ts")).withColumn("_in", F.floor(F.col("_pt") / width))
    placed = Window.partitionBy("ticker", "_in").orderBy("ts", *tie)
    polls = polls.select(
        F.col("ticker").alias("_ticker"), "_pt", "_in", F.row_number().over(placed).alias("_n"), F.rank().over(placed).alias("_tie"),
        F.col("last").cast("double").alias("last"), quote_side(F.col("last"), F.col("bid"), F.col("ask")).alias("_side"),
        F.col("total_volume").cast("double").alias("total_volume"))
    polls = polls.withColumn("_piece", F.explode(F.array(F.col("_in") - 1, F.col("_in"))))
    spans = (signals.select(F.col(signal_id).alias("_sid"), F.col("ticker").alias("_ticker"), F.unix_micros("ts").alias("_at"))
             .dropna().groupBy("_sid", "_ticker", "_at").agg(F.count(F.lit(1)).alias("_times"))
             .join(adv.withColumnRenamed("ticker", "_ticker"), "_ticker", "left"))
    spans = spans.select("_sid", "_ticker", "_at", "_times", F.coalesce(Q.confirm_baseline(F.col("adv"), cfg), F.lit(0.0)).alias("_base"),
                         F.floor(F.col("_at") / width).alias("_piece"))
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema.fields}
    decided = spans.groupBy("_ticker", "_piece").cogroup(polls.groupBy("_ticker", "_piece")).applyInPandas(
        _windows(cfg), f"_sid {kinds['_sid']}, _ticker {kinds['_ticker']}, _at bigint, passed boolean, up_volume double, "
                       "down_volume double, polls_ok bigint, polls_failed bigint, elapsed_sec double")
    state = F.struct("passed", "up_volume", "down_volume", "elapsed_sec", "polls_ok", "polls_failed").alias("_state")
    out = signals.join(decided.select("_sid", "_ticker", "_at", state), (F.col(signal_id) == F.col("_sid")) & (
        F.col("ticker") == F.col("_ticker")) & (F.unix_micros("ts") == F.col("_at")), "left")
    out = out.drop("_sid", "_ticker", "_at").join(adv, "ticker", "left")
    zero, none = F.lit(0.0), F.lit(0)

    def get(name: str, default):
        return F.coalesce(F.col(f"_state.{name}"), default)

    won = get("passed", F.lit(False))
    up, down = get("up_volume", zero), get("down_volume", zero)
    out = out.withColumns({
        "passed": won, "volume_since": up + down, "up_volume": up, "down_volume": down,
        "up_ratio": F.when(up + down > 0, up / (up + down)).otherwise(zero), "baseline": Q.confirm_baseline(F.col("adv"), cfg),
        "elapsed_sec": F.when(won, F.col("_state.elapsed_sec")).otherwise(F.lit(float(cfg.window_sec))),
        "polls_ok": get("polls_ok", none), "polls_failed": get("polls_failed", none)})
    return (out.withColumn("rvol", Q.rvol(F.col("volume_since"), F.col("baseline")))
            .withColumn("data_quality", Q.data_quality(F.col("polls_ok"), F.col("polls_failed")))
            .drop("_state", "adv"))
