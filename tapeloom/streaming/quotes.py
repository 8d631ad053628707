"""Streaming quotes: session highs, reopenings, market scans, volume confirmation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Confirm, Scan
from ..functions import quotes as Q
from ..operators.quotes import confirm_volume, gap_rvol_tier, quote_side
from ..operators.record_paths import decide


def session_highs(polls: DataFrame, poll_id: str = "event_id") -> DataFrame:
    """Keyed running maximum; emits polls strictly above it, with the high they broke."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", poll_id])
        rows = rows[rows["last"].notna() & (rows["last"] != 0)]
        if rows.empty:
            return
        start = state.get[0] if state.exists else np.nan
        seen = np.fmax.accumulate(np.concatenate([[start], rows["last"].to_numpy()]))
        state.update((float(seen[-1]),))
        rows = rows.assign(prior_high=seen[:-1])
        broke = rows[rows["last"] > rows["prior_high"]]
        if len(broke):
            yield broke[["ticker", "ts", poll_id, "last", "prior_high"]]

    return polls.select("ticker", "ts", poll_id, "last").groupBy("ticker").applyInPandasWithState(
        step, f"ticker string, ts timestamp, {poll_id} long, last double, prior_high double", "high double",
        "append", GroupStateTimeout.NoTimeout)


def halt_reopens(polls: DataFrame, poll_id: str = "event_id") -> DataFrame:
    """Keyed halt flag; emits the polls at which it falls."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", poll_id])
        now = rows["halted"].to_numpy(dtype=bool)
        was = np.concatenate([[state.get[0] if state.exists else False], now[:-1]])
        state.update((bool(now[-1]),))
        fell = was & ~now
        if fell.any():
            yield rows[fell][["ticker", "ts", poll_id, "last"]]

    flagged = polls.select("ticker", "ts", poll_id, "last", Q.is_halted(F.col("security_status")).alias("halted"))
    return flagged.groupBy("ticker").applyInPandasWithState(
        step, f"ticker string, ts timestamp, {poll_id} long, last double", "halted boolean",
        "append", GroupStateTimeout.NoTimeout)


def last_polls(polls: DataFrame, cfg: Scan = Scan(), *, tie: Sequence[str] = (), delay: str = "1 minute") -> DataFrame:
    """Newest poll of each ticker per scan interval (a native streaming aggregate)."""
    rest = [c for c in polls.columns if c != "ticker"]
    windows = polls.withWatermark("ts", delay).groupBy(
        "ticker", F.window("ts", f"{cfg.scan_interval_sec} seconds").alias("_w"))
    last = windows.agg(F.max_by(F.struct(*rest), F.struct("ts", *tie)).alias("_q"))
    return last.select("ticker", F.col("_w.start").alias("scan_ts"), "_q.*")


def scan_tier(scans: DataFrame, adv: DataFrame, cfg: Scan = Scan()) -> DataFrame:
    """Tier-1 candidates of the scans; the volume averages are a static side."""
    return gap_rvol_tier(scans, adv, cfg)


_OUT = ("signal_id long, ticker string, passed boolean, up_volume double, down_volume double, polls_ok long, "
        "polls_failed long, decided_at timestamp")
_STATE = ("ask_id array<bigint>, ask_at array<bigint>, ask_base array<double>, ask_times array<bigint>, "
          "at array<bigint>, id array<bigint>, volume array<double>, last array<double>, side array<bigint>")


def close_tape(decided: DataFrame, signals: DataFrame, polls: DataFrame, adv: DataFrame, cfg: Confirm = Confirm(), *,
               poll_id: str = "event_id") -> DataFrame:
    """Decisions of the stream and, for signals whose window was still open when it ended, of the batch operator."""
    columns = ["signal_id", "ticker", "passed", "up_volume", "down_volume", "polls_ok", "polls_failed"]
    still = signals.join(decided.select("signal_id"), "signal_id", "left_anti")
    closed = confirm_volume(still, polls, adv, signal_id="signal_id", cfg=cfg, tie=(poll_id,))
    return decided.select(*columns).unionByName(closed.select(*columns))


def confirm(signals: DataFrame, polls: DataFrame, adv: DataFrame, cfg: Confirm = Confirm(), *,
            poll_id: str = "event_id", delay: str = "1 minute") -> DataFrame:
    """Per-signal window over the poll stream: early fire, else a decision once event time passes the deadline.

    Signals and polls meet in groups of a ticker and a piece of time as long as a window, each poll in the two pieces whose
    windows can hold it, so no poll is paired with a signal. A group keeps its polls and undecided signals as
    state, decides all windows at once (``record_paths``), and is dropped by a timer once no window of it is open.
    """
    span = cfg.window_sec * 1_000_000
    width = max(span, 1_000_000)
    piece = lambda c: F.floor(F.unix_micros(c) / F.lit(float(width)))
    columns = ["ticker", "_piece", "event_ts", "is_poll", "at", "id", "base", "volume", "last", "side"]
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    s = (signals.filter(F.col("ts").isNotNull() & F.col("signal_id").isNotNull()).withWatermark("ts", delay).join(adv, "ticker", "left")
         .withColumn("_piece", piece(F.col("ts")))
         .select("ticker", "_piece", F.col("ts").alias("event_ts"), F.lit(False).alias("is_poll"), F.unix_micros("ts").alias("at"), F.col("signal_id").alias("id"),
                 F.coalesce(Q.confirm_baseline(F.col("adv"), cfg), F.lit(-1.0)).alias("base"), none("double", "volume"), none("double", "last"), none("int", "side")))
    p = (polls.filter(F.col("ts").isNotNull() & F.col("ticker").isNotNull()).withWatermark("ts", delay)
         .withColumn("_piece", F.explode(F.array(piece(F.col("ts")) - 1, piece(F.col("ts")))))
         .select("ticker", "_piece", F.col("ts").alias("event_ts"), F.lit(True).alias("is_poll"), F.unix_micros("ts").alias("at"),
                 F.coalesce(F.col(poll_id), F.lit(-2**63)).alias("id"), none("double", "base"),
                 F.col("total_volume").cast("double").alias("volume"), F.col("last").cast("double").alias("last"),
                 quote_side(F.col("last"), F.col("bid"), F.col("ask")).cast("int").alias("side")))
    polled, asked = ["at", "id", "volume", "last", "side"], ["id", "at", "base", "times"]
    kinds = {"at": np.int64, "id": np.int64, "volume": np.float64, "last": np.float64, "side": np.int64, "base": np.float64, "times": np.int64}

    def frame(names: list[str], values: list) -> pd.DataFrame:
        return pd.DataFrame({c: np.array(v, dtype=kinds[c]) for c, v in zip(names, values)})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        kept = list(state.get) if state.exists else [[]] * 9
        asks, seen = frame(asked, kept[:4]), frame(polled, kept[4:])
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            seen = pd.concat([seen, rows.loc[rows["is_poll"], polled].astype({c: kinds[c] for c in polled})])
            new = rows.loc[~rows["is_poll"]].groupby(["id", "at", "base"], as_index=False).size().rename(columns={"size": "times"})
            asks = pd.concat([asks, new[asked].astype({c: kinds[c] for c in asked})])
        seen, asks = seen.sort_values(["at", "id"]), asks.reset_index(drop=True)
        if len(asks):
            ts, at, volume = seen["at"].to_numpy(np.int64), asks["at"].to_numpy(np.int64), seen["volume"].to_numpy(np.float64)
            first, end = np.searchsorted(ts, at), np.searchsorted(ts, at + span, side="right")
            d = decide(volume, seen["last"].to_numpy(np.float64), seen["side"].to_numpy(np.int64), first, end,
                       asks["base"].to_numpy(np.float64), cfg.tick_multiple, cfg.up_ratio_min)
            won, times = d.row >= 0, asks["times"].to_numpy(np.int64)
            # equal polls, and polls met by equal signals, come one after the other; the first of those that pass decides
            same = np.append((seen["at"] != seen["at"].shift()).to_numpy() | (seen["id"] != seen["id"].shift()).to_numpy(), True)
            until = np.where(won, np.maximum.accumulate(np.where(same, np.arange(len(same)), 0))[d.row], end)
            ok = np.append(0, np.cumsum(~np.isnan(volume)))
            good = (ok[until] - ok[first]) * times + won
            bad = ((until - first) - (ok[until] - ok[first])) * times
            over = won | ((at + span) // 1000 + span // 1000 < mark)
            decided_at = np.where(won, np.append(ts, 0)[d.row], at + span)
            if over.any():
                yield pd.DataFrame({"signal_id": asks["id"], "ticker": key[0], "passed": won, "up_volume": d.up, "down_volume": d.down, "polls_ok": good,
                                    "polls_failed": bad, "decided_at": pd.to_datetime(decided_at, unit="us")})[over]
            asks = asks[~over]
        closes = (int(key[1]) + 3) * width // 1000  # a window after the last deadline of the group
        if closes < mark:
            if state.exists:
                state.remove()
            return
        due = (int(asks["at"].min()) + 2 * span) // 1000 if len(asks) else closes
        state.update((*[asks[c].tolist() for c in asked], *[seen[c].tolist() for c in polled]))
        state.setTimeoutTimestamp(max(due, mark + 1))

    return p.select(*columns).union(s.select(*columns)).groupBy("ticker", "_piece").applyInPandasWithState(
        step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
