"""Streaming exits: open positions and the last bars of their tickers are state, and a position closes on the first exit rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Exit
from ..functions.clock import PACIFIC, hour_of_day
from ..session import fresh_folder
from .run import file_stream

#: Open positions whose tickers share a state, about.
TOGETHER = 2000

_BARS = np.dtype([("ticker", "i8"), ("close", "f8"), ("volume", "f8")])
_HELD = np.dtype([("ticker", "i8"), ("entry", "i8"), ("price", "f8"), ("stop", "f8"), ("age", "i8")])
REASONS = np.array(["", "STOP", "SWING_DIVERGENCE", "BEARISH_VOLUME"], object)


def _before(x: np.ndarray, k: int) -> np.ndarray:
    """The value k places earlier; at the first k places, anything."""
    return np.roll(x, k)


def _divergences(begin: np.ndarray, end: np.ndarray, close: np.ndarray, volume: np.ndarray, w: int) -> np.ndarray:
    """At each bar the older of the last two swing highs known there, if they diverge (else -1); bars ``begin`` to ``end`` are of its ticker."""
    n, here = len(close), np.arange(len(close))
    high = (here - w >= begin) & (here + w < end)
    for k in range(1, w + 1):
        high &= (close > _before(close, k)) & (close > _before(close, -k))
    at, older = np.flatnonzero(high), np.full(n, -1)
    if len(at) < 2:
        return older
    flow = np.sign(close - _before(close, 1)) * volume
    fell = np.add.reduceat(flow, at + 1)[:-1] < 0  # from one swing high to the next
    falls = fell & (close[at[1:]] > close[at[:-1]]) & (at[:-1] >= begin[at[1:]])
    pair = np.append(-1, np.where(falls, at[:-1], -1))
    last = np.searchsorted(at, here - w, side="right") - 1
    known = (last >= 0) & (at[last] >= begin)
    return np.where(known, pair[last], -1)


def _weaks(close: np.ndarray, volume: np.ndarray, cfg: Exit) -> np.ndarray:
    """Is the volume of the last 1, 2, ... changes up to a bar significantly bearish? One row for each number of changes."""
    change, out = close - _before(close, 1), []
    for m in range(1, min(cfg.cvd_bars, cfg.lookback_bars - 1) + 1):
        up, down, total = np.zeros((3, len(close)))
        for k in range(m - 1, -1, -1):
            c, v = _before(change, k), _before(volume, k)
            up, down, total = up + np.where(c >= 0, v, 0.0), down + np.where(c < 0, v, 0.0), total + v
        out.append(np.where(total > 0, (up - down) / np.where(total > 0, total, 1.0), 0.0) <= cfg.cvd_threshold)
    return np.array(out)


def first_exits(bars: np.ndarray, hour: np.ndarray, first: np.ndarray, held: np.ndarray, cfg: Exit) -> tuple[np.ndarray, np.ndarray]:
    """The number of the bar that closes each position (-1: none does) and the number of its reason.

    ``bars`` lie by ticker and in order of time, ``first`` is the first new one of each position, ``age`` of which come before it in
    its life, and no more than the lookback reads. The rules of a position younger than that see its own bars, so it is followed
    bar by bar; from then on they are flags of a bar, and the first bar that can close it is found by halving spans of bars.
    """
    close, volume, ticker = bars["close"], bars["volume"], bars["ticker"]
    n, w, young = len(bars), cfg.swing_window, cfg.lookback_bars - 1
    begin, end = np.searchsorted(ticker, ticker), np.searchsorted(ticker, ticker, side="right")
    older, weaks, late = _divergences(begin, end, close, volume, w), _weaks(close, volume, cfg), hour >= cfg.armed_hour_pt
    until, entry = np.searchsorted(ticker, held["ticker"], side="right"), first - held["age"]
    price, stop = held["price"], held["stop"]
    found, reason = np.full(len(held), -1), np.zeros(len(held), np.int64)

    def moved(c: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.where(p != 0, np.abs(c - p) / np.where(p != 0, p, 1.0) * 100.0, 0.0) >= cfg.armed_move_pct

    def decide(who: np.ndarray, at: np.ndarray) -> None:
        age, c = at - entry[who], close[at]
        second = (age >= 1) & (late[at] | moved(c, price[who]))
        turned = older[at] >= np.maximum(entry[who], at - young) + w
        weak = weaks[np.clip(age, 1, len(weaks)) - 1, at] if len(weaks) else np.zeros(len(at), bool)
        why = np.where(c <= stop[who], 1, np.where(second & turned, 2, np.where(second & weak, 3, 0)))
        found[who], reason[who] = np.where(why > 0, at, -1), why

    at, open_ = first.copy(), np.arange(len(held))
    for _ in range(young):
        open_ = open_[(found[open_] < 0) & (at[open_] < until[open_]) & (at[open_] - entry[open_] < young)]
        if not len(open_):
            break
        decide(open_, at[open_])
        at[open_] += 1

    who = np.flatnonzero((found < 0) & (at < until))
    if not len(who):
        return found, reason
    rule = older >= np.arange(n) - young + w
    if len(weaks):
        rule |= weaks[-1]
    ruled = np.append(np.where(rule, close, np.nan), np.nan)
    spans = [(np.append(close, np.nan), ruled, ruled, np.append(rule & late, False))]  # least close; least, greatest where a rule holds; armed by the hour
    while 1 << len(spans) <= (until - at)[who].max():
        half = np.minimum(np.arange(n + 1) + (1 << len(spans) - 1), n)
        spans.append(tuple(f(x, x[half]) for f, x in zip((np.fmin, np.fmin, np.fmax, np.logical_or), spans[-1], strict=True)))
    here, p = at[who], price[who]
    for k in range(len(spans) - 1, -1, -1):
        low, least, most, armed = (x[here] for x in spans[k])
        free = ~((low <= stop[who]) | armed | moved(least, p) | moved(most, p))
        here = np.minimum(here + (free.astype(np.int64) << k), n)
    there = here < until[who]
    decide(who[there], here[there])
    return found, reason


def _step(cfg: Exit):
    young = cfg.lookback_bars - 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, held = (np.frombuffer(x, kind) for x, kind in zip(state.get, (_BARS, _HELD), strict=True)) if state.exists else (np.zeros(0, _BARS), np.zeros(0, _HELD))
        rows = pd.concat(list(batches))
        is_bar = rows["is_bar"].to_numpy(bool)
        fresh, tape = rows[~is_bar], rows[is_bar]
        more = np.zeros(len(fresh), _HELD)
        for name, column in (("ticker", "ticker"), ("entry", "at"), ("price", "x"), ("stop", "y")):
            more[name] = fresh[column]
        held = np.concatenate([held, more])
        held = held[np.lexsort((held["entry"], held["ticker"]))]

        tape = tape[np.isin(tape["ticker"].to_numpy(), held["ticker"])]
        bars, n = np.zeros(len(kept) + len(tape), _BARS), len(kept)
        bars[:n] = kept
        for name, column in (("ticker", "ticker"), ("close", "x"), ("volume", "y")):
            bars[name][n:] = tape[column]
        ts = np.concatenate([np.full(n, np.iinfo(np.int64).min), tape["at"].to_numpy(np.int64)])
        hour = np.concatenate([np.zeros(n, np.int64), tape["hour"].to_numpy(np.int64)])
        order = np.lexsort((ts, bars["ticker"]))  # stable: kept bars stay in order, before the new ones
        bars, ts, hour = bars[order], ts[order], hour[order]

        # the first new bar of each position: of its ticker, and while none is in its life, at or after its entry
        until = np.searchsorted(bars["ticker"], held["ticker"], side="right")
        since = np.where(held["age"] > 0, np.iinfo(np.int64).min + 1, held["entry"])
        of, first = np.concatenate([bars["ticker"], held["ticker"]]), np.empty(len(held), np.int64)
        both = np.lexsort((np.repeat([1, 0], [len(bars), len(held)]), np.concatenate([ts, since]), of))
        asks = both >= len(bars)
        first[both[asks] - len(bars)] = np.cumsum(~asks)[asks]

        found, reason = first_exits(bars, hour, first, held, cfg)
        # positions of one ticker and time are one: its first exit closes them all
        rank = np.lexsort((np.where(found < 0, len(bars), found), held["entry"], held["ticker"]))
        held, found, reason, first, until = held[rank], found[rank], reason[rank], first[rank], until[rank]
        lead = np.append(True, (held["ticker"][1:] != held["ticker"][:-1]) | (held["entry"][1:] != held["entry"][:-1]))[: len(held)]
        over, out = (found >= 0)[lead][np.cumsum(lead) - 1], lead & (found >= 0)
        if out.any():
            yield pd.DataFrame({"ticker": held["ticker"][out], "entry": held["entry"][out], "exit": ts[found[out]],
                                "exit_price": bars["close"][found[out]], "exit_reason": REASONS[reason[out]]})

        held["age"] = np.minimum(held["age"] + until - first, young)
        held = held[~over]
        if not len(held):
            if state.exists:
                state.remove()
            return
        need, who = np.zeros(len(bars), np.int64), np.searchsorted(bars["ticker"], held["ticker"])
        np.maximum.at(need, who[held["age"] > 0], held["age"][held["age"] > 0])
        begin, end = np.searchsorted(bars["ticker"], bars["ticker"]), np.searchsorted(bars["ticker"], bars["ticker"], side="right")
        state.update((bars[np.arange(len(bars)) >= end - need[begin]].tobytes(), held.tobytes()))

    return step


def monitor(bars: DataFrame, positions: DataFrame, cfg: Exit = Exit(), buckets: int | None = None) -> DataFrame:
    """``bars`` is a stream in time order per ticker; ``positions`` a static table of open positions, told apart by ticker and entry time.

    Tickers are dealt into ``buckets`` (by default as many as there are thousands of positions, by ``TOGETHER``). The state of a bucket
    is its open positions and, of the tickers that have any, the last bars they lived through; closed ones leave it. The table is written once
    and read as a stream beside the bars, whole in the first micro-batch: no bar is paired with a position. To restart from a
    checkpoint give ``positions`` as a stream of the same folder, and ``buckets``. Rows without ticker or time are left out.
    """
    if not positions.isStreaming:
        spark, folder = positions.sparkSession, fresh_folder(positions.sparkSession, "open-positions")
        positions.select("ticker", "entry_time", "entry_price", "stop_price").write.parquet(folder)
        buckets = buckets or -(-spark.read.parquet(folder).count() // TOGETHER) or 1
        positions = file_stream(spark, folder, spark.read.parquet(folder).schema)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("at")
    double = lambda c, name: F.col(c).cast("double").alias(name)
    tape = bars.select("ticker", micros("ts"), hour_of_day(F.col("ts"), PACIFIC).alias("hour"), double("close", "x"), double("volume", "y"), F.lit(True).alias("is_bar"))
    held = positions.select("ticker", micros("entry_time"), F.lit(0).alias("hour"), double("entry_price", "x"), double("stop_price", "y"), F.lit(False).alias("is_bar"))
    rows = tape.union(held).filter("ticker IS NOT NULL AND at IS NOT NULL").withColumn("_bucket", F.pmod(F.xxhash64("ticker"), F.lit(buckets or 1)))
    out = rows.groupBy("_bucket").applyInPandasWithState(
        _step(cfg), "ticker long, entry long, exit long, exit_price double, exit_reason string", "bars binary, held binary",
        "append", GroupStateTimeout.NoTimeout)
    return out.select("ticker", F.timestamp_micros("entry").alias("entry_time"), F.timestamp_micros("exit").alias("exit_time"), "exit_price", "exit_reason")
