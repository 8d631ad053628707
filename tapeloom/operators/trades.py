"""Joins between bars, quotes, positions and the trade log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..config import Exit, Sizing
from .bars import recent_bars
from .matching import asof_join, open_at
from .ordered import Series, tail_rows, uncut

BAR_COLUMNS = ("ts", "open", "high", "low", "close", "volume")


def prenews_bars(news: DataFrame, bars: DataFrame, s: Series = Series(), cfg: Sizing = Sizing(), *,
                 news_ts: str = "created_at") -> DataFrame:
    """The last rows (not minutes) of bars strictly before each article, one output row per bar."""
    windows = uncut(recent_bars(bars, s, cfg.lookback_rows, BAR_COLUMNS, "_bars")).select("ticker", "ts", "_bars")
    hit = asof_join(news, windows, ["_bars"], left_ts=news_ts, width_sec=s.width_sec, strict=True)
    kept = [c for c in hit.columns if c != "_bars"]
    return hit.select(*kept, F.explode("_bars").alias("_b")).select(
        *kept, *[F.col(f"_b.{c}").alias(f"bar_{c}") for c in BAR_COLUMNS])


def prenews_move(news: DataFrame, bars: DataFrame, s: Series = Series(), cfg: Sizing = Sizing(), *,
                 news_ts: str = "created_at") -> DataFrame:
    """First and last close and row count of those bars, without listing them."""
    windows = uncut(recent_bars(bars, s, cfg.lookback_rows, ("close",), "_bars")).select(
        "ticker", "ts", F.col("_bars")[0]["close"].alias("start_close"), F.col("close").alias("end_close"),
        F.size("_bars").alias("bar_rows"))
    return asof_join(news, windows, ["start_close", "end_close", "bar_rows"], left_ts=news_ts,
                     width_sec=s.width_sec, strict=True)


def bars_since_entry(bars: DataFrame, positions: DataFrame, s: Series = Series(), cfg: Exit = Exit()) -> DataFrame:
    """Newest bars at or after each entry, at most the lookback, only where there are two or more.

    The newest n bars since an entry are the newest n bars of the ticker that are not older than it,
    so positions meet n bars each instead of the whole series.
    """
    newest = tail_rows(bars, s, cfg.lookback_bars)
    pairs = positions.join(newest, list(s.keys)).filter(F.col("ts") >= F.col("entry_time"))
    held = Window.partitionBy(*s.keys, "entry_time")
    return pairs.withColumn("_n", F.count(F.lit(1)).over(held)).filter(F.col("_n") >= 2).drop("_n")


def recent_bullish(events: DataFrame, bullish: DataFrame, days: int = 18, *, ts: str = "ts",
                   width_sec: int = 86_400) -> DataFrame:
    """Latest bullish time at or before the event, null when older than the lookback."""
    hit = asof_join(events, bullish.withColumn("bullish_ts", F.col("ts")), ["bullish_ts"],
                    left_ts=ts, width_sec=width_sec)
    fresh = F.col("bullish_ts") >= F.col(ts) - F.expr(f"INTERVAL {days} DAYS")
    return hit.withColumn("bullish_ts", F.when(fresh, F.col("bullish_ts")))


def asof_quote(events: DataFrame, quotes: DataFrame, columns: Sequence[str], *, ts: str = "ts",
               tie: Sequence[str] = (), width_sec: int = 86_400) -> DataFrame:
    """Latest quote at or before each event."""
    return asof_join(events, quotes, columns, left_ts=ts, tie=tie, width_sec=width_sec)


def fresh_fundamentals(events: DataFrame, snapshots: DataFrame, columns: Sequence[str], *, ts: str = "ts",
                       ttl_sec: float = 3600.0, tie: Sequence[str] = (), width_sec: int = 86_400) -> DataFrame:
    """Latest snapshot at or before each event, all null once it is ``ttl_sec`` old."""
    hit = asof_join(events, snapshots, ["fetched_at", *columns], left_ts=ts, right_ts="fetched_at",
                    tie=tie, width_sec=width_sec)
    age = (F.unix_micros(ts) - F.unix_micros("fetched_at")) / F.lit(1e6)
    return hit.withColumns({c: F.when(age < ttl_sec, F.col(c)) for c in ["fetched_at", *columns]})


def without_open_position(signals: DataFrame, held: DataFrame, *, ts: str = "ts",
                          width_sec: int = 86_400) -> DataFrame:
    """Drop signals whose ticker has an open position at that time."""
    return open_at(signals, held, ts=ts, width_sec=width_sec).filter(~F.col("is_open")).drop("is_open")


def round_trips(log: DataFrame, *, ts: str = "ts", tie: Sequence[str] = (), width_sec: int = 86_400) -> DataFrame:
    """Pair each ENTRY with the next EXIT of its ticker; open trades keep null exits."""
    entries = log.filter(F.col("event") == "ENTRY").drop("event").withColumnRenamed(ts, "entry_time") \
        .withColumnRenamed("price", "entry_price")
    exits = log.filter(F.col("event") == "EXIT").select(
        "ticker", F.col(ts).alias("exit_time"), F.col("price").alias("exit_price"), *tie)
    return asof_join(entries, exits.withColumn("_at", F.col("exit_time")), ["exit_time", "exit_price"],
                     left_ts="entry_time", right_ts="_at", tie=tie, width_sec=width_sec, strict=True, forward=True)
