"""Analytics over OHLCV bars: ``ticker, ts, open, high, low, close, volume``, unique by (ticker, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Exit, Stop
from .ordered import Running, Series, core_rows, decayed, running, tail_rows, uncut, with_halo


def from_ticks(ticks: DataFrame, price: str, qty: str, order: Column, unit: str = "minute",
               keys: tuple[str, ...] = ("ticker",), ts: str = "ts") -> DataFrame:
    """Ticks to bars. ``order`` is a total order of the ticks of a bar; a numeric one keeps the aggregate
    hash-based. All five aggregates are partial, so a hot bar is reduced before the shuffle."""
    return (ticks.groupBy(*keys, F.date_trunc(unit, F.col(ts)).alias("ts")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum(qty).alias("volume")))


def _previous_close(bars: DataFrame, s: Series) -> DataFrame:
    return running(bars, s, [Running("prev_close", "last", F.col("close"), inclusive=False),
                             Running("idx", "count", F.lit(1), inclusive=False)])


def _true_range() -> Column:
    spread = F.col("high") - F.col("low")
    return F.when(F.col("prev_close").isNull(), spread).otherwise(F.greatest(
        spread, F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close"))))


def true_range(bars: DataFrame, s: Series = Series()) -> DataFrame:
    return uncut(_previous_close(bars, s).withColumn("true_range", _true_range()))


def _wilder(index: Column, value: Column, period: int) -> tuple[Column, Column]:
    """Wilder's average as a decayed sum: plain sum up to the seed row, mean there, then smoothing."""
    import math

    decay = (F.when(index < period - 1, F.lit(0.0)).when(index == period - 1, F.lit(-math.log(period)))
             .otherwise(F.lit(math.log((period - 1) / period))))
    return decay, F.when(index < period - 1, value).otherwise(value / period)


def atr(bars: DataFrame, s: Series = Series(), cfg: Stop = Stop()) -> DataFrame:
    """True range and Wilder ATR; null before the first full period."""
    rows = _previous_close(bars, s).withColumn("true_range", _true_range())
    decay, addend = _wilder(F.col("idx"), F.col("true_range"), cfg.atr_period)
    rows = decayed(rows, s, decay, {"atr": addend})
    return uncut(rows.withColumn("atr", F.when(F.col("idx") >= cfg.atr_period - 1, F.col("atr"))))


def rsi(bars: DataFrame, s: Series = Series(), period: int = 14) -> DataFrame:
    """Wilder RSI over close changes; null before ``period`` changes, 50 when nothing moved."""
    change = F.col("close") - F.col("prev_close")
    rows = _previous_close(bars, s).withColumn("change", F.coalesce(change, F.lit(0.0)))
    nth = F.col("idx") - 1
    decay, gain = _wilder(nth, F.greatest(F.col("change"), F.lit(0.0)), period)
    _, loss = _wilder(nth, F.greatest(-F.col("change"), F.lit(0.0)), period)
    rows = decayed(rows, s, decay, {"avg_gain": gain, "avg_loss": loss})
    total = F.col("avg_gain") + F.col("avg_loss")
    value = F.when(total > 0, 100.0 * F.col("avg_gain") / total).otherwise(F.lit(50.0))
    return uncut(rows.withColumn("rsi", F.when(nth >= period - 1, value)))


def signed_volume() -> Column:
    """Volume signed by the close change; the first row and unchanged closes give 0."""
    return F.coalesce(F.signum(F.col("close") - F.col("prev_close")) * F.col("volume"), F.lit(0.0))


def _volume_line(bars: DataFrame, s: Series, out: str) -> DataFrame:
    rows = _previous_close(bars, s).withColumn("_signed", signed_volume())
    return running(rows, s, [Running(out, "sum", F.col("_signed"))]).drop("_signed")


def obv(bars: DataFrame, s: Series = Series()) -> DataFrame:
    return uncut(_volume_line(bars, s, "obv"))


def cvd(bars: DataFrame, s: Series = Series()) -> DataFrame:
    """Cumulative volume delta: the same series as :func:`obv` under its own name."""
    return uncut(_volume_line(bars, s, "cvd"))


def _swings(rows: DataFrame, s: Series, w: int, high: bool, flag: str) -> DataFrame:
    near = with_halo(rows, s, before=w, after=w)
    ordered = Window.partitionBy(*s.group).orderBy(*s.order)
    pick = F.max if high else F.min
    left, right = ordered.rowsBetween(-w, -1), ordered.rowsBetween(1, w)
    close = F.col("close")
    beats = ((close > pick("close").over(left)) & (close > pick("close").over(right))) if high else (
        (close < pick("close").over(left)) & (close < pick("close").over(right)))
    full = (F.count("close").over(left) == w) & (F.count("close").over(right) == w)
    return core_rows(near.withColumn(flag, F.coalesce(full & beats, F.lit(False))))


def swing_highs(bars: DataFrame, s: Series = Series(), w: int = 2) -> DataFrame:
    """Closes strictly above the w closes on either side. A swing is only known w bars later."""
    return uncut(_swings(bars, s, w, True, "is_swing_high")).filter("is_swing_high").drop("is_swing_high")


def swing_lows(bars: DataFrame, s: Series = Series(), w: int = 2) -> DataFrame:
    return uncut(_swings(bars, s, w, False, "is_swing_low")).filter("is_swing_low").drop("is_swing_low")


def last_swing_low(bars: DataFrame, s: Series = Series(), w: int = 2) -> DataFrame:
    """Per key the close of its newest swing low, null if it has none."""
    flagged = uncut(_swings(bars.select(*s.keys, *s.order, "close"), s, w, False, "_low"))
    at = F.when(F.col("_low"), s.place())
    return flagged.groupBy(*s.keys).agg(F.max_by("close", at).alias("swing_low_price"))


def last_two_swings(bars: DataFrame, s: Series = Series(), w: int = 2) -> DataFrame:
    """The two newest swing highs per key with the OBV at each; rank 1 is the newest."""
    line = _volume_line(bars.select(*s.keys, *s.order, "close", "volume"), s, "obv").drop("prev_close", "idx", "volume")
    rows = _swings(line, s, w, True, "_high").filter("_high").drop("_high")
    ranked = rows.withColumn("swing_rank", F.row_number().over(s.newest_first()))
    return uncut(ranked.filter(F.col("swing_rank") <= 2))


def swing_divergence(bars: DataFrame, s: Series = Series(), w: int = 2) -> DataFrame:
    """Per key: do the last two swing highs rise in price while OBV falls?"""
    two = last_two_swings(bars, s, w)

    def at(col: str, rank: int) -> Column:
        return F.max(F.when(F.col("swing_rank") == rank, F.col(col)))

    found = two.groupBy(*s.keys).agg(
        at("close", 1).alias("new_close"), at("close", 2).alias("old_close"),
        at("obv", 1).alias("new_obv"), at("obv", 2).alias("old_obv"))
    rule = (F.col("new_close") > F.col("old_close")) & (F.col("new_obv") < F.col("old_obv"))
    every = bars.select(*s.keys).distinct()
    return every.join(found, list(s.keys), "left").withColumn("divergence", F.coalesce(rule, F.lit(False)))


def session_vwap(bars: DataFrame, keys: tuple[str, ...] = ("ticker", "session")) -> DataFrame:
    """Close-weighted VWAP per group; null without volume."""
    volume = F.sum("volume")
    return bars.groupBy(*keys).agg(
        F.when(volume > 0, F.sum(F.col("close") * F.col("volume")) / volume).alias("vwap"))


def cvd_significance(bars: DataFrame, s: Series = Series(), cfg: Exit = Exit()) -> DataFrame:
    """Net up/down volume of the last few bars per key. An unchanged close counts as up."""
    tail = tail_rows(bars, s, cfg.cvd_bars + 1)
    change = F.col("close") - F.lag("close").over(Window.partitionBy(*s.keys).orderBy(*s.order))
    moves = tail.withColumn("_change", change)
    up = F.coalesce(F.sum(F.when(F.col("_change") >= 0, F.col("volume"))), F.lit(0.0))
    down = F.coalesce(F.sum(F.when(F.col("_change") < 0, F.col("volume"))), F.lit(0.0))
    out = moves.groupBy(*s.keys).agg(up.alias("up_volume"), down.alias("down_volume"),
                                     F.count(F.lit(1)).alias("_n"))
    total = F.col("up_volume") + F.col("down_volume")
    ratio = F.when(total > 0, (F.col("up_volume") - F.col("down_volume")) / total).otherwise(F.lit(0.0))
    out = out.withColumn("net_cvd_ratio", ratio)
    significant = (F.col("_n") >= 2) & (F.col("net_cvd_ratio") <= cfg.cvd_threshold)
    return out.withColumn("significant", significant).drop("_n")


def last_row(bars: DataFrame, s: Series = Series()) -> DataFrame:
    return bars.groupBy(*s.keys).agg(F.max_by("close", s.place()).alias("last_close"),
                                     F.max(s.order[0]).alias("last_ts"))


def entry_stop(rows: DataFrame, cfg: Stop = Stop()) -> DataFrame:
    """Fixed stop from ``entry_price`` and ``atr``, bounded on both sides."""
    implied = F.when(F.col("atr").isNotNull() & (F.col("entry_price") > 0),
                     cfg.atr_multiple * F.col("atr") / F.col("entry_price")).otherwise(
        F.lit(cfg.max_loss_pct))
    rows = rows.withColumn("_implied", implied)
    rows = rows.withColumn("stop_pct", F.greatest(
        F.lit(cfg.min_stop_pct), F.least(F.col("_implied"), F.lit(cfg.max_loss_pct))))
    return (rows.withColumn("stop_capped", F.col("_implied") >= cfg.max_loss_pct)
            .withColumn("stop_price", F.col("entry_price") * (1 - F.col("stop_pct"))).drop("_implied"))


def stop_per_ticker(bars: DataFrame, s: Series = Series(), cfg: Stop = Stop()) -> DataFrame:
    """The stop each key would get for an entry at its last close."""
    at = s.place()
    last = atr(bars, s, cfg).groupBy(*s.keys).agg(
        F.max_by("close", at).alias("entry_price"), F.max_by("atr", at).alias("atr"))
    return entry_stop(last, cfg)


def recent_bars(bars: DataFrame, s: Series, n: int, columns: tuple[str, ...], out: str) -> DataFrame:
    """Add to each bar the array of its last n bars (itself included), oldest first."""
    near = with_halo(bars, s, before=n - 1)
    frame = Window.partitionBy(*s.group).orderBy(*s.order).rowsBetween(-(n - 1), 0)
    return core_rows(near.withColumn(out, F.collect_list(F.struct(*columns)).over(frame)))


