"""Research measures over bars, ticks, news and trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.clock import NEW_YORK, hour_of_day
from .matching import asof_join
from .ordered import Running, Series, core_rows, decayed, running, uncut, with_halo


def flow_imbalance(ticks: DataFrame, window: str = "1 hour") -> DataFrame:
    """(up - down) / (up + down) of classified volume per ticker and time window; null without volume."""
    up, down = F.sum("up_volume"), F.sum("down_volume")
    out = ticks.groupBy("ticker", F.window("ts", window).alias("_w")).agg(up.alias("up"), down.alias("down"))
    total = F.col("up") + F.col("down")
    return out.select("ticker", F.col("_w.start").alias("window_start"),
                      F.when(total > 0, (F.col("up") - F.col("down")) / total).alias("imbalance"))


def with_returns(bars: DataFrame, s: Series = Series()) -> DataFrame:
    rows = running(bars, s, [Running("prev_close", "last", F.col("close"), inclusive=False)])
    usable = F.col("prev_close") > 0
    return rows.withColumn("ret", F.when(usable, (F.col("close") - F.col("prev_close")) / F.col("prev_close"))) \
        .withColumn("log_ret", F.when(usable & (F.col("close") > 0), F.ln(F.col("close") / F.when(usable, F.col("prev_close")))))


def amihud(bars: DataFrame, s: Series = Series(), n: int = 5) -> DataFrame:
    """Mean absolute return per traded value over the last n bars."""
    value = F.col("close") * F.col("volume")
    rows = with_returns(bars, s).withColumn("_i", F.when(value > 0, F.abs("ret") / value))
    near = with_halo(rows, s, before=n - 1)
    frame = Window.partitionBy(*s.group).orderBy(*s.order).rowsBetween(-(n - 1), 0)
    return uncut(core_rows(near.withColumn("illiquidity", F.avg("_i").over(frame)))).drop("_i")


def realized_vol_daily(bars: DataFrame, s: Series = Series()) -> DataFrame:
    rows = uncut(with_returns(bars, s)).withColumn("day", F.to_date("ts"))
    return rows.groupBy("ticker", "day").agg(F.sqrt(F.sum(F.col("log_ret") * F.col("log_ret"))).alias("realized_vol"))


def realized_vol_rolling(bars: DataFrame, s: Series = Series(), n: int = 10) -> DataFrame:
    near = with_halo(with_returns(bars, s), s, before=n - 1)
    frame = Window.partitionBy(*s.group).orderBy(*s.order).rowsBetween(-(n - 1), 0)
    vol = F.sqrt(F.sum(F.col("log_ret") * F.col("log_ret")).over(frame))
    return uncut(core_rows(near.withColumn("realized_vol", vol)))


def intraday_profile(bars: DataFrame, s: Series = Series()) -> DataFrame:
    """Mean return, absolute return and volume by New York hour."""
    rows = uncut(with_returns(bars, s)).withColumn("hour", hour_of_day(F.col("ts"), NEW_YORK))
    return rows.groupBy("hour").agg(F.avg("ret").alias("mean_ret"), F.avg(F.abs("ret")).alias("mean_abs_ret"),
                                    F.avg("volume").alias("mean_volume"))


def momentum_deciles(bars: DataFrame, s: Series = Series(), past: int = 5, ahead: int = 3) -> DataFrame:
    """Mean forward return by cross-sectional decile of past return. A cross section holds each ticker once."""
    near = with_halo(bars.select("ticker", "ts", "close"), s, before=past, after=ahead)
    w = Window.partitionBy(*s.group).orderBy(*s.order)
    rows = near.withColumn("_p", F.lag("close", past).over(w)).withColumn("_f", F.lead("close", ahead).over(w))
    rows = uncut(core_rows(rows)).filter((F.col("_p") > 0) & F.col("_f").isNotNull() & (F.col("close") > 0))
    rows = rows.select("ticker", "ts", ((F.col("close") - F.col("_p")) / F.col("_p")).alias("momentum"),
                       ((F.col("_f") - F.col("close")) / F.col("close")).alias("forward"))
    ranked = rows.withColumn("decile", F.ntile(10).over(Window.partitionBy("ts").orderBy("momentum", "ticker")))
    return ranked.groupBy("decile").agg(F.avg("momentum").alias("mean_momentum"), F.avg("forward").alias("mean_forward"),
                                        F.count(F.lit(1)).alias("n"))


def event_study(events: DataFrame, bars: DataFrame, s: Series = Series(), horizons: Sequence[int] = (1, 5, 10), *,
                ts: str = "created_at") -> DataFrame:
    """Mean return from the first bar after an event to each later bar, one row per horizon."""
    near = with_halo(bars.select("ticker", "ts", "close"), s, after=max(horizons))
    w = Window.partitionBy(*s.group).orderBy(*s.order)
    rows = uncut(core_rows(near.withColumns({f"_h{h}": F.lead("close", h).over(w) for h in horizons})))
    hit = asof_join(events, rows, ["close", *[f"_h{h}" for h in horizons]], left_ts=ts, width_sec=s.width_sec,
                    strict=True, forward=True).filter(F.col("close") > 0)
    sums = hit.agg(*[F.struct(F.avg((F.col(f"_h{h}") - F.col("close")) / F.col("close")).alias("mean_return"),
                              F.count(f"_h{h}").alias("events")).alias(f"_s{h}") for h in horizons])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"_s{h}.mean_return").alias("mean_return"), F.col(f"_s{h}.events").alias("events"))
        for h in horizons])))


def event_intensity(events: DataFrame, s: Series, rate_per_sec: float) -> DataFrame:
    """Exponential-kernel clustering: how much recent events of the key still weigh at each event."""
    rows = running(events, s, [Running("_prev", "last", F.col(s.order[0]), inclusive=False)])
    gap = (F.unix_micros(s.order[0]) - F.unix_micros("_prev")) / F.lit(1e6)
    fade = F.coalesce(-F.lit(rate_per_sec) * gap, F.lit(0.0))
    start = F.when(F.col("_prev").isNull(), F.lit(0.0)).otherwise(F.exp(fade))
    return uncut(decayed(rows, s, fade, {"intensity": start})).drop("_prev")


def cost_adjusted(trades: DataFrame, fee_bps: float = 10.0, slippage_bps: float = 5.0) -> DataFrame:
    """Gross against net mean return after both sides' costs, and the share of trades still positive."""
    cost = 2 * (fee_bps + slippage_bps) / 100.0
    net = F.col("pnl_pct") - F.lit(cost)
    return trades.agg(F.count("pnl_pct").alias("trades"), F.avg("pnl_pct").alias("gross_pct"), F.avg(net).alias("net_pct"),
                      F.avg(F.when(F.col("pnl_pct") > 0, 1.0).otherwise(0.0)).alias("share_positive_gross"),
                      F.avg(F.when(net > 0, 1.0).otherwise(0.0)).alias("share_positive_net"))


def temporal_split(rows: DataFrame, order: tuple[str, ...], width_sec: int = 60,
                   cuts: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """Label rows train / validation / test by their exact place in time order, without a global sort:
    counts per time piece give the offsets, rows are only ranked inside their piece."""
    s = Series(keys=(), order=order, width_sec=width_sec)
    ranked = uncut(running(rows, s, [Running("_rank", "count", F.lit(1), inclusive=False)]))
    total = rows.agg(F.count(F.lit(1))).scalar()
    placed = ranked.withColumn("_at", F.col("_rank") / total)
    label = F.when(F.col("_at") < cuts[0], "train").when(F.col("_at") < cuts[1], "validation").otherwise("test")
    return placed.withColumn("split", label).drop("_rank", "_at")


def parameter_sweep(trades: DataFrame, feature: str, thresholds: Sequence[float]) -> DataFrame:
    """Mean P&L of the trades whose feature reaches each threshold, per split; the best threshold on
    validation is marked. All thresholds are conditional sums of one pass, rows are not multiplied."""
    def mean(t: float):
        return F.avg(F.when(F.col(feature) >= t, F.col("pnl_pct")))

    sums = trades.groupBy("split").agg(*[F.struct(F.lit(t).alias("threshold"), mean(t).alias("mean_pnl"),
                                                  F.count(F.when(F.col(feature) >= t, 1)).alias("trades")).alias(f"_t{i}")
                                         for i, t in enumerate(thresholds)])
    scores = sums.select("split", F.inline(F.array(*[f"_t{i}" for i in range(len(thresholds))])))
    by = scores.groupBy("threshold").agg(*[
        F.max(F.when(F.col("split") == name, F.col("mean_pnl"))).alias(f"{name}_pnl") for name in ("train", "validation", "test")],
        F.sum("trades").alias("trades"))
    best = by.agg(F.max_by("threshold", F.when(F.col("validation_pnl").isNotNull(), F.struct("validation_pnl", "threshold")))
                  .alias("_best"))
    out = by.withColumn("is_best", F.col("threshold") == best.scalar())
    # the test score is only reported for the chosen threshold
    return out.withColumn("test_pnl", F.when(F.col("is_best"), F.col("test_pnl")))


def winner_concentration(trades: DataFrame, k: int = 10, *, pnl: str = "pnl_usd") -> DataFrame:
    """Share of the total P&L that the k best trades make."""
    top = trades.orderBy(F.desc(pnl)).limit(k).agg(F.sum(pnl).alias("top_pnl"))
    total = trades.agg(F.sum(pnl).alias("total_pnl"), F.count(pnl).alias("trades"))
    return total.withColumn("top_pnl", top.scalar()).withColumn(
        "top_share", F.when(F.col("total_pnl") != 0, F.col("top_pnl") / F.col("total_pnl")))
