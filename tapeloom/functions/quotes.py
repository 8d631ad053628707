"""Row-level quote expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import Confirm, Entry, Scan
from .clock import session_elapsed
from .rounding import truthy


def is_halted(status: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(status, r"(?U)^\s+|\s+$", "")) == "halted", F.lit(False))


def gap_pct(last: Column, previous_close: Column) -> Column:
    """Percent above the previous close; null unless both prices are usable."""
    return F.when((truthy(last).isNotNull()) & (previous_close > 0),
                  (last - previous_close) / previous_close * 100.0)


def volume_baseline(adv: Column, window_sec: Column | float, session_seconds: float = 23_400.0) -> Column:
    """Average daily volume scaled to a window; null without a positive average."""
    window = window_sec if isinstance(window_sec, Column) else F.lit(float(window_sec))
    return F.when(adv > 0, adv * (window / F.lit(session_seconds)))


def rvol(volume: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, volume / baseline).otherwise(F.lit(0.0))


def rvol_pass(volume: Column, baseline: Column, multiple: float) -> Column:
    return F.coalesce((baseline > 0) & (volume / baseline >= multiple), F.lit(False))


def session_baseline(ts: Column, adv: Column, cfg: Scan = Scan()) -> Column:
    elapsed = session_elapsed(ts, cfg.premarket_open_sec, cfg.min_elapsed_sec)
    return volume_baseline(adv, elapsed, cfg.session_seconds)


def is_liquid(bid: Column, ask: Column, cfg: Entry = Entry()) -> Column:
    spread = F.try_divide(ask - bid, (bid + ask) / 2.0)
    return F.coalesce((bid > 0) & (ask > 0) & (spread <= cfg.max_spread), F.lit(False))


def classify_volume(last: Column, bid: Column, ask: Column, prev_last: Column, delta: Column) -> Column:
    """Split new volume into {up, down}: quote rule, then tick rule, else half and half."""
    zero, half = F.lit(0.0), delta / 2.0

    def split(up: Column, down: Column) -> Column:
        return F.struct(up.alias("up"), down.alias("down"))

    return (F.when(delta.isNull() | (delta <= 0), split(zero, zero))
            .when(last >= ask, split(delta, zero)).when(last <= bid, split(zero, delta))
            .when(last > prev_last, split(delta, zero)).when(last < prev_last, split(zero, delta))
            .otherwise(split(half, half)))


def data_quality(ok: Column, failed: Column) -> Column:
    return F.when(ok == 0, "NO_DATA").when(failed > 0, "PARTIAL").otherwise("OK")


def confirm_baseline(adv: Column, cfg: Confirm = Confirm()) -> Column:
    return volume_baseline(adv, float(cfg.window_sec), cfg.session_seconds)
