"""Parameters of every operator, grouped by concern, as frozen dataclasses.

The defaults are the specified production values; callers pass a changed copy
(``dataclasses.replace``) when their data has another density.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Screen:
    float_ceiling: float = 10_000_000.0
    market_cap_ceiling: float = 300_000_000.0
    min_avg_volume: float = 100_000.0


@dataclass(frozen=True)
class Scan:
    gap_pct_min: float = 10.0
    rvol_min: float = 3.0
    min_volume: float = 20_000.0
    session_seconds: float = 23_400.0
    premarket_open_sec: int = 4 * 3600      # 04:00 New York
    min_elapsed_sec: float = 60.0
    scan_interval_sec: int = 60
    bullish_lookback_days: int = 18


@dataclass(frozen=True)
class Confirm:
    window_sec: int = 60
    tick_multiple: float = 4.0
    up_ratio_min: float = 0.60
    session_seconds: float = 23_400.0


@dataclass(frozen=True)
class Sentiment:
    negative_max: float = 0.30
    positive_min: float = 0.65
    dictionary_bonus: float = 0.05
    normalisation: float = 15.0


@dataclass(frozen=True)
class News:
    similarity: float = 0.85
    history: int = 20
    fan_out: int = 3
    backfill_minutes: int = 10
    backfill_every_sec: int = 180


@dataclass(frozen=True)
class Sizing:
    weight_float: float = 0.25
    weight_price: float = 0.25
    weight_verdict: float = 0.30
    weight_category: float = 0.20
    lookback_rows: int = 20
    clip_pct: float = 10.0
    confidence: tuple = (("high", 1.0), ("medium", 0.6), ("low", 0.3))
    confidence_default: float = 0.3
    confidence_mix: float = 0.7
    word_cap: int = 40
    float_ceiling: float = 10_000_000.0
    min_slots: int = 1
    max_slots: int = 10
    weight_confirmation: float = 0.5
    weight_gap: float = 0.5
    gap_clip: float = 50.0
    rvol_clip: float = 10.0


@dataclass(frozen=True)
class Stop:
    atr_period: int = 14
    atr_multiple: float = 2.5
    max_loss_pct: float = 0.10
    min_stop_pct: float = 0.02


@dataclass(frozen=True)
class Exit:
    swing_window: int = 2
    lookback_bars: int = 30
    cvd_bars: int = 5
    cvd_threshold: float = -0.50
    armed_hour_pt: int = 6
    armed_move_pct: float = 5.0


@dataclass(frozen=True)
class Entry:
    max_spread: float = 0.03
    price_ceiling: float = 1_000_000.0
    vwap_window_sec: int = 86_400
    pool: int = 10
    slippage: float = 0.01
    widen_step: float = 0.01
    attempts: int = 5
    pre_session_end_sec: int = 7 * 3600     # 07:00 New York


@dataclass(frozen=True)
class Engine:
    """All parameter groups together."""

    screen: Screen = field(default_factory=Screen)
    scan: Scan = field(default_factory=Scan)
    confirm: Confirm = field(default_factory=Confirm)
    sentiment: Sentiment = field(default_factory=Sentiment)
    news: News = field(default_factory=News)
    sizing: Sizing = field(default_factory=Sizing)
    stop: Stop = field(default_factory=Stop)
    exit: Exit = field(default_factory=Exit)
    entry: Entry = field(default_factory=Entry)
