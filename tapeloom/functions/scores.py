"""Scores in [0, 1] and their mapping to capital slots."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import Confirm, Sizing
from ..constants import NEWS_CATEGORY_BASELINE, NEWS_CATEGORY_TIERS
from .rounding import clamp
from .text import contains_any


def float_score(shares: Column, cfg: Sizing = Sizing()) -> Column:
    return F.when(shares > 0, clamp(1.0 - shares / cfg.float_ceiling, 0.0, 1.0)).otherwise(F.lit(0.5))


def move_pct(start: Column, end: Column, rows: Column) -> Column:
    return F.when((rows >= 2) & (start > 0), (end - start) / start * 100.0)


def price_action_score(pct: Column, cfg: Sizing = Sizing()) -> Column:
    scaled = (clamp(pct, -cfg.clip_pct, cfg.clip_pct) + cfg.clip_pct) / (2 * cfg.clip_pct)
    return F.when(pct.isNull(), F.lit(0.5)).otherwise(scaled)


def confidence_component(confidence: Column, cfg: Sizing = Sizing()) -> Column:
    out = F.lit(cfg.confidence_default)
    for label, score in cfg.confidence:
        out = F.when(confidence == label, F.lit(score)).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), " ")
    return F.size(F.filter(words, lambda w: w != ""))


def verdict_score(confidence: Column, reasoning: Column, cfg: Sizing = Sizing()) -> Column:
    richness = F.least(word_count(reasoning) / F.lit(float(cfg.word_cap)), F.lit(1.0))
    return (cfg.confidence_mix * confidence_component(confidence, cfg)
            + (1 - cfg.confidence_mix) * richness)


def news_category(headline: Column, summary: Column) -> Column:
    """Best tier whose phrases occur, as {category, score}."""
    text = F.lower(F.concat_ws(" ", headline, summary))
    name, score = NEWS_CATEGORY_BASELINE
    out = F.struct(F.lit(name).alias("category"), F.lit(score).alias("score"))
    for tier, value, phrases in reversed(NEWS_CATEGORY_TIERS):
        hit = F.struct(F.lit(tier).alias("category"), F.lit(value).alias("score"))
        out = F.when(contains_any(text, phrases), hit).otherwise(out)
    return out


def magnitude(float_s: Column, price_s: Column, verdict_s: Column, category_s: Column,
              cfg: Sizing = Sizing()) -> Column:
    return clamp(cfg.weight_float * float_s + cfg.weight_price * price_s
                 + cfg.weight_verdict * verdict_s + cfg.weight_category * category_s, 0.0, 1.0)


def slots(composite: Column, cfg: Sizing = Sizing()) -> Column:
    raw = cfg.min_slots + composite * (cfg.max_slots - cfg.min_slots)
    return F.bround(clamp(raw, float(cfg.min_slots), float(cfg.max_slots)), 0).cast("int")


def confirmation_score(volume: Column, baseline: Column, up_ratio: Column, cfg: Confirm = Confirm()) -> Column:
    top = cfg.tick_multiple * 3
    reached = F.when(baseline > 0, clamp(volume / baseline, 0.0, top) / top).otherwise(F.lit(0.5))
    buying = F.when(up_ratio >= cfg.up_ratio_min,
                    (up_ratio - cfg.up_ratio_min) / (1.0 - cfg.up_ratio_min)).otherwise(F.lit(0.0))
    return clamp(0.5 * reached + 0.5 * buying, 0.0, 1.0)


def gap_scanner_score(gap: Column, rvol: Column, cfg: Sizing = Sizing()) -> Column:
    return clamp(0.5 * clamp(gap, 0.0, cfg.gap_clip) / cfg.gap_clip
                 + 0.5 * clamp(rvol, 0.0, cfg.rvol_clip) / cfg.rvol_clip, 0.0, 1.0)


def breakout_score(confirmation: Column, gap_score: Column, cfg: Sizing = Sizing()) -> Column:
    return clamp(cfg.weight_confirmation * confirmation + cfg.weight_gap * gap_score, 0.0, 1.0)
