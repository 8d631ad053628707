"""From feeds to signals: the news path, the breakout path and the reopen path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..config import Engine
from ..constants import REASON_BREAKOUT, REASON_FDA, REASON_HALT, REASON_NEWS
from ..functions import quotes as Q, text as X
from ..operators import news as N, quotes as P, trades as T
from ..operators.ordered import Series
from ..session import materialise
from ..sources import news as feed
from .sizing import breakout, magnitude

CONFIRM_KEPT = ("passed", "volume_since", "up_ratio", "baseline")


def bullish_tier(candidates: DataFrame, news: DataFrame, verdicts: DataFrame, scored: DataFrame, as_of: str,
                 cfg: Engine = Engine()) -> DataFrame:
    """``ticker, ts, id`` of articles of the lookback that a verdict calls positive and first-hand.

    Articles scored before, recaps and articles without a verdict do not count.
    """
    rows = feed.history(news, candidates, as_of, cfg.scan.bullish_lookback_days)
    rows = rows.join(scored.select("id"), "id", "left_anti").filter(~X.is_stale_recap(F.col("headline")))
    rows = rows.join(verdicts, "id")
    good = (F.col("verdict.catalyst") == "positive") & ~F.col("verdict.is_secondhand")
    return rows.filter(good).select("ticker", F.col("created_at").alias("ts"), "id")


def _confirmed(rows: DataFrame, quotes: DataFrame, adv: DataFrame, signal_id: str, cfg: Engine,
               tie: Sequence[str]) -> DataFrame:
    at = rows.select(signal_id, "ticker", "ts")
    checked = P.confirm_volume(at, quotes, adv, signal_id=signal_id, cfg=cfg.confirm, tie=tie)
    return rows.join(checked.filter("passed").select(signal_id, *CONFIRM_KEPT), signal_id)


def rolling_high(quotes: DataFrame, adv: DataFrame, bullish: DataFrame, s: Series, cfg: Engine = Engine(), *,
                 poll_id: str = "event_id") -> DataFrame:
    """New highs among tier-1 polls with recent bullish news and confirmed volume.

    The running high only sees polls at which the ticker is a candidate, as only those are watched.
    """
    tier = P.gap_rvol_tier(quotes, adv, cfg.scan).withColumnRenamed("rvol", "scan_rvol").drop("adv", "baseline")
    breaks = P.session_high_break(tier, s)
    news = T.recent_bullish(breaks, bullish, cfg.scan.bullish_lookback_days).filter(F.col("bullish_ts").isNotNull())
    news = materialise(news, "breaks")  # new highs are rare, and read twice below
    won = _confirmed(news, quotes, adv, poll_id, cfg, s.order[1:])
    return breakout(won, cfg.sizing, cfg.confirm).withColumn("reason", F.lit(REASON_BREAKOUT))


def halt_reopen(quotes: DataFrame, adv: DataFrame, s: Series, cfg: Engine = Engine(), *,
                poll_id: str = "event_id") -> DataFrame:
    """Reopened tickers with confirmed volume; no news needed, a missing gap counts as 0."""
    opened = materialise(P.halt_reopen(quotes, s).filter(F.col("last") != 0), "reopened")
    won = _confirmed(opened, quotes, adv, poll_id, cfg, s.order[1:]).join(adv, "ticker", "left")
    base = Q.session_baseline(F.col("ts"), F.col("adv"), cfg.scan)
    won = won.withColumns({
        "gap_pct": F.coalesce(Q.gap_pct(F.col("last"), F.col("previous_close")), F.lit(0.0)), "_base": base})
    won = won.withColumn("scan_rvol", Q.rvol(F.coalesce("total_volume", F.lit(0.0)), F.col("_base"))).drop("_base", "adv")
    return breakout(won, cfg.sizing, cfg.confirm).withColumn("reason", F.lit(REASON_HALT))


def news_signals(news: DataFrame, watchlist: DataFrame, verdicts: DataFrame, lexicon: DataFrame, quotes: DataFrame,
                 adv: DataFrame, bars: DataFrame, fundamentals: DataFrame, cfg: Engine = Engine(), *,
                 tie: Sequence[str] = (), check_recycled: bool = True) -> DataFrame:
    """Articles to signals: first copy, watched and relevant tickers, decision gates, volume confirmation,
    magnitude. Confirmed approvals skip confirmation and sizing and ask for the whole pool.
    """
    # without an id there is no verdict, so no signal, only a place in the history of headlines
    first = feed.first_of_each(news, unnamed=check_recycled)
    tagged = N.relevant(N.tag_watchlist(first, watchlist), cfg.news)
    # the tone decides only what the verdict leaves open; no other text is read word by word
    v = F.col("verdict")
    open_ids = verdicts.filter(v.isNotNull() & (v["catalyst"] == "positive") & ~v["is_secondhand"] & (v["confidence"] != "high")).select("id")
    tone = N.sentiment_gate(first.join(open_ids, "id", "left_semi"), lexicon, cfg.sentiment)
    decided = N.decide(tagged, verdicts, tone, cfg=cfg.news, check_recycled=check_recycled)
    decided = decided.withColumn("signal_id", F.concat_ws("|", "id", "ticker")).withColumn("ts", F.col("created_at"))
    # few articles survive the gates and are read several times below: store them once
    decided = materialise(decided.filter((F.col("decision") == REASON_FDA) | F.col("decision").startswith("PASS"))
                          .select("signal_id", "id", "ticker", "ts", "headline", "summary", "verdict", "decision"), "decided")
    fda = decided.filter(F.col("decision") == REASON_FDA).select(
        "signal_id", "id", "ticker", "ts", F.lit(REASON_FDA).alias("reason"), F.lit(None).cast("double").alias("composite"),
        F.lit(cfg.entry.pool).alias("slots"), F.lit(None).cast("string").alias("category"))
    passed = decided.filter(F.col("decision").startswith("PASS")).select(
        "signal_id", "id", "ticker", "ts", "headline", "summary", F.col("verdict.confidence").alias("confidence"),
        F.col("verdict.reasoning").alias("reasoning"))
    won = _confirmed(passed, quotes, adv, "signal_id", cfg, tie)
    won = T.fresh_fundamentals(won, fundamentals, ["float_shares"])
    won = T.prenews_move(won, bars, Series(), cfg.sizing, news_ts="ts")
    sized = magnitude(won, cfg.sizing).select(
        "signal_id", "id", "ticker", "ts", F.lit(REASON_NEWS).alias("reason"), "composite", "slots", "category")
    return sized.unionByName(fda)
