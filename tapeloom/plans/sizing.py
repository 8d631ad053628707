"""Composite scores and capital slots per signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Confirm, Sizing
from ..functions import scores as C


def magnitude(rows: DataFrame, cfg: Sizing = Sizing()) -> DataFrame:
    """News signals: needs float_shares, start_close, end_close, bar_rows, confidence, reasoning, headline, summary."""
    pct = C.move_pct(F.col("start_close"), F.col("end_close"), F.coalesce("bar_rows", F.lit(0)))
    rows = rows.withColumns({
        "float_score": C.float_score(F.col("float_shares"), cfg), "price_action_pct": pct,
        "verdict_score": C.verdict_score(F.col("confidence"), F.col("reasoning"), cfg),
        "_cat": C.news_category(F.col("headline"), F.col("summary"))})
    rows = rows.withColumns({"price_action_score": C.price_action_score(F.col("price_action_pct"), cfg),
                             "category": F.col("_cat.category"), "category_score": F.col("_cat.score")}).drop("_cat")
    composite = C.magnitude(F.col("float_score"), F.col("price_action_score"), F.col("verdict_score"),
                            F.col("category_score"), cfg)
    return rows.withColumn("composite", composite).withColumn("slots", C.slots(F.col("composite"), cfg))


def breakout(rows: DataFrame, cfg: Sizing = Sizing(), confirm: Confirm = Confirm(), *, gap: str = "gap_pct",
             rvol: str = "scan_rvol") -> DataFrame:
    """Breakout and reopen signals: needs volume_since, baseline, up_ratio, gap and relative volume."""
    rows = rows.withColumns({
        "confirmation_score": C.confirmation_score(F.col("volume_since"), F.col("baseline"), F.col("up_ratio"), confirm),
        "gap_scanner_score": C.gap_scanner_score(F.col(gap), F.col(rvol), cfg)})
    rows = rows.withColumn("composite", C.breakout_score(F.col("confirmation_score"), F.col("gap_scanner_score"), cfg))
    return rows.withColumn("slots", C.slots(F.col("composite"), cfg))
