"""Subscription sets and the heartbeat numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def unconfirmed(watchlist: DataFrame, acked: DataFrame) -> DataFrame:
    return watchlist.select("ticker").join(acked.select("ticker"), "ticker", "left_anti")


def acknowledged(acks: Sequence[DataFrame]) -> DataFrame:
    """Every symbol any acknowledgement has named so far."""
    return reduce(DataFrame.unionByName, [a.select("ticker") for a in acks]).distinct()


def seed_batch(candidates: DataFrame, size: int = 100) -> DataFrame:
    """First subscription batch: distinct tickers in text order."""
    return candidates.select("ticker").distinct().orderBy("ticker").limit(size)


def snapshot(watchlist: DataFrame, acked: DataFrame, positions: DataFrame, news: DataFrame, at: str,
             examples: int = 5) -> DataFrame:
    """One row of heartbeat numbers at a moment; every part is an aggregate or a top-k."""
    now = F.lit(at).cast("timestamp")
    missing = unconfirmed(watchlist, acked)
    first = (missing.select(F.col("ticker").cast("string").alias("ticker")).orderBy("ticker").limit(examples)
             .agg(F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("first_unconfirmed")))
    held = positions.filter((F.col("entry_time") <= now) & (F.coalesce(F.col("exit_time") > now, F.lit(True))))
    latest = news.filter(F.col("created_at") <= now).agg(F.max("created_at").alias("_news"))
    parts = [watchlist.agg(F.count(F.lit(1)).alias("watchlist")), acked.agg(F.count(F.lit(1)).alias("acked")),
             missing.agg(F.count(F.lit(1)).alias("unconfirmed")), first,
             held.agg(F.count(F.lit(1)).alias("open_positions")), latest]
    row = parts[0].withColumns({p.columns[0]: p.scalar() for p in parts[1:]})
    since = (F.unix_micros(now) - F.unix_micros("_news")) / F.lit(1e6)
    return (row.withColumn("seconds_since_news", since).drop("_news")
            .withColumn("is_paused", F.col("open_positions") > 0))
