"""Streaming news: dedup across live and backfill, headline history, bullish tier."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import News
from ..functions import text as X
from ..session import fresh_folder
from ..sources.news import first_of_each
from .run import for_each_batch


def dedup(news: DataFrame, label: str = "news-once", horizon_days: int | None = None) -> DataFrame:
    """Drain a stream of articles and return the first arrival of each id, however late any copy comes.

    Every micro-batch is reduced to one row per id and anti-joined with the ids that earlier batches stored, by day. A batch
    overwrites its own folder only, so a replayed one adds nothing. ``horizon_days`` bounds the days looked up before the oldest
    article of the batch; without it all are. Articles without an id are all kept.
    """
    spark = news.sparkSession
    path = fresh_folder(spark, label)
    schema = T.StructType([*news.schema.fields, T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())])

    def keep(batch: DataFrame, number: int) -> None:
        rows = first_of_each(batch)
        if number:
            stored = spark.read.schema(schema).option("basePath", path).parquet(path).filter(F.col("batch") < number)
            if horizon_days is not None:
                oldest = batch.agg(F.date_sub(F.to_date(F.min("created_at")), horizon_days)).first()[0]
                stored = stored.filter(F.col("day") >= F.lit(oldest)) if oldest else stored
            rows = rows.join(stored.select("id"), "id", "left_anti")
        rows.withColumn("day", F.to_date("created_at")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")

    for_each_batch(news, keep, path)
    return spark.read.schema(schema).option("basePath", path).parquet(path).drop("batch", "day")


def counts(news: DataFrame, window: str = "1 day", label: str = "news-counts") -> DataFrame:
    """Drain a stream of articles and count them per time window, late ones too.

    Counts add up, so every micro-batch writes its own and none waits for a watermark; a replayed batch overwrites
    its own. Articles without a time are in no window.
    """
    spark = news.sparkSession
    path = fresh_folder(spark, label)

    def count(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy(F.window("created_at", window).alias("_w")).agg(F.count(F.lit(1)).alias("articles"))
        rows.select(F.col("_w.start").alias("window_start"), "articles").write.mode("overwrite").parquet(f"{path}/batch={number}")

    for_each_batch(news, count, path)
    rows = spark.read.schema("window_start timestamp, articles bigint, batch bigint").parquet(path)
    return rows.groupBy("window_start").agg(F.sum("articles").alias("articles"))


def bullish(news: DataFrame, candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``ticker, ts, id`` as articles arrive: stream-static joins, re-read at every trigger."""
    rows = news.filter(~X.is_stale_recap(F.col("headline"))).withColumn("ticker", F.explode("symbols"))
    rows = rows.join(candidates.select("ticker").distinct(), "ticker", "left_semi").join(verdicts, "id")
    good = (F.col("verdict.catalyst") == "positive") & ~F.col("verdict.is_secondhand")
    return rows.filter(good).select("ticker", F.col("created_at").alias("ts"), "id")


def recycled(tagged: DataFrame, cfg: News = News()) -> DataFrame:
    """Keyed state: the last headlines of each ticker. Emits ``ticker, created_at, id, is_recycled``."""
    size, threshold = cfg.history, cfg.similarity

    def similar(text: str, history: list[str]) -> bool:
        matcher = difflib.SequenceMatcher()
        for prior in history:
            if 2.0 * min(len(text), len(prior)) / (len(text) + len(prior)) < threshold:
                continue  # a bound of the ratio, before the texts are indexed
            matcher.set_seqs(text, prior)
            if matcher.quick_ratio() >= threshold and matcher.ratio() >= threshold:
                return True
        return False

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["created_at", "id"])
        history = list(state.get[0]) if state.exists else []
        flags = []
        for headline in rows["headline"]:
            norm = re.sub(r"\s+", " ", headline or "").strip().lower()
            flags.append(bool(norm) and similar(norm, history))
            if norm:
                history = [*history, norm][-size:]
        state.update((history,))
        yield pd.DataFrame({"ticker": key[0], "created_at": rows["created_at"], "id": rows["id"], "is_recycled": flags})

    return tagged.select("ticker", "created_at", "id", "headline").groupBy("ticker").applyInPandasWithState(
        step, "ticker string, created_at timestamp, id long, is_recycled boolean", "headlines array<string>",
        "append", GroupStateTimeout.NoTimeout)
