"""News feeds: live, backfill, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

NEWS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("symbols", T.ArrayType(T.StringType())),
    T.StructField("headline", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("created_at", T.TimestampType())])


def read_news_stream(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """Unbounded feed with a fixed schema; restart and replay come from the query's checkpoint."""
    return spark.readStream.schema(NEWS_SCHEMA).options(**options).format(fmt).load(path)


def for_symbols(news: DataFrame, symbols: DataFrame) -> DataFrame:
    """Articles that tag a subscribed symbol, each once: a semi join on (id, time) of its tags."""
    tags = news.select("id", "created_at", F.explode("symbols").alias("ticker"))
    hits = tags.join(symbols, "ticker", "left_semi").select("id", "created_at").distinct()
    return news.join(hits, ["id", "created_at"], "left_semi")


def first_of_each(news: DataFrame, unnamed: bool = True) -> DataFrame:
    """Earliest arrival per article id; articles without an id are all kept, or none of them, and the rows then stay dealt out by id.

    Copies of an article are reduced inside each task first, so one id with many copies stays cheap.
    """
    rest = [c for c in news.columns if c != "id"]
    order = F.struct("created_at", F.xxhash64(*rest))
    kept = (news.filter(F.col("id").isNotNull()).groupBy("id")
            .agg(F.min_by(F.struct(*rest), order).alias("_n")).select("id", "_n.*"))
    return kept.unionByName(news.filter(F.col("id").isNull())) if unnamed else kept


def reconcile(live: DataFrame, backfill: DataFrame) -> DataFrame:
    """Live feed and backfill through one path, deduplicated by id."""
    return first_of_each(live.unionByName(backfill))


def recent(news: DataFrame, as_of: str, minutes: int = 10) -> DataFrame:
    """The backfill request: articles of the last minutes before ``as_of``."""
    end = F.lit(as_of).cast("timestamp")
    return news.filter((F.col("created_at") >= end - F.expr(f"INTERVAL {minutes} MINUTES"))
                       & (F.col("created_at") <= end))


def history(news: DataFrame, candidates: DataFrame, as_of: str, days: int = 18) -> DataFrame:
    """Articles of candidate tickers in the lookback, one row per (article, ticker)."""
    end = F.lit(as_of).cast("timestamp")
    inside = news.filter((F.col("created_at") >= end - F.expr(f"INTERVAL {days} DAYS")) & (F.col("created_at") <= end))
    tagged = inside.withColumn("ticker", F.explode("symbols"))
    return tagged.join(candidates.select("ticker").distinct(), "ticker", "left_semi")
