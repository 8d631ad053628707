"""Bars, quotes and volume averages from raw feed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rounding import truthy

CANDLE = ("open", "high", "low", "close", "volume")
PAYLOAD = "map<string, struct<quote: map<string, string>, fundamental: map<string, string>>>"


def bars_from_candles(raw: DataFrame, as_of: str | None = None, lookback_sec: int = 86_400) -> DataFrame:
    """``ticker, datetime`` (epoch milliseconds) and prices to bars; rows with any null are dropped.

    The window is a plain comparison on the raw column, so it reaches the file scan.
    """
    if as_of is not None:
        end = F.unix_millis(F.lit(as_of).cast("timestamp"))
        raw = raw.filter((F.col("datetime") >= end - F.lit(lookback_sec * 1000)) & (F.col("datetime") <= end))
    bars = raw.select("ticker", F.timestamp_millis("datetime").alias("ts"),
                      *[F.col(c).cast("double").alias(c) for c in CANDLE])
    return bars.na.drop("any")


def _number(quote: Column, name: str) -> Column:
    return F.element_at(quote, F.lit(name)).try_cast("double")


def _quote_columns(quote: Column) -> list[Column]:
    first = F.coalesce(truthy(_number(quote, "lastPrice")), truthy(_number(quote, "mark")),
                       _number(quote, "closePrice"))
    return [first.alias("last"), _number(quote, "bidPrice").alias("bid"), _number(quote, "askPrice").alias("ask"),
            _number(quote, "totalVolume").alias("total_volume"), _number(quote, "closePrice").alias("previous_close"),
            F.element_at(quote, F.lit("securityStatus")).alias("security_status")]


def quote_of(raw: DataFrame, symbol: Column, payload: str = "payload") -> DataFrame:
    """Flatten the quote of one requested symbol per payload; an absent symbol gives nulls."""
    node = F.try_element_at(F.from_json(payload, PAYLOAD), symbol)
    kept = [c for c in raw.columns if c != payload]
    return raw.withColumn("_q", node["quote"]).select(*kept, *_quote_columns(F.col("_q")))


def quotes_of(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Flatten every symbol of each payload; symbols without a quote are dropped."""
    kept = [c for c in raw.columns if c != payload]
    nodes = raw.select(*kept, F.explode(F.from_json(payload, PAYLOAD)).alias("ticker", "_node"))
    quoted = nodes.filter(F.size("_node.quote") > 0)
    return quoted.select(*kept, "ticker", *_quote_columns(F.col("_node.quote")))


def volume_averages(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Average daily volume per payload and symbol: ten days, else one year, else dropped."""
    kept = [c for c in raw.columns if c != payload]
    nodes = raw.select(*kept, F.explode(F.from_json(payload, PAYLOAD)).alias("ticker", "_node"))
    f = F.col("_node.fundamental")
    adv = F.coalesce(truthy(_number(f, "avg10DaysVolume")), truthy(_number(f, "avg1YearVolume")))
    return nodes.select(*kept, "ticker", adv.alias("adv")).filter(F.col("adv").isNotNull())


def read_bars(spark, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars stored by session date; the time bounds prune partitions and reach the scan."""
    bars = spark.read.parquet(path)
    for bound, keep in ((start, F.col("ts") >= F.lit(start)), (end, F.col("ts") < F.lit(end))):
        if bound is not None:
            bars = bars.filter(keep)
            if "session" in bars.columns:
                day = F.lit(bound).cast("date")
                bars = bars.filter(F.col("session") >= day if bound is start else F.col("session") <= day)
    return bars


def write_bars(bars: DataFrame, path: str) -> None:
    """Store bars by session date, each day spread by ticker and hour so a hot ticker makes many files."""
    by_day = bars.withColumn("session", F.to_date("ts"))
    (by_day.repartition("session", "ticker", F.hour("ts")).sortWithinPartitions("ticker", "ts")
     .write.mode("append").partitionBy("session").parquet(path))
