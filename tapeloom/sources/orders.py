"""Orders, fills and the trade log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import (
    EVENT_ENTRY, EVENT_ENTRY_UNFILLED, EVENT_EXIT, EVENT_EXIT_UNFILLED, TRADE_LOG_COLUMNS,
)
from ..functions.rounding import round_exact, truthy


def order_legs(orders: DataFrame) -> DataFrame:
    """One row per execution leg; orders without legs keep one row of nulls."""
    acts = orders.select("order_id", "status", F.explode_outer("orderActivityCollection").alias("_a"))
    legs = acts.select("order_id", "status", F.explode_outer("_a.executionLegs").alias("_l"))
    return legs.select("order_id", "status", F.col("_l.quantity").alias("leg_qty"), F.col("_l.price").alias("leg_px"))


def order_fills(orders: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Status, filled quantity and average fill price, computed inside each order row (no shuffle); ``keep`` names
    columns to carry along."""
    legs = F.flatten(F.transform(F.coalesce("orderActivityCollection", F.array().cast(
        "array<struct<executionLegs: array<struct<quantity: double, price: double>>>>")),
        lambda a: F.coalesce(a["executionLegs"], F.array().cast("array<struct<quantity: double, price: double>>"))))
    usable = F.filter(legs, lambda l: truthy(l["quantity"]).isNotNull() & truthy(l["price"]).isNotNull())
    zero = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("n"))
    total = F.aggregate(usable, zero, lambda a, l: F.struct(
        (a["q"] + l["quantity"]).alias("q"), (a["n"] + l["quantity"] * l["price"]).alias("n")))
    rows = orders.withColumn("_t", total)
    price = (F.when(F.col("_t.q") > 0, F.col("_t.n") / F.col("_t.q"))
             .when((F.col("status") == "FILLED") & truthy(F.col("price")).isNotNull(), F.col("price")))
    return rows.select(*keep, "order_id", "status", F.coalesce("filledQuantity", F.lit(0.0)).alias("filled_quantity"),
                       price.alias("avg_fill_price"))


def order_outcome(attempts: DataFrame, side: str = "ENTRY", tie: tuple[str, ...] = ()) -> DataFrame:
    """First filled attempt per signal, else the unfilled label. ``attempts``: signal_id, attempt,
    status, price. Partial aggregates, so a signal with many attempts is reduced before the shuffle."""
    at = F.when(F.col("status") == "FILLED", F.struct("attempt", *tie))
    fill = F.min_by(F.struct("attempt", "price"), at)
    done = attempts.groupBy("signal_id").agg(fill.alias("_f"), F.max("attempt").alias("attempts"))
    done_event, open_event = ((EVENT_ENTRY, EVENT_ENTRY_UNFILLED) if side == "ENTRY"
                              else (EVENT_EXIT, EVENT_EXIT_UNFILLED))
    return done.select("signal_id", F.col("_f.attempt").alias("fill_attempt"), F.col("_f.price").alias("fill_price"),
                       "attempts", F.when(F.col("_f").isNull(), open_event).otherwise(done_event).alias("outcome"))


def _text(x: Column, digits: int, signed: bool = False) -> Column:
    return F.format_string(f"%{'+' if signed else ''}.{digits}f", round_exact(x, digits))


def trade_log_rows(trades: DataFrame) -> DataFrame:
    """The seven text columns of the log from ``event, ticker, time, price, quantity, pnl_pct, reason, headline``."""
    value = (F.when(F.col("event") == EVENT_ENTRY, F.format_string("qty=%d", F.col("quantity").cast("bigint")))
             .when(F.col("event") == EVENT_EXIT, _text(F.col("pnl_pct"), 2, signed=True)).otherwise("unfilled"))
    stamp = F.date_format(F.col("time").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return trades.select("event", F.col("ticker").cast("string").alias("ticker"), stamp.alias("time"),
                         _text(F.col("price"), 4).alias("price"), value.alias("value"), "reason",
                         F.coalesce("headline", F.lit("")).alias("headline")).select(*TRADE_LOG_COLUMNS)


#: Beside the batches of a log: its header, and which batches are whole.
HEADER, MANIFEST = "_header", "_manifest"


def append_trade_log(trades: DataFrame, path: str, batch: int = 0) -> None:
    """Write one batch of a CSV log; for ``foreachBatch``.

    A batch has a folder of its own and is listed in the manifest once it is whole, so a replayed batch adds nothing and
    a broken one is not read. The log has one header, beside the batches.
    """
    spark = trades.sparkSession
    rows = trade_log_rows(trades)
    rows.write.mode("overwrite").csv(f"{path}/batch={batch}")
    names = spark.createDataFrame([(",".join(rows.columns),)], "value string").coalesce(1)
    names.write.mode("ignore").text(f"{path}/{HEADER}")
    spark.range(1).select(F.lit(batch).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}/batch={batch}")


def read_trade_log(spark: SparkSession, path: str) -> DataFrame:
    """The whole batches of a log, columns named by its header."""
    names = spark.read.text(f"{path}/{HEADER}").first()[0].split(",")
    whole = spark.read.option("basePath", f"{path}/{MANIFEST}").parquet(f"{path}/{MANIFEST}").select("batch").distinct()
    rows = spark.read.schema(", ".join([*(f"`{n}` string" for n in names), "batch int"])).csv(path, emptyValue="", nullValue="\u0000")
    return rows.join(whole, "batch", "left_semi").select(*names)
