"""Registration of queries with their DuckDB twins, in one comparable output form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tapeloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Timestamps as epoch microseconds, dates as text, doubles to six decimals without signed zero."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def micros(name: str):
    """A time stamp that may be missing, as a double (exact up to 2**53)."""
    return F.unix_micros(name).cast("double").alias(name)


def query(key: str, sql: str | None = None, *, stamps: str = "", dates: str = "", doubles: str = ""):
    """Register ``fn(spark, sf_dir)``; the SQL twin is put into the same output form by column name."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(configure(spark), sf_dir))

        QUERIES[key] = run
        if sql is not None:
            swaps = ([f"epoch_us({c}) AS {c}" for c in stamps.split()]
                     + [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
                     + [f"round({c}, 6) + 0e0 AS {c}" for c in doubles.split()])
            ORACLES[key] = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({sql})" if swaps else sql
        return fn

    return add
