"""As-of, interval and range joins on (key, time) that never pair whole groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import Running, Series, by_length, running


def asof_join(left: DataFrame, right: DataFrame, values: Sequence[str], *,
              keys: tuple[str, ...] = ("ticker",), left_ts: str = "ts", right_ts: str = "ts",
              tie: Sequence[str] = (), width_sec: int = 86_400, strict: bool = False,
              forward: bool = False, kind: str = "last", stored: bool = False) -> DataFrame:
    """Attach to each left row the right row nearest in time: at or before it (``forward``: at or
    after), strictly so with ``strict``. ``tie`` orders right rows with equal time.

    With ``kind`` max/min/sum/count the single column in ``values`` is aggregated over all right rows
    on that side of the left row instead. One union, one ordered pass; no pair of rows is formed.
    With ``stored`` tables the rows of a key are counted first, and short keys pass whole.
    """
    taken = [f"_r{i}" for i in range(len(values))]
    carried = F.struct(*[F.col(v).alias(n) for v, n in zip(values, taken)]) if kind == "last" \
        else F.col(values[0])
    # the side that must be seen first at equal times sorts first in the direction of travel
    right_first = not strict
    right_side, left_side = (0, 1) if right_first != forward else (1, 0)
    ties = [f"_tie{i}" for i in range(len(tie))]
    r = right.filter(F.col(right_ts).isNotNull()).select(
        *keys, F.col(right_ts).alias("_t"), F.lit(right_side).alias("_side"),
        *[F.col(c).alias(n) for c, n in zip(tie, ties)], carried.alias("_v"))
    l = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(left_side).alias("_side"),
                    F.struct(*left.columns).alias("_l"))
    s = Series(keys=keys, order=("_t", "_side", *ties), width_sec=width_sec, reverse=forward)
    step = lambda rows, s: running(rows, s, [Running("_hit", kind, F.col("_v"))], keep=F.col("_side") == left_side)
    both = l.unionByName(r, allowMissingColumns=True)
    seen = by_length(both, s, step) if stored else step(both, s)
    if kind != "last":
        return seen.select("_l.*", F.col("_hit").alias(values[0]))
    return seen.select("_l.*", *[F.col(f"_hit.{n}").alias(v) for v, n in zip(values, taken)])


def range_join(points: DataFrame, spans: DataFrame, low: Column, high: Column, *,
               point_ts: str = "ts", keys: tuple[str, ...] = ("ticker",), width_sec: int) -> DataFrame:
    """Points with ``low <= ts <= high``, matched on (key, time bucket) so that a pair is only tried
    where the point's bucket meets the span. Point columns must not clash with span columns."""
    scale = F.lit(float(width_sec * 1_000_000))
    p = points.withColumn("_bucket", F.floor(F.unix_micros(F.col(point_ts)) / scale))
    first, last = F.floor(F.unix_micros(low) / scale), F.floor(F.unix_micros(high) / scale)
    q = spans.withColumn("_low", low).withColumn("_high", high).withColumn(
        "_bucket", F.explode(F.sequence(first, last)))
    p = p.withColumnRenamed(point_ts, "_pt")
    joined = q.join(p, [*keys, "_bucket"]).filter(
        (F.col("_pt") >= F.col("_low")) & (F.col("_pt") <= F.col("_high")))
    return joined.drop("_bucket", "_low", "_high").withColumnRenamed("_pt", f"point_{point_ts}")


def open_at(events: DataFrame, intervals: DataFrame, *, ts: str = "ts", start: str = "entry_time",
            end: str = "exit_time", keys: tuple[str, ...] = ("ticker",),
            width_sec: int = 86_400) -> DataFrame:
    """Flag events that fall inside any interval [start, end) of their key; a null end never closes.

    An event is inside some interval exactly if the latest end among the intervals started by then
    lies after it, so one running maximum replaces the interval join.
    """
    forever = F.lit("9999-12-31").cast("timestamp")
    ends = intervals.select(*keys, F.col(start).alias("_from"),
                            F.coalesce(F.col(end), forever).alias("_until"))
    hit = asof_join(events, ends, ["_until"], keys=keys, left_ts=ts, right_ts="_from",
                    width_sec=width_sec, kind="max")
    return hit.withColumn("is_open", F.coalesce(F.col("_until") > F.col(ts), F.lit(False))).drop("_until")


