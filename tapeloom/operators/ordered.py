"""Ordered series per key, cut into time pieces so that no key ever has to fit one task.

A plain ``Window.partitionBy("ticker")`` sends a whole ticker to one task. Here a series is cut into
(key, piece) groups, a piece being a fixed span of time, and each operator runs in two levels:

1. inside the pieces, in parallel, with ordinary windows;
2. over one summary row per piece, whose running result ("carry") is joined back on (key, piece).

The results equal those of the unbounded window. Summaries are one row per (key, piece), so the only
window keyed by the bare key sees as many rows as the series has pieces, whatever its row count.

Keys with few rows need no pieces: ``by_length`` counts the rows of each key and hands short keys on whole
(``Series.whole``), so that a chain of these operators shuffles them once, and only long ones in pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..session import materialise

PIECE = "_piece"
CORE = "_core"
MAX_LOG_DECAY = 300.0
SHORT = 100_000  # rows of a key that one group may hold


@dataclass(frozen=True)
class Running:
    """One running aggregate; ``kind`` is sum, count, max, min or last (last non-null value)."""

    out: str
    kind: str
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class Series:
    """How rows form series: key columns (non-null), total order (time first), span of a piece; ``whole``: one piece a key."""

    keys: tuple[str, ...] = ("ticker",)
    order: tuple[str, ...] = ("ts",)
    width_sec: int = 86_400
    reverse: bool = False
    whole: bool = False

    @property
    def group(self) -> list[str]:
        return [*self.keys, PIECE]

    def piece_of(self, ts: Column) -> Column:
        return F.floor(F.unix_micros(ts) / F.lit(float(self.width_sec * 1_000_000)))

    def cut(self, df: DataFrame) -> DataFrame:
        """Lay rows out by (key, piece). The explicit repartition also keeps a layout that an earlier
        join left hashed on the bare key from being reused for the windows below."""
        if PIECE in df.columns:
            return df
        if self.whole:  # the windows below lay rows out by the key, once for all of them
            return df.withColumn(PIECE, F.lit(0).cast("bigint"))
        return df.withColumn(PIECE, self.piece_of(F.col(self.order[0]))).repartition(*self.group)

    def _sorted(self, names: Sequence[str]) -> list[Column]:
        return [F.col(c).desc() if self.reverse else F.col(c).asc() for c in names]

    def within(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(*self._sorted(self.order))

    def across(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self._sorted([PIECE]))

    def place(self) -> Column:
        """The order key as one column; a single primitive one keeps aggregates hash-based."""
        return F.col(self.order[0]) if len(self.order) == 1 else F.struct(*self.order)

    def newest_first(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc() for c in self.order])


def _total(spec: Running, s: Series) -> Column:
    if spec.kind == "last":
        at = F.when(spec.value.isNotNull(), s.place())
        return F.min_by(spec.value, at) if s.reverse else F.max_by(spec.value, at)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[spec.kind](spec.value)


def _over(kind: str, value: Column, frame: WindowSpec) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(frame)
    if kind == "count":
        return F.count(value).over(frame)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(frame)


def _merge(kind: str, near: Column, carried: Column) -> Column:
    if kind == "last":
        return F.coalesce(near, carried)
    if kind in ("max", "min"):
        return F.greatest(near, carried) if kind == "max" else F.least(near, carried)
    return F.coalesce(near + carried, near, carried)


def running(df: DataFrame, s: Series, specs: Sequence[Running], keep: Column | None = None) -> DataFrame:
    """Add running aggregates over all earlier rows of the key (and the row itself if inclusive).

    ``keep`` drops rows once the aggregates have seen them. The piece column stays for further steps.
    """
    cut = rows = s.cut(df)
    for p in specs:
        frame = s.within().rowsBetween(Window.unboundedPreceding, 0 if p.inclusive else -1)
        rows = rows.withColumn(p.out, _over(p.kind, p.value, frame))
    if keep is not None:
        rows = rows.filter(keep)
    if s.whole:
        return rows
    totals = cut.groupBy(*s.group).agg(*[_total(p, s).alias(p.out) for p in specs])
    earlier = s.across().rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*s.group, *[
        _over("sum" if p.kind == "count" else p.kind, F.col(p.out), earlier).alias(f"_c_{p.out}")
        for p in specs])
    rows = rows.join(carry, s.group, "left")
    for p in specs:
        rows = rows.withColumn(p.out, _merge(p.kind, F.col(p.out), F.col(f"_c_{p.out}")))
    return rows.drop(*[f"_c_{p.out}" for p in specs])


def with_halo(df: DataFrame, s: Series, before: int = 0, after: int = 0) -> DataFrame:
    """Copy into each piece the ``before`` rows preceding and ``after`` rows following it.

    Frames of at most that many rows can then be evaluated inside the pieces; filter on the core flag
    afterwards. A neighbour may lie several sparse pieces away, so the edge rows travel through the
    piece summaries, at most before+after of them per piece.
    """
    rows = s.cut(df)
    columns = [c for c in rows.columns if c != PIECE]
    row = F.struct(*s.order, F.struct(*columns).alias("_row"))
    out = rows.withColumn(CORE, F.lit(True))
    if s.whole:
        return out

    def edge(count: int, newest: bool) -> DataFrame:
        order = [F.col(c).desc() if newest else F.col(c).asc() for c in s.order]
        top = Window.partitionBy(*s.group).orderBy(*order)
        return (rows.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= count)
                .groupBy(*s.group).agg(F.array_sort(F.collect_list(row)).alias("_edge")))

    def place(edges: DataFrame, count: int, frame: WindowSpec, newest: bool) -> DataFrame:
        near = F.flatten(F.collect_list("_edge").over(frame))
        start = F.greatest(F.size("_all") - count + 1, F.lit(1)) if newest else F.lit(1)
        picked = (edges.withColumn("_all", near).filter(F.size("_all") > 0)
                  .select(*s.group, F.explode(F.slice("_all", start, F.lit(count))).alias("_e")))
        return picked.select(F.col("_e._row.*"), PIECE, F.lit(False).alias(CORE))

    forward = Window.partitionBy(*s.keys).orderBy(PIECE)
    if before:
        out = out.unionByName(place(edge(before, True), before, forward.rowsBetween(-before, -1), True))
    if after:
        out = out.unionByName(place(edge(after, False), after, forward.rowsBetween(1, after), False))
    return out


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter(CORE).drop(CORE)


def uncut(df: DataFrame) -> DataFrame:
    return df.drop(PIECE)


def by_length(df: DataFrame, s: Series, step: Callable[[DataFrame, Series], DataFrame], rows: int | None = None) -> DataFrame:
    """``step`` over the keys of at most ``rows`` rows (``SHORT``), each whole, and over longer ones in pieces; both parts together.

    ``step`` must keep the rows of different keys apart. ``df`` is read twice, so it should be stored. A key with a row
    without a time goes in pieces too, as that row carries only counts and sums over to the others there.
    """
    rows, names = rows or SHORT, [f"_long{i}" for i in range(len(s.keys))]
    counts = df.groupBy(*[F.col(k).alias(n) for k, n in zip(s.keys, names)]).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(F.when(F.col(s.order[0]).isNull(), 1)).alias("_timeless"))
    long = materialise(counts.filter((F.col("_rows") > rows) | (F.col("_timeless") > 0)).select(*names), "long-keys")
    if long.isEmpty():
        return step(df, replace(s, whole=True))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(s.keys, names)])
    part = lambda kind: df.join(long, same, kind)
    return step(part("left_anti"), replace(s, whole=True)).unionByName(step(part("left_semi"), s))


def decayed(df: DataFrame, s: Series, log_decay: Column, addends: dict[str, Column]) -> DataFrame:
    """Linear recurrences ``x[i] = exp(log_decay[i]) * x[i-1] + addend[i]``, x before the first row 0.

    Such a recurrence composes, so pieces are solved from a zero start by window sums and the start
    value is carried over the piece summaries. Inside a piece the sums are taken in blocks that decay
    by at most e**-300, which keeps the weights inside the range of a double. Addends must be >= 0 for
    the block sums to be free of cancellation.
    """
    outs = list(addends)
    rows = s.cut(df).withColumn("_ld", log_decay)
    for name in outs:
        rows = rows.withColumn(f"_b_{name}", addends[name])
    to_here = s.within().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cum", F.sum("_ld").over(to_here))
    rows = rows.withColumn("_block", F.floor(-F.col("_cum") / F.lit(MAX_LOG_DECAY)))
    unit = Window.partitionBy(*s.group, "_block").orderBy(*s._sorted(s.order)) \
        .rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_rel", F.col("_cum") - F.first("_cum").over(unit))
    for name in outs:
        weighted = F.sum(F.col(f"_b_{name}") * F.exp(-F.col("_rel"))).over(unit)
        rows = rows.withColumn(name, F.exp(F.col("_rel")) * weighted)

    if s.whole:  # the blocks of the key that ended before a row, oldest first: mostly none
        along = Window.partitionBy(*s.group).orderBy("_block", *s._sorted(s.order))
        last = F.coalesce(F.lead("_block").over(along) != F.col("_block"), F.lit(True))
        rows = rows.withColumn("_ends", F.when(last, F.struct("_cum", *outs)))
        ended = F.collect_list("_ends").over(along.rowsBetween(Window.unboundedPreceding, -1))
        start = F.aggregate(ended, F.struct(F.lit(0.0).alias("base"), *[F.lit(0.0).alias(n) for n in outs]), lambda a, u: F.struct(
            u["_cum"].alias("base"), *[(u[n] + F.exp(u["_cum"] - a["base"]) * a[n]).alias(n) for n in outs]))
        rows = rows.withColumn("_start", start)
        for name in outs:
            rows = rows.withColumn(name, F.col(name) + F.exp(F.col("_cum") - F.col("_start.base")) * F.col(f"_start.{name}"))
        return rows.drop("_ld", "_cum", "_block", "_rel", "_ends", "_start", *[f"_b_{n}" for n in outs])

    at = s.place()
    units = rows.groupBy(*s.group, "_block").agg(
        F.max_by("_cum", at).alias("_end"), *[F.max_by(n, at).alias(n) for n in outs])
    per_key = units.groupBy(*s.keys).agg(
        F.array_sort(F.collect_list(F.struct(PIECE, "_block", "_end", *outs))).alias("_units"))

    entry = ", ".join([f"{PIECE}: bigint", "_block: bigint", "_base: double", "_end: double"]
                      + [f"_in_{n}: double, _out_{n}: double" for n in outs])
    base = f"CASE WHEN a._last.{PIECE} = u.{PIECE} THEN a._last._end ELSE 0D END"
    fields = [f"u.{PIECE}, u._block, {base}, u._end"] + [
        f"coalesce(a._last._out_{n}, 0D), u.{n} + exp(u._end - ({base})) * coalesce(a._last._out_{n}, 0D)"
        for n in outs]
    step = f"CAST(struct({', '.join(fields)}) AS struct<{entry}>)"
    folded = F.expr(
        f"aggregate(_units, CAST(struct(array(), null) AS struct<_all: array<struct<{entry}>>, "
        f"_last: struct<{entry}>>), (a, u) -> struct(array_append(a._all, {step}) AS _all, {step} AS _last), "
        "a -> a._all)")
    starts = (per_key.select(*s.keys, F.explode(folded).alias("_u")).select(*s.keys, "_u.*")
              .groupBy(*s.group).agg(F.map_from_entries(F.collect_list(F.struct(
                  "_block", F.struct("_base", *[f"_in_{n}" for n in outs])))).alias("_start")))
    rows = rows.join(starts, s.group, "left")
    start = F.element_at("_start", F.col("_block"))
    for name in outs:
        rows = rows.withColumn(
            name, F.col(name) + F.exp(F.col("_cum") - start["_base"]) * start[f"_in_{name}"])
    return rows.drop("_ld", "_cum", "_block", "_rel", "_start", *[f"_b_{n}" for n in outs])


def tail_rows(df: DataFrame, s: Series, n: int) -> DataFrame:
    """Newest n rows per key. Spark keeps n rows per key and task before its shuffle, so a hot key
    brings n rows per task to the final ranking."""
    return (df.withColumn("_n", F.row_number().over(s.newest_first()))
            .filter(F.col("_n") <= n).drop("_n"))
