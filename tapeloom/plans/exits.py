"""Exits: stop first, then the armed secondary exit, per open position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Exit
from ..functions.clock import PACIFIC, hour_of_day
from ..operators.matching import asof_join, range_join
from ..operators.ordered import PIECE, Running, Series, by_length, core_rows, running, uncut, with_halo
from ..session import materialise


def peak_pnl(bars: DataFrame, positions: DataFrame, s: Series = Series()) -> DataFrame:
    """Bars of every position's life with its running peak close (never under the entry price) and percent P&L.

    A key holds one position at a time: a position lives until its ``exit_time``, where ``positions`` has
    that column, and no longer than to the next entry of its key. So every bar belongs to one position.
    """
    at, lives = s.order[0], ["entry_time", "entry_price", *[c for c in positions.columns if c == "exit_time"]]
    held = asof_join(bars, positions.select(*s.keys, *lives), lives, keys=s.keys, left_ts=at, right_ts="entry_time", width_sec=s.width_sec)
    held = held.filter(F.col("entry_time").isNotNull())
    if "exit_time" in lives:
        held = held.filter(F.col("exit_time").isNull() | (F.col(at) <= F.col("exit_time"))).drop("exit_time")
    each = Series(keys=(*s.keys, "entry_time"), order=s.order, width_sec=s.width_sec)
    rows = uncut(running(held, each, [Running("_peak", "max", F.col("close"))]))
    return (rows.withColumn("peak_price", F.greatest("entry_price", "_peak")).drop("_peak")
            .withColumn("pnl_pct", pnl_pct(F.col("close"), F.col("entry_price"))))


def pnl_pct(price: Column, entry: Column) -> Column:
    return F.when(entry != 0, (price - entry) / entry * 100.0).otherwise(F.lit(0.0))


def secondary_armed(ts: Column, price: Column, entry: Column, cfg: Exit = Exit()) -> Column:
    """The secondary exit arms by Pacific hour, or once price has moved far enough either way."""
    moved = F.when(entry != 0, F.abs(price - entry) / entry * 100.0).otherwise(F.lit(0.0))
    return (hour_of_day(ts, PACIFIC) >= cfg.armed_hour_pt) | (moved >= cfg.armed_move_pct)


def _net_ratio(bars: str, n: int) -> str:
    """Net up-volume ratio of the last n changes of an array of {close, volume}; SQL text."""
    moves = (f"transform(sequence(greatest(1, size({bars}) - {n}), size({bars}) - 1), "
             f"i -> struct({bars}[i].close - {bars}[i - 1].close AS c, {bars}[i].volume AS v))")
    sums = (f"aggregate({moves}, struct(0D AS up, 0D AS down), (a, m) -> struct("
            "a.up + CASE WHEN m.c >= 0 THEN m.v ELSE 0D END AS up, a.down + CASE WHEN m.c < 0 THEN m.v ELSE 0D END AS down), "
            "a -> CASE WHEN a.up + a.down > 0 THEN (a.up - a.down) / (a.up + a.down) ELSE 0D END)")
    return f"CASE WHEN size({bars}) >= 2 THEN {sums} ELSE 0D END"


def _diverges(bars: str, w: int) -> str:
    """Do the last two swing highs of the array rise in close while OBV falls between them? SQL text."""
    beats = " AND ".join(f"{bars}[i].close > {bars}[i - {k}].close AND {bars}[i].close > {bars}[i + {k}].close"
                         for k in range(1, w + 1))
    swings = f"filter(sequence({w}, size({bars}) - {w + 1}), i -> {beats})"
    flow = (f"aggregate(sequence(p.old + 1, p.new), 0D, (a, j) -> a + "
            f"signum({bars}[j].close - {bars}[j - 1].close) * {bars}[j].volume)")
    last = f"transform(array({swings}), s -> struct(get(s, size(s) - 1) AS new, get(s, size(s) - 2) AS old, size(s) AS n))"
    rule = f"CASE WHEN p.n < 2 THEN false ELSE {bars}[p.new].close > {bars}[p.old].close AND {flow} < 0 END"
    return f"CASE WHEN size({bars}) >= {2 * w + 3} THEN transform({last}, p -> {rule})[0] ELSE false END"


def exit_signals(bars: DataFrame, positions: DataFrame, s: Series = Series(), cfg: Exit = Exit(), sold: DataFrame | None = None) -> DataFrame:
    """First exit of each position: the stop, else (once armed) divergence, else significant bearish volume.

    With ``sold`` (ticker, ts, exit_fill: the bars on which an exit order fills) a position stays open, and its exit is
    tried again, until an exit falls on such a bar; ``exit_fill`` is then added.

    While a position is younger than the lookback, its rules see only bars it lived through: these few bars are paired with
    it. From then on the rules read the same bars for every position, so they are flags of a bar, and the first bar that
    fires is found by ``first_passage``: no position is paired with the bars of its later life.
    """
    flagged = by_length(bars.select("ticker", "ts", "close", "volume"), s, lambda rows, s: _flagged(rows, s, cfg))
    fills = sold.select("ticker", "ts", *[c for c in sold.columns if c == "exit_fill"]).withColumn("_sells", F.lit(True)) if sold is not None else None
    flagged = flagged.join(fills, ["ticker", "ts"], "left") if sold is not None else flagged.withColumn("_sells", F.lit(True))
    flagged = materialise(flagged, "flagged-bars")

    held = asof_join(positions.select("ticker", "entry_time", "entry_price", "stop_price"), flagged.select("ticker", "ts", F.col("idx").alias("entry_idx")), ["entry_idx"],
                     left_ts="entry_time", width_sec=s.width_sec, forward=True, stored=True)
    held = materialise(held.filter(F.col("entry_idx").isNotNull()), "held")
    fill = [F.col("exit_fill")] if sold is not None else []

    # the first bars of a life, by blocks of bar numbers
    young = cfg.lookback_bars - 1
    block = lambda c: F.floor(c / F.lit(young))
    span = held.withColumn("_block", F.explode(F.sequence(block(F.col("entry_idx")), block(F.col("entry_idx") + young - 1))))
    pairs = (span.join(flagged.withColumn("_block", block(F.col("idx"))), ["ticker", "_block"])
             .filter((F.col("idx") >= F.col("entry_idx")) & (F.col("idx") < F.col("entry_idx") + young) & F.col("_sells")).withColumnRenamed("ts", "exit_time"))
    age = F.col("idx") - F.col("entry_idx")
    moves = F.least(age, F.lit(min(cfg.cvd_bars, young))).cast("int")
    second = secondary_armed(F.col("exit_time"), F.col("close"), F.col("entry_price"), cfg) & (age >= 1)
    early = pairs.withColumn("exit_reason", F.when(F.col("close") <= F.col("stop_price"), "STOP")
                             .when(second & F.col("_falls") & (F.col("_older") >= F.col("entry_idx") + cfg.swing_window), "SWING_DIVERGENCE")
                             .when(second & F.get("_weaks", moves - 1), "BEARISH_VOLUME")).filter(F.col("exit_reason").isNotNull())

    # the rest of it: what a block of bars can do to a position, from the block's extremes
    armed = hour_of_day(F.col("ts"), PACIFIC) >= cfg.armed_hour_pt
    rule = F.col("_turned") | F.col("_weak")
    usable = flagged.filter("_sells")
    leaves = usable.select("ticker", "idx", F.col("close").alias("lo"), F.when(rule, F.col("close")).alias("flo"), F.when(rule, F.col("close")).alias("fhi"),
                           (rule & armed).alias("armed"))
    moved = lambda c: F.coalesce(F.abs(F.col(c) - F.col("entry_price")) / F.col("entry_price") * 100.0 >= cfg.armed_move_pct, F.lit(False)) & (F.col("entry_price") != 0)
    fires = (F.col("lo") <= F.col("stop_price")) | F.coalesce("armed", F.lit(False)) | moved("flo") | moved("fhi")
    late = first_passage(held.withColumn("_from", F.col("entry_idx") + young), leaves,
                         {"lo": F.min("lo"), "flo": F.min("flo"), "fhi": F.max("fhi"), "armed": F.max("armed")}, fires)
    late = late.join(usable, ["ticker", "idx"]).withColumn("exit_reason", F.when(F.col("close") <= F.col("stop_price"), "STOP")
                                                           .when(F.col("_turned"), "SWING_DIVERGENCE").otherwise("BEARISH_VOLUME")).withColumnRenamed("ts", "exit_time")

    what = ["ticker", "entry_time", F.struct("exit_time", F.col("close").alias("exit_price"), "exit_reason", *fill).alias("_x")]
    exits = early.select(*what).unionByName(late.select(*what)).groupBy("ticker", "entry_time").agg(F.min_by("_x", "_x.exit_time").alias("_x"))
    return positions.join(exits.select("ticker", "entry_time", "_x.*"), ["ticker", "entry_time"], "left")


FAN = 5  # 32 bars, or blocks of bars, to a block


def first_passage(seekers: DataFrame, leaves: DataFrame, extremes: dict[str, Column], hits: Column, *, key: str = "ticker",
                  mark: tuple[str, ...] = ("entry_time",)) -> DataFrame:
    """The first leaf of its key, from number ``_from`` on, that ``hits`` each seeker: its columns and ``idx``; none for those never hit.

    Leaves (key, idx, ...) are summed up by ``extremes`` in blocks of 32, those in blocks of 32 blocks, and so on; ``hits`` must hold for a
    block if it holds for a leaf in it. A seeker meets, level by level, only what comes after it in its own block; in the
    first block that can hit it, it goes down again. So it meets a logarithmic number of blocks, whatever lies between.
    """
    top = leaves.agg(F.max("idx")).first()[0]
    if top is None:
        return seekers.withColumn("idx", F.lit(None).cast("bigint")).limit(0)
    levels = [leaves.withColumnRenamed("idx", "node").withColumn("level", F.lit(0))]
    while top >> FAN * (len(levels) - 1):
        below = levels[-1].withColumn("node", F.shiftright("node", FAN))
        levels.append(below.groupBy(key, "node").agg(*[e.alias(c) for c, e in extremes.items()]).withColumn("level", F.lit(len(levels))))
    blocks = levels[0]
    for more in levels[1:]:
        blocks = blocks.unionByName(more)
    blocks = materialise(blocks.withColumn("_up", F.shiftright("node", FAN)), "blocks")
    each = seekers.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))))
    own = F.expr(f"shiftright(_from, cast({FAN} * level as int))")
    each = each.withColumn("_own", own).withColumn("_up", F.shiftright("_own", FAN))
    after = (F.col("node") > F.col("_own")) | ((F.col("level") == 0) & (F.col("node") == F.col("_own")))

    def first(pairs: DataFrame) -> DataFrame:
        """Of the blocks that can hit a seeker, the first: lower levels come before higher ones."""
        kept = pairs.filter(hits).select(key, *mark, F.struct("level", "node").alias("_at"))
        return kept.groupBy(key, *mark).agg(F.min("_at").alias("_at")).select(key, *mark, "_at.level", "_at.node")

    found = materialise(first(each.join(blocks, [key, "level", "_up"]).filter(after)), "passages")
    for level in range(len(levels) - 1, 0, -1):
        above = found.filter(F.col("level") == level).select(key, *mark, F.col("node").alias("_up"))
        down = first(above.join(seekers, [key, *mark]).join(blocks.filter(F.col("level") == level - 1), [key, "_up"]))
        found = materialise(found.filter(F.col("level") < level).unionByName(down), "passages")
    return seekers.join(found.select(key, *mark, F.col("node").alias("idx")), [key, *mark])


def _numbered(bars: DataFrame, s: Series, cfg: Exit) -> DataFrame:
    """Bars with their number in the key and the net volume ratio of the last few changes."""
    # bar numbers and ratios are read several times: store these few columns once
    return materialise(by_length(bars.select("ticker", "ts", "close", "volume"), s, lambda rows, s: uncut(_numbers(rows, s, cfg))), "bar-numbers")


def _numbers(bars: DataFrame, s: Series, cfg: Exit) -> DataFrame:
    change = F.col("close") - F.col("prev_close")
    rows = running(bars.select("ticker", "ts", "close", "volume"), s, [
        Running("idx", "count", F.lit(1), inclusive=False),
        Running("prev_close", "last", F.col("close"), inclusive=False)])
    rows = rows.withColumns({"_up": F.when(change >= 0, F.col("volume")), "_down": F.when(change < 0, F.col("volume"))})
    near = with_halo(rows, s, before=cfg.cvd_bars - 1)
    recent = Window.partitionBy(*s.group).orderBy(*s.order).rowsBetween(-(cfg.cvd_bars - 1), 0)
    up, down = (F.coalesce(F.sum(c).over(recent), F.lit(0.0)) for c in ("_up", "_down"))
    rows = core_rows(near.withColumns({"_u": up, "_d": down}))
    total = F.col("_u") + F.col("_d")
    ratio = F.when(total > 0, (F.col("_u") - F.col("_d")) / total).otherwise(F.lit(0.0))
    return rows.select("ticker", "ts", "close", "volume", "idx", ratio.alias("_ratio"), PIECE)


def _flagged(bars: DataFrame, s: Series, cfg: Exit) -> DataFrame:
    """Numbered bars with what the exit rules say on each, by frames of bars alone.

    ``_turned`` and ``_weak`` hold for positions as old as the lookback. A younger one sees only bars from its
    entry on: ``_falls`` tells whether the last two swing highs known at the bar diverge, ``_older`` is the number of the
    older one, and ``_weaks[m - 1]`` whether the last m changes are bearish.
    """
    w, young = cfg.swing_window, cfg.lookback_bars - 1
    rows = with_halo(_numbers(bars, s, cfg), s, before=young)
    along = Window.partitionBy(*s.group).orderBy(*s.order)
    close, before = F.col("close"), F.lag("close").over(along)
    beats = [close > side("close", k).over(along) for k in range(1, w + 1) for side in (F.lag, F.lead)]
    flow = F.signum(close - before) * F.col("volume")
    rows = rows.withColumns({"_c": close - before, "_high": F.coalesce(reduce(lambda a, b: a & b, beats), F.lit(False)), "_flow": flow})
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_obv": F.sum("_flow").over(upto), "_gaps": F.count(F.when(F.col("_flow").isNull(), 1)).over(upto)})
    swing = F.when(F.col("_high"), F.struct("idx", "close", "_obv", "_gaps"))
    rows = rows.withColumn("_last", F.last(swing, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    falls = (close > F.col("_last.close")) & (F.col("_obv") < F.col("_last._obv")) & (F.col("_gaps") == F.col("_last._gaps"))
    rows = rows.withColumn("_pair", F.when(F.col("_high"), F.struct(F.col("_last.idx").alias("older"), F.coalesce(falls, F.lit(False)).alias("falls"))))
    rows = rows.withColumn("_known", F.last("_pair", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -w)))

    # as the rules of a position read them: a change or volume that is missing makes no ratio
    up, down, weaks = F.lit(0.0), F.lit(0.0), []
    for k in range(min(cfg.cvd_bars, young)):
        c, v = (F.lag(x, k).over(along) if k else F.col(x) for x in ("_c", "volume"))
        up, down = up + F.when(c >= 0, v).otherwise(0.0), down + F.when(c < 0, v).otherwise(0.0)
        weaks.append(F.when(up + down > 0, (up - down) / (up + down)).otherwise(0.0) <= cfg.cvd_threshold)
    rows = rows.withColumns({f"_w{m}": x for m, x in enumerate(weaks)})
    older, falls = F.col("_known.older"), F.coalesce("_known.falls", F.lit(False))
    return uncut(core_rows(rows).select(
        "ticker", "ts", "close", "idx", older.alias("_older"), falls.alias("_falls"), F.array(*[f"_w{m}" for m in range(len(weaks))]).alias("_weaks"),
        (falls & (older >= F.col("idx") - young + w)).alias("_turned"), (F.col("_ratio") <= cfg.cvd_threshold).alias("_weak"), PIECE))


def _reasons(pairs: DataFrame, cfg: Exit) -> DataFrame:
    """Adds the exit reason of each pair of a position and a bar it lived through, from the bars since its entry."""
    lived = Window.partitionBy("ticker", "entry_time").orderBy("exit_time").rowsBetween(-(cfg.lookback_bars - 1), 0)
    pairs = pairs.withColumn("_bars", F.collect_list(F.struct("close", "volume")).over(lived))
    armed = secondary_armed(F.col("exit_time"), F.col("close"), F.col("entry_price"), cfg) & (F.size("_bars") >= 2)
    weak = F.expr(_net_ratio("_bars", cfg.cvd_bars)) <= cfg.cvd_threshold
    reason = (F.when(F.col("close") <= F.col("stop_price"), "STOP")
              .when(armed & F.expr(_diverges("_bars", cfg.swing_window)), "SWING_DIVERGENCE")
              .when(armed & weak, "BEARISH_VOLUME"))
    return pairs.withColumn("exit_reason", reason)


def exit_tries(bars: DataFrame, positions: DataFrame, s: Series = Series(), cfg: Exit = Exit(), sold: DataFrame | None = None) -> DataFrame:
    """Every exit of a position that was tried, up to the one that sold it: (ticker, entry_time, exit_time, exit_price, exit_reason, sold)."""
    fired = materialise(_fired(bars, positions, s, cfg, sold).select("ticker", "entry_time", "exit_time", F.col("close").alias("exit_price"), "exit_reason", "sold"), "fired")
    last = fired.filter("sold").groupBy("ticker", "entry_time").agg(F.min("exit_time").alias("_last"))
    return fired.join(last, ["ticker", "entry_time"], "left").filter(F.col("_last").isNull() | (F.col("exit_time") <= F.col("_last"))).drop("_last")


def _fired(bars: DataFrame, positions: DataFrame, s: Series, cfg: Exit, sold: DataFrame | None) -> DataFrame:
    """Bars of a position's life on which an exit rule holds, up to one on which it must have been sold.

    A position is followed bar by bar only up to a time by which it must have closed: the first bar, enough
    bars after its entry, on which the volume rule holds while the hour arms it and an order fills. That bar does not depend on
    the position, so it is found by an as-of join on the bar number; the pairs formed after that are the
    bars a position really lived through.
    """
    rows = _numbered(bars, s, cfg)
    certain = rows.filter((F.col("_ratio") <= cfg.cvd_threshold) & (F.col("idx") >= cfg.cvd_bars)
                          & (hour_of_day(F.col("ts"), PACIFIC) >= cfg.armed_hour_pt))

    if sold is not None:
        certain = certain.join(sold.select("ticker", "ts"), ["ticker", "ts"], "left_semi")

    # entry bar number: the first bar at or after the entry
    held = asof_join(positions, rows.select("ticker", "ts", F.col("idx").alias("entry_idx")), ["entry_idx"],
                     left_ts="entry_time", width_sec=s.width_sec, forward=True)
    held = held.filter(F.col("entry_idx").isNotNull()).withColumn("_from", F.col("entry_idx") + cfg.cvd_bars)
    as_time = lambda c: F.timestamp_seconds(c)  # bar numbers on a time axis for the as-of join
    bound = certain.select("ticker", as_time("idx").alias("_at"), F.col("ts").alias("_until"))
    held = asof_join(held.withColumn("_n", as_time("_from")), bound, ["_until"], left_ts="_n", right_ts="_at",
                     width_sec=4096, forward=True).drop("_n", "_from")
    last = rows.groupBy("ticker").agg(F.max("ts").alias("_last"))
    held = held.join(last, "ticker", "left").withColumn("_until", F.coalesce("_until", "_last")).drop("_last")

    spans = held.select("ticker", "entry_time", "entry_price", "stop_price", "_until")
    pairs = range_join(rows.select("ticker", "ts", "close", "volume"), spans, F.col("entry_time"), F.col("_until"),
                       width_sec=s.width_sec).withColumnRenamed("point_ts", "exit_time")
    fired = _reasons(pairs, cfg).filter(F.col("exit_reason").isNotNull())
    if sold is None:
        return fired.withColumn("sold", F.lit(True))
    fills = sold.select("ticker", F.col("ts").alias("exit_time"), "exit_fill", F.lit(True).alias("sold"))
    return fired.join(fills, ["ticker", "exit_time"], "left").withColumn("sold", F.coalesce("sold", F.lit(False)))
