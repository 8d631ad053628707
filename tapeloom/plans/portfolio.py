"""Capital: entry gates, slots, one position at a time, order prices, round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Entry, Sizing
from ..functions import quotes as Q
from ..functions.clock import is_pre_session
from ..functions.rounding import floor_div, round_exact, truthy
from ..operators.matching import asof_join, open_at
from ..operators.ordered import Running, Series, by_length, running, uncut
from ..session import materialise
from .exits import pnl_pct
from .trading_run import needed_slots, pool_entries, with_entries


def slot_request(request: Column, cfg: Sizing = Sizing()) -> Column:
    asked = F.coalesce(truthy(request), F.lit(cfg.min_slots))
    return F.least(F.greatest(asked, F.lit(cfg.min_slots)), F.lit(cfg.max_slots)).cast("int")


def limit_ladder(rows: DataFrame, cfg: Entry = Entry(), *, side: str = "BUY", reference: str = "ref_price") -> DataFrame:
    """One row per order attempt with its limit price, widened each time, rounded to cents."""
    out = rows.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(cfg.attempts))))
    widen = F.lit(cfg.slippage) + F.lit(cfg.widen_step) * (F.col("attempt") - 1)
    factor = 1 + widen if side == "BUY" else 1 - widen
    out = out.withColumn("_raw", F.col(reference) * factor)
    return out.withColumn("limit_price", round_exact(F.col("_raw"), 2)).drop("_raw")


def share_quantity(rows: DataFrame, per_slot: Column, cfg: Entry = Entry(), *, price: str = "price", slots: str = "slots",
                   remaining: str = "remaining", is_fda: str = "is_fda") -> DataFrame:
    """Whole shares for the claimed slots. If they buy none, slots are added one by one (from the remaining
    pool, up to the maximum, not for approvals) until they buy one share; otherwise the quantity is 0."""
    top = F.least(F.lit(cfg.pool), F.col(slots) + F.col(remaining))
    rows = rows.withColumn("_per", per_slot).withColumn("_top", F.greatest(F.col(slots), F.when(
        F.col(is_fda), F.col(slots)).otherwise(top)))
    enough = F.filter(F.sequence(F.col(slots), F.col("_top")), lambda s: s * F.col("_per") >= F.col(price))
    rows = rows.withColumn("slots_used", F.coalesce(F.get(enough, F.lit(0)), F.col("_top")).cast("int"))
    spend = F.col("slots_used") * F.col("_per")
    quantity = F.when(F.col(price) > 0, floor_div(spend, F.col(price))).otherwise(F.lit(0))
    return rows.withColumn("quantity", quantity.cast("bigint")).drop("_per", "_top")


FEW = 2_000  # rows of a ticker whose windows are summed row by row


def trailing_vwap(events: DataFrame, bars: DataFrame, *, ts: str = "ts", window_sec: int = 86_400, stored: bool = False) -> DataFrame:
    """VWAP of the bars in [ts - window, ts] per event, null without volume.

    Pieces are as wide as the window, so a window is the head of its own piece plus the tail of the piece
    before it. Both are sums from one end of a piece; nothing is subtracted, so a window without volume
    has a sum of exactly 0. With ``stored`` tables the rows of a ticker are counted first, and short tickers sum their windows
    directly, in one pass.
    """
    s = Series(width_sec=window_sec)
    if stored:
        own = F.struct(*events.columns)
        both = bars.filter(F.col("ts").isNotNull()).select("ticker", "ts", "close", "volume", F.lit(None).cast(events.select(own.alias("e")).dtypes[0][1]).alias("_e"))
        both = both.unionByName(events.select("ticker", F.col(ts).alias("ts"), own.alias("_e")), allowMissingColumns=True)

        def step(rows: DataFrame, s: Series) -> DataFrame:
            mine = F.col("_e").isNotNull()
            if not s.whole:
                return trailing_vwap(rows.filter(mine).select("_e.*"), rows.filter(~mine).drop("_e"), ts=ts, window_sec=window_sec)
            span = Window.partitionBy("ticker").orderBy(F.unix_micros("ts")).rangeBetween(-window_sec * 1_000_000, 0)
            summed = rows.withColumns({"_num": F.sum(F.col("close") * F.col("volume")).over(span), "_den": F.sum("volume").over(span)})
            return summed.filter(mine).select("_e.*", F.when(F.col("_den") > 0, F.coalesce("_num", F.lit(0.0)) / F.col("_den")).alias("vwap"))

        return by_length(both, s, step, FEW)
    piece = Window.partitionBy(*s.group).orderBy(*s.order)
    head, tail = piece.rowsBetween(Window.unboundedPreceding, 0), piece.rowsBetween(0, Window.unboundedFollowing)
    rows = s.cut(bars.select("ticker", "ts", (F.col("close") * F.col("volume")).alias("_pv"), "volume"))
    sums = rows.select("ticker", "ts", "_piece", F.sum("_pv").over(head).alias("_hn"), F.sum("volume").over(head).alias("_hv"),
                       F.sum("_pv").over(tail).alias("_tn"), F.sum("volume").over(tail).alias("_tv"))
    here, there = ["_p1", "_n1", "_v1"], ["_p0", "_n0", "_v0"]
    name = lambda side, cols: sums.select("ticker", "ts", *[
        F.col(c).alias(n) for c, n in zip(("_piece", f"_{side}n", f"_{side}v"), cols)])
    out = asof_join(events, name("h", here), here, left_ts=ts, width_sec=window_sec)
    out = out.withColumn("_from", F.col(ts) - F.expr(f"INTERVAL {window_sec} SECONDS"))
    out = asof_join(out, name("t", there), there, left_ts="_from", width_sec=window_sec, forward=True)
    out = out.withColumn("_piece", s.piece_of(F.col(ts)))

    def sum_of(kind: str) -> Column:
        own = F.when(F.col("_p1") == F.col("_piece"), F.col(f"_{kind}1"))
        before = F.when(F.col("_p0") == F.col("_piece") - 1, F.col(f"_{kind}0"))
        return F.coalesce(own, F.lit(0.0)) + F.coalesce(before, F.lit(0.0))

    out = out.withColumn("_num", sum_of("n")).withColumn("_den", sum_of("v"))
    return out.withColumn("vwap", F.when(F.col("_den") > 0, F.col("_num") / F.col("_den"))).drop(
        "_piece", "_from", "_num", "_den", *here, *there)


def under_ceiling(price: Column, is_fda: Column, cfg: Entry = Entry()) -> Column:
    return is_fda | (price <= cfg.price_ceiling)


def over_vwap(price: Column, vwap: Column, is_fda: Column) -> Column:
    """Above the VWAP; passes where either is missing."""
    return is_fda | F.coalesce(price > vwap, F.lit(True))


def entry_price(signals: DataFrame, quotes: DataFrame, bars: DataFrame, *, tie: tuple[str, ...] = ()) -> DataFrame:
    """Last quote at or before the signal, else the last bar close, with the quote's bid and ask."""
    named = quotes.select("ticker", "ts", *tie, F.col("last").alias("_last"), "bid", "ask")
    out = asof_join(signals, named, ["_last", "bid", "ask"], tie=tie)
    out = asof_join(out, bars.select("ticker", "ts", F.col("close").alias("_close")), ["_close"])
    price = F.coalesce(truthy(F.col("_last")), truthy(F.col("_close")))
    return out.withColumn("price", price).drop("_last", "_close")


def entry_gates(signals: DataFrame, quotes: DataFrame, bars: DataFrame, held: DataFrame, per_slot: float,
                cfg: Entry = Entry(), sizing: Sizing = Sizing(), *, run: str = "run", order: tuple[str, ...] = ("ts", "signal_id"),
                tie: tuple[str, ...] = ()) -> DataFrame:
    """Outcome label of each entry attempt, in the order of the gates, with price, slots and quantity.

    The signals of a run share its pool in ``order``: each claims what it asks for or what is left (``slots``), adds slots
    until they buy one share (``slots_used``), and gives all back if a gate fails. Approvals skip the liquidity,
    ceiling and VWAP gates and claim all that is left.
    """
    rows = open_at(signals, held)
    rows = entry_price(rows, quotes, bars, tie=tie)
    rows = trailing_vwap(rows, bars, window_sec=cfg.vwap_window_sec)
    normal = ~F.col("is_fda")
    gate = (F.when(normal & ~Q.is_liquid(F.col("bid"), F.col("ask"), cfg), "GATE_LIQUIDITY")
            .when(F.col("price").isNull(), "ABORT_NO_PRICE")
            .when(~under_ceiling(F.col("price"), F.col("is_fda"), cfg), "ABORT_PRICE_CEILING")
            .when(~over_vwap(F.col("price"), F.col("vwap"), F.col("is_fda")), "ABORT_VWAP"))
    rows = rows.withColumns({"_gate": gate, "request": slot_request(F.col("request"), sizing), "need": needed_slots(F.col("price"), per_slot, cfg)})
    rows = materialise(rows, "gated")  # read for the entries and for the outcomes
    at = F.struct(*order)
    entries = pool_entries(rows.filter(F.col("_gate").isNull() & ~F.col("is_open")), at, cfg, run=run)
    rows = with_entries(rows, entries, at, cfg, run=run)
    outcome = (F.when(F.col("is_open"), "SKIP_OPEN_POSITION").when(F.col("left") <= 0, "SKIP_NO_SLOTS")
               .when(F.col("_gate").isNotNull(), F.col("_gate")).when(F.col("slots_used") < 1, "ABORT_NO_SHARE").otherwise("ENTER"))
    spend = F.col("slots_used") * F.lit(per_slot)
    quantity = F.when(F.col("slots_used") > 0, floor_div(spend, F.col("price"))).otherwise(F.lit(0)).cast("bigint")
    claimed = F.when(F.col("is_fda"), F.col("left")).otherwise(F.least("request", "left"))
    return rows.withColumns({"outcome": outcome, "slots": claimed, "quantity": quantity,
                             "pre_session": is_pre_session(F.col("ts"), cfg.pre_session_end_sec)}).drop("is_open", "_gate", "need", "paused")


def allocate_slots(signals: DataFrame, cfg: Entry = Entry(), sizing: Sizing = Sizing(), *,
                   run: str = "run", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Slots given to each signal of a run in order, from one pool per run.

    Every request takes at least one slot, so only the first ``pool`` signals of a run can get any. They are
    ranked with a per-task limit; all later signals of a hot run never meet in one task.
    """
    if sizing.min_slots < 1:
        raise ValueError("every request must take a slot at least")
    need = F.when(F.col("is_fda"), F.lit(cfg.pool)).otherwise(slot_request(F.col("request"), sizing))
    rows = signals.withColumn("requested", need)
    in_run = Window.partitionBy(run).orderBy(*order)
    first = rows.withColumn("_n", F.row_number().over(in_run)).filter(F.col("_n") <= cfg.pool)
    before = F.coalesce(F.sum("requested").over(in_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    given = first.select(run, *order, F.least(F.col("requested"), F.greatest(
        F.lit(cfg.pool) - before, F.lit(0))).cast("int").alias("allocated"))
    return rows.join(given, [run, *order], "left").withColumn("allocated", F.coalesce("allocated", F.lit(0)))


FOREVER = "9999-12-31"


def single_position(signals: DataFrame, *, run: str = "run", seq: str = "seq", start: str = "entry_time",
                    end: str = "exit_time", width_sec: int = 86_400) -> DataFrame:
    """Accept signals of a run in order of (start, seq) while no accepted position is open (flag ``accepted``).

    A signal that starts after everything before it has ended is always accepted, whatever was accepted
    before. Runs are cut there into independent islands. Inside an island the accepted positions are the
    chain "first signal at or after my end", followed by doubling the jump length, so that no island ever
    lies in one group.
    """
    rows = signals.withColumn("_end", F.coalesce(F.col(end), F.lit(FOREVER).cast("timestamp")))
    s = Series(keys=(run,), order=(start, seq), width_sec=width_sec)
    rows = running(rows, s, [Running("_busy", "max", F.col("_end"), inclusive=False)])
    fresh = F.when(F.col("_busy").isNull() | (F.col(start) >= F.col("_busy")), 1).otherwise(0)
    rows = running(rows.withColumn("_new", fresh), s, [Running("_island", "sum", F.col("_new"))])
    slim = materialise(uncut(rows).select(run, "_island", seq, F.col(start).alias("_start"), "_end"), "islands")
    won = _chained(slim, run, seq, width_sec)
    return signals.join(won.withColumn("accepted", F.lit(True)), [run, seq], "left").withColumn(
        "accepted", F.coalesce("accepted", F.lit(False)))


def _chained(rows: DataFrame, run: str, seq: str, width_sec: int) -> DataFrame:
    """Accepted (run, seq) of all islands. A signal alone on its island is accepted as it stands; only the others are followed."""
    sizes = rows.groupBy(run, "_island").agg(F.count(F.lit(1)).alias("_rows"))
    marked = materialise(rows.join(sizes, [run, "_island"]), "sized-islands")
    alone, rows = marked.filter("_rows = 1").select(run, seq), marked.filter("_rows > 1").drop("_rows")
    spans = rows.filter(F.col("_end") > F.col("_start"))
    nodes = spans.withColumn("_next", F.col(seq))
    jumps = materialise(asof_join(
        spans, nodes.select(run, "_island", F.col("_start").alias("_at"), F.col(seq).alias("_tie"), "_next"), ["_next"],
        keys=(run, "_island"), left_ts="_end", right_ts="_at", tie=("_tie",), width_sec=width_sec, forward=True)
        .select(run, "_island", seq, "_start", "_next"), "jumps")
    reached = materialise(jumps.groupBy(run, "_island").agg(F.min_by(seq, F.struct("_start", seq)).alias(seq)), "heads")
    hops = jumps.filter(F.col("_next").isNotNull()).select(run, "_island", seq, "_next")
    while True:
        # a chain never meets itself, so what is reached by longer hops is new; an island is left once nothing is
        ahead = materialise(reached.join(hops, [run, "_island", seq]).select(run, "_island", F.col("_next").alias(seq)), "ahead")
        if ahead.isEmpty():
            break
        reached = reached.unionByName(ahead)
        growing = hops.join(ahead.select(run, "_island").distinct(), [run, "_island"], "left_semi")
        second = growing.select(run, "_island", F.col(seq).alias("_next"), F.col("_next").alias("_far"))
        hops = materialise(growing.join(second, [run, "_island", "_next"]).select(run, "_island", seq, F.col("_far").alias("_next")), "hops")
    won = materialise(spans.join(reached.select(run, seq), [run, seq], "left_semi"), "accepted")
    # a position that ends as it starts never blocks; it is refused inside an accepted one that comes before it
    instant = rows.filter(F.col("_end") <= F.col("_start"))
    later = won.withColumn("_start", F.timestamp_micros(F.unix_micros("_start") + 1))
    inside = open_at(instant, later.select(run, "_start", "_end"), ts="_start", start="_start", end="_end", keys=(run,),
                     width_sec=width_sec)
    same = won.select(run, "_start", F.col(seq).alias("_first"))
    free = (inside.filter(~F.col("is_open")).join(same, [run, "_start"], "left")
            .filter(F.col("_first").isNull() | (F.col("_first") > F.col(seq))))
    return won.select(run, seq).unionByName(free.select(run, seq)).unionByName(alone)


def report(trips: DataFrame) -> DataFrame:
    """P&L in percent and dollars and the holding time of closed trades; fill prices win over references."""
    bought = F.coalesce("entry_fill", "entry_price")
    sold = F.coalesce("exit_fill", "exit_price")
    out = trips.withColumn("bought_at", bought).withColumn("sold_at", sold)
    return out.withColumns({
        "pnl_pct": pnl_pct(F.col("sold_at"), F.col("bought_at")),
        "pnl_usd": (F.col("sold_at") - F.col("bought_at")) * F.col("quantity"),
        "holding_sec": (F.unix_micros("exit_time") - F.unix_micros("entry_time")) / F.lit(1e6)})
