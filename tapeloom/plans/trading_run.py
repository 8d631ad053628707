"""A run from its signals to its closed trades: one pool of slots, one position at a time, real fills.

A run spends its pool in order: a signal claims what it asks for of the slots that are left, gives all of it back
if a later gate, the price of a share or the order fails, and keeps it once its order is filled. Every entry
takes a slot at least, so a run has at most ``pool`` entries, however many signals it has. Both functions below
look for the entries only; everything else about a signal follows from the few entries of its run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Entry, Exit
from ..constants import EVENT_ENTRY, EVENT_ENTRY_UNFILLED, EVENT_EXIT, EVENT_EXIT_UNFILLED
from ..functions.rounding import floor_div
from ..operators.bars import entry_stop
from ..operators.ordered import Series
from ..session import materialise
from ..sources.orders import order_fills, order_outcome
from .exits import exit_signals, exit_tries, pnl_pct


def needed_slots(price: Column, per_slot: float, cfg: Entry = Entry()) -> Column:
    """The fewest slots that buy one share; null where the whole pool buys none."""
    enough = F.filter(F.sequence(F.lit(1), F.lit(cfg.pool)), lambda s: s * F.lit(per_slot) >= price)
    return F.when(price > 0, F.get(enough, F.lit(0)))


def _used(left: Column, e: Column) -> Column:
    """Slots that a signal keeps of those left: 0 if they buy no share, all for an approval, else what it asked for and
    got, raised to what buys a share."""
    return (F.when(e["need"].isNull() | (e["need"] > left), 0).when(e["is_fda"], left)
            .otherwise(F.greatest(F.least(e["request"], left), e["need"])))


ENTRY_TYPE = "struct<o: {order}, used: int, until: timestamp>"


def pool_entries(ready: DataFrame, order: Column, cfg: Entry = Entry(), *, run: str = "run") -> DataFrame:
    """(run, entries): the entries of every run that has any, in order, each as (o, used, until).

    ``ready`` are the signals that pass all other gates: run, need, request, is_fda. Of the signals of one need only the first ``pool``
    of a run can enter, as any that came before one that enters, with the same need, entered itself. So at
    most ``pool`` squared signals of a run meet, in one array; the rank is limited inside the tasks.
    """
    rows = ready.filter(F.col("need").isNotNull()).select(run, order.alias("o"), "need", "request", "is_fda")
    rank = F.row_number().over(Window.partitionBy(run, "need").orderBy("o"))
    few = rows.withColumn("_n", rank).filter(F.col("_n") <= cfg.pool).drop("_n")
    kind = ENTRY_TYPE.format(order=dict(rows.dtypes)["o"])
    met = few.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("o", "need", "request", "is_fda"))).alias("_all"))

    def step(acc: Column, e: Column) -> Column:
        used = _used(acc["left"], e).cast("int")
        entry = F.struct(e["o"].alias("o"), used.alias("used"), F.lit(None).cast("timestamp").alias("until"))
        return F.struct((acc["left"] - used).cast("int").alias("left"), F.when(used > 0, F.array_append(acc["done"], entry)).otherwise(acc["done"]).alias("done"))

    start = F.struct(F.lit(cfg.pool).cast("int").alias("left"), F.array().cast(f"array<{kind}>").alias("done"))
    return met.select(run, F.aggregate("_all", start, step, lambda a: a["done"]).alias("entries"))


def paused_entries(ready: DataFrame, order: Column, cfg: Entry = Entry(), *, run: str = "run", start: str = "ts",
                   end: str = "exit_time") -> DataFrame:
    """As ``pool_entries``, but a run takes no signal while its last position is open.

    ``ready`` also has the time of the signal and of the exit it would get; no exit keeps the run busy for good. Each
    round finds the next entry of every run by one aggregate; a run takes part as long as it enters, so there
    are ``pool`` rounds at most, and no run ever lies in one group.
    """
    rows = ready.filter(F.col("need").isNotNull()).select(run, order.alias("o"), "need", "request", "is_fda", F.col(start).alias("at"), F.col(end).alias("until"))
    rows = materialise(rows, "ready")
    state = rows.select(run).distinct().select(run, F.lit(None).cast(dict(rows.dtypes)["o"]).alias("after"), F.lit(cfg.pool).alias("left"),
                                               F.lit(None).cast("timestamp").alias("free"))
    found = []
    for _ in range(cfg.pool):
        open_to = (F.col("after").isNull() | ((F.col("o") > F.col("after")) & (F.col("at") >= F.col("free")))) & (F.col("need") <= F.col("left"))
        first = rows.join(state, run).filter(open_to).groupBy(run, "left").agg(F.min_by(F.struct("o", "need", "request", "is_fda", "until"), "o").alias("e"))
        entered = materialise(first.select(run, "e.*", "left").withColumn("used", _used(F.col("left"), F.struct("need", "request", "is_fda")).cast("int")), "entries")
        found.append(entered.select(run, F.struct("o", "used", "until").alias("e")))
        state = entered.filter(F.col("until").isNotNull() & (F.col("used") < F.col("left"))).select(
            run, F.col("o").alias("after"), (F.col("left") - F.col("used")).alias("left"), F.col("until").alias("free"))
        if state.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy(run).agg(F.array_sort(F.collect_list("e")).alias("entries"))


def with_entries(signals: DataFrame, entries: DataFrame, order: Column, cfg: Entry = Entry(), *, run: str = "run", start: str = "ts") -> DataFrame:
    """Adds what a signal finds: ``left`` slots, whether the run is ``paused``, and ``slots_used`` if it enters itself.

    The entries of a run are one short array, so a join on the run brings them to all of its signals.
    """
    rows = signals.join(entries, run, "left").withColumn("_o", order)
    before = F.filter(F.coalesce("entries", F.array().cast(dict(entries.dtypes)["entries"])), lambda e: e["o"] < F.col("_o"))
    own = F.get(F.filter("entries", lambda e: e["o"] == F.col("_o")), F.lit(0))
    rows = rows.withColumns({
        "left": (F.lit(cfg.pool) - F.aggregate(before, F.lit(0), lambda a, e: a + e["used"])).cast("int"),
        "paused": F.exists(before, lambda e: e["until"].isNull() | (F.col(start) < e["until"])),
        "slots_used": F.coalesce(own["used"], F.lit(0)).cast("int")})
    return rows.drop("entries", "_o")


def first_fills(orders: DataFrame, side: str, cfg: Entry = Entry()) -> DataFrame:
    """(ticker, ts, filled, fill_price): does one of the first attempts on a bar fill, and at what average price of its legs.

    ``orders``: ticker, ts, attempt beside the execution report.
    """
    fills = order_fills(orders.filter(F.col("attempt") <= cfg.attempts), keep=("ticker", "ts", "attempt"))
    tries = fills.select(F.struct("ticker", "ts").alias("signal_id"), "attempt", "status", F.col("avg_fill_price").alias("price"))
    done = EVENT_ENTRY if side == "ENTRY" else EVENT_EXIT
    return order_outcome(tries, side).select("signal_id.ticker", "signal_id.ts", (F.col("outcome") == done).alias("filled"), "fill_price")


def trade(signals: DataFrame, bars: DataFrame, orders: DataFrame, per_slot: float, s: Series = Series(), cfg: Entry = Entry(),
          rules: Exit = Exit()) -> DataFrame:
    """Every signal of every run with its outcome, and the trade it became.

    ``signals``: run, ticker, ts, price, atr, request, is_fda, gate (the label of a failed gate, else null); (ticker, ts) is unique. An order that
    fills at its bar (``first_fills``) makes a position at the fill price, or the reference price where the
    report has none, with its stop; it ends at the first exit whose order fills. Which of these positions the run takes
    depends on the slots left and on the one before being closed: signals of one run are taken in order of (ts, ticker).

    Outcomes: SKIP_PAUSED, SKIP_NO_SLOTS, the label of the gate, ABORT_NO_SHARE, ENTRY_ATTEMPT_UNFILLED, ENTER.
    """
    fills = materialise(first_fills(orders, "ENTRY", cfg), "fills")  # an order fills or not, whichever side it is on
    rows = (signals.withColumn("need", needed_slots(F.col("price"), per_slot, cfg))
            .join(fills.withColumnRenamed("fill_price", "entry_fill"), ["ticker", "ts"], "left")
            .withColumn("filled", F.coalesce("filled", F.lit(False)))
            .withColumn("entry_price", F.coalesce("entry_fill", "price")))
    rows = materialise(entry_stop(rows), "signals")
    ready = rows.filter(F.col("gate").isNull() & F.col("filled") & F.col("need").isNotNull())
    positions = ready.select("ticker", F.col("ts").alias("entry_time"), "entry_price", "stop_price")
    sold = fills.filter("filled").select("ticker", "ts", F.col("fill_price").alias("exit_fill"))
    ends = materialise(exit_signals(bars, positions, s, rules, sold=sold)
                       .select("ticker", F.col("entry_time").alias("ts"), "exit_time", "exit_price", "exit_reason", "exit_fill"), "exits")
    order = F.struct("ts", "ticker")
    ready = ready.join(ends, ["ticker", "ts"], "left")
    entries = paused_entries(ready, order, cfg)
    out = with_entries(rows, entries, order, cfg)
    entered = F.col("slots_used") > 0
    outcome = (F.when(entered, "ENTER").when(F.col("paused"), "SKIP_PAUSED").when(F.col("left") <= 0, "SKIP_NO_SLOTS")
               .when(F.col("gate").isNotNull(), F.col("gate"))
               .when(F.col("need").isNull() | (F.col("need") > F.col("left")), "ABORT_NO_SHARE").otherwise(EVENT_ENTRY_UNFILLED))
    quantity = F.when(entered, floor_div(F.col("slots_used") * F.lit(per_slot), F.col("price")))
    taken = out.withColumn("outcome", outcome).withColumn("quantity", quantity.cast("double")).join(ends, ["ticker", "ts"], "left")
    ended = [F.when(entered, F.col(c)).alias(c) for c in ("exit_time", "exit_price", "exit_reason", "exit_fill")]
    return taken.select("run", "ticker", "ts", "price", "outcome", "left", "slots_used", "quantity", "entry_fill", "entry_price", "stop_price", *ended)


def run_state(trades: DataFrame, cfg: Entry = Entry(), *, run: str = "run") -> DataFrame:
    """A run is complete once its pool is spent and its positions are closed."""
    entered = F.col("slots_used") > 0
    return trades.groupBy(run).agg(
        F.sum("slots_used").alias("slots_spent"), F.count(F.when(entered & F.col("exit_time").isNull(), 1)).alias("still_open")).withColumn(
        "is_complete", (F.col("slots_spent") >= cfg.pool) & (F.col("still_open") == 0))


def log_events(trades: DataFrame, bars: DataFrame, orders: DataFrame, s: Series = Series(), cfg: Entry = Entry(), rules: Exit = Exit()) -> DataFrame:
    """What the runs write into their log: entries, unfilled entries, exits, and every exit order that did not fill.

    (event, ticker, time, price, quantity, pnl_pct, reason, headline), as ``trade_log_rows`` takes them.
    """
    entered = trades.filter("slots_used > 0")
    none = F.lit(None).cast("double")
    event = lambda name, time, price, quantity, pnl, reason: (
        F.lit(name).alias("event"), "ticker", F.col(time).alias("time"), price.alias("price"), quantity.alias("quantity"), pnl.alias("pnl_pct"),
        reason.alias("reason"), F.lit("").alias("headline"))
    ins = entered.select(*event(EVENT_ENTRY, "ts", F.col("entry_price"), F.col("quantity"), none, F.lit("SIGNAL")))
    missed = trades.filter(F.col("outcome") == EVENT_ENTRY_UNFILLED).select(*event(EVENT_ENTRY_UNFILLED, "ts", F.col("price"), none, none, F.lit("SIGNAL")))
    price = F.coalesce("exit_fill", "exit_price")
    outs = entered.filter("exit_time IS NOT NULL").select(*event(
        EVENT_EXIT, "exit_time", price, F.col("quantity"), pnl_pct(price, F.col("entry_price")), F.col("exit_reason")))
    held = entered.select("ticker", F.col("ts").alias("entry_time"), "entry_price", "stop_price")
    sold = first_fills(orders, "EXIT", cfg).filter("filled").select("ticker", "ts", F.col("fill_price").alias("exit_fill"))
    tries = exit_tries(bars, held, s, rules, sold=sold).filter(~F.col("sold"))
    stuck = tries.select(*event(EVENT_EXIT_UNFILLED, "exit_time", F.col("exit_price"), none, none, F.col("exit_reason")))
    return ins.unionByName(missed).unionByName(outs).unionByName(stuck)
