"""Pools and pauses of runs against a walk over the signals, one by one."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tapeloom.config import Entry
from tapeloom.plans import trading_run as R

T0 = datetime(2024, 1, 1)
FOREVER = datetime(9999, 12, 31)
SCHEMA = "run string, seq long, ts timestamp, request int, is_fda boolean, price double, passes boolean, exit_time timestamp"


def signals(rng, runs, hot):
    rows = []
    for r in range(runs):
        n = hot if r == 0 else rng.randint(0, 40)
        for i in range(n):
            ts = T0 + timedelta(minutes=rng.randint(0, 3 * n))
            out = None if rng.random() < 0.02 else ts + timedelta(minutes=rng.choice([0, 1, 5, 40, 300]))
            rows.append((f"r{r}", i, ts, rng.randint(1, 10), rng.random() < 0.05, rng.choice([50.0, 99.0, 150.0, 480.0, 1000.0, 1500.0, 0.0, None]),
                         rng.random() < 0.6, out))
    rng.shuffle(rows)
    return rows


def need(price):
    return next((s for s in range(1, 11) if price and s * 100.0 >= price), None)


def walk(rows, pause):
    """(run, seq): (left, paused, used) of every signal."""
    out = {}
    for run in {r[0] for r in rows}:
        left, free = 10, datetime(1900, 1, 1)
        for _, seq, ts, request, is_fda, price, passes, end in sorted((r for r in rows if r[0] == run), key=lambda r: (r[2], r[1])):
            paused, n = pause and ts < free, need(price)
            used = 0 if paused or not passes or n is None or n > left else left if is_fda else max(min(request, left), n)
            out[run, seq] = (left, paused, used)
            left -= used
            free = (end or FOREVER) if used else free
    return out


def checked(spark, rows, pause):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("need", R.needed_slots(F.col("price"), 100.0)).repartition(7)
    at = F.struct("ts", "seq")
    entries = (R.paused_entries if pause else R.pool_entries)(df.filter("passes"), at)
    got = R.with_entries(df, entries, at).collect()
    assert {(r["run"], r["seq"]): (r["left"], r["paused"] if pause else False, r["slots_used"]) for r in got} == walk(rows, pause)
    assert len(got) == len(rows)


def test_pool_with_partial_claims_and_slots_given_back(spark):
    checked(spark, signals(random.Random(1), 25, 900), pause=False)


def test_one_position_at_a_time(spark):
    checked(spark, signals(random.Random(2), 25, 900), pause=True)


def test_no_signals_and_no_entries(spark):
    none = spark.createDataFrame([], SCHEMA).withColumn("need", F.lit(1))
    at = F.struct("ts", "seq")
    assert R.pool_entries(none, at).count() == 0 and R.paused_entries(none, at).count() == 0
    rows = [("a", 1, T0, 3, False, 5000.0, True, None), ("a", 2, T0, 3, True, None, True, None)]
    for pause in (False, True):
        checked(spark, rows, pause)


def test_needed_slots(spark):
    prices = [0.01, 100.0, 100.01, 1000.0, 1000.01, 0.0, -5.0, None]
    got = spark.createDataFrame([(p,) for p in prices], "p double").select(R.needed_slots(F.col("p"), 100.0, Entry())).collect()
    assert [r[0] for r in got] == [1, 1, 2, 10, None, None, None, None]
