"""Windows decided over one forest of polls against a walk poll by poll, and without pairs of polls and signals."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tapeloom.config import Confirm
from tapeloom.operators.quotes import confirm_volume
from tapeloom.operators.record_paths import decide


def walk(volume, last, side, first, end, base, need, share):
    top = prev = None
    up = down = 0.0
    for i in range(first, end):
        v = volume[i]
        if not np.isnan(v):
            if top is not None and v > top:
                d, s = v - top, side[i] or (1 if last[i] > prev else -1 if last[i] < prev else 0)
                up, down = up + d * (1 + s) / 2, down + d * (1 - s) / 2
            top, prev = v if top is None else max(top, v), last[i]
        if base > 0 and (up + down) / base >= need and (up / (up + down) if up + down > 0 else 0.0) >= share:
            return i, up, down
    return -1, up, down


def test_decisions_equal_a_walk():
    rng = np.random.default_rng(4)
    for n, need, share in ((0, 0.5, 0.6), (1, 0.5, 0.6), (40, 0.5, 0.6), (300, 0.3, 0.6), (300, 2.0, 0.0), (120, 0.0, 0.5), (60, 0.0, 0.0), (2000, 0.2, 0.5)):
        volume = np.where(rng.random(n) < 0.2, np.nan, np.maximum.accumulate(rng.integers(0, 50, n)) + rng.integers(0, 30, n) + np.arange(n) // 5)
        last = np.where(rng.random(n) < 0.1, np.nan, rng.integers(1, 6, n).astype(float))
        side = rng.integers(-1, 2, n)
        first = np.sort(rng.integers(0, n + 1, 200))
        end = np.minimum(first + rng.integers(0, n + 1, 200), n)
        base = rng.choice([0.0, -1.0, 5.0, 20.0, 60.0], 200)
        d = decide(volume, last, side, first, end, base, need, share)
        want = [walk(volume, last, side, int(a), int(b), c, need, share) for a, b, c in zip(first, end, base)]
        assert list(zip(d.row.tolist(), d.up.tolist(), d.down.tolist())) == want


def test_dense_windows_are_not_paired(spark):
    """3,000 signals over 3,000 polls of one ticker and hour: the plan holds no join of polls with signals; copies of rows count each."""
    rng = random.Random(1)
    t0 = datetime(2024, 1, 2, 15)
    rows = [("A", t0 + timedelta(seconds=i), i, 10.0 + rng.random(), 9.0, 12.0, float(i)) for i in range(3000)]
    q = spark.createDataFrame(rows, "ticker string, ts timestamp, event_id long, last double, bid double, ask double, total_volume double")
    signals = q.select(F.col("event_id").alias("sid"), "ticker", "ts")
    adv = spark.createDataFrame([("A", 9e9)], "ticker string, adv double")
    ask = lambda s: confirm_volume(s, q, adv, signal_id="sid", cfg=Confirm(window_sec=3600), tie=["event_id"])
    out = ask(signals)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "_bucket" not in plan
    got = {r["sid"]: (r["polls_ok"], r["volume_since"]) for r in out.collect()}
    assert got == {i: (3000 - i, 2999.0 - i) for i in range(3000)}
    twice = ask(signals.filter("sid < 5").unionAll(signals.filter("sid < 3"))).collect()
    assert sorted((r["sid"], r["polls_ok"]) for r in twice) == [(0, 6000)] * 2 + [(1, 5998)] * 2 + [(2, 5996)] * 2 + [(3, 2997), (4, 2996)]
    odd = spark.createDataFrame([(None, "A", t0), (7, None, t0), (8, "A", None)], signals.schema)
    assert [(r["passed"], r["polls_ok"]) for r in ask(odd).collect()] == [(False, 0)] * 3
