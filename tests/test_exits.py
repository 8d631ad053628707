"""The first bar that ends a position, found by descent over blocks, against a scan of all bars."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tapeloom.config import Exit
from tapeloom.operators.ordered import Series
from tapeloom.plans import exits as X

T0 = datetime(2024, 1, 2, 1)


def test_first_passage_over_many_levels(spark):
    rng = random.Random(5)
    closes = {"hot": 40_000, "b": 33, "c": 1}
    bars, level = {}, {}
    for key, n in closes.items():
        px = 100.0
        bars[key] = []
        for _ in range(n):
            px *= 1 + rng.uniform(-0.001, 0.001)
            bars[key].append(px)
    rows = [(k, i, p) for k, each in bars.items() for i, p in enumerate(each) if k != "hot" or i % 7]  # some numbers are missing
    leaves = spark.createDataFrame(rows, "ticker string, idx long, lo double").repartition(6)
    seekers = [(k, T0 + timedelta(seconds=n), rng.randrange(len(bars[k]) + 3), rng.choice([60.0, 95.0, 97.0, 99.0, 100.0, 101.0])) for n in range(300) for k in ("hot", "b", "c")]
    df = spark.createDataFrame(seekers, "ticker string, entry_time timestamp, _from long, stop_price double")
    got = {(r["ticker"], r["entry_time"]): r["idx"] for r in X.first_passage(df, leaves, {"lo": F.min("lo")}, F.col("lo") <= F.col("stop_price")).collect()}
    there = {k: [(i, p) for t, i, p in rows if t == k] for k in bars}
    for key, at, start, stop in seekers:
        assert got.get((key, at)) == next((i for i, p in there[key] if i >= start and p <= stop), None)
    assert X.first_passage(df, leaves.limit(0), {"lo": F.min("lo")}, F.col("lo") <= F.col("stop_price")).count() == 0


def by_hand(bars, position, sold, cfg=Exit()):
    """Bar by bar from the entry on, with the rules on the bars lived through."""
    lived = [b for b in bars if b[0] >= position[0]]
    for n in range(1, len(lived) + 1):
        last = lived[max(0, n - cfg.lookback_bars): n]
        ts, close, _ = last[-1]
        reason = "STOP" if close <= position[2] else None
        armed = (ts - timedelta(hours=8)).hour >= cfg.armed_hour_pt or abs(close - position[1]) / position[1] * 100.0 >= cfg.armed_move_pct
        if reason is None and armed and len(last) >= 2:
            w = cfg.swing_window
            swings = [i for i in range(w, len(last) - w) if all(last[i][1] > last[i - k][1] and last[i][1] > last[i + k][1] for k in range(1, w + 1))]
            if len(last) >= 2 * w + 3 and len(swings) >= 2:
                old, new = swings[-2:]
                flow = sum(((last[j][1] > last[j - 1][1]) - (last[j][1] < last[j - 1][1])) * last[j][2] for j in range(old + 1, new + 1))
                reason = "SWING_DIVERGENCE" if last[new][1] > last[old][1] and flow < 0 else None
            if reason is None:
                moves = [(last[i][1] - last[i - 1][1], last[i][2]) for i in range(max(1, len(last) - cfg.cvd_bars), len(last))]
                up, down = sum(v for c, v in moves if c >= 0), sum(v for c, v in moves if c < 0)
                reason = "BEARISH_VOLUME" if up + down > 0 and (up - down) / (up + down) <= cfg.cvd_threshold else None
        if reason and (sold is None or ts in sold):
            return ts, reason
    return None


def test_exits_by_hand(spark):
    rng = random.Random(8)
    bars, held = {}, []
    for key, n, drift in (("a", 700, 0.0), ("b", 90, 0.002), ("c", 20, -0.001)):
        px, each = 50.0, []
        for i in range(n):
            px *= 1 + drift + rng.uniform(-0.004, 0.004)
            each.append((T0 + timedelta(minutes=3 * i), round(px, 3), float(rng.choice([1, 5, 20]))))
        bars[key] = each
        for _ in range(40):
            at = each[rng.randrange(n)]
            held.append((key, at[0] + timedelta(seconds=rng.choice([0, 1])), at[1], at[1] * rng.choice([0.9, 0.97, 0.99])))
    held = list({h[:2]: h for h in held}.values())
    tape = spark.createDataFrame([(k, *b) for k, each in bars.items() for b in each], "ticker string, ts timestamp, close double, volume double")
    positions = spark.createDataFrame(held, "ticker string, entry_time timestamp, entry_price double, stop_price double")
    some = {k: {b[0] for b in each if rng.random() < 0.3} for k, each in bars.items()}
    fills = spark.createDataFrame([(k, t, 1.0) for k, times in some.items() for t in times], "ticker string, ts timestamp, exit_fill double")
    for sold in (None, some):
        out = X.exit_signals(tape, positions, Series(width_sec=3600), sold=fills if sold else None)
        got = {(r["ticker"], r["entry_time"]): r["exit_time"] and (r["exit_time"], r["exit_reason"]) for r in out.collect()}
        assert len(got) == len(held)
        for key, *position in held:
            assert got[key, position[0]] == by_hand(bars[key], position, sold and sold[key]), (key, position)
