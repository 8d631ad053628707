"""Streams over several micro-batches give what the batch operators give."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.config import Confirm, Exit
from tapeloom.operators import news as N, quotes as P
from tapeloom.operators.ordered import Series
from tapeloom.session import fresh_folder
from tapeloom.streaming import news as SN, positions as SP, quotes as SQ
from tapeloom.streaming.run import drain, file_stream, for_each_batch

T0 = datetime(2024, 1, 2, 15)
S = Series(order=("ts", "event_id"), width_sec=600)


@pytest.fixture(scope="module")
def tape(spark):
    rng = random.Random(6)
    rows, total = [], {"A": 0.0, "B": 0.0}
    for i in range(400):
        t = rng.choice("AAAB")
        total[t] += rng.choice([0, 40, 200])
        px = round(10 + rng.uniform(-1, 1) + i / 200, 2)
        rows.append((t, T0 + timedelta(seconds=9 * i), i, None if rng.random() < 0.05 else px, px - 0.1, px + rng.choice([0.0, 0.1]),
                     None if rng.random() < 0.1 else total[t], rng.choice(["Halted", "Normal", "Normal", None])))
    df = spark.createDataFrame(rows, "ticker string, ts timestamp, event_id long, last double, bid double, ask double, "
                                     "total_volume double, security_status string")
    path = fresh_folder(spark, "tape")
    for part in range(4):  # four files, read one per micro-batch in the order written
        df.filter((F.col("event_id") >= part * 100) & (F.col("event_id") < part * 100 + 100)).coalesce(1).write.mode("append").parquet(path)
    return df, lambda: file_stream(spark, path, df.schema, files_per_trigger=1)


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_highs_and_reopens(tape):
    df, stream = tape
    assert ids(drain(SQ.session_highs(stream()), "highs"), "event_id", "prior_high") == ids(P.session_high_break(df, S), "event_id", "prior_high")
    assert ids(drain(SQ.halt_reopens(stream()), "opens"), "event_id") == ids(P.halt_reopen(df, S), "event_id")


def test_confirmation(spark, tape):
    df, stream = tape
    cfg = Confirm(window_sec=120, tick_multiple=0.5)
    adv = spark.createDataFrame([("A", 60_000.0), ("B", 9e9)], "ticker string, adv double")
    pick = lambda d: d.filter(F.col("event_id") % 9 == 0).select(F.col("event_id").alias("signal_id"), "ticker", "ts")
    got = {r["signal_id"]: r for r in drain(SQ.confirm(pick(stream()), stream(), adv, cfg), "confirm").collect()}
    want = {r["signal_id"]: r for r in P.confirm_volume(pick(df), df, adv, signal_id="signal_id", cfg=cfg, tie=["event_id"]).collect()}
    end = T0 + timedelta(seconds=9 * 399)
    for sid, w in want.items():
        if w["passed"] or w["ts"] + timedelta(seconds=120 + 200) < end:
            g = got[sid]
            assert (g["passed"], g["polls_ok"], g["polls_failed"]) == (w["passed"], w["polls_ok"], w["polls_failed"])
            assert abs(g["up_volume"] - w["up_volume"]) < 1e-9 and abs(g["down_volume"] - w["down_volume"]) < 1e-9
    assert len(got) == len({r for r in got})


def test_confirmation_pairs_no_poll_with_a_signal(spark, tape):
    """The stream has one state operator, keyed by ticker and time, and no join of two streams."""
    df, stream = tape
    adv = spark.createDataFrame([("A", 60_000.0)], "ticker string, adv double")
    out = SQ.confirm(stream().select(F.col("event_id").alias("signal_id"), "ticker", "ts"), stream(), adv, Confirm(window_sec=120))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("FlatMapGroupsInPandasWithState") == 1 and "Join Inner" not in plan


def test_batches_lie_in_files_of_a_task_each(spark, tmp_path):
    """Rows read by several tasks are written by as many a batch; batches stay in order, with equally many files, empty ones too."""
    from queryset import streams as Q

    rows = spark.createDataFrame([(i, T0 + timedelta(hours=0 if i < 300 else 1000 + i)) for i in range(400)], "id long, ts timestamp").repartition(6)
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.option("maxPartitionBytes", 1).parquet(str(tmp_path / "rows"))
    files = Q._files_a_batch(rows)
    assert files > 1
    batches = []
    for stream in (Q._in_order(spark, rows, "ts", "ordered"), Q._dealt(spark, rows, "id", "dealt")):
        got = {}
        for_each_batch(stream, lambda b, n, got=got: got.update({n: [(r["ts"], r["id"], r["f"]) for r in b.withColumn("f", F.input_file_name()).collect()]}),
                       fresh_folder(spark, "batches"))
        assert sorted(i for rows_ in got.values() for _, i, _ in rows_) == list(range(400))
        assert max(len({f for _, _, f in rows_}) for rows_ in got.values()) > 1
        batches.append([sorted(r[0] for r in got[n]) for n in sorted(got) if got[n]])
    assert all(a[-1] <= b[0] for a, b in zip(batches[0], batches[0][1:]))


def test_dedup_and_recycled(spark):
    rows = [(i % 7 if i % 5 else None, T0 + timedelta(seconds=i), "T", f"acme wins contract {i // 3}") for i in range(21)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp, ticker string, headline string")
    path = fresh_folder(spark, "articles")
    df.coalesce(1).write.parquet(path)
    stream = lambda: file_stream(spark, path, df.schema)
    once = [r["id"] for r in SN.dedup(stream()).collect()]
    assert sorted(i for i in once if i is not None) == sorted({r[0] for r in rows if r[0] is not None})
    assert once.count(None) == sum(r[0] is None for r in rows)
    tagged = df.withColumn("id", F.coalesce("id", F.lit(-1)))
    got = ids(drain(SN.recycled(stream().withColumn("id", F.coalesce("id", F.lit(-1)))), "recycled"), "created_at", "is_recycled")
    assert got == ids(N.recycled_headlines(tagged), "created_at", "is_recycled")


def test_late_articles_are_kept_and_counted(spark):
    """Five ids in four files, days apart and out of order, with copies in earlier and later files and a file delivered again."""
    day = timedelta(days=1)
    files = [[(1, T0 + 3 * day, "a"), (2, T0 + 3 * day, "b"), (None, T0, "n")], [(4, T0 - 9 * day, "late"), (1, T0 + 3 * day + timedelta(minutes=5), "a")],
             [(5, T0 - 40 * day, "later"), (4, T0 - 8 * day, "copy"), (5, T0 - 40 * day, "later")], [(3, T0, "c"), (None, T0, "n"), (2, None, "no time")]]
    path = fresh_folder(spark, "late")
    for rows in files:
        spark.createDataFrame(rows, "id long, created_at timestamp, headline string").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    got = [(r["id"], r["headline"]) for r in SN.dedup(stream()).collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (2, "b"), (4, "late"), (5, "later"), (3, "c"), (None, "n"), (None, "n")], key=str)
    assert len(SN.dedup(stream(), horizon_days=60).collect()) == 7
    every = spark.read.parquet(path)
    want = {r["d"]: r["n"] for r in every.filter("created_at IS NOT NULL").groupBy(F.date_trunc("day", "created_at").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert {r["window_start"]: r["articles"] for r in SN.counts(stream()).collect()} == want and sum(want.values()) == 10


def held_by_hand(bars, position, cfg=Exit()):
    """Bar by bar, over the last bars lived through. Missing values (NaN) are in no swing high, and make no ratio."""
    entry, price, stop = position
    lived = [b for b in bars if b[0] >= entry]
    for n in range(1, len(lived) + 1):
        ts, last, volume = lived[n - 1][0], *np.array([b[1:] for b in lived[max(0, n - cfg.lookback_bars): n]]).T
        if last[-1] <= stop:
            return ts, "STOP"
        move = abs(last[-1] - price) / price * 100.0 if price else 0.0
        if len(last) < 2 or not ((ts - timedelta(hours=8)).hour >= cfg.armed_hour_pt or move >= cfg.armed_move_pct):
            continue
        w, change = cfg.swing_window, np.diff(last)
        swings = [i for i in range(w, len(last) - w) if all(last[i] > last[i + k] for k in range(-w, w + 1) if k)]
        if len(last) >= 2 * w + 3 and len(swings) >= 2:
            old, new = swings[-2:]
            if last[new] > last[old] and (np.sign(change) * volume[1:])[old:new].sum() < 0:
                return ts, "SWING_DIVERGENCE"
        change, volume = change[-cfg.cvd_bars:], volume[1:][-cfg.cvd_bars:]
        if volume.sum() > 0 and (volume[change >= 0].sum() - volume[change < 0].sum()) / volume.sum() <= cfg.cvd_threshold:
            return ts, "BEARISH_VOLUME"
    return None


def test_position_monitor_by_hand(spark):
    """Four micro-batches, lives across them, entries between bars and before all bars, missing values; one state, no join."""
    rng, start = random.Random(9), datetime(2024, 1, 2, 1)
    tapes, held = {}, []
    for key, n, drift in ((1, 600, 0.0), (2, 80, 0.002), (3, 12, -0.001), (4, 300, 0.0004), (None, 5, 0.0)):
        px, tapes[key] = 50.0, []
        for i in range(n):
            px *= 1 + drift + rng.uniform(-0.004, 0.004)
            close, volume = (float("nan") if rng.random() < 0.03 else x for x in (round(px, 3), float(rng.choice([1, 5, 20]))))
            tapes[key].append((start + timedelta(minutes=3 * i), close, volume))
        for _ in range(40):
            at = rng.choice(tapes[key])
            price = rng.choice([at[1], 50.0, 0.0, float("nan")]) if rng.random() < 0.3 else at[1]
            held.append((key, at[0] + timedelta(seconds=rng.choice([0, 1, -1])), price, at[1] * rng.choice([0.5, 0.9, 0.97, 0.99])))
    held = [*{h[:2]: h for h in held}.values()]
    held += [(1, start + timedelta(days=9), 50.0, 40.0), (1, None, 50.0, 60.0), (5, start, 50.0, 60.0), held[0]]  # late, without time, without bars, twice
    missing = lambda x: None if x != x else x
    schema = "ticker long, ts timestamp, close double, volume double"
    path = fresh_folder(spark, "bars")
    rows = sorted(((t, *b) for t, each in tapes.items() for b in each), key=lambda r: r[1])
    for part in range(4):
        some = [(t, ts, missing(c), missing(v)) for t, ts, c, v in rows if (ts - start) // timedelta(minutes=150) == part or (part == 3 and ts - start >= timedelta(minutes=600))]
        some = rng.sample(some, len(some))
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(path)
    positions = spark.createDataFrame([(t, at, missing(p), missing(s)) for t, at, p, s in held], "ticker long, entry_time timestamp, entry_price double, stop_price double")
    reasons = set()
    for buckets, cfg in ((None, Exit()), (3, Exit(lookback_bars=14, cvd_threshold=-0.99, armed_move_pct=0.3))):
        want = {(key, position[0]): held_by_hand(tapes[key], position, cfg) for key, *position in held if key in tapes and key is not None and position[0] is not None}
        out = SP.monitor(file_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1), positions, cfg, buckets)
        plan = out._jdf.queryExecution().analyzed().toString()
        assert plan.count("FlatMapGroupsInPandasWithState") == 1 and "Join" not in plan
        got = [((r["ticker"], r["entry_time"]), (r["exit_time"], r["exit_reason"])) for r in drain(out, "exits").collect()]
        assert dict(got) == {k: v for k, v in want.items() if v} and len(got) == len(dict(got))
        reasons |= {r for _, r in dict(got).values()}
    assert reasons == {"STOP", "SWING_DIVERGENCE", "BEARISH_VOLUME"} and None in want.values()
