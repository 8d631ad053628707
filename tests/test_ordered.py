"""Two-level ordered operators against plain Python, with a hot key, sparse pieces and tied times."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from tapeloom.operators.matching import asof_join, open_at, range_join
from tapeloom.operators.ordered import Running, Series, core_rows, decayed, running, tail_rows, uncut, with_halo

T0 = datetime(2024, 3, 8)
S = Series(order=("ts", "n"), width_sec=3600)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for n in range(600):
        key = "HOT" if rng.random() < 0.7 else rng.choice("ABC")
        ts = T0 + timedelta(seconds=rng.choice([rng.randrange(0, 90_000), rng.randrange(0, 40) * 3600]))
        data.append((key, ts, n, rng.choice([None, round(rng.uniform(-5, 5), 2)])))
    data.append(("ONE", T0, 9999, 1.0))
    return data, spark.createDataFrame(data, "ticker string, ts timestamp, n long, v double")


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_running(rows):
    data, df = rows
    got = {r["n"]: r for r in uncut(running(df, S, [
        Running("s", "sum", F.col("v")), Running("m", "max", F.col("v"), False), Running("c", "count", F.lit(1), False),
        Running("l", "last", F.col("v"), False)])).collect()}
    for series in by_key(data).values():
        total, top, last = None, None, None
        for i, (_, _, n, v) in enumerate(series):
            assert got[n]["m"] == top and got[n]["l"] == last and got[n]["c"] == i
            if v is not None:
                total, top, last = (total or 0.0) + v, v if top is None else max(top, v), v
            assert (got[n]["s"] is None) == (total is None) and (total is None or math.isclose(got[n]["s"], total, abs_tol=1e-9))


def test_halo_frames(rows):
    data, df = rows
    near = with_halo(df, S, before=7, after=3)
    w = Window.partitionBy(*S.group).orderBy(*S.order)
    got = {r["n"]: (r["b"], r["a"]) for r in core_rows(near.withColumn("b", F.collect_list("n").over(w.rowsBetween(-7, -1)))
                                                     .withColumn("a", F.collect_list("n").over(w.rowsBetween(1, 3)))).collect()}
    assert len(got) == len(data)
    for series in by_key(data).values():
        ids = [r[2] for r in series]
        for i, n in enumerate(ids):
            assert got[n] == (ids[max(0, i - 7):i], ids[i + 1:i + 4])


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_asof(spark, rows, strict, forward):
    data, df = rows
    events = [(k, T0 + timedelta(seconds=s), i) for i, (k, s) in enumerate(
        (k, s) for k in ("HOT", "A", "NONE") for s in (-5, 0, 3600, 7200, 40_000, 89_999, 500_000))]
    left = spark.createDataFrame(events, "ticker string, ts timestamp, id long")
    got = {r["id"]: r["n"] for r in asof_join(left, df, ["n"], tie=["n"], width_sec=3600, strict=strict, forward=forward).collect()}
    series = by_key(data)
    for key, ts, i in events:
        rows_ = series.get(key, [])
        if forward:
            hits = [r[2] for r in rows_ if (r[1] > ts if strict else r[1] >= ts)]
            assert got[i] == (hits[0] if hits else None)
        else:
            hits = [r[2] for r in rows_ if (r[1] < ts if strict else r[1] <= ts)]
            assert got[i] == (hits[-1] if hits else None)


def test_decayed_long_series(spark):
    n = 3000
    data = [("K", T0 + timedelta(seconds=40 * i), i, -0.3 if i % 400 else -900.0, float(i % 5)) for i in range(n)]
    df = spark.createDataFrame(data, "ticker string, ts timestamp, n long, d double, b double")
    got = {r["n"]: r["x"] for r in uncut(decayed(df, S, F.col("d"), {"x": F.col("b")})).collect()}
    x = 0.0
    for _, _, i, d, b in data:
        x = math.exp(d) * x + b
        assert math.isclose(got[i], x, rel_tol=1e-9, abs_tol=1e-12)


def test_open_at_and_tail_and_range(spark, rows):
    data, df = rows
    spans = [("HOT", T0, T0 + timedelta(hours=2)), ("HOT", T0 + timedelta(hours=1), T0 + timedelta(hours=1, minutes=5)),
             ("A", T0 + timedelta(hours=5), None)]
    held = spark.createDataFrame(spans, "ticker string, entry_time timestamp, exit_time timestamp")
    got = {r["n"]: r["is_open"] for r in open_at(df, held, width_sec=3600).collect()}
    for key, ts, n, _ in data:
        assert got[n] == any(k == key and a <= ts and (b is None or ts < b) for k, a, b in spans)
    tails = {}
    for r in tail_rows(df, S, 4).collect():
        tails.setdefault(r["ticker"], []).append(r["n"])
    assert {k: sorted(v) for k, v in tails.items()} == {k: sorted(r[2] for r in v[-4:]) for k, v in by_key(data).items()}
    closed = held.filter("exit_time IS NOT NULL")
    pairs = range_join(df.select("ticker", "ts", "n"), closed, F.col("entry_time"), F.col("exit_time"), width_sec=900).count()
    assert pairs == sum(1 for k, t, _, _ in data for a, s, e in spans if e and a == k and s <= t <= e)
