"""Bar analytics against small Python restatements, at the lengths where frames and seeds begin."""

import math
import random
from datetime import datetime, timedelta

import pytest

from tapeloom.config import Stop
from tapeloom.operators import bars as B
from tapeloom.operators.ordered import Series

S = Series(width_sec=600)
T0 = datetime(2024, 1, 2, 14)


@pytest.fixture(scope="module")
def tape(spark):
    rng = random.Random(11)
    data = []
    for ticker, n in [(f"N{n}", n) for n in (1, 2, 6, 7, 13, 14, 15, 90)] + [("FLAT", 20)]:
        price = 10.0
        for i in range(n):
            price = 10.0 if ticker == "FLAT" else round(max(0.5, price + rng.choice([-1, -0.5, 0, 0, 0.5, 1])), 2)
            hi, lo = price + rng.choice([0, 0.25]), price - rng.choice([0, 0.25])
            data.append((ticker, T0 + timedelta(minutes=i * (1 if i % 7 else 9) + i), price, hi, lo, price, float(rng.choice([0, 100, 250]))))
    series = {}
    for r in sorted(data, key=lambda r: r[1]):
        series.setdefault(r[0], []).append(r)
    return series, spark.createDataFrame(data, "ticker string, ts timestamp, open double, high double, low double, close double, volume double")


def swings(c, w, sign):
    return [i for i in range(w, len(c) - w) if all(sign * c[i] > sign * c[i + k] for k in range(-w, w + 1) if k)]


def obv(rows):
    out, total = [], 0.0
    for i, r in enumerate(rows):
        if i:
            d = r[5] - rows[i - 1][5]
            total += ((d > 0) - (d < 0)) * r[6]
        out.append(total)
    return out


def test_obv_swings_divergence(tape):
    series, df = tape
    got_obv = {(r["ticker"], r["ts"]): r["obv"] for r in B.obv(df, S).collect()}
    highs = {(r["ticker"], r["ts"]) for r in B.swing_highs(df, S).collect()}
    lows = {r["ticker"]: r["swing_low_price"] for r in B.last_swing_low(df, S).collect()}
    div = {r["ticker"]: r["divergence"] for r in B.swing_divergence(df, S).collect()}
    for t, rows in series.items():
        c, o = [r[5] for r in rows], obv(rows)
        assert [got_obv[t, r[1]] for r in rows] == o
        hi, lo = swings(c, 2, 1), swings(c, 2, -1)
        assert {ts for k, ts in highs if k == t} == {rows[i][1] for i in hi}
        assert lows[t] == (c[lo[-1]] if lo else None)
        assert div[t] == (len(hi) >= 2 and c[hi[-1]] > c[hi[-2]] and o[hi[-1]] < o[hi[-2]])


def test_atr_rsi_stop(tape):
    series, df = tape
    got = {(r["ticker"], r["ts"]): r["atr"] for r in B.atr(df, S).collect()}
    rsi = {(r["ticker"], r["ts"]): r["rsi"] for r in B.rsi(df, S).collect()}
    stops = {r["ticker"]: r for r in B.stop_per_ticker(df, S).collect()}
    for t, rows in series.items():
        tr = [max(r[3] - r[4], *(abs(x - rows[i - 1][5]) for x in (r[3], r[4]))) if i else r[3] - r[4] for i, r in enumerate(rows)]
        atr = None
        for i, r in enumerate(rows):
            atr = None if i < 13 else sum(tr[:14]) / 14 if i == 13 else (atr * 13 + tr[i]) / 14
            assert (got[t, r[1]] is None) == (atr is None) and (atr is None or math.isclose(got[t, r[1]], atr, rel_tol=1e-9, abs_tol=1e-12))
        implied = 2.5 * atr / rows[-1][5] if atr is not None else 0.10
        pct = max(0.02, min(implied, 0.10))
        assert math.isclose(stops[t]["stop_pct"], pct, rel_tol=1e-9) and stops[t]["stop_capped"] == (implied >= 0.10)
        assert all(v is None or 0 <= v <= 100 for (k, _), v in rsi.items() if k == t)
    assert rsi["FLAT", series["FLAT"][-1][1]] == 50.0


def test_vwap_and_cvd(spark, tape):
    series, df = tape
    from pyspark.sql import functions as F
    vwap = {r["ticker"]: r["vwap"] for r in B.session_vwap(df.withColumn("session", F.lit(1))).collect()}
    cvd = {r["ticker"]: r for r in B.cvd_significance(df, S).collect()}
    for t, rows in series.items():
        v = sum(r[6] for r in rows)
        assert vwap[t] is None if v <= 0 else math.isclose(vwap[t], sum(r[5] * r[6] for r in rows) / v)
        tail = rows[-6:]
        up = sum(b[6] for a, b in zip(tail, tail[1:]) if b[5] >= a[5])
        down = sum(b[6] for a, b in zip(tail, tail[1:]) if b[5] < a[5])
        ratio = (up - down) / (up + down) if up + down else 0.0
        assert math.isclose(cvd[t]["net_cvd_ratio"], ratio, abs_tol=1e-12)
        assert cvd[t]["significant"] == (len(tail) >= 2 and ratio <= -0.5)


def test_stop_without_price(spark):
    df = spark.createDataFrame([(0.0, 1.0), (-1.0, 1.0), (10.0, None), (100.0, 0.1), (10.0, 3.0)], "entry_price double, atr double")
    got = [(r["stop_pct"], r["stop_capped"]) for r in B.entry_stop(df, Stop()).collect()]
    assert got == [(0.10, True), (0.10, True), (0.10, True), (0.02, False), (0.10, True)]
