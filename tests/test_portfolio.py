"""Capital, positions, confirmation and sources against plain Python."""

import csv
import glob
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tapeloom.config import Confirm
from tapeloom.operators.quotes import confirm_volume
from tapeloom.plans import portfolio as P
from tapeloom.plans.exits import secondary_armed
from tapeloom.sources import market, orders as O, reference

T0 = datetime(2024, 1, 2, 15)


def test_slot_allocation(spark):
    rng = random.Random(4)
    rows = [(r, i, rng.choice([0, 1, 3, 12]), rng.random() < 0.05) for r in ("a", "b", "c") for i in range(40)]
    rows += [("fda", 0, 9, False), ("fda", 1, 1, True), ("fda", 2, 1, True), ("full", 0, 10, False), ("full", 1, 1, True)]
    df = spark.createDataFrame(rows, "run string, seq long, request int, is_fda boolean")
    got = {(r["run"], r["seq"]): r["allocated"] for r in P.allocate_slots(df).collect()}
    left = {}
    for run, seq, request, fda in rows:
        pool = left.get(run, 10)
        want = pool if fda else min(max(1, min(request or 1, 10)), pool)
        assert got[run, seq] == want
        left[run] = pool - want


def test_single_position(spark):
    rng = random.Random(9)
    rows = []
    for run in ("x", "y"):
        for i in range(120):
            start = T0 + timedelta(minutes=rng.randrange(0, 4000))
            hold = rng.choice([0, 5, 30, 90, 400])
            rows.append((run, len(rows), start, start + timedelta(minutes=hold)))
    for i, (a, b) in enumerate(((0, 10), (5, 100), (10, 10), (10, 20), (10, 10), (20, 20), (20, 25), (20, 20), (22, 22), (25, 25))):
        rows.append(("r", len(rows), T0 + timedelta(minutes=a), T0 + timedelta(minutes=b)))
    for i in range(400):  # many ties of positions that end as they start with longer ones
        start = T0 + timedelta(minutes=rng.randrange(0, 60))
        rows.append(("t", len(rows), start, start + timedelta(minutes=rng.choice([0, 0, 1, 3]))))
    rows.append(("z", len(rows), T0, None))
    rows.append(("z", len(rows), T0 + timedelta(days=3), None))
    df = spark.createDataFrame(rows, "run string, seq long, entry_time timestamp, exit_time timestamp")
    got = {r["seq"]: r["accepted"] for r in P.single_position(df, width_sec=20_000).collect()}
    busy = {}
    for run, seq, start, end in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        ok = busy.get(run) is None or start >= busy[run]
        if ok:
            busy[run] = end or datetime.max
        assert got[seq] == ok, (run, seq)


def test_ladder_and_quantity(spark):
    prices = [0.5, 10.5, 99.995, 123.45, 3.335]
    df = spark.createDataFrame([(p,) for p in prices], "ref_price double")
    got = {(r["ref_price"], r["attempt"]): r["limit_price"] for r in P.limit_ladder(df).collect()}
    for p in prices:
        for k in range(1, 6):
            assert got[p, k] == round(p * (1 + (0.01 + 0.01 * (k - 1))), 2)
    rows = [(250.0, 1, 9, False), (250.0, 1, 1, False), (250.0, 1, 9, True), (2000.0, 1, 9, False), (33.0, 2, 0, False)]
    df = spark.createDataFrame(rows, "price double, slots int, remaining int, is_fda boolean")
    out = [(r["slots_used"], r["quantity"]) for r in P.share_quantity(df, F.lit(100.0)).collect()]
    assert out == [(3, 1), (2, 0), (1, 0), (10, 0), (2, 6)]


def test_trailing_vwap(spark):
    rng = random.Random(1)
    bars = [("T", T0 + timedelta(minutes=rng.randrange(0, 9000)), 0.0, 0.0, 0.0, rng.uniform(1, 9), float(rng.choice([0, 5, 50])))
            for _ in range(400)]
    bars = list({b[1]: b for b in bars}.values())
    events = [("T", T0 + timedelta(minutes=m), m) for m in (-10, 0, 30, 1440, 2881, 5000, 8999, 30_000)]
    b = spark.createDataFrame(bars, "ticker string, ts timestamp, open double, high double, low double, close double, volume double")
    e = spark.createDataFrame(events, "ticker string, ts timestamp, id long")
    got = {r["id"]: r["vwap"] for r in P.trailing_vwap(e, b).collect()}
    for _, ts, i in events:
        inside = [x for x in bars if ts - timedelta(days=1) <= x[1] <= ts]
        v = sum(x[6] for x in inside)
        want = sum(x[5] * x[6] for x in inside) / v if v > 0 else None
        assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) < 1e-9)


def test_confirmation_poll_by_poll(spark):
    rng = random.Random(8)
    cfg, adv = Confirm(window_sec=60, tick_multiple=2.0), 39_000.0
    polls, total = [], 0.0
    for i in range(900):
        total = total + rng.choice([0, 20, 90]) if rng.random() > 0.02 else total - 50
        last = round(rng.uniform(9.9, 10.1), 2)
        polls.append(("T", T0 + timedelta(seconds=i), i, last, 9.95, 10.05, None if rng.random() < 0.1 else total))
    signals = [(s, "T", T0 + timedelta(seconds=s * 23)) for s in range(38)] + [(99, "NOQUOTE", T0), (100, "T", T0 + timedelta(days=2))]
    q = spark.createDataFrame(polls, "ticker string, ts timestamp, n long, last double, bid double, ask double, total_volume double")
    s = spark.createDataFrame(signals, "sid long, ticker string, ts timestamp")
    a = spark.createDataFrame([("T", adv)], "ticker string, adv double")
    got = {r["sid"]: r for r in confirm_volume(s, q, a, signal_id="sid", cfg=cfg, tie=["n"]).collect()}
    assert len(got) == len(signals)
    base = adv * 60 / 23_400
    for sid, ticker, at in signals:
        start = top = prev = None
        up = down = 0.0
        ok = failed = 0
        passed = False
        for t, ts, _, last, bid, ask, vol in polls:
            if t != ticker or not at <= ts <= at + timedelta(seconds=60):
                continue
            if vol is None:
                failed += 1
                continue
            ok += 1
            if start is None:
                start = top = vol
            else:
                d = max(vol - start - (up + down), 0.0)
                if d > 0:
                    if last >= ask or (last > bid and last > prev):
                        up += d
                    elif last <= bid or last < prev:
                        down += d
                    else:
                        up, down = up + d / 2, down + d / 2
            prev = last
            if up + down > 0 and (up + down) / base >= 2.0 and up / (up + down) >= 0.6:
                passed = True
                break
        r = got[sid]
        assert (r["passed"], r["polls_ok"], r["polls_failed"]) == (passed, ok, failed), sid
        assert abs(r["up_volume"] - up) < 1e-9 and abs(r["down_volume"] - down) < 1e-9
        assert r["data_quality"] == ("NO_DATA" if not ok else "PARTIAL" if failed else "OK")


def test_secondary_armed(spark):
    rows = [("2024-01-02 13:59:00", 104.9, False), ("2024-01-02 14:00:00", 100.0, True), ("2024-01-02 09:00:00", 105.0, True), ("2024-01-02 09:00:00", 94.0, True)]
    df = spark.createDataFrame(rows, "t string, px double, want boolean").select(
        "want", secondary_armed(F.col("t").cast("timestamp"), F.col("px"), F.lit(100.0)).alias("got"))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_quote_payloads(spark):
    raw = spark.createDataFrame([
        ('{"A": {"quote": {"lastPrice": 0, "mark": 2.5, "closePrice": 2, "totalVolume": 7}, "fundamental": {"avg10DaysVolume": 0, "avg1YearVolume": 9}}}',),
        ('{"A": {"quote": {}}, "B": {"quote": {"closePrice": 0}, "fundamental": {}}}',), ("{}",)], "payload string")
    one = market.quote_of(raw, F.lit("A")).collect()
    assert [r["last"] for r in one] == [2.5, None, None] and one[0]["previous_close"] == 2.0
    assert sorted((r["ticker"], r["last"]) for r in market.quotes_of(raw).collect()) == [("A", 2.5), ("B", 0.0)]
    assert [(r["ticker"], r["adv"]) for r in market.volume_averages(raw).collect()] == [("A", 9.0)]
    candles = spark.createDataFrame([("A", 1_704_200_000_000, 1.0, 1.0, 1.0, 1.0, 5.0), ("A", 1_704_200_060_000, 1.0, None, 1.0, 1.0, 5.0)],
                                    "ticker string, datetime long, open double, high double, low double, close double, volume double")
    assert market.bars_from_candles(candles).count() == 1
    assert market.bars_from_candles(candles.limit(0)).count() == 0


def test_reference_sources(spark):
    pages = spark.createDataFrame([(1, '<a href="q?x=1&t=abc&y"> <a href="q?t=BRK.B"> <a t=no'), (2, "<a href='?t=ABC'>?t=zz&"), (3, "t=none")],
                                  "page_id long, html string")
    got = sorted((r["first_page"], r["first_pos"], r["ticker"]) for r in reference.tickers_from_pages(pages).collect())
    assert got == [(1, 0, "ABC"), (1, 1, "BRK.B"), (2, 1, "ZZ")]
    assert [r["is_empty"] for r in reference.tickers_per_page(pages).orderBy("page_id").collect()] == [False, False, True]
    cash = spark.createDataFrame([("a", None, "100", "5"), ("b", "7", "100", "5"), ("c", None, None, None), ("d", "x", "0", None), ("e", None, None, "3")],
                                 "account string, buyingPower string, cashAvailableForWithdrawal string, cashBalance string")
    got = {r["account"]: (r["problem"], r["per_slot"]) for r in reference.buying_power(cash).collect()}
    assert got == {"a": (None, 10.0), "b": ("UNEXPECTED_FIELD", None), "c": ("MISSING", None), "d": ("NOT_POSITIVE", None), "e": ("UNEXPECTED_FIELD", None)}


def test_orders_and_log(spark, tmp_path):
    schema = ("order_id long, status string, filledQuantity double, price double, "
              "orderActivityCollection array<struct<executionLegs: array<struct<quantity: double, price: double>>>>")
    rows = [(1, "FILLED", 3.0, 9.0, [([(1.0, 10.0), (2.0, 13.0)],), ([(0.0, 5.0)],)]), (2, "FILLED", None, 9.0, []), (3, "WORKING", None, 9.0, None),
            (4, "FILLED", 1.0, None, [(None,)])]
    got = {r["order_id"]: (r["avg_fill_price"], r["filled_quantity"]) for r in O.order_fills(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (12.0, 3.0), 2: (9.0, 0.0), 3: (None, 0.0), 4: (None, 1.0)}
    trades = spark.createDataFrame([("ENTRY", "A", T0, 1.00005, 3.0, None, "r", "h"), ("EXIT", "A", T0, 2.0, 3.0, 0.125, "stop", None),
                                    ("ENTRY_ATTEMPT_UNFILLED", "B", T0, 2.0, 0.0, None, "r", "h")],
                                   "event string, ticker string, time timestamp, price double, quantity double, pnl_pct double, reason string, headline string")
    path = str(tmp_path / "log")
    for batch in (0, 1, 1):  # the second batch is delivered twice
        O.append_trade_log(trades.coalesce(1), path, batch)
    with open(glob.glob(path + "/_header/*.txt")[0]) as head, open(glob.glob(path + "/batch=0/*.csv")[0]) as f:
        rows = list(csv.DictReader([*head, *f]))
    assert list(rows[0]) == ["event", "ticker", "time", "price", "value", "reason", "headline"]
    trades.write.csv(path + "/batch=7")  # a batch that broke before it was listed
    again = [r.asDict() for r in O.read_trade_log(spark, path).collect()]
    key = lambda r: sorted(r.items())
    assert sorted(again, key=key) == sorted(rows * 2, key=key)
    assert [r["price"] for r in rows] == [f"{1.00005:.4f}", "2.0000", "2.0000"]
    assert [r["value"] for r in rows] == ["qty=3", f"{0.125:+.2f}", "unfilled"]
