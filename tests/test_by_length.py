"""Short keys pass whole, long ones in pieces; both give what the pieces alone give."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import bars as B, matching as M, ordered
from tapeloom.operators.ordered import Running, Series, by_length, core_rows, decayed, running, uncut, with_halo
from tapeloom.plans import portfolio as P, signals as G
from test_exits import test_exits_by_hand as exits_by_hand

T0 = datetime(2024, 1, 2, 1)
S = Series(width_sec=600)


@pytest.fixture(scope="module")
def tape(spark):
    rng = random.Random(4)
    rows = [(k, T0 + timedelta(seconds=37 * i), round(50 + rng.uniform(-3, 3), 2), float(rng.choice([1, 5]))) for k, n in (("a", 300), ("b", 40), ("c", 1)) for i in range(n)]
    path = spark.createDataFrame(rows, "ticker string, ts timestamp, close double, volume double")
    return path.withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1}).cache()


def rounded(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def steps(rows, s):
    rows = running(rows, s, [Running("n", "count", F.lit(1)), Running("top", "max", F.col("close"), inclusive=False)])
    rows = decayed(rows, s, F.when(F.col("n") % 7 == 0, -150.0).otherwise(-0.4), {"x": F.col("volume")})
    near = with_halo(rows, s, before=3)
    frame = ordered.Window.partitionBy(*s.group).orderBy("ts").rowsBetween(-3, 0)
    return uncut(core_rows(near.withColumn("sum", F.sum("volume").over(frame)))).select("ticker", "ts", "n", "top", "x", "sum")


@pytest.mark.parametrize("short", [1000, 100, 0.5])
def test_parts_give_what_pieces_give(tape, short):
    assert rounded(by_length(tape, S, steps, short)) == rounded(steps(tape, S))
    assert rounded(by_length(tape, S, B.rsi, short).select("ticker", "ts", "rsi").na.fill(-1.0)) == rounded(B.rsi(tape, S).select("ticker", "ts", "rsi").na.fill(-1.0))


def test_rows_without_a_time(spark, tape):
    bars = tape.unionByName(spark.createDataFrame([("b", None, 49.0, 2.0, 50.0, 48.0), ("d", None, 1.0, 1.0, 2.0, 0.5)], tape.schema))
    assert rounded(by_length(bars, S, B.rsi).select("ticker", "ts", "rsi")) == rounded(B.rsi(bars, S).select("ticker", "ts", "rsi"))


def test_short_keys_are_shuffled_once(tape):
    out = by_length(tape, S, lambda rows, s: B.atr(running(rows, s, [Running("top", "max", F.col("close"))]), s))
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("short", [1000, 60])
def test_asof_of_stored_tables(spark, tape, short, monkeypatch):
    monkeypatch.setattr(ordered, "SHORT", short)
    left = spark.createDataFrame([(k, T0 + timedelta(seconds=s)) for k in "abcd" for s in (0, 36, 38, 1500, 20_000)] + [("a", None)], "ticker string, at timestamp")
    for forward in (False, True):
        got = [M.asof_join(left, tape, ["close"], left_ts="at", width_sec=600, forward=forward, stored=x) for x in (True, False)]
        assert sorted(map(str, got[0].collect())) == sorted(map(str, got[1].collect()))


def test_exits_of_long_keys(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SHORT", 50)
    exits_by_hand(spark)


@pytest.mark.parametrize("few", [1000, 60])
def test_vwap_of_stored_tables(spark, tape, few, monkeypatch):
    monkeypatch.setattr(P, "FEW", few)
    events = spark.createDataFrame([(k, T0 + timedelta(seconds=s), s) for k in "abcd" for s in (0, 36, 38, 1500, 11_000, 20_000)] + [("a", None, 7)], "ticker string, ts timestamp, id long")
    got = [P.trailing_vwap(events, tape, window_sec=900, stored=x).na.fill(-1.0).select("ticker", "id", "vwap") for x in (True, False)]
    assert rounded(got[0]) == rounded(got[1])


class Stored(Exception):
    pass


def test_first_articles_meet_verdicts_where_they_lie(spark, monkeypatch):
    """Without the history of headlines, articles without an id cannot become signals; the others are not dealt out twice by id."""
    def stored(df, label):
        raise Stored(df)

    monkeypatch.setattr(G, "materialise", stored)
    news = spark.createDataFrame([(i, ["T"], "Acme wins", "text", T0 + timedelta(seconds=n)) for n, i in enumerate((1, 1, 2, None))],
                                 "id long, symbols array<string>, headline string, summary string, created_at timestamp")
    verdict = "struct<catalyst: string, confidence: string, reasoning: string, is_secondhand: boolean>"
    verdicts = spark.createDataFrame([(1, ("positive", "high", "", False), None), (2, ("negative", "high", "", False), None)],
                                     f"id long, verdict {verdict}, fda struct<is_approval: boolean, confidence: string, reasoning: string>")
    words = spark.createDataFrame([("good", 1.0, True, False)], "word string, valence double, is_pos boolean, is_neg boolean")
    for recycled in (False, True):
        with pytest.raises(Stored) as found:
            G.news_signals(news, spark.createDataFrame([("T",)], "ticker string"), verdicts, words, None, None, None, None, check_recycled=recycled)
        decided = found.value.args[0]
        assert [r["id"] for r in decided.collect()] == [1]
        assert ("Union" in decided._jdf.queryExecution().optimizedPlan().toString()) == recycled
