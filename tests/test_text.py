"""Text, clock and rounding expressions."""

import difflib
import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tapeloom.functions import clock, scores as C, text as X
from tapeloom.functions.rounding import floor_div, round_exact
from tapeloom.operators import news as N
from tapeloom.operators.ordered import Series


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_rounding_is_pythons(spark):
    rng = random.Random(3)
    values = [0.505, 1.005, 2.675, 0.125, 0.375, -0.505, -2.675, 0.0, 1e-9] + [
        rng.randrange(1, 10 ** 6) / 100 * rng.choice([1.01, 1.02, 0.99, 0.5]) for _ in range(800)]
    assert column(spark, values, lambda v: round_exact(v, 2), "double") == [round(v, 2) + 0.0 for v in values]
    assert column(spark, values, lambda v: round_exact(v, 4), "double") == [round(v, 4) + 0.0 for v in values]
    assert column(spark, [1.0, 0.3, 10.0], lambda v: floor_div(v, F.lit(0.1)), "double") == [9, 2, 99]


def test_share_counts(spark):
    texts = ["5.20M", "800.00K", "12.5%", "-", "", None, "1.1b", "n/a", " 7 ", "K"]
    assert column(spark, texts, X.share_count) == [5_200_000.0, 800_000.0, 12.5, None, None, None, 1.1e9, None, 7.0, None]


def test_anchor_and_relevance(spark):
    heads = ["Why Acme Robotics Shares are up", "Nasdaq shares fall; Beta Corp to merge", "nothing here", "", None,
             "S&P 500 Shares slide", "Gamma Ray Therapeutics wins"]
    assert column(spark, heads, X.company_anchor) == [
        "Why Acme Robotics", "Beta Corp", None, None, None, None, "Gamma Ray Therapeutics"]
    rows = [("abc", "Acme Shares up", "", 2, True), ("abc", "Acme Shares up", "", 3, False), ("abc", "Acme Shares up", "see ABC.", 3, True),
            ("ab", "Acme Shares up", "abc", 3, False), ("acme", "Acme Shares up", "", 4, True), ("brk.b", "Acme Shares up", "now BRK.B rises", 3, True)]
    df = spark.createDataFrame(rows, "t string, h string, s string, n int, want boolean")
    assert all(r["ok"] == r["want"] for r in df.select("want", X.is_relevant(
        F.col("t"), F.col("h"), F.col("s"), F.col("n")).alias("ok")).collect())


def test_html_and_summary(spark):
    assert column(spark, ["a &amp; b", "x&eacute;&#39;", "plain", None], X.unescape) == ["a & b", "xé'", "plain", None]
    df = spark.createDataFrame([("sum", "<p>Hello  <b>you</b></p>"), ("Hello you too", "<p>Hello you</p>"), ("s", ""), ("s", "z" * 5000)],
                               "s string, c string")
    got = [r[0] for r in df.select(X.full_summary(F.col("s"), F.col("c"))).collect()]
    assert got == ["sum\n\nHello you", "Hello you too", "s", "s\n\n" + "z" * 5000]


def test_verdict_truthiness(spark):
    def body(flag):
        return '{"catalyst": " Positive", "confidence": "LOW ", "reasoning": "r", "is_stale_or_secondhand": %s}' % flag

    raw = [body(f) for f in ("true", "false", '"false"', '""', "null", "0", "2", "[]", "[1]", "{}", '{"a":1}')]
    raw += ["not json", "[]", '{"catalyst": "up", "confidence": "low"}', '{"catalyst": "neutral", "confidence": "high"}', None]
    got = column(spark, raw, X.parse_verdict)
    assert [g["is_secondhand"] if g else None for g in got] == [
        True, False, True, False, False, False, True, False, True, False, True, None, None, None, False, None]
    assert got[0]["catalyst"] == "positive" and got[0]["confidence"] == "low"


def test_flags_and_categories(spark):
    texts = ["SEC charges fraud", "Chapter 11 bankruptcy", "fine", ""]
    assert column(spark, texts, X.red_flag) == ["fraud", "bankruptcy", None, None]
    fda = ["FDA approves X", "FDA approval expected; PDUFA date set", "approved"]
    assert column(spark, fda, X.is_fda_candidate) == [True, False, False]
    cats = column(spark, ["tender offer with FDA clearance", "FDA approval and buyout", "uplist", "zzz"],
                  lambda v: C.news_category(v, F.lit("")))
    assert [(c["category"], c["score"]) for c in cats] == [
        ("ma_acquisition", 0.9), ("regulatory_approval", 1.0), ("uplisting_squeeze_setup", 0.6), ("uncategorized", 0.3)]
    assert column(spark, [1 / 6, 0.0, 1.0, 0.5], lambda v: C.slots(v), "double") == [2, 1, 10, 6]


def test_blank_text_scores(spark):
    news = spark.createDataFrame([(1, " ", ""), (2, "the going concern", "of the is"), (3, "is of the", None)],
                                 "id long, headline string, summary string")
    lex = spark.createDataFrame([("the", 1.9, True, False), ("of", 0.8, True, False)], "word string, valence double, is_pos boolean, is_neg boolean")
    got = {(r["id"], r["field"]): r for r in N.text_scores(news, lex).collect()}
    assert (got[1, "headline"]["p_negative"], got[1, "headline"]["p_neutral"], got[1, "summary"]["label"]) == (0.5, 1.0, "neutral")
    assert got[2, "headline"]["p_negative"] == 1.0 and got[2, "headline"]["red_flag"] == "going concern"
    assert got[3, "headline"]["p_positive"] == got[3, "summary"]["p_positive"] > 0.65
    gate = {r["id"]: r["sentiment_ok"] for r in N.sentiment_gate(news, lex).collect()}
    assert gate == {1: False, 2: False, 3: True}


def test_recycled_headlines(spark):
    rng = random.Random(2)
    words = "acme beta corp wins big contract today fda says shares rise fall board".split()
    heads = [" ".join(rng.choices(words, k=6)) for _ in range(60)]
    for i in range(10, 60, 7):
        heads[i] = "  " + heads[i - 5].upper() + " "
    heads[20] = heads[40] = "  "
    heads[59] = heads[30]
    base = datetime(2024, 1, 1)
    rows = [("T", base + timedelta(hours=3 * i), i, h) for i, h in enumerate(heads)]
    df = spark.createDataFrame(rows, "ticker string, created_at timestamp, id long, headline string")
    got = {r["id"]: r["is_recycled"] for r in N.recycled_headlines(df, Series(order=("created_at", "id"), width_sec=20_000)).collect()}
    history, want = [], {}
    for i, h in enumerate(heads):
        norm = re.sub(r"\s+", " ", h).strip().lower()
        if norm:
            want[i] = any(difflib.SequenceMatcher(None, norm, p).ratio() >= 0.85 for p in history)
            history = [*history, norm][-20:]
    assert got == want and any(want.values()) and not all(want.values())


def test_clock(spark):
    stamps = ["2024-01-02 08:59:00", "2024-01-02 09:00:00", "2024-01-02 11:59:59", "2024-01-02 12:00:00", "2024-07-02 08:00:30",
              "2024-03-10 08:00:00", "2024-11-03 09:30:00"]
    ts = lambda v: v.cast("timestamp")
    assert column(spark, stamps, lambda v: clock.session_elapsed(ts(v))) == [86_340.0, 60.0, 10_799.0, 10_800.0, 60.0, 60.0, 1800.0]
    assert column(spark, stamps, lambda v: clock.is_pre_session(ts(v))) == [True, True, True, False, True, True, True]
    assert column(spark, ["2024-01-02 13:59:59", "2024-01-02 14:00:00", "2024-07-02 13:00:00"],
                  lambda v: clock.hour_of_day(ts(v), clock.PACIFIC)) == [5, 6, 6]
