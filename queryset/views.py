"""Market-shaped inputs derived by Spark from the given tables, whole, and the same views as DuckDB SQL.

Each Spark view has a twin in ``SQL`` with the same columns. Scan pieces and thresholds that fit the
density of this data are set here once; the library defaults stay untouched.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tapeloom.config import Confirm, Engine, Scan
from tapeloom.operators import bars as B
from tapeloom.operators.ordered import Running, Series, by_length, running, uncut
from tapeloom.session import materialise

DAY = 86_400
BAR_SERIES = Series(width_sec=1200 * DAY)
QUOTE_SERIES = Series(order=("ts", "event_id"), width_sec=DAY)
SCAN = replace(Scan(), rvol_min=0.5, min_volume=1000.0, scan_interval_sec=3600)
CONFIRM = replace(Confirm(), window_sec=21_600, tick_multiple=0.2)
ENGINE = replace(Engine(), scan=SCAN, confirm=CONFIRM)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ts(name: str) -> Column:
    return F.col(name).cast("timestamp")


# ---------------------------------------------------------------- bars

def ticks(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return (table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("ticker"), _ts("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("wild_px"),
        (F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("calm_px"),
        F.col("l_quantity").alias("qty"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq")))


def bars_calm(spark: SparkSession, sf: str) -> DataFrame:
    return B.from_ticks(ticks(spark, sf), "calm_px", "qty", F.col("seq"))


def bars_wild(spark: SparkSession, sf: str) -> DataFrame:
    return B.from_ticks(ticks(spark, sf), "wild_px", "qty", F.col("seq"))


# ---------------------------------------------------------------- quotes

def _polls(spark: SparkSession, sf: str) -> DataFrame:
    return polls_of(table(spark, sf, "events"))


def polls_of(e: DataFrame) -> DataFrame:
    """Event rows (batch or stream) as quote polls."""
    ts = _ts("ts")
    second = F.floor(F.pmod(F.unix_micros(ts), F.lit(DAY * 1_000_000)) / F.lit(1e6))
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        "event_id", F.concat(F.lit("T"), F.col("user_id") % 5).alias("ticker"), ts.alias("ts"),
        F.to_date(ts).alias("d"), F.col("value").alias("last"),
        (F.col("value") * (1 - (F.col("event_id") % 7) * F.lit(4e-3))).alias("bid"),
        (F.col("value") * (1 + (F.col("event_id") % 5) * F.lit(4e-3))).alias("ask"),
        F.when(F.col("event_id") % 10 != 3, F.floor(second / 20) + k).alias("total_volume"),
        k.alias("k"), "event_type",
        F.when(F.col("event_type") == "error", "Halted").otherwise("Normal").alias("security_status"))


def prior_closes(spark: SparkSession, sf: str) -> DataFrame:
    """Close of the ticker's previous day with polls, per day."""
    polls = _polls(spark, sf)
    daily = polls.groupBy("ticker", "d").agg(F.max_by("last", F.struct("ts", "event_id")).alias("c"))
    daily = daily.withColumn("day_ts", F.col("d").cast("timestamp"))
    days = Series(order=("day_ts",), width_sec=365 * DAY)
    prior = uncut(running(daily, days, [Running("previous_close", "last", F.col("c"), inclusive=False)]))
    return prior.select("ticker", "d", "previous_close")


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    return _polls(spark, sf).join(prior_closes(spark, sf), ["ticker", "d"], "left").drop("d", "k", "event_type")


def quote_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Minute bars of the polled tickers; the k of a poll is its traded quantity."""
    return B.from_ticks(_polls(spark, sf), "last", "k", F.col("event_id"))


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Each view event holds its ticker for k minutes."""
    return _polls(spark, sf).filter(F.col("event_type") == "view").select("ticker", F.col("ts").alias("entry_time"),
                    F.timestamp_micros(F.unix_micros("ts") + F.col("k").cast("bigint") * 60_000_000).alias("exit_time"))


def trade_events(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases enter, sign-ups leave."""
    e = table(spark, sf, "events").filter(F.col("event_type").isin("purchase", "signup"))
    return e.select(
        "event_id", F.concat(F.lit("T"), F.col("user_id") % 5).alias("ticker"), _ts("ts").alias("ts"),
        F.when(F.col("event_type") == "purchase", "ENTRY").otherwise("EXIT").alias("event"),
        F.col("value").alias("price"))


def adv(spark: SparkSession, sf: str) -> DataFrame:
    daily = _polls(spark, sf).groupBy("ticker", "d").agg(F.max("total_volume").alias("v"))
    return daily.groupBy("ticker").agg(F.avg("v").alias("adv"))


# ---------------------------------------------------------------- news

def _headline_prefix() -> Column:
    phrases = {0: "FDA approves new drug: ", 1: "Why shares of Acme rise: ",
               2: "Acme Corp to be acquired: ", 3: "Company raises guidance: ",
               4: "Going concern doubt: ", 5: "PDUFA date set, FDA approval awaited: ",
               6: "Nova Robotics Shares jump; "}
    out = F.lit("")
    for n, text in phrases.items():
        out = F.when(F.col("doc_id") % 13 == n, text).otherwise(out)
    return out


def news_once(spark: SparkSession, sf: str) -> DataFrame:
    return news_of(table(spark, sf, "documents"))


def news_time() -> Column:
    return F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("doc_id") * 7919) % 2_592_000)


def news_of(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Whole documents as articles: the first sentence is the headline, all the rest the summary."""
    t = lambda n: F.concat(F.lit("T"), (F.col("doc_id") + n) % 5)
    first = F.regexp_extract("text", r"^[^.\n]*", 0)
    return documents.select(
        *keep,
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 3 == 0, F.array(t(0), t(1), t(2), F.lit("X9")))
        .otherwise(F.array(t(0))).alias("symbols"),
        F.concat(_headline_prefix(), first).alias("headline"),
        F.expr(r"substring(text, length(regexp_extract(text, '^[^.\\n]*', 0)) + 1)").alias("summary"),
        news_time().alias("created_at"))


def news(spark: SparkSession, sf: str) -> DataFrame:
    """Articles plus the repeats that a backfill delivers five minutes later under the same id."""
    once = news_once(spark, sf)
    return once.unionByName(backfill(spark, sf))


def backfill(spark: SparkSession, sf: str) -> DataFrame:
    return news_once(spark, sf).withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 300 SECONDS"))


def verdicts_raw(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    catalyst = F.when(d % 4 == 0, "negative").when(d % 4 == 1, "neutral").otherwise(" Positive ")
    confidence = F.when(d % 3 == 0, "high").when(d % 3 == 1, "medium").otherwise("low")
    stale = F.when(d % 5 == 0, "true").when(d % 19 == 0, '"false"').otherwise("false")
    approval = F.when(d % 2 == 0, "true").otherwise('""')
    body = F.concat(F.lit('{"catalyst": "'), catalyst, F.lit('", "confidence": "'), confidence,
                    F.lit('", "reasoning": "one short sentence", "is_stale_or_secondhand": '), stale,
                    F.lit("}"))
    fda = F.concat(F.lit('{"is_explicit_approval": '), approval, F.lit(', "confidence": "'), confidence,
                   F.lit('", "reasoning": "one short sentence"}'))
    return table(spark, sf, "documents").select(
        d.alias("id"), F.when(d % 17 == 0, "not json").otherwise(body).alias("raw_json"),
        F.when(d % 23 == 0, "[]").otherwise(fda).alias("fda_json"))


# ---------------------------------------------------------------- reference data

def fundamentals_text(spark: SparkSession, sf: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size").cast("string")
    shares = (F.when(p % 6 == 0, F.concat(size, F.lit(".20M"))).when(p % 6 == 1, F.concat(size, F.lit("00.00K")))
              .when(p % 6 == 2, "-").when(p % 6 == 3, F.concat(size, F.lit(".5%")))
              .when(p % 6 == 4, "1.10b").otherwise("n/a"))
    return table(spark, sf, "part").select(
        p.alias("ticker"), shares.alias("shs_float"),
        F.concat(size, F.lit("%")).alias("short_float"), size.alias("short_ratio"),
        F.concat((F.col("p_retailprice") / 10).cast("int").cast("string"), F.lit(".5K")).alias("avg_volume"),
        (F.col("p_size") * 10_000_000.0).alias("market_cap"))


def fundamentals_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Each sign-up event is a fundamentals snapshot of its ticker."""
    e = table(spark, sf, "events").filter(F.col("event_type") == "signup")
    return e.select("event_id", F.concat(F.lit("T"), F.col("user_id") % 5).alias("ticker"),
                    _ts("ts").alias("fetched_at"), (F.col("value") * 40_000.0).alias("float_shares"))


def orders_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a nested execution report: two legs, one of them sometimes empty, or none."""
    o = F.col("o_orderkey")
    leg1 = F.struct((1 + F.col("o_custkey") % 5).cast("double").alias("quantity"),
                    (F.col("o_totalprice") / 100).alias("price"))
    leg2 = F.struct((o % 3).cast("double").alias("quantity"),
                    (F.col("o_totalprice") / 101).alias("price"))
    activity = lambda legs: F.struct(legs.alias("executionLegs"))
    empty = F.expr("CAST(array() AS array<struct<executionLegs: array<struct<quantity: double, price: double>>>>)")
    return table(spark, sf, "orders").select(
        o.alias("order_id"),
        F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "O", "WORKING")
        .otherwise("CANCELED").alias("status"),
        F.when(o % 4 != 0, (1 + F.col("o_custkey") % 5).cast("double")).alias("filledQuantity"),
        F.when(o % 11 != 0, F.col("o_totalprice")).alias("price"),
        F.when(o % 5 == 0, empty).otherwise(
            F.array(activity(F.array(leg1)), activity(F.array(leg2)))).alias("orderActivityCollection"))


def balances(spark: SparkSession, sf: str) -> DataFrame:
    c, bal = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("account"),
        F.when(c % 4 == 0, bal.cast("string")).when(c % 4 == 1, "n/a").alias("buyingPower"),
        F.when(c % 3 != 0, (bal * 2).cast("string")).alias("cashAvailableForWithdrawal"),
        F.when(c % 5 != 0, "0").alias("cashBalance"))


# ---------------------------------------------------------------- trading

def stored(df: DataFrame, label: str) -> DataFrame:
    """A derived feed written once, as a collector would, for queries that read it many times."""
    return materialise(df, label)


def closing_highs(bars: DataFrame) -> DataFrame:
    """Bars of a stored table that set a new closing high of their ticker, with its ATR."""

    def step(rows: DataFrame, s: Series) -> DataFrame:
        high = running(rows, s, [Running("_high", "max", F.col("close"), inclusive=False)])
        return B.atr(high, s).filter(F.col("close") > F.col("_high"))

    return by_length(bars.select("ticker", "ts", "high", "low", "close"), BAR_SERIES, step)


def positions(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> DataFrame:
    """Every calm bar that sets a new closing high of its ticker opens a position, with its stop."""
    rows = closing_highs(bars if bars is not None else stored(bars_calm(spark, sf), "bars")).select(
        "ticker", F.col("ts").alias("entry_time"), F.col("close").alias("entry_price"),
        (1 + F.col("ticker") % 9).cast("double").alias("quantity"), "atr")
    return B.entry_stop(rows)


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        _ts("o_orderdate").cast("date").alias("run"), F.col("o_orderkey").alias("seq"),
        (F.col("o_custkey") % 20).alias("ticker"), (1 + F.col("o_orderkey") % 6).cast("int").alias("request"),
        ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 7 == 0)).alias("is_fda"),
        F.col("o_totalprice").alias("price"))


def quote_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase event asks for an entry into its ticker at its own time."""
    return quote_signals_of(table(spark, sf, "events"))


def quote_signals_of(e: DataFrame) -> DataFrame:
    return e.filter(F.col("event_type") == "purchase").select(F.col("event_id").alias("signal_id"), F.concat(F.lit("T"), F.col("user_id") % 5).alias("ticker"),
                    _ts("ts").alias("ts"), (1 + F.col("event_id") % 6).cast("int").alias("request"),
                    (F.col("event_id") % 31 == 0).alias("is_fda"), F.to_date(_ts("ts")).alias("run"))


def new_highs(spark: SparkSession, sf: str, bars: DataFrame) -> DataFrame:
    """Every calm bar that sets a new closing high of its ticker asks for an entry; a month is a run."""
    return closing_highs(bars).select(
        F.trunc("ts", "month").alias("run"), "ticker", "ts", F.col("close").alias("price"), "atr",
        (1 + F.col("ticker") % 6).cast("int").alias("request"), (F.col("ticker") % 31 == 0).alias("is_fda"))


def trade_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Order attempts on a bar: its ticks in order, each with the status of its order and a report of two legs, one, or none."""
    part, orders = table(spark, sf, "part").select("p_partkey", "p_retailprice"), table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    o, px = F.col("l_orderkey"), F.col("p_retailprice") * (1 - F.col("l_discount"))
    rows = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, o == F.col("o_orderkey"))
    leg = lambda q, p: F.struct(q.cast("double").alias("quantity"), p.alias("price"))
    # ranked while they are narrow; the reports are made of the ranked rows
    rows = rows.select(F.col("l_partkey").alias("ticker"), _ts("l_shipdate").alias("ts"), (o * 8 + F.col("l_linenumber")).alias("order_id"), o.alias("_o"),
                       F.col("o_orderstatus").alias("_status"), F.col("l_quantity").alias("_qty"), px.alias("_px"))
    rows = rows.withColumn("attempt", F.row_number().over(Window.partitionBy("ticker", "ts").orderBy("order_id")))
    o, qty, px, status = F.col("_o"), F.col("_qty"), F.col("_px"), F.col("_status")
    return rows.select(
        "ticker", "ts", "order_id", F.when(status == "F", "FILLED").when(status == "O", "WORKING").otherwise("CANCELED").alias("status"),
        qty.alias("filledQuantity"), F.when(o % 11 != 0, px).alias("price"),
        F.when(o % 5 != 0, F.array(F.struct(F.array(leg(qty, px), leg(o % 3, px * 1.01)).alias("executionLegs")))).alias("orderActivityCollection"), "attempt")


LEXICON_ROWS = [("the", 1.9, True, False), ("and", -1.2, False, True), ("of", 0.8, True, False),
                ("in", -0.4, False, True), ("is", 2.1, True, False), ("or", -2.3, False, True)]


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON_ROWS, "word string, valence double, is_pos boolean, is_neg boolean")


# ---------------------------------------------------------------- the same views for DuckDB

SQL: dict[str, str] = {
    "ticks": """SELECT l_partkey AS ticker, l_shipdate AS ts, l_extendedprice / l_quantity AS wild_px,
        p_retailprice * (1 - l_discount) AS calm_px, l_quantity AS qty,
        l_orderkey * 8 + l_linenumber AS ord
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "bars_calm": """SELECT ticker, ts, min_by(calm_px, ord) AS open, max(calm_px) AS high,
        min(calm_px) AS low, max_by(calm_px, ord) AS close, sum(qty) AS volume FROM ticks GROUP BY ticker, ts""",
    "bars_wild": """SELECT ticker, ts, min_by(wild_px, ord) AS open, max(wild_px) AS high,
        min(wild_px) AS low, max_by(wild_px, ord) AS close, sum(qty) AS volume FROM ticks GROUP BY ticker, ts""",
    "polls": """SELECT event_id, 'T' || (user_id % 5) AS ticker, ts, CAST(ts AS DATE) AS d, value AS last,
        value * (1 - (event_id % 7) * 4e-3) AS bid, value * (1 + (event_id % 5) * 4e-3) AS ask,
        CASE WHEN event_id % 10 <> 3 THEN floor((epoch_us(ts) % 86400000000) / 1000000 / 20)
             + CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS total_volume,
        CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type,
        CASE WHEN event_type = 'error' THEN 'Halted' ELSE 'Normal' END AS security_status FROM events""",
    "quotes": """SELECT p.* EXCLUDE (d, k, event_type), x.previous_close FROM polls p JOIN (
        SELECT ticker, d, lag(c) OVER (PARTITION BY ticker ORDER BY d) AS previous_close FROM (
          SELECT ticker, d, max_by(last, ts) AS c FROM polls GROUP BY ticker, d)) x
        ON p.ticker = x.ticker AND p.d = x.d""",
    "quote_bars": """SELECT ticker, date_trunc('minute', ts) AS ts, min_by(last, p.ts) AS open, max(last) AS high,
        min(last) AS low, max_by(last, p.ts) AS close, sum(k) AS volume FROM polls p GROUP BY ticker, date_trunc('minute', p.ts)""",
    "holdings": """SELECT ticker, ts AS entry_time, ts + to_seconds(CAST(k AS BIGINT) * 60) AS exit_time
        FROM polls WHERE event_type = 'view'""",
    "trade_events": """SELECT event_id, ticker, ts, CASE event_type WHEN 'purchase' THEN 'ENTRY' ELSE 'EXIT' END AS event,
        last AS price FROM polls WHERE event_type IN ('purchase', 'signup')""",
    "news_tickers": """SELECT id, unnest(symbols) AS ticker, len(symbols) AS num_symbols, headline, summary,
        created_at FROM news_once""",
    "adv": """SELECT ticker, avg(v) AS adv FROM (SELECT ticker, d, max(total_volume) AS v FROM polls
        GROUP BY ticker, d) GROUP BY ticker""",
    "news_once": r"""SELECT doc_id AS id,
        CASE WHEN doc_id % 3 = 0 THEN ['T' || (doc_id % 5), 'T' || ((doc_id + 1) % 5), 'T' || ((doc_id + 2) % 5), 'X9']
             ELSE ['T' || (doc_id % 5)] END AS symbols,
        CASE doc_id % 13 WHEN 0 THEN 'FDA approves new drug: ' WHEN 1 THEN 'Why shares of Acme rise: '
          WHEN 2 THEN 'Acme Corp to be acquired: ' WHEN 3 THEN 'Company raises guidance: '
          WHEN 4 THEN 'Going concern doubt: ' WHEN 5 THEN 'PDUFA date set, FDA approval awaited: '
          WHEN 6 THEN 'Nova Robotics Shares jump; ' ELSE '' END || regexp_extract(text, '^[^.\n]*') AS headline,
        substr(text, length(regexp_extract(text, '^[^.\n]*')) + 1) AS summary,
        TIMESTAMP '2024-01-01 00:00:00' + to_seconds((doc_id * 7919) % 2592000) AS created_at
        FROM documents""",
    "backfill": """SELECT id, symbols, headline, summary, created_at + to_seconds(300) AS created_at
        FROM news_once""",
    "news": "SELECT * FROM news_once UNION ALL SELECT * FROM backfill",
    "verdicts_raw": """SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN 'not json' ELSE
        '{"catalyst": "' || CASE doc_id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE ' Positive ' END ||
        '", "confidence": "' || CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END ||
        '", "reasoning": "one short sentence", "is_stale_or_secondhand": ' ||
        CASE WHEN doc_id % 5 = 0 THEN 'true' WHEN doc_id % 19 = 0 THEN '"false"' ELSE 'false' END || '}' END AS raw_json,
        CASE WHEN doc_id % 23 = 0 THEN '[]' ELSE '{"is_explicit_approval": ' ||
        CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE '""' END || ', "confidence": "' ||
        CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END ||
        '", "reasoning": "one short sentence"}' END AS fda_json
        FROM documents""",
    "fundamentals_text": """SELECT p_partkey AS ticker, CASE p_partkey % 6 WHEN 0 THEN p_size || '.20M'
        WHEN 1 THEN p_size || '00.00K' WHEN 2 THEN '-' WHEN 3 THEN p_size || '.5%' WHEN 4 THEN '1.10b'
        ELSE 'n/a' END AS shs_float, p_size || '%' AS short_float, CAST(p_size AS VARCHAR) AS short_ratio,
        CAST(trunc(p_retailprice / 10) AS INTEGER) || '.5K' AS avg_volume,
        p_size * 10000000e0 AS market_cap FROM part""",
    "share_counts": r"""SELECT *, CASE WHEN body IN ('', '-') THEN NULL
          WHEN lower(right(body, 1)) IN ('k', 'm', 'b') THEN TRY_CAST(left(body, -1) AS DOUBLE) *
            CASE lower(right(body, 1)) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 ELSE 1e9 END
          ELSE TRY_CAST(body AS DOUBLE) END AS float_shares
        FROM (SELECT *, replace(trim(shs_float), '%', '') AS body FROM fundamentals_text)""",
    "fundamentals_snapshots": """SELECT event_id, 'T' || (user_id % 5) AS ticker, ts AS fetched_at,
        value * 40000e0 AS float_shares FROM events WHERE event_type = 'signup'""",
    "orders_raw": """SELECT o_orderkey AS order_id, CASE o_orderstatus WHEN 'F' THEN 'FILLED'
        WHEN 'O' THEN 'WORKING' ELSE 'CANCELED' END AS status,
        CASE WHEN o_orderkey % 4 <> 0 THEN CAST(1 + o_custkey % 5 AS DOUBLE) END AS filled,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price,
        o_orderkey % 5 <> 0 AS has_legs, CAST(1 + o_custkey % 5 AS DOUBLE) AS q1, o_totalprice / 100 AS p1,
        CAST(o_orderkey % 3 AS DOUBLE) AS q2, o_totalprice / 101 AS p2 FROM orders""",
    "signals": """SELECT CAST(o_orderdate AS DATE) AS run, o_orderkey AS seq, o_custkey % 20 AS ticker,
        CAST(1 + o_orderkey % 6 AS INTEGER) AS request,
        o_orderpriority = '1-URGENT' AND o_orderkey % 7 = 0 AS is_fda, o_totalprice AS price FROM orders""",
    "quote_signals": """SELECT event_id AS signal_id, 'T' || (user_id % 5) AS ticker, ts,
        CAST(1 + event_id % 6 AS INTEGER) AS request, event_id % 31 = 0 AS is_fda, CAST(ts AS DATE) AS run
        FROM events WHERE event_type = 'purchase'""",
    "new_highs": """SELECT CAST(date_trunc('month', entry_time) AS DATE) AS run, ticker, entry_time AS ts, entry_price AS price, atr,
        CAST(1 + ticker % 6 AS INTEGER) AS request, ticker % 31 = 0 AS is_fda FROM entries""",
    "trade_orders": """SELECT l_partkey AS ticker, l_shipdate AS ts, o_orderstatus = 'F' AS is_filled, l_quantity AS q1, CAST(l_orderkey % 3 AS DOUBLE) AS q2,
        p_retailprice * (1 - l_discount) AS px, l_orderkey % 5 <> 0 AS has_legs, l_orderkey % 11 <> 0 AS has_price,
        row_number() OVER (PARTITION BY l_partkey, l_shipdate ORDER BY l_orderkey * 8 + l_linenumber) AS attempt
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "lexicon": """SELECT * FROM (VALUES ('the', 1.9e0, true, false), ('and', -1.2e0, false, true),
        ('of', 0.8e0, true, false), ('in', -0.4e0, false, true), ('is', 2.1e0, true, false),
        ('or', -2.3e0, false, true)) t(word, valence, is_pos, is_neg)""",
    # Wilder ATR per ticker by a list fold, independent of the two-level form used on the Spark side
    "true_range": """SELECT *, row_number() OVER w - 1 AS idx, CASE WHEN lag(close) OVER w IS NULL THEN high - low
        ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr
        FROM bars_calm WINDOW w AS (PARTITION BY ticker ORDER BY ts)""",
    "atr": """WITH RECURSIVE seed AS (SELECT ticker, avg(tr) AS a FROM true_range WHERE idx < 14 GROUP BY ticker),
        step AS (SELECT t.ticker, t.idx, s.a FROM true_range t JOIN seed s USING (ticker) WHERE t.idx = 13
          UNION ALL SELECT t.ticker, t.idx, (p.a * 13 + t.tr) / 14 FROM step p JOIN true_range t
          ON t.ticker = p.ticker AND t.idx = p.idx + 1)
        SELECT t.*, step.a AS atr FROM true_range t LEFT JOIN step ON t.ticker = step.ticker AND t.idx = step.idx""",
    "stops": """SELECT *, entry_price * (1 - stop_pct) AS stop_price FROM (
        SELECT *, greatest(0.02e0, least(implied, 0.1e0)) AS stop_pct, implied >= 0.1e0 AS stop_capped FROM (
        SELECT *, CASE WHEN atr IS NOT NULL AND entry_price > 0 THEN 2.5e0 * atr / entry_price ELSE 0.1e0 END AS implied
        FROM entries))""",
    "entries": """SELECT ticker, ts AS entry_time, close AS entry_price, CAST(1 + ticker % 9 AS DOUBLE) AS quantity, atr
        FROM (SELECT *, max(close) OVER (PARTITION BY ticker ORDER BY ts
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_high FROM atr)
        WHERE close > prior_high""",
    "positions": "SELECT * FROM stops",
}
NEEDS: dict[str, tuple[str, ...]] = {
    "bars_calm": ("ticks",), "bars_wild": ("ticks",), "quotes": ("polls",), "adv": ("polls",), "quote_bars": ("polls",),
    "holdings": ("polls",), "trade_events": ("polls",), "news_tickers": ("news_once",),
    "backfill": ("news_once",), "news": ("news_once", "backfill"), "share_counts": ("fundamentals_text",),
    "true_range": ("bars_calm",), "atr": ("true_range",), "entries": ("atr",), "stops": ("entries",), "new_highs": ("entries",),
    "positions": ("stops",),
}


def with_views(names: str, body: str, **extra: str) -> str:
    """Prefix a query with the views it needs as common table expressions; ``extra`` adds more."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, ()):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({SQL[n]})" for n in ordered] + [f"{n} AS MATERIALIZED ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
