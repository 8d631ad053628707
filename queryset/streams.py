"""Streaming queries: each drains the given table as a stream and returns the table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import news as N
from tapeloom.session import fresh_folder
from tapeloom.sources import news as feed
from tapeloom.streaming import news as SN, positions as SP, quotes as SQ
from tapeloom.streaming.run import drain, drain_updates, file_stream

from . import news as QN, plans as QP, quotes as QQ, views as V
from .core import query
from .views import with_views


BATCHES = 5


def _files_a_batch(rows):
    """As many files as tasks read the rows, so that no task writes or reads more of a batch than one of them."""
    return max(rows.rdd.getNumPartitions(), 1)


def _dealt(spark, rows, key, label):
    """A feed in some files a micro-batch, dealt by a hash: out of order in time."""
    folder, files = fresh_folder(spark, label), _files_a_batch(rows)
    rows.repartition(BATCHES * files, key).write.parquet(folder)
    return file_stream(spark, folder, rows.schema, files_per_trigger=files)


def _file_count(spark, folder):
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = there.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(there)
    return sum(f.getPath().getName().startswith("part-") for f in found)


def _in_order(spark, rows, at, label):
    """A feed in some files a micro-batch, each batch later in time than the one before.

    All batches have equally many files, as the stream counts files: where a batch has too few rows for that, empty ones follow.
    """
    folder, micros, files = fresh_folder(spark, label), F.unix_micros(F.col(at).cast("timestamp")), _files_a_batch(rows)
    first, last = rows.agg(F.min(micros), F.max(micros)).first()
    part = F.least(F.floor((micros - F.lit(first)) * BATCHES / F.lit(max((last or 0) - (first or 0), 1))), F.lit(BATCHES - 1))
    for n in range(BATCHES):
        rows.filter(part == n).repartition(files).write.mode("append").parquet(folder)
        for _ in range(files * (n + 1) - _file_count(spark, folder)):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(folder)
    return file_stream(spark, folder, rows.schema, files_per_trigger=files)


def _news(spark, sf):
    return V.news_of(_dealt(spark, V.table(spark, sf, "documents"), "doc_id", "articles"))


def _both(spark, sf):
    """The live feed and, interleaved with it, what the backfill delivers again: each id comes twice, often in different batches."""
    once = V.table(spark, sf, "documents")
    feed_rows = once.withColumn("late", F.lit(0)).unionByName(once.withColumn("late", F.lit(300))).withColumn("_deal", F.hash("doc_id", "late"))
    rows = _dealt(spark, feed_rows, "_deal", "articles")
    late = F.make_interval(secs=F.col("late"))
    return V.news_of(rows, keep=("late",)).withColumn("created_at", F.col("created_at") + late).drop("late")


def _polls(spark, sf):
    return V.polls_of(_in_order(spark, V.table(spark, sf, "events"), "ts", "polls"))


def _tagged(spark, sf):
    return _news(spark, sf).withColumn("ticker", F.explode("symbols"))


@query("src_news_stream", with_views("news_tickers", "SELECT id, ticker FROM news_tickers WHERE ticker IN (SELECT ticker FROM w)", w=QN.WATCH))
def src_news_stream(spark, sf):
    """Live feed restricted to the subscribed symbols."""
    return drain(_tagged(spark, sf).join(QN.watchlist(spark, sf), "ticker", "left_semi").select("id", "ticker"), "news-stream")


@query("st_news_ingest", with_views("news_once", "SELECT id, created_at, len(symbols) AS symbols, length(headline) AS headline_chars FROM news_once"), stamps="created_at")
def st_news_ingest(spark, sf):
    """Articles written as JSON lines, read back by the JSON news source, appended to a table."""
    folder = fresh_folder(spark, "news-json")
    V.news_once(spark, sf).withColumn("content", F.lit("")).write.json(folder)
    out = drain(feed.read_news_stream(spark, folder), "news-ingest")
    return out.select("id", "created_at", F.size("symbols").cast("bigint").alias("symbols"),
                      F.char_length("headline").cast("bigint").alias("headline_chars"))


@query("st_dedup_article", with_views("news", "SELECT DISTINCT id, headline_md5 FROM (SELECT id, md5(headline) AS headline_md5 FROM news)"))
def st_dedup_article(spark, sf):
    """Live and backfill copies in micro-batches out of order; an id is kept once, whenever its copies come."""
    once = SN.dedup(_both(spark, sf))
    return once.select("id", F.md5(F.encode("headline", "UTF-8")).alias("headline_md5"))


@query("st_late_backfill", with_views("news", "SELECT date_trunc('day', created_at) AS window_start, count(*) AS articles FROM news GROUP BY 1"), stamps="window_start")
def st_late_backfill(spark, sf):
    return SN.counts(_both(spark, sf))


@query("st_session_high", with_views("quotes", QQ.HIGHS), stamps="ts", doubles="last prior_high")
def st_session_high(spark, sf):
    return drain(SQ.session_highs(_polls(spark, sf)), "session-high")


@query("st_halt_reopen", with_views("quotes", """SELECT event_id, ticker, ts, last FROM (SELECT *,
    lag(security_status) OVER (PARTITION BY ticker ORDER BY ts) AS was FROM quotes)
    WHERE was = 'Halted' AND security_status <> 'Halted'"""), stamps="ts", doubles="last")
def st_halt_reopen(spark, sf):
    return drain(SQ.halt_reopens(_polls(spark, sf)), "halt-reopen")


@query("st_tick_window", with_views("quotes adv quote_signals", """SELECT signal_id, ticker, passed, up_volume, down_volume, polls_ok, polls_failed
    FROM confirmed""", **QQ.CONFIRM), doubles="up_volume down_volume")
def st_tick_window(spark, sf):
    """All signals: decided on the stream, or, where the tape ends before the deadline, at its end."""
    signals = V.quote_signals_of(_in_order(spark, V.table(spark, sf, "events"), "ts", "signals")).drop("run")
    out = drain(SQ.confirm(signals, _polls(spark, sf), V.adv(spark, sf), V.CONFIRM), "tick-window")
    return SQ.close_tape(out, V.quote_signals(spark, sf), V.quotes(spark, sf), V.adv(spark, sf), V.CONFIRM)


@query("st_recycled_headline")
def st_recycled_headline(spark, sf):
    rows = V.news_of(_in_order(spark, V.table(spark, sf, "documents").withColumn("created_at", V.news_time()), "created_at", "articles"))
    return drain(SN.recycled(rows.withColumn("ticker", F.explode("symbols"))), "recycled")


@query("st_market_scan", with_views("quotes adv", "SELECT ticker, scan_ts, event_id, gap_pct, rvol FROM scans",
                                    metrics_scan=QQ.METRICS_SCAN, scans=QQ.SCANS), stamps="scan_ts", doubles="gap_pct rvol")
def st_market_scan(spark, sf):
    """Scan windows by a streaming aggregate; previous closes and volume averages are static tables."""
    polls = _polls(spark, sf).drop("k", "event_type")
    last = drain_updates(SQ.last_polls(polls, V.SCAN, tie=["event_id"]), "market-scan", ["ticker", "scan_ts"])
    priced = last.join(V.prior_closes(spark, sf), ["ticker", "d"], "left")
    return SQ.scan_tier(priced, V.adv(spark, sf), V.SCAN).select("ticker", "scan_ts", "event_id", "gap_pct", "rvol")


@query("st_bullish_refresh", with_views("news_tickers verdicts_raw", f"""SELECT n.ticker, n.created_at AS ts, n.id FROM (SELECT *, lower(headline) AS low FROM news_tickers) n
    JOIN verdicts v USING (id) WHERE ticker IN (SELECT ticker FROM w) AND v.ok AND v.catalyst = 'positive' AND NOT v.is_secondhand
    AND NOT {QN.any_of('low', QN.K.STALE_RECAP_PHRASES)}""", w=QN.WATCH, verdicts=QN.VERDICTS), stamps="ts")
def st_bullish_refresh(spark, sf):
    return drain(SN.bullish(_news(spark, sf), QN.watchlist(spark, sf), N.parse_verdicts(V.verdicts_raw(spark, sf))), "bullish")


@query("st_position_monitor", with_views("positions bars_calm", """SELECT ticker, entry_time, exit_time, exit_price, exit_reason FROM exits
    WHERE exit_time IS NOT NULL""", **QP.EXIT), stamps="entry_time exit_time", doubles="exit_price")
def st_position_monitor(spark, sf):
    bars = V.stored(V.bars_calm(spark, sf), "bars")
    return drain(SP.monitor(_in_order(spark, bars, "ts", "bars-in-order"), V.positions(spark, sf, bars)), "exits")
