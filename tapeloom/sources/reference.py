"""Watchlist, fundamentals and account snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Entry, Screen
from ..constants import BALANCE_FIELDS, EXPECTED_BALANCE_FIELD, TICKER_LINK_PATTERN
from ..functions.text import share_count


def _links(pages: DataFrame, param: str) -> DataFrame:
    pattern = TICKER_LINK_PATTERN.replace("{param}", param)
    return pages.withColumn("_found", F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))


def tickers_from_pages(pages: DataFrame, param: str = "t") -> DataFrame:
    """Distinct upper-case tickers linked from screener pages with the place of their first sight;
    order by (first_page, first_pos) for reading order. Reduced before the shuffle by partial minima."""
    seen = _links(pages, param).select("page_id", F.posexplode("_found").alias("pos", "_t"))
    first = seen.groupBy(F.upper("_t").alias("ticker")).agg(F.min(F.struct("page_id", "pos")).alias("_at"))
    return first.select("ticker", F.col("_at.page_id").alias("first_page"), F.col("_at.pos").alias("first_pos"))


def tickers_per_page(pages: DataFrame, param: str = "t") -> DataFrame:
    """Distinct tickers on each page; a page with none was throttled or has changed its links."""
    tickers = F.array_distinct(F.transform("_found", F.upper))
    return _links(pages, param).select("page_id", F.size(tickers).alias("tickers"),
                                       (F.size(tickers) == 0).alias("is_empty"))


def parse_fundamentals(raw: DataFrame) -> DataFrame:
    kept = [c for c in raw.columns if c not in ("shs_float", "short_float", "short_ratio", "avg_volume")]
    return raw.select(
        *kept, share_count(F.col("shs_float")).alias("float_shares"),
        share_count(F.col("short_float")).alias("short_float_pct"),
        share_count(F.col("short_ratio")).alias("days_to_cover"),
        share_count(F.col("avg_volume")).alias("avg_volume"))


def watchlist_screen(fundamentals: DataFrame, cfg: Screen = Screen()) -> DataFrame:
    """Low float, micro cap, liquid enough."""
    return fundamentals.filter(
        (F.col("float_shares") < cfg.float_ceiling) & (F.col("market_cap") < cfg.market_cap_ceiling)
        & (F.col("avg_volume") > cfg.min_avg_volume))


def buying_power(balances: DataFrame, cfg: Entry = Entry(), allow_fallback: bool = False) -> DataFrame:
    """First numeric balance field with its name, the capital per slot and a problem label (null if usable)."""
    found = F.coalesce(*[
        F.when(F.col(f).try_cast("double").isNotNull(),
               F.struct(F.col(f).try_cast("double").alias("value"), F.lit(f).alias("field")))
        for f in BALANCE_FIELDS])
    rows = balances.withColumn("_f", found).withColumn("buying_power", F.col("_f.value")) \
        .withColumn("field", F.col("_f.field")).drop("_f", *BALANCE_FIELDS)
    expected = F.coalesce(F.col("field") == EXPECTED_BALANCE_FIELD, F.lit(False))
    problem = (F.when(F.col("field").isNull(), "MISSING")
               .when(~expected & F.lit(not allow_fallback), "UNEXPECTED_FIELD")
               .when(F.col("buying_power") <= 0, "NOT_POSITIVE"))
    return (rows.withColumn("is_expected", expected).withColumn("problem", problem)
            .withColumn("per_slot", F.when(F.col("problem").isNull(), F.col("buying_power") / cfg.pool)))
