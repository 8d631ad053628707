"""Mixing feeds to target weights by nested hash thresholds, without sorting the articles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tapeloom.session import materialise

from .records import words

HASH_BITS = 60
DIGIT_BITS = 12


@F.pandas_udf(T.LongType())
def count_words(content: pd.Series) -> pd.Series:
    return pd.Series([len(words(t)) for t in content], dtype="int64")


def _place(key: str, text: str) -> Column:
    """A fixed place of an article in its feed: the upper bits of a hash of its id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), 64 - HASH_BITS)


def ranked(feeds: DataFrame) -> DataFrame:
    """``position`` of every feed in code-point order (null last), by counts over range partitions."""
    parts = materialise(feeds.repartitionByRange("feed_key").withColumn("_part", F.spark_partition_id()), "feeds")
    counts = parts.groupBy("_part").count()
    ahead = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("feed_key")) - 1
    return parts.join(ahead, "_part").withColumn("position", inside + F.col("_ahead")).drop("_part", "_ahead")


def targets(feeds: DataFrame, weights: tuple[float, ...], ceiling: float) -> DataFrame:
    """``target`` words of every feed: the words of all feeds shared by weight, none above ``ceiling`` times its own.

    What is above a ceiling is shared again by weight among the others until none is above. Only two sums
    a round come to the driver.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    feeds = materialise(ranked(feeds).withColumn("weight", F.element_at(cycle, (F.pmod("position", F.lit(len(weights))) + 1).cast("int")))
                        .withColumn("limit", F.col("feed_size") * F.lit(float(ceiling))), "weighted-feeds")
    total, level, full = float(feeds.agg(F.coalesce(F.sum("feed_size"), F.lit(0))).first()[0]), 0.0, -1
    held = F.lit(False)
    while True:
        spent, weight, n = feeds.agg(F.coalesce(F.sum(F.when(held, F.col("limit"))), F.lit(0.0)),
                                     F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0)),
                                     F.count(F.when(held, 1))).first()
        if n == full or not weight:
            break
        full, level = n, (total - spent) / weight
        held = held | (F.lit(level) * F.col("weight") > F.col("limit"))
    return feeds.select("feed_key", "feed_size", F.when(held, F.col("limit")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(feed_key, threshold, more): articles placed below it, and ``more`` of those at it, hold ``budget`` words of their feed,
    to half an article. Only rows of one id and text share a place.

    Words are summed by feed and leading digit of the place. The digit where the sum passes the budget is
    the boundary; only articles of that bucket are summed again, by their next digit, until the bucket
    holds a single place. Fewer digits or more give the same threshold.
    """
    state = budgets.select("feed_key", F.lit(0).cast("bigint").alias("prefix"), F.col("budget").alias("rest"))
    depth = 0
    while True:
        depth += 1
        low = HASH_BITS - DIGIT_BITS * depth
        inside = rows.join(state, "feed_key").filter(F.shiftright("place", low + DIGIT_BITS) == F.col("prefix"))
        sums = (inside.groupBy("feed_key", "prefix", "rest", F.shiftright("place", low).alias("bucket"))
                .agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("place").alias("first"), F.max("place").alias("last")))
        upto = F.sum("words").over(Window.partitionBy("feed_key").orderBy("bucket"))
        at = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
        state = materialise(at.groupBy("feed_key").agg(F.min_by(F.struct(
            F.col("bucket").alias("prefix"), (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"),
            "words", "rows", "first", "last"), "bucket").alias("_s")).select("feed_key", "_s.*"), "thresholds")
        if not low or state.filter(F.col("first") < F.col("last")).isEmpty():
            break
        state = state.select("feed_key", "prefix", "rest")
    return state.select("feed_key", F.col("first").alias("threshold"), F.round(F.col("rest") * F.col("rows") / F.col("words")).cast("bigint").alias("more"))


def feed_key(feed: str) -> Column:
    """A feed as a key that sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), F.col(f"`{feed}`")), F.lit("b"))


def mix_plan(sizes: DataFrame, weights: tuple[float, ...], ceiling: float) -> DataFrame:
    """(feed_key, feed_size, target, times, threshold, more) from sized articles (feed_key, place, size): one row per feed."""
    feeds = sizes.groupBy("feed_key").agg(F.sum("size").alias("feed_size"))
    whole = F.when(F.col("feed_size") > 0, F.floor(F.col("target") / F.col("feed_size"))).otherwise(F.lit(0))
    aims = materialise(targets(feeds, weights, ceiling).withColumn("times", whole), "targets")
    budgets = aims.filter("feed_size > 0").select("feed_key", (F.col("target") - F.col("times") * F.col("feed_size")).alias("budget"))
    limits = thresholds(sizes.select("feed_key", "place", "size"), budgets)
    return materialise(aims.join(limits, "feed_key", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("threshold", "more")}), "mix")


def with_copies(rows: DataFrame) -> DataFrame:
    """Adds how often a row is taken: as often as its feed, and once more below the threshold, or among the first ``more`` at it.

    Rows at the threshold are equal in id and text, mostly there is one. They are counted through in parts, so that
    even a third of all rows at one place never meets in one task.
    """
    below = rows.filter("place <> threshold").withColumn("copies", F.expr("times + CAST(place < threshold AS BIGINT)"))
    at = materialise(rows.filter("place = threshold").withColumn("_mark", F.monotonically_increasing_id()), "at-threshold").withColumn("_part", F.shiftright("_mark", 33))
    counts = at.groupBy("feed_key", "_part").count()
    ahead = counts.select("feed_key", "_part", (F.sum("count").over(Window.partitionBy("feed_key").orderBy("_part")) - F.col("count")).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("feed_key", "_part").orderBy("_mark")) + F.col("_ahead")
    here = at.join(ahead, ["feed_key", "_part"]).withColumn("copies", F.col("times") + (place <= F.col("more")).cast("bigint"))
    return below.unionByName(here.drop("_mark", "_part", "_ahead"))


def mix(articles: DataFrame, key: str = "id", text: str = "content", feed: str = "feed",
        weights: tuple[float, ...] = (5, 2, 1), ceiling: float = 3.0) -> DataFrame:
    """How many words of each article the mix takes: (id, size, feed_size, target, taken), one row per input row.

    ``size`` counts words. Feeds in code-point order, null last, have the ``weights`` in turn and share the
    words of all feeds; ``target`` is the feed's share, at most ``ceiling`` times its own words. Every
    article is taken a whole number of times: ``floor(target / feed_size)`` times, and once more if its
    place, a hash of its id and text, lies below the feed's threshold. So no article is taken more than
    ``ceil(ceiling)`` times, a larger budget takes all that a smaller one takes, and reruns agree.

    Null texts have size 0. A null feed is a feed. Rows repeated in id and text share a place; at the threshold as many of them
    are taken once more as the budget has room for, whichever they are. A missing id is an id like others. A feed without words has
    target 0. Other columns are ignored; no rows give no rows.
    """
    rows = _sized(articles, key, text, feed)
    return with_copies(rows.join(mix_plan(rows, weights, ceiling), "feed_key")).select(
        "id", "size", "feed_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _sized(articles: DataFrame, key: str, text: str, feed: str) -> DataFrame:
    return materialise(articles.select(F.col(f"`{key}`").alias("id"), feed_key(feed).alias("feed_key"), _place(key, text).alias("place"),
                                       count_words(F.col(f"`{text}`")).alias("size")), "sizes")


def take(articles: DataFrame, key: str = "id", text: str = "content", feed: str = "feed",
         weights: tuple[float, ...] = (5, 2, 1), ceiling: float = 3.0) -> DataFrame:
    """The rows of ``articles``, all columns, each as often as ``mix`` takes it."""
    sizes = _sized(articles, key, text, feed)
    plan = mix_plan(sizes, weights, ceiling).select("feed_key", "times", "threshold", "more")
    marked = articles.select(F.struct(*[F.col(f"`{c}`") for c in articles.columns]).alias("row"), feed_key(feed).alias("feed_key"),
                             _place(key, text).alias("place"))
    copies = with_copies(marked.join(plan, "feed_key")).filter("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("n")).select("row.*")
