"""News analytics: normalisation, relevance, near-duplicate headlines, lexicon tone, decision gate."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..config import News, Sentiment
from ..constants import REASON_FDA
from ..functions import text as X
from .ordered import Series, core_rows, uncut, with_halo

HEADLINES = Series(order=("created_at", "id"))


def normalise(news: DataFrame) -> DataFrame:
    """Decode character references, fold the article text into the summary, default the time."""
    rows = news.withColumn("headline", X.unescape(F.coalesce("headline", F.lit("")))) \
        .withColumn("summary", X.unescape(F.coalesce("summary", F.lit(""))))
    return (rows.withColumn("summary", X.full_summary(F.col("summary"), F.col("content")))
            .withColumn("created_at", F.coalesce("created_at", F.current_timestamp())).drop("content"))


def tag_watchlist(news: DataFrame, watchlist: DataFrame) -> DataFrame:
    """One row per (article, watched ticker) with the article's own symbol count."""
    tagged = news.withColumn("num_symbols", F.size("symbols")).withColumn("ticker", F.explode("symbols"))
    return tagged.drop("symbols").join(watchlist.select("ticker"), "ticker", "left_semi")


def relevant(tagged: DataFrame, cfg: News = News()) -> DataFrame:
    return tagged.filter(X.is_relevant(F.col("ticker"), F.col("headline"), F.col("summary"),
                                       F.col("num_symbols"), cfg))


def _similar(threshold: float):
    @F.pandas_udf(T.BooleanType())
    def any_similar(text: pd.Series, priors: pd.Series) -> pd.Series:
        def check(a: str, history) -> bool:
            matcher = difflib.SequenceMatcher()
            for b in history:
                matcher.set_seqs(a, b)
                # the two quick ratios are upper bounds of the ratio
                if matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold \
                        and matcher.ratio() >= threshold:
                    return True
            return False

        return pd.Series([check(a, h) for a, h in zip(text, priors)], dtype=bool)

    return any_similar


def recycled_headlines(tagged: DataFrame, s: Series = HEADLINES, cfg: News = News()) -> DataFrame:
    """``ticker, created_at, id, is_recycled``: is the headline a near-copy of one of the ticker's
    previous headlines (a fixed number of them)? Blank headlines neither match nor enter the history.

    Candidates that fail the length bound of the ratio are dropped before the texts reach Python.
    """
    norm = F.lower(X.collapse(F.col("headline")))
    rows = tagged.select("ticker", "created_at", "id", norm.alias("_h")).filter(F.col("_h") != "")
    near = with_halo(rows, s, before=cfg.history)
    last = Window.partitionBy(*s.group).orderBy(*s.order).rowsBetween(-cfg.history, -1)
    near = core_rows(near.withColumn("_prior", F.collect_list("_h").over(last)))
    size = F.char_length("_h")
    possible = F.filter("_prior", lambda p: 2.0 * F.least(F.char_length(p), size) / (F.char_length(p) + size)
                        >= cfg.similarity)
    near = uncut(near.withColumn("_prior", possible))
    hit = _similar(cfg.similarity)(F.col("_h"), F.col("_prior"))
    return near.select("ticker", "created_at", "id", hit.alias("is_recycled"))


def lexicon_scores(texts: DataFrame, lexicon: DataFrame, keys: tuple[str, ...],
                   cfg: Sentiment = Sentiment(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Tone per text: tokens meet the lexicon, sums per key give compound, hit counts and polarity.

    The tokens of a text sit in one task, so the partial sums collapse them before the shuffle. ``carry``
    names columns (fixed per key) to keep, so that the texts themselves need no shuffle or join.
    """
    tokens = texts.select(*keys, *carry, F.explode_outer(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    hits = tokens.join(lexicon, "word", "left")
    sums = hits.groupBy(*keys).agg(
        F.coalesce(F.sum("valence"), F.lit(0.0)).alias("_s"),
        F.count(F.when(F.col("is_pos"), 1)).alias("pos_words"),
        F.count(F.when(F.col("is_neg"), 1)).alias("neg_words"), *[F.max(c).alias(c) for c in carry])
    total = F.col("pos_words") + F.col("neg_words")
    return sums.select(
        *keys, *carry, (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + cfg.normalisation)).alias("compound"),
        "pos_words", "neg_words",
        F.when(total > 0, (F.col("pos_words") - F.col("neg_words")) / total).otherwise(F.lit(0.0)).alias("polarity"))


def text_scores(news: DataFrame, lexicon: DataFrame, cfg: Sentiment = Sentiment()) -> DataFrame:
    """``id, field`` and scores: headline and summary of each article scored; a blank summary uses the headline."""
    summary = F.when(X.is_blank(F.col("summary")), F.col("headline")).otherwise(F.col("summary"))
    parts = F.array(F.struct(F.lit("headline").alias("field"), F.col("headline").alias("text")),
                    F.struct(F.lit("summary").alias("field"), summary.alias("text")))
    texts = news.select("id", F.inline(parts)).withColumns({
        "flag_rank": X.red_flag_rank(F.col("text")), "is_blank": X.is_blank(F.col("text"))})
    tone = lexicon_scores(texts, lexicon, ("id", "field"), cfg, carry=("flag_rank", "is_blank"))
    scored = X.score_texts(tone, cfg)
    return scored.select("id", "field", "label", "confidence", "p_negative", "p_positive", "p_neutral", "red_flag")


def sentiment_gate(news: DataFrame, lexicon: DataFrame, cfg: Sentiment = Sentiment()) -> DataFrame:
    """Worst of headline and summary in each direction, the pass flag, and the first red flag."""
    scores = text_scores(news, lexicon, cfg)

    def flag(field: str) -> Column:
        return F.max(F.when(F.col("field") == field, F.col("red_flag")))  # one row per id and field

    out = scores.groupBy("id").agg(
        F.max("p_negative").alias("worst_negative"), F.min("p_positive").alias("worst_positive"),
        F.coalesce(flag("headline"), flag("summary")).alias("red_flag"))
    return out.withColumn("sentiment_ok", X.sentiment_pass(F.col("worst_negative"), F.col("worst_positive"), cfg))


def parse_verdicts(raw: DataFrame) -> DataFrame:
    return raw.select("id", X.parse_verdict(F.col("raw_json")).alias("verdict"),
                      X.parse_fda_verdict(F.col("fda_json")).alias("fda"))


def decide(tagged: DataFrame, verdicts: DataFrame, sentiment: DataFrame,
           s: Series = HEADLINES, cfg: News = News(), check_recycled: bool = True) -> DataFrame:
    """Label each (article, ticker) with the outcome of the ordered gates.

    Cheap native predicates run first; the similarity check runs last, and only over the rows that are
    not FDA-confirmed, because confirmed rows leave before the headline history is touched.
    """
    rows = tagged.join(verdicts, "id", "left").join(sentiment.select("id", "sentiment_ok"), "id", "left")
    text = F.concat_ws(" ", "headline", "summary")
    rows = rows.withColumn("_fda", X.is_fda_candidate(text)).withColumn("_stale", X.is_stale_recap(F.col("headline")))

    def label(recycled: Column) -> Column:
        return X.verdict_gate(F.col("_fda"), F.col("fda"), recycled, F.col("_stale"), F.col("verdict"),
                              F.coalesce("sentiment_ok", F.lit(False)))

    if not check_recycled:
        return rows.withColumn("decision", label(F.lit(False))).drop("_fda", "_stale")
    before = rows.withColumn("decision", label(F.lit(False)))
    seen = before.filter(F.col("decision") != REASON_FDA)
    flags = recycled_headlines(seen, s, cfg).filter("is_recycled")
    flags = flags.select(F.col("ticker").alias("_t"), F.col("created_at").alias("_at"), F.col("id").alias("_id"), "is_recycled")
    same = ((F.col("ticker") == F.col("_t")) & (F.col("created_at") == F.col("_at"))
            & F.col("id").eqNullSafe(F.col("_id")))
    rows = before.join(flags, same, "left").drop("_t", "_at", "_id")
    final = F.when(F.coalesce("is_recycled", F.lit(False)), "DROP_RECYCLED").otherwise(F.col("decision"))
    return rows.withColumn("decision", final).drop("_fda", "_stale", "is_recycled")
