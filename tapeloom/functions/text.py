"""Text expressions over headlines, summaries and verdict JSON."""

from __future__ import annotations

import html
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import News, Sentiment
from ..constants import (
    COMPANY_NAME_PATTERN, FDA_APPROVAL_PHRASES, FDA_EXCLUDE_PHRASES, MARKET_WIDE_OPENERS,
    REASON_FDA, RED_FLAG_PHRASES, SHARES_OF_PATTERN, STALE_RECAP_PHRASES,
)
from .rounding import round_exact

UNICODE = "(?U)"  # white space and word boundaries by Unicode classes


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def collapse(text: Column) -> Column:
    """White space runs become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, UNICODE + r"\s+", " "))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~F.rlike(text, F.lit(UNICODE + r"\S"))


def is_stale_recap(headline: Column) -> Column:
    return F.coalesce(contains_any(F.lower(headline), STALE_RECAP_PHRASES), F.lit(False))


def is_fda_candidate(text: Column) -> Column:
    low = F.lower(text)
    return ~contains_any(low, FDA_EXCLUDE_PHRASES) & contains_any(low, FDA_APPROVAL_PHRASES)


def red_flag_rank(text: Column) -> Column:
    """Place in the list (from 1) of the first listed phrase that the text contains, else null."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(p), F.lit(i)) for i, p in enumerate(RED_FLAG_PHRASES, 1)])


def red_flag(text: Column) -> Column:
    """First phrase of the list, in list order, that the text contains."""
    return red_flag_name(red_flag_rank(text))


def red_flag_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in RED_FLAG_PHRASES]), rank - 1)


def score_texts(rows: DataFrame, cfg: Sentiment = Sentiment()) -> DataFrame:
    """Probabilities and label from ``flag_rank, is_blank, compound, pos_words, neg_words``.

    Built in steps of columns, so that each rounded value is computed once.
    """
    bonus = F.col("flag_rank").isNull() & (F.col("pos_words") >= 2) & (F.col("neg_words") == 0)
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumns({"red_flag": red_flag_name(F.col("flag_rank")), "_tone": (F.col("compound") + 1.0) / 2.0})
    rows = rows.withColumns({
        "_n": unit(F.when(F.col("flag_rank").isNotNull(), F.lit(1.0)).otherwise(1.0 - F.col("_tone"))),
        "_p": unit(F.when(bonus, F.col("_tone") + cfg.dictionary_bonus).otherwise(F.col("_tone")))})
    rows = rows.withColumns({"_n": round_exact(F.col("_n"), 4), "_p": round_exact(F.col("_p"), 4)})
    rows = rows.withColumn("_u", F.greatest(F.lit(0.0), 1.0 - F.greatest("_n", "_p")))
    rows = rows.withColumn("_u", round_exact(F.col("_u"), 4))
    label = (F.when(F.col("is_blank"), "neutral")
             .when((F.col("_n") >= 0.5) & (F.col("_n") >= F.col("_p")), "negative")
             .when(F.col("_p") >= 0.5, "positive").otherwise("neutral"))

    def unless_blank(default: float, value: Column) -> Column:
        return F.when(F.col("is_blank"), F.lit(default)).otherwise(value)

    return rows.withColumns({
        "label": label, "confidence": unless_blank(0.0, F.greatest("_n", "_p", "_u")),
        "p_negative": unless_blank(0.5, F.col("_n")), "p_positive": unless_blank(0.5, F.col("_p")),
        "p_neutral": unless_blank(1.0, F.col("_u"))}).drop("_tone", "_n", "_p", "_u")


def sentiment_pass(worst_negative: Column, worst_positive: Column, cfg: Sentiment = Sentiment()) -> Column:
    return (worst_negative < cfg.negative_max) & (worst_positive > cfg.positive_min)


def company_anchor(headline: Column) -> Column:
    """The company a headline is about: a capitalised phrase before "shares" that does not name the
    market, else the first phrase ending in a company suffix, else null."""
    phrases = F.regexp_extract_all(headline, F.lit(UNICODE + SHARES_OF_PATTERN), F.lit(1))
    named = F.transform(phrases, lambda p: F.trim(F.element_at(F.split(F.trim(p), r"[;:,]\s*"), -1)))
    company = F.filter(named, lambda p: (p != "") & ~F.lower(p).isin(*MARKET_WIDE_OPENERS))
    suffixed = F.regexp_extract(headline, UNICODE + COMPANY_NAME_PATTERN, 1)
    return F.coalesce(F.get(company, F.lit(0)), F.when(suffixed != "", F.trim(suffixed)))


def is_relevant(ticker: Column, headline: Column, summary: Column, num_symbols: Column,
                cfg: News = News()) -> Column:
    """False only when many symbols are tagged and the headline is anchored to another company."""
    low, anchor = F.lower(ticker), company_anchor(headline)
    text = F.lower(F.concat_ws(" ", headline, summary))
    word = F.concat(F.lit(UNICODE + r"\b\Q"), low, F.lit(r"\E\b"))
    mentioned = text.contains(low) & F.rlike(text, word)
    overlap = F.lower(anchor).contains(low) | low.contains(F.lower(anchor))
    return (num_symbols < cfg.fan_out) | anchor.isNull() | mentioned | overlap


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """Decode character references; only texts with an ampersand travel to Python."""
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)


def strip_tags(raw: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(raw, F.lit("")), "<[^>]+>", " "))


def full_summary(summary: Column, content: Column) -> Column:
    """Summary plus the whole plain article text unless already inside it."""
    body = strip_tags(content)
    joined = F.regexp_replace(F.concat(summary, F.lit("\n\n"), body), UNICODE + r"^\s+|\s+$", "")
    return F.when((body == "") | F.contains(summary, body), summary).otherwise(joined)


def _truthy_json(v: Column) -> Column:
    """Truth of a JSON value: false, null, 0, "" and empty collections are false, the rest is true."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    return (F.when(v.isNull() | (kind == "VOID"), False).when(kind == "BOOLEAN", text == "true")
            .when(kind == "STRING", text != "").when(kind.startswith("ARRAY"), text != "[]")
            .when(kind.startswith("OBJECT"), text != "{}").otherwise(F.coalesce(number != 0, F.lit(True))))


def _field(doc: Column, name: str) -> Column:
    return F.regexp_replace(F.coalesce(F.try_variant_get(doc, f"$.{name}", "string"), F.lit("")),
                            UNICODE + r"^\s+|\s+$", "")


def parse_verdict(raw: Column) -> Column:
    """Catalyst verdict from JSON text, null when unparsable or outside the allowed labels."""
    doc = F.try_parse_json(raw)
    catalyst, confidence = F.lower(_field(doc, "catalyst")), F.lower(_field(doc, "confidence"))
    allowed = (doc.isNotNull() & catalyst.isin("positive", "negative", "neutral")
               & confidence.isin("high", "medium", "low"))
    return F.when(allowed, F.struct(
        catalyst.alias("catalyst"), confidence.alias("confidence"),
        _field(doc, "reasoning").alias("reasoning"),
        _truthy_json(F.try_variant_get(doc, "$.is_stale_or_secondhand", "variant")).alias("is_secondhand")))


def parse_fda_verdict(raw: Column) -> Column:
    doc = F.try_parse_json(raw)
    confidence = F.lower(_field(doc, "confidence"))
    return F.when(doc.isNotNull() & confidence.isin("high", "medium", "low"), F.struct(
        _truthy_json(F.try_variant_get(doc, "$.is_explicit_approval", "variant")).alias("is_approval"),
        confidence.alias("confidence"), _field(doc, "reasoning").alias("reasoning")))


def verdict_gate(fda_candidate: Column, fda: Column, recycled: Column, stale: Column, verdict: Column,
                 sentiment_ok: Column) -> Column:
    """Ordered decision per (article, ticker); labels in order of evaluation."""
    confirmed = fda_candidate & fda.isNotNull() & fda["is_approval"] & (fda["confidence"] != "low")
    return (F.when(F.coalesce(confirmed, F.lit(False)), REASON_FDA)
            .when(recycled, "DROP_RECYCLED").when(stale, "DROP_STALE_RECAP")
            .when(verdict.isNull(), "DROP_NO_VERDICT").when(verdict["is_secondhand"], "DROP_SECONDHAND")
            .when(verdict["catalyst"] != "positive", "DROP_NOT_POSITIVE")
            .when(verdict["confidence"] == "high", "PASS_HIGH_CONFIDENCE")
            .when(sentiment_ok, "PASS_BOTH_TIERS").otherwise("DROP_SENTIMENT"))


def share_count(text: Column) -> Column:
    """'5.20M', '800.00K', '12.5%' to a number; blank, '-' and unparsable text to null."""
    body = F.replace(F.regexp_replace(text, UNICODE + r"^\s+|\s+$", ""), F.lit("%"), F.lit(""))
    suffix = F.upper(F.right(body, F.lit(1)))
    scale = F.when(suffix == "K", 1e3).when(suffix == "M", 1e6).when(suffix == "B", 1e9)
    digits = F.when(scale.isNotNull(), F.expr("1")).otherwise(F.lit(0))
    number = F.substr(body, F.lit(1), F.length(body) - digits).try_cast("double")
    return F.when((body != "") & (body != "-"), number * F.coalesce(scale, F.lit(1.0)))
