"""Filtering of page links: host rules and pattern rules behind one index of rare literal tokens.

For the links of screener and news pages. All of it is DataFrame expressions.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .records import narrowed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class SiteRule:
    """Fits a host and its subdomains where the path starts with ``path``; the longest that fits decides."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def label(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return rf"\A(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    @property
    def literals(self) -> list[str]:
        """The labels of the host: each stands between dots or ends, so it is a whole token of any link that fits."""
        return re.findall(r"[0-9a-z]+", self.host)


@dataclass(frozen=True)
class PatternRule:
    """Blocks links that no site rule decides. ``*`` stands for any text; runs of letters and digits must match whole."""

    pattern: str

    @property
    def label(self) -> str:
        return self.pattern

    @property
    def regex(self) -> str:
        text = ".*".join(re.escape(x) for x in self.pattern.split("*"))
        edge = lambda at, side: side if re.fullmatch("[0-9a-z]", at) else ""
        return rf"(?s){edge(self.pattern[:1], '(?<![0-9a-z])')}{text}{edge(self.pattern[-1:], '(?![0-9a-z])')}"

    @property
    def literals(self) -> list[str]:
        """Runs of letters and digits that no ``*`` touches, so that they are whole tokens of any link that fits."""
        return re.findall(r"(?<![*0-9a-z])[0-9a-z]+(?![*0-9a-z])", self.pattern)


#: Words of link spam and tracking hosts; a change of parameter, not of code, adapts them.
PATTERNS = tuple(map(PatternRule, ("casino-*", "*-casino", "casino", "free-bets", "bets", "poker", "cheap-pills", "pills",
                                   "viagra", "ads-track", "ads", "adserver", "doubleclick", "payday-loans", "xxx", "porn", "adult-*", "spam-*")))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a link; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lowered, and the empty token for rules without a literal."""
    found = F.split(F.translate(F.concat_ws("/", host, path), _UPPER, _LOWER), "[^0-9a-z]+")
    return F.array_distinct(F.array_append(found, F.lit("")))


def rule_table(spark: SparkSession, sites: tuple[SiteRule, ...], patterns: tuple[PatternRule, ...]) -> DataFrame:
    rows = [{"kind": "site", "verdict": r.verdict, "length": len(r.label)} for r in sites]
    rows += [{"kind": "pattern", "verdict": "block", "length": 0} for _ in patterns]
    for n, (row, r) in enumerate(zip(rows, (*sites, *patterns), strict=True)):
        row |= {"n": n, "rule": r.label, "regex": r.regex, "literals": r.literals or [""]}
    schema = ("array<struct<n int, kind string, verdict string, rule string, regex string, length int, "
              "literals array<string>>>")
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def judge_links(pages: DataFrame, sites: tuple[SiteRule, ...], patterns: tuple[PatternRule, ...] = PATTERNS,
                key: str = "page", url: str = "url", max_rules: int = 20_000) -> DataFrame:
    """Host, path, deciding site rule and verdict of every link: (page, host, path, rule, verdict), a row per input row.

    A site rule that fits decides, the longest first; else any fitting pattern blocks; else the link is
    allowed. Every rule waits under that of its literal tokens which the fewest links hold, counted over all
    links. The tokens of a link fetch the rules waiting there and only those run their regular expression.
    Rules are parameters, at most ``max_rules`` of them, so their index may be broadcast; links never are.

    A null link and one without ``://`` have empty host and path; a null link is allowed. Equal links are judged
    once. Repeated rows stay, other columns are ignored, an empty table gives no rows.
    """
    if len(sites) + len(patterns) > max_rules:
        raise ValueError(f"at most {max_rules} rules")
    rows = narrowed(pages, page=key, url=url)
    host, path = parts(F.col("url"))
    links = rows.select("url").distinct().filter("url IS NOT NULL").select("url", host.alias("host"), path.alias("path"))
    words = links.select("url", "host", "path", F.explode(tokens(F.col("host"), F.col("path"))).alias("token"))
    rules = rule_table(pages.sparkSession, sites, patterns)
    waiting = rules.select("n", F.explode("literals").alias("token"))
    held = words.select("token").join(F.broadcast(waiting.select("token").distinct()), "token").groupBy("token").count()
    rarest = (waiting.join(held, "token", "left")
              .groupBy("n").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token")))
    index = rules.drop("literals").join(rarest, "n")
    where = F.concat("host", "path")
    fits = words.join(F.broadcast(index), "token").filter(
        F.when(F.col("kind") == "site", F.rlike(where, F.col("regex")))
        .otherwise(F.rlike(F.translate(where, _UPPER, _LOWER), F.col("regex"))))
    best = fits.groupBy("url").agg(
        F.max(F.when(F.col("kind") == "site", F.struct("length", "rule", "verdict"))).alias("site"),
        F.max(F.col("kind") == "pattern").alias("spam"))
    judged = rows.join(best, "url", "left")
    return judged.select("page", host.alias("host"), path.alias("path"), F.col("site.rule").alias("rule"),
                         F.coalesce("site.verdict", F.when(F.col("spam"), "block").otherwise("allow")).alias("verdict"))
