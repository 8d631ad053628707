"""Ranked word search: best-first over document intervals, bounded by range maxima of posting lists."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.session import materialise

from .records import narrowed, utf8

#: A term is a run of letters and digits of ASCII and of all other characters; only A-Z are lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_READ = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEPT else 32 for b in range(256))


def terms(content: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return utf8(content).translate(_READ).split()


@dataclass(frozen=True)
class Layout:
    """Sizes of the work, none of which changes a result."""

    search_bytes: int = 4_000_000    # searches of about so much text share one pass over the articles
    block_articles: int = 8_192      # articles of one index
    block_postings: int = 1_000_000  # and at most about so many postings
    popped: int = 256                # intervals split at once


@dataclass(frozen=True)
class Corpus:
    """What the weights need of all articles: N, L, and w of every asked term."""

    articles: int
    tokens: int
    weights: np.ndarray

    @staticmethod
    def of(articles: int, tokens: int, found: np.ndarray) -> Corpus:
        weights = [math.floor(1000 * math.log((2 * articles + 2) / (2 * df + 1))) for df in found.tolist()]
        return Corpus(articles, tokens, np.array(weights, np.int64))

    def impacts(self, term: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a posting adds to the score of its article, in whole numbers."""
        m = 100 - 50 + (50 * length * self.articles) // max(self.tokens, 1)
        return self.weights[term] * ((1_000_000_000 * times) // (1000 * times + 20 * m))


class Index:
    """Posting lists of one block of articles, end to end in flat arrays, with sparse tables for range maxima.

    ``best[k][i]`` is the posting of the greatest impact among the 2**k from i on (the first of equal ones).
    """

    def __init__(self, term: np.ndarray, article: np.ndarray, impact: np.ndarray, articles: int):
        order = np.argsort(term * articles + article, kind="stable")
        self.article, self.impact, self.articles = article[order], impact[order], articles
        self.terms, first = np.unique(term[order], return_index=True)
        self.begin = np.append(first, len(order))
        self.key = np.repeat(np.arange(len(self.terms)), np.diff(self.begin)) * articles + self.article
        longest = int(np.diff(self.begin).max(initial=1))
        level = np.arange(len(order), dtype=np.int32)
        levels = [level]
        for k in range(longest.bit_length() - 1):
            left, right = level, np.append(level[1 << k:], np.repeat(level[-1:], min(1 << k, len(level))))
            level = np.where(self.impact[right] > self.impact[left], right, left)
            levels.append(level)
        self.best = np.array(levels)

    def greatest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The posting of the greatest impact in each range [a, b), and that impact (0 for empty ranges)."""
        size = b - a
        level = np.frexp(np.maximum(size, 1))[1] - 1
        a = np.minimum(a, len(self.impact) - 1)
        left, right = self.best[level, a], self.best[level, np.maximum(b - (1 << level), 0)]
        at = np.where(self.impact[right] > self.impact[left], right, left)
        return at, np.where(size > 0, self.impact[at], 0)

    def search(self, asked: np.ndarray, k: int, floor: int, popped: int) -> tuple[np.ndarray, np.ndarray]:
        """Articles of the ``k`` best scores from ``floor`` on, best first, equal ones by place; and the scores.

        An interval of articles is bounded by the sum of the terms' greatest impacts inside it. The intervals
        of the highest bounds are split at the article of their greatest single impact, whose score is then
        summed up; what is bounded below the k-th score is left.
        """
        lists = np.flatnonzero(np.isin(self.terms, asked, assume_unique=True))
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(lists):
            return places, scores
        base = lists * self.articles
        low, a, b = np.zeros(1, np.int64), self.begin[lists][None, :], self.begin[lists + 1][None, :]
        bound, split = self._bounds(a, b)
        while True:
            least = max(floor, int(scores[-1]) if len(scores) == k else 1)
            last = places[-1] if len(scores) == k and scores[-1] == least else self.articles
            live = np.flatnonzero((bound > least) | ((bound == least) & (low <= last)))
            if not len(live):
                return places, scores
            order = live[np.argsort(-bound[live], kind="stable")]
            now, rest = order[:popped], order[popped:]
            at = split[now]
            rank = np.searchsorted(self.key, base[None, :] + at[:, None])
            inside = np.minimum(rank, len(self.key) - 1)
            here = self.key[inside] == base[None, :] + at[:, None]
            places = np.append(places, at)
            scores = np.append(scores, np.where(here, self.impact[inside], 0).sum(axis=1))
            top = np.lexsort((places, -scores))[:k]
            places, scores = places[top], scores[top]
            more_a, more_b = np.concatenate([a[now], rank + here]), np.concatenate([rank, b[now]])
            more_bound, more_split = self._bounds(more_a, more_b)
            go = np.flatnonzero(more_bound > 0)
            low = np.concatenate([low[rest], np.concatenate([low[now], at + 1])[go]])
            a, b = np.concatenate([a[rest], more_a[go]]), np.concatenate([b[rest], more_b[go]])
            bound, split = np.append(bound[rest], more_bound[go]), np.append(split[rest], more_split[go])

    def _bounds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, value = self.greatest(a, b)
        most = value.argmax(axis=1)[:, None]
        return value.sum(axis=1), self.article[np.take_along_axis(at, most, 1)[:, 0]]


def _postings(numbers: dict[bytes, int]):
    """(id, n, terms, times) of every article with a term: how often the asked terms occur in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, content in zip(batch["id"], batch["content"], strict=True):
                found = terms(content)
                if found:
                    hits = [(numbers[t], times) for t, times in Counter(found).items() if t in numbers]
                    out.append((i, len(found), [h[0] for h in hits], [h[1] for h in hits]))
            yield pd.DataFrame(out, columns=["id", "n", "terms", "times"])

    return run


def _best(searches: list[tuple[int, np.ndarray]], corpus: Corpus, k: int, layout: Layout):
    """The ``k`` best articles of a partition for each search, block by block; earlier blocks set the floor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, list[tuple[int, object]]] = {}
        rows: list[tuple] = []
        n = 0

        def flush() -> None:
            rows.sort(key=lambda r: (pd.isna(r[0]), 0 if pd.isna(r[0]) else r[0]))
            sizes = np.array([len(r[2]) for r in rows])
            term = np.concatenate([r[2] for r in rows]).astype(np.int64)
            times = np.concatenate([r[3] for r in rows]).astype(np.int64)
            article = np.repeat(np.arange(len(rows)), sizes)
            length = np.array([r[1] for r in rows], np.int64)
            index = Index(term, article, corpus.impacts(term, times, length[article]), len(rows))
            for number, asked in searches:
                top = kept.setdefault(number, [])
                places, scores = index.search(asked, k, top[-1][0] if len(top) == k else 1, layout.popped)
                if len(places):
                    top += [(s, rows[p][0]) for p, s in zip(places.tolist(), scores.tolist(), strict=True)]
                    top.sort(key=lambda x: (-x[0], pd.isna(x[1]), 0 if pd.isna(x[1]) else x[1]))
                    del top[k:]

        for batch in batches:
            for row in zip(batch["id"], batch["n"], batch["terms"], batch["times"], strict=True):
                if len(row[2]):
                    rows.append(row)
                    n += len(row[2])
                    if len(rows) >= layout.block_articles or n >= layout.block_postings:
                        flush()
                        rows.clear()
                        n = 0
        if rows:
            flush()
        out = [(number, i, score) for number, top in kept.items() for score, i in top]
        yield pd.DataFrame(out, columns=["number", "id", "score"])

    return run


def _one_block(articles: DataFrame, asked: list, searches: DataFrame, k: int, layout: Layout) -> DataFrame | None:
    """The best articles for the searches of one block: their texts come to the driver, as ``Layout`` bounds them."""
    numbers: dict[bytes, int] = {}
    wanted = [(row["number"], np.unique([numbers.setdefault(t, len(numbers)) for t in terms(row["content"])]))
              for row in asked]
    kind = dict(articles.dtypes)["id"]
    postings = materialise(articles.mapInPandas(_postings(numbers), f"id {kind}, n bigint, terms array<int>, times array<int>"), "postings")
    total, tokens = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = np.zeros(len(numbers), np.int64)
    for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # of the asked terms only
        found[row["term"]] = row["count"]
    corpus = Corpus.of(total, tokens, found)
    best = postings.mapInPandas(_best([(i, t) for i, t in wanted if len(t)], corpus, k, layout), f"number bigint, id {kind}, score bigint")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(searches.select("number", "search"), "number").select("search", "rank", "id", "score")


def best_articles(articles: DataFrame, headlines: DataFrame, limit: int = 50, key: str = "id", text: str = "content",
                  search: str = "id", words: str = "headline", layout: Layout = Layout()) -> DataFrame:
    """The ``limit`` articles that match each headline best: (search, rank, id, score), one row per match.

    Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lowered. With N
    articles that have a term, L terms in all of them, n terms in one, df articles holding a term and tf of it in
    one, a term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 50 + (50 * n * N) div L, and a score is the sum of
    w * ((10**9 * tf) div (1000 * tf + 20 * m)) over the distinct terms of the headline. Ranks run from 1 without gaps;
    equal scores come by rising id, a missing id last. Scores of 0 are left out.

    One pass counts the asked terms in whole articles and stores them; the second builds an index per block
    of articles (``Index``) and searches it. A partition sends at most ``limit`` rows a headline. Headlines are
    taken in blocks of bounded text, each with its own passes.

    Null and empty texts have no terms: such articles never match, such headlines match nothing. Repeated rows,
    of articles and of headlines, count and match each on their own. Other columns are ignored; no articles or no
    headlines give no rows.
    """
    rows = narrowed(articles, id=key, content=text)
    asked = narrowed(headlines, search=search, content=words).withColumn("number", F.monotonically_increasing_id())
    asked = materialise(asked, "searches")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("bigint")).first()[0]
    blocks = max(1, -(-size // layout.search_bytes))
    block: Column = F.pmod(F.xxhash64("number"), F.lit(blocks))
    out = None
    for at in range(blocks):
        mine = asked.filter(block == at)
        part = _one_block(rows, mine.select("number", "content").collect(), mine, limit, layout)
        out = part if out is None else out.unionByName(part)
    return out if blocks == 1 else materialise(out, "matches")
