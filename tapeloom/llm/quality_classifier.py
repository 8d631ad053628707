"""Quality scores of articles: random-indexing word vectors, pooled, into a small numpy network."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .records import narrowed, words


@dataclass(frozen=True)
class Space:
    """Word vectors. Words share ``buckets`` by hash, so the table has one size for every corpus."""

    buckets: int = 8192
    width: int = 32
    window: int = 2
    ending: int = 3


@dataclass(frozen=True)
class Fit:
    """Network and fitting. ``rows`` bounds the rated articles it is fitted on, taken by a hash of their ids."""

    rows: int = 20_000
    hidden: int = 24
    epochs: int = 60
    batch: int = 256
    rate: float = 3e-3
    decay: float = 1e-4
    aside: float = 0.2
    seed: int = 7


def units(content: str | None, space: Space) -> np.ndarray:
    """Buckets of each word and of its ending, shape (2, words). The ending stands in for words never seen."""
    found = words(content)
    crc = zlib.crc32
    whole = np.fromiter(map(crc, found), np.int64, len(found))
    ends = np.fromiter((crc(w[-space.ending:], 1) for w in found), np.int64, len(found))
    return np.stack([whole, ends]) % space.buckets


def index_signs(space: Space) -> np.ndarray:
    """The sparse random index of each bucket: two places, one counted up and one down."""
    rng = np.random.default_rng(12)
    up = rng.integers(0, space.width, space.buckets)
    return np.stack([up, (up + rng.integers(1, space.width, space.buckets)) % space.width])


def add_contexts(table: np.ndarray, parts: list[np.ndarray], space: Space, signs: np.ndarray) -> None:
    """Adds to the rows of every word and ending the random indexes of the words around it."""
    size = space.buckets * space.width
    for d in range(1, space.window + 1):
        near = [(p[:, :-d], p[:, d:]) for p in parts if p.shape[1] > d]
        if not near:
            continue
        before, after = (np.concatenate(x, axis=1) for x in zip(*near, strict=True))
        for mine, other in ((before, after[0]), (after, before[0])):
            for k, sign in ((0, 1), (1, -1)):
                at = signs[k][other]
                for unit in mine:
                    table += sign * np.bincount(unit * space.width + at, minlength=size)


def _contexts(space: Space, flush_words: int = 1_000_000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signs = index_signs(space)
        table = np.zeros(space.buckets * space.width, np.int64)
        parts, n = [], 0
        for batch in batches:
            for content in batch["content"]:
                parts.append(units(content, space))
                n += parts[-1].shape[1]
                if n >= flush_words:
                    add_contexts(table, parts, space, signs)
                    parts, n = [], 0
        add_contexts(table, parts, space, signs)
        rows = table.reshape(space.buckets, space.width)
        used = np.flatnonzero(rows.any(axis=1))
        yield pd.DataFrame({"bucket": used, **{f"x{k}": rows[used, k] for k in range(space.width)}})

    return run


def word_vectors(articles: DataFrame, space: Space = Space()) -> np.ndarray:
    """Vectors of all buckets, from the contexts of all words of all articles.

    Every task adds its own table; the tables are summed by bucket. The result has ``buckets`` rows however
    many articles there are. Vectors are centred and have length 1; an unused bucket is zero.
    """
    columns = [f"x{k}" for k in range(space.width)]
    parts = articles.select("content").mapInPandas(_contexts(space), "bucket int, " + ", ".join(f"{c} bigint" for c in columns))
    summed = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    table = np.zeros((space.buckets, space.width), np.float32)
    if len(summed):
        rows = summed[columns].to_numpy(np.float64)
        rows = np.sign(rows) * np.log1p(np.abs(rows))
        rows -= rows.mean(axis=0)
        rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        table[summed["bucket"].to_numpy()] = rows
    return table


def pool(contents: pd.Series, vectors: np.ndarray, space: Space) -> np.ndarray:
    """Mean and deviation of the word vectors of each text, and the logarithm of its length; zeros without words."""
    out = np.zeros((len(contents), 2 * space.width + 1), np.float32)
    for i, content in enumerate(contents):
        whole, ends = units(content, space)
        if len(whole):
            own = vectors[whole] + vectors[ends]
            mean = own.mean(axis=0)
            spread = np.einsum("ij,ij->j", own, own) / len(own) - mean * mean
            out[i] = np.concatenate([mean, np.sqrt(np.maximum(spread, 0)), [np.log1p(len(whole)) / 10]])
    return out


class Network:
    """One hidden layer of rectified units and a logistic output, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fit: Fit):
        rng = np.random.default_rng(fit.seed)
        self.middle, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.parts = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], fit.hidden)), np.zeros(fit.hidden),
                      rng.normal(0, np.sqrt(1 / fit.hidden), fit.hidden), np.zeros(1)]
        self.temperature = 1.0
        order = rng.permutation(len(x))
        aside, order = np.split(order, [int(fit.aside * len(x))])
        self._train(x[order], y[order], fit, rng)
        if len(aside):
            self._calibrate(self.logits(x[aside]), y[aside])

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.middle) / self.scale @ self.parts[0] + self.parts[1], 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(x) @ self.parts[2] + self.parts[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))

    def _train(self, x, y, fit, rng) -> None:
        first, second, step = [0.0] * 4, [0.0] * 4, 0
        for _ in range(fit.epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // fit.batch)):
                step += 1
                a, h = (x[at] - self.middle) / self.scale, self._hidden(x[at])
                error = (1 / (1 + np.exp(-np.clip(h @ self.parts[2] + self.parts[3][0], -50, 50))) - y[at]) / len(at)
                back = np.outer(error, self.parts[2]) * (h > 0)
                slopes = [a.T @ back + fit.decay * self.parts[0], back.sum(0), h.T @ error + fit.decay * self.parts[2],
                          np.array([error.sum()])]
                for k, slope in enumerate(slopes):
                    first[k] = 0.9 * first[k] + 0.1 * slope
                    second[k] = 0.999 * second[k] + 0.001 * slope**2
                    self.parts[k] = self.parts[k] - fit.rate * (first[k] / (1 - 0.9**step)) / (
                        np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def _calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        """The temperature under which rows set aside are likeliest."""
        tried = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, np.where(y > 0, -logits, logits) / t).mean() for t in tried]
        self.temperature = float(tried[int(np.argmin(loss))])


class Constant:
    """The score where ratings of one kind only, or none, are known."""

    def __init__(self, score: float):
        self.score = score

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.score)


def _pooled(vectors: np.ndarray, space: Space):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "x": list(pool(batch["content"], vectors, space).astype(np.float64))})

    return run


def fitted(articles: DataFrame, ratings: DataFrame, vectors: np.ndarray, space: Space = Space(), fit: Fit = Fit()):
    """A model of the ratings (id, quality), fitted on at most ``fit.rows`` of them; the bound holds on the driver too."""
    rated = (ratings.filter("id IS NOT NULL AND quality IN (0, 1)").groupBy("id").agg(F.max("quality").alias("quality"))
             .orderBy(F.xxhash64("id"), "id").limit(fit.rows))
    known = articles.join(F.broadcast(rated.select("id")), "id", "left_semi")
    rows = (known.mapInPandas(_pooled(vectors, space), "id bigint, x array<double>").groupBy("id").agg(F.min("x").alias("x"))
            .join(F.broadcast(rated), "id").orderBy("id").toPandas())
    y = rows["quality"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return Constant(float((y.sum() + 1) / (len(y) + 2)))
    return Network(np.stack(rows["x"]), y, fit)


def quality_of(articles: DataFrame, ratings: DataFrame, key: str = "id", text: str = "content", space: Space = Space(),
               fit: Fit = Fit()) -> Callable[[Column], Column]:
    """The fitted classifier as a function from a text column to a column of probabilities, for ``quality_scores`` or filters."""
    rows = narrowed(articles, id=key, content=text)
    vectors = word_vectors(rows, space)
    model = fitted(rows, ratings, vectors, space, fit)

    @F.pandas_udf(T.DoubleType())
    def score(content: pd.Series) -> pd.Series:
        return pd.Series(model.scores(pool(content, vectors, space)), dtype="float64")

    return score


def quality_scores(articles: DataFrame, ratings: DataFrame, key: str = "id", text: str = "content",
                   space: Space = Space(), fit: Fit = Fit()) -> DataFrame:
    """Probability that an article is of good quality: (id, score), one row per input row.

    ``ratings`` (id, quality 0 or 1) are the only labels used. Word vectors come from all articles; the
    network is fitted on at most ``fit.rows`` rated ones and its probabilities are calibrated by a
    temperature on a part set aside.

    Only the text makes the score: rows with equal texts get equal scores. Null and blank texts get the score
    of a text without words. An id rated twice counts as good if any rating is good. With ratings of one
    kind, or none, every score is their smoothed share. Other columns are ignored; no rows give no rows.
    """
    score = quality_of(articles, ratings, key, text, space, fit)
    rows = narrowed(articles, id=key, content=text)
    return rows.select("id", score(F.col("content")).alias("score"))
