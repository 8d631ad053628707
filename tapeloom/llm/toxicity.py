"""Toxicity of articles from their nearest moderated examples, by exact TF-IDF cosine over all terms of the examples."""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tapeloom.session import materialise

from .records import narrowed

@dataclass(frozen=True)
class Votes:
    """``rows`` bounds the examples, and with them the index on the driver and in every task; all their terms are in it."""

    rows: int = 20_000
    stem: int = 5             # a longer word also counts as its first letters
    neighbours: int = 25
    block: int = 64
    aside: float = 0.2        # share of the examples that only calibrates
    checked: int = 4000       # and at most so many
    shown: int = 3            # neighbours named as evidence


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters whose hashes are made at once, but for longer words.
_SPAN = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Of every code point, whether it is a letter: a character of words that is neither a digit nor the underscore."""
    out = np.zeros(sys.maxunicode + 1, bool)
    out[[i for i in range(len(out)) if (c := chr(i)).isalnum() and not c.isdecimal()]] = True
    return out


def _powers(base: int, n: int) -> np.ndarray:
    """At least n powers, from the 0th; as many as were asked for once are kept."""
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = np.cumprod(np.append(np.uint64(1), np.full(max(n, 1 << 18), base, np.uint64)))
    return _POWERS[base]


_POWERS: dict[int, np.ndarray] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _hashed(word: str) -> int:
    """64 bits of a word: a polynomial of its characters, mixed."""
    return int(_mixed(np.array([sum(ord(c) * pow(_BASE, i, 1 << 64) for i, c in enumerate(word)) % (1 << 64)], np.uint64))[0])


class Terms:
    """Terms of texts: words of letters, lower case, and the stems of longer ones (``abcde~``), by 64-bit hashes.

    With a vocabulary (rising hashes) terms are numbers in it and others are left out. The words of all texts of a call are found
    and hashed together, from sums of powers along their characters.
    """

    def __init__(self, stem: int, vocabulary: np.ndarray | None = None):
        self.stem, self.vocabulary = stem, vocabulary

    def _numbers(self, found: np.ndarray) -> np.ndarray:
        if self.vocabulary is None:
            return found
        if not len(self.vocabulary):
            return np.full(len(found), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, found), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == found, at, -1)

    def _hashes(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words, whether they have a stem, and its hashes."""
        longer = ends - starts > self.stem
        whole, stems = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        cuts = [*np.flatnonzero(np.diff(starts // _SPAN, prepend=-1)).tolist(), len(starts)]
        for x, y in pairwise(cuts):
            first, n = starts[x], int(ends[y - 1] - starts[x])
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(codes[first: first + n] * _powers(_BASE, n)[:n], out=sums[1:])
            s, e, own = starts[x:y] - first, ends[x:y] - first, longer[x:y]
            back = _powers(_INVERSE, n)[s]
            whole[x:y] = (sums[e] - sums[s]) * back
            stems[x:y][own] = (sums[s[own] + self.stem] - sums[s[own]]) * back[own]
        return _mixed(whole), longer, _mixed(stems[longer] + np.uint64(ord("~") * pow(_BASE, self.stem, 1 << 64) % (1 << 64)))

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The distinct terms of each text, rising, and their counts."""
        low = [(t or "").lower() for t in texts]
        codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        borders = np.flatnonzero(np.diff(_letters()[codes].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = borders[::2], borders[1::2]
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), starts, side="right")
        whole, longer, stems = self._hashes(codes, starts, ends)
        distinct, which = np.unique(np.concatenate([whole, stems]), return_inverse=True)
        numbers, size = self._numbers(distinct), max(len(distinct), 1)
        both = np.concatenate([text, text[longer]]) * size + which
        if self.vocabulary is not None:
            both = both[numbers[which] >= 0]
        both, n = np.unique(both, return_counts=True)
        text, at = np.divmod(both, size)
        at, cuts = numbers[at], np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        return [(at[x:y], n[x:y]) for x, y in pairwise(cuts)]


def telling(clean: np.ndarray, toxic: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """Factor of every term, at least 1: the more its presence tells the classes apart, either way, the larger.

    The root of 1 plus the G-square of its presence. No term is left out.
    """
    x = lambda n: n * np.log(np.maximum(n, 1))
    a, b, c, d = toxic, clean, sizes[1] - toxic, sizes[0] - clean
    g = x(a) + x(b) + x(c) + x(d) + x(np.float64(sum(sizes))) - x(a + b) - x(c + d) - x(a + c) - x(b + d)
    return np.sqrt(1 + np.maximum(2 * g, 0))


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of length 1."""
    w = (1 + np.log(counts)) * idf
    return w / np.sqrt(w @ w) if len(w) else w


def similar_first(matrix: np.ndarray, block: int) -> np.ndarray:
    """An order of rows that brings alike ones together: halves along the main direction, again and again."""
    out, todo = [], [np.arange(len(matrix))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            out.append(rows)
            continue
        own = matrix[rows] - matrix[rows].mean(axis=0)
        along = own @ np.linalg.eigh(own.T @ own)[1][:, -1]
        rows = rows[np.argsort(along, kind="stable")]
        half = -(-len(rows) // (2 * block)) * block
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _chunks(n: int, size: int = 1_000_000) -> Iterator[slice]:
    return (slice(at, min(n, at + size)) for at in range(0, n, size))


class BlockMaxIndex:
    """Examples in blocks of alike ones, with the largest weight that every frequent term has in every block.

    Counts are kept, not weights: four bytes a posting. The ``dense`` most frequent terms, which also order the examples, travel as
    columns, the others as posting lists. Once ``ready``, the four times as many most frequent terms are columns: ``matrix``
    has their weights in single precision for each example, and ``most`` their maxima by block, rounded up. ``terms`` and ``counts``
    are those of all examples end to end, ``sizes`` how many each has.
    """

    def __init__(self, labels: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray, block: int = 64, dense: int = 256):
        n = len(sizes)
        self.idf, self.block, self.starts = idf, block, np.arange(0, n, block)
        kind = np.uint16 if n <= 1 << 16 else np.int32
        example = np.repeat(np.arange(n, dtype=kind), sizes)
        counts = np.minimum(counts, 65535).astype(np.uint16)
        self.tf = 1 + np.log(np.maximum(np.arange(int(counts.max(initial=1)) + 1), 1))
        held = np.bincount(terms, minlength=len(idf))
        self.column = np.full(len(idf), -1, np.int32)
        self.often = np.argsort(-held, kind="stable")[:dense]
        self.column[self.often] = np.arange(len(self.often))
        square, table = np.zeros(n), np.zeros((n, len(self.often)), np.uint16)
        for s in _chunks(len(terms)):
            square += np.bincount(example[s], weights=(self.tf[counts[s]] * idf[terms[s]]) ** 2, minlength=n)
            column = self.column[terms[s]]
            inside = np.flatnonzero(column >= 0)
            table[example[s][inside], column[inside]] = counts[s][inside]
        self.length = np.where(square > 0, np.sqrt(square), 1.0)
        self.table = table
        self.order = similar_first(self._weights(), block)
        place = np.empty(n, kind)
        place[self.order] = np.arange(n)
        self.table, self.length, self.labels = table[self.order], self.length[self.order], labels[self.order].astype(np.float64)
        rest = np.flatnonzero(self.column[terms] < 0)
        rest = rest[np.argsort(terms[rest], kind="stable")]
        self.postings = np.empty(len(rest), np.uint32 if n <= 1 << 16 else np.uint64)  # example and count
        for s in _chunks(len(rest)):
            self.postings[s] = place[example[rest[s]]]
            self.postings[s] <<= 16
            self.postings[s] |= counts[rest[s]]
        held[self.often] = 0
        self.begin = np.append(0, np.cumsum(held))

    def _weights(self) -> np.ndarray:
        """Rows of the frequent terms' weights, in vectors of length 1."""
        seen = np.where(self.table > 0, self.tf[self.table], 0.0)
        return seen * self.idf[self.often] / self.length[:, None]

    def ready(self) -> BlockMaxIndex:
        """Makes what needs not travel: the rows of weights and the maxima of the blocks."""
        held, own = np.diff(self.begin), len(self.often)
        more = np.argsort(-held, kind="stable")[: 3 * own]
        more = more[held[more] > 0]
        self.wide, self.place = np.concatenate([self.often, more]), self.column.copy()
        self.place[more] = np.arange(own, len(self.wide))
        self.seen = np.zeros((len(self.length), len(self.wide)), np.uint16)
        self.seen[:, :own] = self.table
        for c, t in enumerate(more.tolist(), own):
            run = self.postings[self.begin[t]: self.begin[t + 1]]
            self.seen[run >> 16, c] = run & 0xFFFF
        self.present = np.append(0.0, self.tf[1:])  # a term that is not there weighs nothing
        self.matrix = np.empty(self.seen.shape, np.float32)
        for s in _chunks(len(self.seen), 1000):
            self.matrix[s] = self.present[self.seen[s]] * self.idf[self.wide] / self.length[s, None]
        self.most = np.maximum.reduceat(self.matrix, self.starts, axis=0) * np.float64(1 + 1e-6) if len(self.starts) else self.matrix
        #: Of the sum over the columns in single precision, of two vectors no longer than 1, the largest error.
        self.slack = 1.1 * (len(self.wide) + 4) * 2.0**-24
        return self

    def _listed(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the terms with posting lists add to the cosine of each example."""
        first, n = self.begin[at], self.begin[at + 1] - self.begin[at]
        ends = np.cumsum(n)
        if not len(at) or not ends[-1]:
            return np.zeros(len(self.length))
        found = self.postings[np.arange(ends[-1]) + np.repeat(first - ends + n, n)]
        weight = self.tf[found & 0xFFFF] * np.repeat(w * self.idf[at], n)
        return np.bincount((found >> 16).astype(np.int64), weights=weight, minlength=len(self.length)) / self.length

    def nearest(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector (terms, weights) the k examples of the largest cosine above 0, exactly, and all that tie with the last of
        them; nearest first.

        A bound of a block is what the listed terms add at most in it, plus the sum of the block's maxima of the frequent ones. Each
        vector opens its best blocks first, which gives it a k-th cosine, then only blocks whose bound reaches that. A
        block is opened for all vectors of a batch that want it at once, in single precision; whatever may be among the nearest by
        that, errors allowed for, gets its cosine in double precision from the counts.
        """
        n, q = len(self.length), len(asked)
        if not n or not q:
            return [(np.zeros(0, np.int64), np.zeros(0))] * q
        dense, part = np.zeros((q, len(self.wide))), np.zeros((q, n))
        for i, (at, w) in enumerate(asked):
            column = self.place[at]
            often = column >= 0
            dense[i, column[often]] = w[often]
            part[i] = self._listed(at[~often], w[~often])
        single, slack = dense.astype(np.float32), self.slack + 1e-9
        bounds = np.maximum.reduceat(part, self.starts, axis=1) + dense @ self.most.T
        floor = np.full(q, 1e-12)
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # vector, place, cosine: those that reach the floor

        def open_blocks(wanted: np.ndarray) -> None:
            met = [[x] for x in best]
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                who = np.flatnonzero(wanted[:, b])
                rows = slice(self.starts[b], min(n, self.starts[b] + self.block))
                cos = part[who, rows] + single[who] @ self.matrix[rows].T
                hit, at = np.nonzero((cos >= floor[who, None] - slack) & (cos > 5e-13))
                for x, more in zip(met, (who[hit], at + rows.start, cos[hit, at]), strict=True):
                    x.append(more)
            who, places, cos = (np.concatenate(x) for x in met)
            order = np.lexsort((-cos, who))
            who, places, cos = who[order], places[order], cos[order]
            first = np.searchsorted(who, np.arange(q + 1))
            full = np.flatnonzero(np.diff(first) >= k)
            floor[full] = np.maximum(floor[full], cos[first[full] + k - 1] - slack)  # no more than the true k-th
            kept = cos >= floor[who] - slack
            best[:] = who[kept], places[kept], cos[kept]

        rank = np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1)
        seen = np.zeros_like(bounds, bool)
        for upto in (4, 32, len(self.starts)):
            wanted = (rank < upto) & ~seen & (bounds >= floor[:, None] - 1e-9)
            open_blocks(wanted)
            seen |= wanted
        out = []
        first = np.searchsorted(best[0], np.arange(q + 1))
        for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            places, own = best[1][x:y], np.flatnonzero(dense[i])
            cos = part[i, places] + self.present[self.seen[places[:, None], own]] @ (dense[i, own] * self.idf[self.wide[own]]) / self.length[places]
            places, cos = places[cos > 1e-12], cos[cos > 1e-12]
            near = np.round(cos, 12)
            order = np.lexsort((places, -near))
            order = order[near[order] >= near[order[min(k, len(order)) - 1]]] if len(order) else order
            out.append((places[order], cos[order]))
        return out

    def votes(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[float, np.ndarray]]:
        """Share of toxic neighbours, the nearer the heavier; NaN without neighbours. And the neighbours, by the caller's numbers."""
        out = []
        for places, cos in self.nearest(asked, k):
            near = 1 / (1.02 - np.minimum(cos, 1.0))
            out.append((float(near @ self.labels[places] / near.sum()) if len(places) else float("nan"), self.order[places]))
        return out


class Calibration:
    """Rising steps from votes to frequencies of toxic examples (pool adjacent violators); apart for no vote at all."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray):
        share = float((labels.sum() + 1) / (len(labels) + 2))
        none = np.isnan(votes)
        self.silent = float((labels[none].sum() + share) / (none.sum() + 1))
        order = np.argsort(votes[~none], kind="stable")
        steps: list[list[float]] = []  # sum of votes, of labels, rows
        for v, y in zip(votes[~none][order].tolist(), labels[~none][order].tolist(), strict=True):
            steps.append([v, y, 1.0])
            while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
                last = steps.pop()
                steps[-1] = [a + b for a, b in zip(steps[-1], last, strict=True)]
        self.x = np.array([s[0] / s[2] for s in steps] or [0.0])
        self.y = np.maximum.accumulate(np.array([(s[1] + share) / (s[2] + 1) for s in steps] or [share]))

    def __call__(self, vote: float) -> float:
        return self.silent if np.isnan(vote) else float(np.interp(vote, self.x, self.y))


# ---------------------------------------------------------------- Spark

#: Characters of the texts whose terms are held at once.
TOGETHER = 200_000


def _portions(texts: list) -> Iterator[slice]:
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= TOGETHER or i == len(texts) - 1:
            yield slice(at, i + 1)
            at, n = i + 1, 0


def _hashes(stem: int):
    """Hashes and counts of the examples' terms, packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Terms(stem)
        for batch in batches:
            texts = batch["content"].tolist()
            for s in _portions(texts):
                found = find(texts[s])
                yield pd.DataFrame({"id": batch["id"].iloc[s], "toxic": batch["toxic"].iloc[s], "at": [a.tobytes() for a, _ in found],
                                    "n": [n.astype(np.uint32).tobytes() for _, n in found]})

    return run


def _unpacked(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each value holds, and all numbers end to end, chunk by chunk out of Arrow's own buffers."""
    size = np.dtype(kind).itemsize
    sizes = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) // size for c in column.chunks]
    out, at = np.empty(sum(int(s.sum()) for s in sizes), kind), 0
    for chunk, each in zip(column.chunks, sizes, strict=True):
        n = int(each.sum())
        if n:
            start = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset]
            out[at: at + n] = np.frombuffer(chunk.buffers()[2], kind, n, start)
        at += n
    return np.concatenate([np.zeros(0, np.int64), *sizes]), out


def _held(vocabulary: np.ndarray, stem: int):
    """How many texts hold each term of the vocabulary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, held = Terms(stem, vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            texts = batch["content"].tolist()
            for s in _portions(texts):
                for at, _ in find(texts[s]):
                    held[at] += 1
        used = np.flatnonzero(held)
        yield pd.DataFrame({"term": used, "n": held[used]})

    return run


@dataclass(frozen=True)
class Examples:
    """The index of the examples, for the tasks, and what makes vectors of texts."""

    name: str
    ids: list
    index: BlockMaxIndex
    vocabulary: np.ndarray

    def ready(self, votes: Votes) -> tuple[Terms, BlockMaxIndex]:
        """Once in each Python worker."""
        if self.name not in _MADE:
            _MADE.clear()
            _MADE[self.name] = Terms(votes.stem, self.vocabulary), self.index.ready()
        return _MADE[self.name]


_MADE: dict[str, tuple[Terms, BlockMaxIndex]] = {}
#: Vectors looked up together.
AT_ONCE = 192


def _voted(examples: Examples, steps: Calibration | None, votes: Votes):
    """Votes on texts and the nearest examples; as probabilities with ``steps``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[bytes, tuple[float, list]] = {}
        find, index = examples.ready(votes)

        def look_up(new: dict[bytes, tuple[np.ndarray, np.ndarray]]) -> None:
            for key, (vote, docs) in zip(new, index.votes(list(new.values()), votes.neighbours), strict=True):
                memo[key] = vote if steps is None else steps(vote), [examples.ids[d] for d in docs[: votes.shown].tolist()]

        for batch in batches:
            if len(memo) > 20_000:
                memo.clear()
            keys, new, texts = [], {}, batch["content"].tolist()
            for s in _portions(texts):
                for at, counts in find(texts[s]):
                    keys.append(hashlib.sha256(at.tobytes() + counts.tobytes()).digest())
                    if keys[-1] not in memo and keys[-1] not in new:
                        new[keys[-1]] = at, weighted(counts, index.idf[at])
                        if len(new) == AT_ONCE:
                            look_up(new)
                            new = {}
            look_up(new)
            yield pd.DataFrame({"id": batch["id"], "score": [memo[k][0] for k in keys], "evidence": [memo[k][1] for k in keys]})

    return run


def toxicity(articles: DataFrame, moderated: DataFrame, key: str = "id", text: str = "content", votes: Votes = Votes()) -> DataFrame:
    """Probability that an article is toxic: (id, score, evidence), one row per input row.

    ``moderated`` (id, toxic 0 or 1) are the only labels used; at most ``votes.rows`` of them, taken by a hash
    of their ids, are the examples. All terms of the examples, of both classes, span the space, their document
    frequencies are counted over all articles; a term weighs the more, the more it tells the classes apart. The nearest examples
    by exact cosine vote, the nearer the heavier, all that tie with the last one too. A part of the examples is set aside: it neither
    votes nor weighs terms, and tells how often texts with such a vote are toxic. ``evidence`` names the nearest examples (ids).

    Only the text makes the score. Null and empty texts and those without a term of any example have no neighbours:
    their score is the share of toxic ones among the examples set aside without neighbours. An id labelled twice is toxic
    if any label says so; equal texts are one example. Without labels every score is 0.5. Other columns are ignored; no rows give no rows.
    """
    rows = narrowed(articles, id=key, content=text)
    kind = dict(rows.dtypes)["id"]
    labels = (moderated.filter("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("id"), "id").limit(votes.rows))
    known = rows.join(F.broadcast(labels), "id").groupBy("id", "toxic").agg(F.min("content").alias("content"))
    known = materialise(known.groupBy("content").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic")), "moderated")
    found = known.mapInPandas(_hashes(votes.stem), f"id {kind}, toxic int, at binary, n binary").toArrow()
    order = pc.sort_indices(found, [("id", "ascending")])
    ids, toxic = found.column("id").take(order).to_pylist(), found.column("toxic").take(order).to_numpy()
    (sizes, counts), found = _unpacked(found.column("n").take(order), np.uint32), found.drop_columns(["n"])
    (_, hashes), found = _unpacked(found.column("at").take(order), np.uint64), None
    vocabulary, terms = np.unique(hashes), np.empty(len(hashes), np.int32)
    for s in _chunks(len(hashes)):
        terms[s] = np.searchsorted(vocabulary, hashes[s])
    del hashes
    counted = rows.select("content").mapInPandas(_held(vocabulary, votes.stem), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(len(vocabulary))
    frequency[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    idf = np.log((1 + rows.count()) / (1 + frequency)) + 1
    # every few in the order of their ids' hashes, so that both parts are alike
    aside = np.zeros(len(ids), bool)
    every = max(1, round(1 / votes.aside), -(-len(ids) // votes.checked))
    aside[np.argsort([xxhash.xxh64_intdigest(str(i).encode("utf-8", "replace")) for i in ids], kind="stable")[every - 1:: every]] = True
    of = np.repeat(~aside, sizes)
    own = np.repeat(toxic.astype(np.int8), sizes)
    classes = [np.bincount(terms[of & (own == y)], minlength=len(vocabulary)).astype(float) for y in (0, 1)]
    idf *= telling(*classes, (int((toxic[~aside] == 0).sum()), int((toxic[~aside] == 1).sum())))
    terms, counts = terms[of], counts[of]
    del of, own
    shipped = Examples(uuid.uuid4().hex, [i for i, out in zip(ids, aside, strict=True) if not out],
                       BlockMaxIndex(toxic[~aside], sizes[~aside], terms, counts, idf, votes.block), vocabulary)
    del terms, counts
    spoken = f"id {kind}, score double, evidence array<{kind}>"
    checks = rows.sparkSession.createDataFrame([(i,) for i, out in zip(ids, aside, strict=True) if out], f"id {kind}")
    told = known.join(F.broadcast(checks), "id", "left_semi").select("id", "content").mapInPandas(_voted(shipped, None, votes), spoken)
    told = {r["id"]: r["score"] for r in told.select("id", "score").collect()}  # of the examples set aside
    pairs = [(told[i], y) for i, y, out in zip(ids, toxic.tolist(), aside, strict=True) if out]
    steps = Calibration(np.array([np.nan if v is None else v for v, _ in pairs], float), np.array([y for _, y in pairs], float))
    return rows.mapInPandas(_voted(shipped, steps, votes), spoken)
