"""Log-probability of articles under a smoothed n-gram model of the other articles, read by a backoff automaton."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.session import materialise

from .pieces import mixed
from .records import lower_words, narrowed


@dataclass(frozen=True)
class Smoothing:
    """``strength``: how many words' worth the unigram model weighs beside the followers of a word."""

    strength: float = 500.0
    chunk_words: int = 600_000      # articles are encoded in chunks of about so many words
    bucket_grams: int = 1_000_000   # n-grams counted at once


_END, _BEGIN = 0x27D4EB2F165667C5, 0x165667B19E3779F9  # stand in for hashes of the two marks


def _planes(values: np.ndarray) -> np.ndarray:
    """The lowest byte of each number, then the next byte of each, and so on."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)


def packed(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Whole numbers from 0 on, between the borders ``at``: the bytes that the largest one needs, and their planes."""
    values = values.astype(np.uint64, copy=False)
    planes, most = _planes(values), np.maximum.reduceat(values, at[:-1])
    out = []
    for x, y, largest in zip(at[:-1].tolist(), at[1:].tolist(), most.tolist(), strict=True):
        width = max(1, -(-largest.bit_length() // 8))
        out.append(bytes([width]) + planes[:width, x:y].tobytes())
    return out


def unpacked(blob: pa.BinaryScalar) -> np.ndarray:
    flat = np.frombuffer(blob.as_buffer(), np.uint8)
    planes = flat[1:].reshape(flat[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(np.uint64)[:, 0]


class Texts:
    """Articles on their way into a chunk: their words only as numbers of the distinct ones."""

    def __init__(self):
        self.ids, self.train, self.sizes = [], [], []
        self.names: dict[bytes, int] = {}
        self.codes, self.tokens = array("i"), 0

    def add(self, content: str | None) -> None:
        names, found = self.names, lower_words(content)
        self.codes.extend([names.setdefault(w, len(names)) for w in found])
        self.sizes.append(len(found))
        self.tokens += len(found) + 1

    def chunk(self, name: str) -> pa.RecordBatch:
        """Articles with their words as numbers, the most frequent word 0; and the words' hashes."""
        codes = np.frombuffer(self.codes, np.int32)
        order = np.argsort(-np.bincount(codes, minlength=len(self.names)), kind="stable")
        place = np.empty(len(self.names), np.uint16 if len(self.names) < 2**16 else np.uint32)
        place[order] = np.arange(len(self.names))
        digest, known = xxhash.xxh64_intdigest, list(self.names)
        hashes = np.array([digest(known[i]) for i in order.tolist()], np.uint64)
        one = {"chunk": pa.array([name])}
        for column, parts in (("ids", self.ids), ("train", self.train), ("sizes", [pa.array(self.sizes, pa.int32())])):
            flat = pa.concat_arrays(parts)
            one[column] = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
        one["words"] = pa.array([hashes.tobytes()], pa.binary())
        one["wide"] = pa.array([place.itemsize == 4])
        one["codes"] = pa.array([pa.compress(_planes(place[codes]).tobytes(), codec="zstd", asbytes=True)], pa.binary())
        return pa.RecordBatch.from_pydict(one)


def _encoded(chunk_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, texts = TaskContext.get().partitionId(), 0, Texts()
        for batch in batches:
            at, n = 0, batch.num_rows
            for i, content in enumerate(batch.column("content"), 1):
                texts.add(content.as_py())
                if texts.tokens >= chunk_words or i == n:
                    texts.ids.append(batch.column("id").slice(at, i - at))
                    texts.train.append(batch.column("train").slice(at, i - at))
                    at = i
                if texts.tokens >= chunk_words:
                    yield texts.chunk(f"{part}-{number}")
                    number, texts = number + 1, Texts()
        if texts.sizes:
            yield texts.chunk(f"{part}-{number}")

    return run


class Chunk:
    """A chunk with its n-grams: of each order, their hashes in rising order and their training counts."""

    def __init__(self, rows: pa.RecordBatch | pa.Table, i: int = 0):
        of = {name: rows.column(name)[i] for name in rows.schema.names}
        self.name, self.ids = of["chunk"].as_py(), of["ids"].values
        self.sizes = of["sizes"].values.to_numpy().astype(np.int64)
        train = of["train"].values.to_numpy(zero_copy_only=False).astype(bool)
        words = np.frombuffer(of["words"].as_buffer(), np.uint64)
        self.end, self.begin = len(words), len(words) + 1
        self.width = self.begin + 1
        # each text is its words and one end; what stands before each of them
        last = np.cumsum(self.sizes + 1) - 1
        self.starts = last - self.sizes
        self.tokens = np.full(last[-1] + 1, self.end, np.int32)
        inside = np.ones(len(self.tokens), bool)
        inside[last] = False
        kind, n = np.dtype(np.uint32 if of["wide"].as_py() else np.uint16), int(self.sizes.sum())
        if n:
            planes = np.frombuffer(pa.decompress(of["codes"].as_buffer(), n * kind.itemsize, codec="zstd"), np.uint8)
            self.tokens[inside] = np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind)[:, 0]
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = self.begin
        learned = np.repeat(train, self.sizes + 1)
        hashes = mixed(np.concatenate([words, np.array([_END, _BEGIN], np.uint64)]))
        word_counts = np.bincount(self.tokens[learned], minlength=self.begin)[: self.begin]
        self.word_order = np.argsort(hashes[: self.begin], kind="stable")
        self.word_hashes, self.word_counts = hashes[self.word_order], word_counts[self.word_order]
        self.texts = int(train.sum())
        # a pair and whether it is learned from as one number, which is sorted in place
        pair = self.before.astype(np.int64)
        pair *= self.width
        pair += self.tokens
        pair *= 2
        pair += learned
        pair.sort()
        learned = (pair & 1).astype(np.int32)
        pair >>= 1
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        pairs, counts = pair[first], np.add.reduceat(learned, first)
        del pair, learned, first
        right = np.concatenate([words, np.array([_END, _BEGIN], np.uint64)]) * np.uint64(0x9E3779B97F4A7C15)
        grams = hashes[pairs // self.width]
        grams += right[pairs % self.width]
        grams = mixed(grams)
        order = np.argsort(grams, kind="stable")
        self.pairs, self.pair_hashes, self.pair_counts = pairs[order], grams[order], counts[order]


def _buckets(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of rising hashes, equal shares of the range: those that hold any, their borders, and the gaps
    from hash to hash, the first of a bucket from the bucket's edge."""
    edges = ((np.arange(n, dtype=object) << 64) // n).astype(np.uint64)
    at = np.append(np.searchsorted(hashes, edges), len(hashes))
    full = np.flatnonzero(at[1:] > at[:-1])
    starts = at[full]
    gaps = np.diff(hashes, prepend=np.uint64(0))
    gaps[starts] = hashes[starts] - edges[full]
    return full, np.append(starts, len(hashes)), gaps


def _asked(word_buckets: int, pair_buckets: int):
    """Sorted hashes of a bucket travel as gaps and counts as whole numbers, both in as many bytes as the largest needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch, i)
                for order, hashes, counts, buckets in ((1, chunk.word_hashes, chunk.word_counts, word_buckets),
                                                       (2, chunk.pair_hashes, chunk.pair_counts, pair_buckets)):
                    full, at, gaps = _buckets(hashes, buckets)
                    yield pa.RecordBatch.from_pydict({
                        "n": pa.array(np.full(len(full), order, np.int32)), "bucket": pa.array(full.astype(np.int32)),
                        "chunk": pa.array([chunk.name] * len(full)), "grams": pa.array(packed(gaps, at), pa.binary()),
                        "counts": pa.array(packed(counts, at), pa.binary())})

    return run


#: Counts travel as four bytes; those that need more travel beside them.
MOST = 2**31 - 1


def _counts(answers: pd.DataFrame) -> np.ndarray:
    """Counts of all buckets in order."""
    parts = [np.zeros(0, np.int64)]
    for counts, over in zip(answers["counts"], answers["over"], strict=True):
        parts.append(np.array(counts, np.int64))
        for one in over:
            parts[-1][one["at"]] = one["count"]
    return np.concatenate(parts)


def _answered(frame: pd.DataFrame) -> pd.DataFrame:
    """Counts over all chunks for every n-gram asked for, in the order asked; and totals of the bucket."""
    sizes = [len(g) for g in frame["grams"]]
    grams, which = np.unique(np.concatenate(frame["grams"].tolist()), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(frame["counts"].tolist()), minlength=len(grams)).astype(np.int64)
    found = np.split(total[which], np.cumsum(sizes)[:-1])
    out = pd.DataFrame({"n": frame["n"], "bucket": frame["bucket"], "chunk": frame["chunk"],
                        "counts": [np.minimum(x, MOST).astype(np.int32) for x in found],
                        "over": [[(int(i), int(x[i])) for i in np.flatnonzero(x >= MOST)] for x in found]})
    out[["tokens", "kinds", "once", "twice"]] = 0
    first = out.columns.get_indexer(["tokens", "kinds", "once", "twice"])
    out.iloc[0, first] = [total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()]
    return out


def _answers(asked: pa.Table) -> pa.Table:
    """``_answered`` for a bucket whose hashes and counts are packed; so are the counts it returns."""
    out = _answered(pd.DataFrame({
        "n": asked.column("n").to_numpy(), "bucket": asked.column("bucket").to_numpy(), "chunk": asked.column("chunk").to_pylist(),
        "grams": [np.cumsum(unpacked(x)) for x in asked.column("grams")],
        "counts": [unpacked(x).astype(np.int64) for x in asked.column("counts")]}))
    at = np.append(0, np.cumsum([len(x) for x in out["counts"]]))
    over = [[{"at": i, "count": x} for i, x in found] for found in out["over"]]
    whole = {c: pa.array(out[c].to_numpy(np.int64)) for c in ("tokens", "kinds", "once", "twice")}
    return pa.table({"n": asked.column("n"), "bucket": asked.column("bucket"), "chunk": asked.column("chunk"),
                     "counts": pa.array(packed(np.concatenate(out["counts"].tolist()), at), pa.binary()),
                     "over": pa.array(over, pa.list_(pa.struct({"at": pa.int32(), "count": pa.int64()}))), **whole})


@dataclass(frozen=True)
class Totals:
    tokens: int
    kinds: int
    once: int
    twice: int
    texts: int

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Discounted frequency; what is taken off is the probability of any word never seen."""
        if not self.tokens:
            return np.ones(len(counts))
        off = self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.5
        return np.where(counts > 0, counts - off, off * self.kinds) / self.tokens


class Automaton:
    """The model as far as a chunk needs it.

    A state is the word just read. It has arcs for the words that followed it in training, weighing
    log10((c(vw) + s * p(w)) / (c(v) + s)), and a failure arc to the root, weighing log10(s / (c(v) + s)), where
    every word has an arc of weight log10 p(w). Arcs lie in flat arrays, sorted by state and word.
    """

    def __init__(self, chunk: Chunk, words: np.ndarray, pairs: np.ndarray, totals: Totals, strength: float):
        self.width = chunk.width
        single = totals.unigram(words)
        context = np.concatenate([words[: chunk.end], [0, totals.texts]]).astype(float)
        seen = np.flatnonzero(pairs)
        seen = seen[np.argsort(chunk.pairs[seen])]
        self.arcs = chunk.pairs[seen]
        before, after = self.arcs // self.width, self.arcs % self.width
        self.weights = np.log10((pairs[seen] + strength * single[after]) / (context[before] + strength))
        self.failure = np.log10(strength / (context + strength))
        self.root = np.log10(single)

    def read(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Weights of the arcs taken from states over words: the state's own, or else its failure arc and the root's."""
        out = self.failure[states]
        out += self.root[words]
        step = 100_000
        for x in range(0, len(words), step):
            asked = states[x: x + step].astype(np.int64) * self.width + words[x: x + step]
            at = np.searchsorted(self.arcs, asked)
            own = np.flatnonzero(at < len(self.arcs))
            own = own[self.arcs[at[own]] == asked[own]]
            out[x + own] = self.weights[at[own]]
        return out


def _scored(totals: Totals, strength: float):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunks.num_rows:
            none = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
            return pa.schema({"id": chunks.schema.field("ids").type.value_type, **none}).empty_table()
        chunk = Chunk(chunks)
        order = np.lexsort((answers.column("bucket").to_numpy(), answers.column("n").to_numpy()))
        answers = answers.select(["n", "counts", "over"]).take(pa.array(order))
        frame = pd.DataFrame({"n": answers.column("n").to_numpy(), "counts": [unpacked(x) for x in answers.column("counts")],
                              "over": answers.column("over").to_pylist()})
        found = [_counts(frame[frame["n"] == n]) for n in (1, 2)]
        del answers, frame
        words = np.empty(chunk.begin, np.int64)
        words[chunk.word_order] = found[0]
        model = Automaton(chunk, words, found[1], totals, strength)
        known, base = words > 0, np.log10((words + 1) / (totals.tokens + totals.kinds + 1))
        # the state before a word is the word before it
        return pa.table({"id": chunk.ids, "n_tokens": chunk.sizes + 1,
                         "n_known": np.add.reduceat(known[chunk.tokens].astype(np.int64), chunk.starts),
                         "base_score": np.add.reduceat(base[chunk.tokens], chunk.starts),
                         "score": np.add.reduceat(model.read(chunk.before, chunk.tokens), chunk.starts)})

    return run


#: Tokens whose n-grams one task of a shuffle reads, if the session has fewer partitions than that asks for.
TASK_TOKENS = 3_000_000
#: While an intermediate table is made. Shuffle files go when it is stored, not when the driver happens to collect
#: its garbage; a reader holds the rows of a file's row group at once, and a Python worker those of a batch, and a chunk
#: is a row of some megabytes.
STORING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.files.maxRecordsPerFile": "4",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def _dealt(df: DataFrame, tokens: int, *keys: str) -> DataFrame:
    parts = -(-tokens // TASK_TOKENS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _stored(df: DataFrame, label: str, *settings: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in settings}
    try:
        for key in settings:
            conf.set(key, STORING[key])
        return materialise(df, label)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def log_probabilities(articles: DataFrame, train: Column, key: str = "id", text: str = "content",
                      smoothing: Smoothing = Smoothing()) -> DataFrame:
    """log10 probability of every article: (id, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    A text is its words, A-Z lowered, and one end. Rows where ``train`` (a condition on the input) holds are
    learned from. ``base_score`` is the unigram model with one added to every count; ``score`` the bigram
    model with Dirichlet smoothing towards a discounted unigram model, read by an automaton with failure
    arcs. Words are told apart by 64-bit hashes.

    The model is as large as the corpus has word pairs and never lies in one place: chunks of articles
    count their distinct n-grams first, buckets of the hash range add the counts of all chunks and send each
    chunk the counts it asked for, and every chunk builds its part of the automaton.

    A null text is an empty one: its end alone. Repeated rows are scored and learned from as often as they
    come. Without training rows the one unseen word has probability 1. Other columns are ignored; no rows
    give no rows.
    """
    kind = dict(narrowed(articles, id=key).dtypes)["id"]
    rows = articles.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("content"), F.coalesce(train, F.lit(False)).alias("train"))
    cleanup, records, batch = STORING
    chunks = _stored(rows.mapInArrow(_encoded(smoothing.chunk_words), (
        f"chunk string, ids array<{kind}>, train array<boolean>, sizes array<int>, words binary, wide boolean, codes binary")), "encoded", records)
    tokens, texts = chunks.agg(
        F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x + 1)), F.lit(0)),
        F.coalesce(F.sum(F.size(F.filter("train", lambda x: x))), F.lit(0))).first()
    buckets = max(4, -(-tokens // smoothing.bucket_grams))
    # a chunk has several times fewer words than pairs
    asked = chunks.mapInArrow(_asked(max(4, -(-buckets // 3)), buckets), "n int, bucket int, chunk string, grams binary, counts binary")
    answers = _stored(_dealt(asked, tokens, "n", "bucket").groupBy("n", "bucket").applyInArrow(_answers, (
        "n int, bucket int, chunk string, counts binary, over array<struct<at: int, count: bigint>>, "
        "tokens bigint, kinds bigint, once bigint, twice bigint")), "counts", cleanup, batch)
    sums = answers.filter("n = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "kinds", "once", "twice")]).first()
    totals = Totals(*sums, texts)
    found = _dealt(answers.select("n", "bucket", "chunk", "counts", "over"), tokens, "chunk")
    scored = (_dealt(chunks, tokens, "chunk").groupBy("chunk").cogroup(found.groupBy("chunk"))
              .applyInArrow(_scored(totals, smoothing.strength),
                            f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double"))
    return scored.select("id", "n_tokens", "n_known", F.lit(totals.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
