"""Sampled SentencePiece segmentations of articles, and their lossless decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .records import narrowed

#: Where the vocabulary lies; only the driver reads it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"  # stands for a blank in pieces
#: No piece crosses from another character to a blank, or holds a line feed: the lattice of a text is the
#: chain of the lattices of these runs.
_RUN = re.compile(r"\n| *[^ \n]+| +")


class Vocabulary:
    """Pieces of a model file with their weights, and a hash table over all their prefixes.

    The model ranks its pieces. A piece of rank r weighs ``(r + 2) ** -sharpness``, and a segmentation the
    product of its pieces, so few and frequent pieces are likelier. Characters without a piece are spelt in bytes.
    """

    def __init__(self, model: bytes, sharpness: float = 1.0):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.weights: dict[str, float] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        plain = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(BLANK, " ").encode())
                plain.append((piece, i))
        for rank, (piece, i) in enumerate(plain):
            if BLANK in piece.lstrip(BLANK) or "\n" in piece:
                raise ValueError("a piece crosses runs")
            self.ids[piece], self.weights[piece] = i, (rank + 2) ** -sharpness
        self.rare = min(self.weights.values())
        self.longest = max(map(len, self.ids))
        prefixes = sorted({p[:k] for p in self.ids for k in range(1, len(p) + 1)})
        self.id_of = np.array([self.ids.get(p, -1) for p in prefixes], np.int64)
        self.weight_of = np.array([self.weights.get(p, 0.0) for p in prefixes])
        self.hashes = np.array([self._hash(p) for p in prefixes], np.uint64)
        self.slots: list[np.ndarray] = []  # what meets in a table goes on to the next
        left = np.arange(len(prefixes))
        while len(left):
            slots = np.zeros(1 << 20, np.int32)
            slots[self._slot(self.hashes[left], len(self.slots))[::-1]] = left[::-1] + 1
            self.slots.append(slots)
            left = left[slots[self._slot(self.hashes[left], len(self.slots) - 1)] != left + 1]

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * _FACTOR + ord(c) + 1) % 2**64
        return h

    @staticmethod
    def _slot(hashes: np.ndarray, table: int) -> np.ndarray:
        return (hashes * np.uint64(pow(_SECOND, table, 2**64))) >> np.uint64(44)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the prefix with each hash, or -1."""
        out = self.slots[0][self._slot(hashes, 0)] - 1
        for k in range(1, len(self.slots)):
            other = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes))
            out[other] = self.slots[k][self._slot(hashes[other], k)] - 1
        out[(out >= 0) & (self.hashes[out] != hashes)] = -1
        return out


_FACTOR, _SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs get unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lattices:
    """Forward-filtered lattices of distinct runs, all runs side by side in flat arrays.

    Node ``base[run] + end`` stands for the first ``end`` characters of a run. Its pieces lie from ``begin`` of
    the node on: for each the start, its code, and ``upto``, the running probability that backward
    sampling chooses it. Codes from ``fallback`` on are characters spelt in bytes.
    """

    def __init__(self, vocabulary: Vocabulary, runs: list[str]):
        v = vocabulary
        self.length = np.fromiter(map(len, runs), np.int64, len(runs))
        total = int(self.length.sum())
        chars = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).astype(np.int64)
        # a blank reads as the sign for blanks; the sign itself is a character without a piece
        read = np.where(chars == 32, ord(BLANK), np.where(chars == ord(BLANK), 0, chars)).astype(np.uint64)
        begins = np.cumsum(self.length) - self.length
        self.base = begins + np.arange(len(runs))
        run = np.repeat(np.arange(len(runs)), self.length)
        offset = np.arange(total) - begins[run]
        left = self.length[run] - offset
        at, h, edges = np.arange(total), np.zeros(total, np.uint64), []
        for n in range(1, v.longest + 1):  # pieces of n characters, at the places whose prefixes still fit
            fits = np.flatnonzero(left[at] >= n)
            at, h = at[fits], h[fits] * np.uint64(_FACTOR) + read[at[fits] + n - 1] + np.uint64(1)
            found = v.find(h)
            if n == 1:
                bare = np.ones(len(at), bool)
                bare[found >= 0] = v.id_of[found[found >= 0]] < 0
            go = np.flatnonzero(found >= 0)
            at, h, found = at[go], h[go], found[go]
            real = np.flatnonzero(v.id_of[found] >= 0)
            edges.append((at[real], np.full(len(real), n), v.id_of[found[real]], v.weight_of[found[real]]))
        self.fallback = len(v.bytes)
        bare = np.flatnonzero(bare)
        kinds, which = np.unique(chars[bare], return_inverse=True)
        edges.append((bare, np.ones(len(bare), np.int64), self.fallback + which, np.full(len(bare), v.rare)))
        place, n, code, weight = (np.concatenate(x) for x in zip(*edges, strict=True))
        self.spelt = [[v.byte_ids[b] for b in chr(c).encode()] for c in kinds.tolist()]
        start = offset[place]
        end, node = start + n, self.base[run[place]] + start + n
        order = np.lexsort((node, end))
        start, end, node, code, weight = (x[order] for x in (start, end, node, code, weight))
        self._forward(start, end, node, weight, v.longest)
        order = np.argsort(node, kind="stable")
        self.start, self.code, self.upto = start[order], code[order], self.upto[order]
        self.begin = np.searchsorted(node[order], np.arange(total + len(runs) + 1))

    def _forward(self, start, end, node, weight, longest) -> None:
        """Sums the weights of all ways to each node, end by end for all runs together."""
        forward = np.zeros(int(self.length.sum()) + len(self.length) + 1)
        forward[self.base] = 1.0
        self.upto = np.empty(len(node))
        cuts = np.searchsorted(end, np.arange(1, int(self.length.max(initial=0)) + 2))
        active = np.arange(len(self.length))
        for e, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), 1):
            own = node[a:b]
            mass = forward[own - e + start[a:b]] * weight[a:b]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sums = np.add.reduceat(mass, first)
            sizes = np.diff(np.concatenate([first, [b - a]]))
            running = np.cumsum(mass / np.repeat(sums, sizes))
            self.upto[a:b] = running - np.repeat(running[first] - mass[first] / sums, sizes)
            self.upto[a + first + sizes - 1] = 2.0  # the last one takes all that is left
            forward[own[first]] = sums
            if e % 16 == 0:  # only ratios count: lift what later ends still use
                active = active[self.length[active] > e]
                if len(active):
                    recent = self.base[active][:, None] + np.arange(max(0, e - longest), e + 1)
                    forward[recent] /= forward[self.base[active] + e][:, None]

    def draw(self, run: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of one segmentation for each asked run, drawn backwards; and how many codes each has."""
        live, end, steps = np.arange(len(run)), self.length[run], []
        base = self.base[run]
        taken = np.zeros(len(run), np.int64)
        while len(live):
            seed = mixed(seed + np.uint64(0x9E3779B97F4A7C15))
            u = (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53
            at = self.begin[base[live] + end]
            over = np.flatnonzero(self.upto[at] <= u)
            while len(over):
                at[over] += 1
                over = over[self.upto[at[over]] <= u[over]]
            steps.append((live, self.code[at]))
            taken[live] += 1
            end = self.start[at]
            go = np.flatnonzero(end > 0)
            live, end, seed = live[go], end[go], seed[go]
        last = np.cumsum(taken)
        codes = np.zeros(int(last[-1]) if len(last) else 0, np.int64)
        for k, (which, code) in enumerate(steps):
            codes[last[which] - 1 - k] = code
        return codes, taken

    def spell(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the codes, and the number of ids of each."""
        n = np.ones(len(codes), np.int64)
        odd = np.flatnonzero(codes >= self.fallback)
        if not len(odd):
            return codes.astype(np.int32), n
        sizes = np.array([len(x) for x in self.spelt], np.int64)
        pool, begins = np.array([i for x in self.spelt for i in x], np.int64), np.cumsum(sizes) - sizes
        n[odd] = sizes[codes[odd] - self.fallback]
        ids = np.repeat(codes, n)
        inside = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        spelt = np.flatnonzero(ids >= self.fallback)
        ids[spelt] = pool[begins[ids[spelt] - self.fallback] + inside[spelt]]
        return ids.astype(np.int32), n


def sampled(vocabulary: Vocabulary, texts: list[str | None], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of one segmentation of each text, end to end, drawn backwards through its lattice with the text's seed; and
    how many ids each text has."""
    found = [_RUN.findall(f" {t}") if t else [] for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    names: dict[str, int] = {}
    run = np.array([names.setdefault(r, len(names)) for runs in found for r in runs], np.int64)
    lattices = Lattices(vocabulary, list(names))
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    codes, taken = lattices.draw(run, mixed(seeds.astype(np.uint64)[owner] + mixed(place.astype(np.uint64))))
    ids, n = lattices.spell(codes)
    return ids, np.bincount(np.repeat(owner, taken), weights=n, minlength=len(texts)).astype(np.int64)


def sample(vocabulary: Vocabulary, texts: list[str | None], seeds: np.ndarray) -> list[np.ndarray | None]:
    """The ids of each text; none for none."""
    ids, sizes = sampled(vocabulary, texts, seeds)
    return [None if t is None else p for t, p in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True)]


def decode(ids: list[int] | np.ndarray | None, pieces: list[bytes]) -> str | None:
    """The text of a list of ids: their bytes in order, without the blank put before every text."""
    if ids is None:
        return None
    return b"".join(map(pieces.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")[1:]


_LOADED: dict[tuple[int, float], Vocabulary] = {}


def _vocabulary(model: bytes, sharpness: float) -> Vocabulary:
    """One per worker process, as building it takes longer than a batch."""
    key = (hash(model), sharpness)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(model, sharpness)
    return _LOADED[key]


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


#: Characters of the texts whose lattices are held at once.
TOGETHER = 100_000


def _encoded(model: bytes, sharpness: float):
    """Adds the pieces to batches of (id, content, seed): few texts at a time, so that memory stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model, sharpness)
        for batch in batches:
            content = batch.column("content")
            upto = np.cumsum(pc.fill_null(pc.utf8_length(content), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            seeds = batch.column("seed").to_numpy().view(np.uint64)
            at = 0
            while at < len(upto):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOGETHER)))
                part = batch.slice(at, to - at)
                ids, sizes = sampled(vocabulary, content.slice(at, to - at).to_pylist(), seeds[at:to])
                offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids), mask=pc.is_null(part.column("content")))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("content"), lists], ["id", "content", "pieces"])
                at = to

    return run


def _decoded(model: bytes):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _vocabulary(model, 1.0).bytes
        for ids in batches:
            yield pd.Series([decode(x, pieces) for x in ids], dtype=object)

    return run


def text_of(ids: Column, model: bytes) -> Column:
    return F.pandas_udf(_decoded(model), T.StringType())(ids)


def encode_articles(articles: DataFrame, model: str = MODEL, key: str = "id", text: str = "content",
                    sharpness: float = 1.0, salt: int = 0) -> DataFrame:
    """One sampled segmentation of every article: (id, content, pieces), one row per input row.

    Forward filtering sums the weights of all segmentations of the whole text over the piece lattice;
    backward sampling draws one in proportion to its weight, with random numbers made of the row's id,
    ``salt`` and the place in the text alone. So reruns, repeated rows and other partitions agree, and
    other salts give other samples. A larger ``sharpness`` comes nearer to the best segmentation.

    A null text has null pieces, an empty one none. Rows without an id share a seed. Other columns are
    ignored; no rows give no rows.
    """
    rows = narrowed(articles, id=key, content=text)
    kind = dict(rows.dtypes)["id"]
    return rows.withColumn("seed", F.xxhash64("id", F.lit(salt))).mapInArrow(
        _encoded(model_bytes(model), sharpness), f"id {kind}, content string, pieces array<int>")


def decode_articles(encoded: DataFrame, model: str = MODEL, pieces: str = "pieces", to: str = "decoded") -> DataFrame:
    """Adds the text that a list of pieces spells: exactly the encoded one, null for null, as column ``to``, in place of
    a column of that name."""
    return encoded.withColumn(to, text_of(F.col(f"`{pieces}`"), model_bytes(model)))
