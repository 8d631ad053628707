"""Which tokens of two tokenizers meet in the same bytes of articles, and in how many articles each pair does."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tapeloom.session import materialise

from .pieces import BLANK, MODEL, mixed, model_bytes
from .records import narrowed, utf8

#: Where the byte-level vocabulary lies; only the driver reads it.
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: where the byte-level tokenizer cuts a text before it merges.
CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Layout:
    """Sizes of the work, none of which changes a result."""

    chunk_bytes: int = 1_500_000   # texts of about so many bytes are aligned at once
    slice_pairs: int = 1_000_000   # pairs, counted once a chunk, that share a slice
    fan_in: int = 32               # chunks, or sums, that one task adds up


def byte_level_tokens(vocabulary: bytes) -> dict[bytes, int]:
    """Bytes and id of every ordinary token of a byte-level vocabulary file.

    Such files write bytes as printable characters: those that are printable in Latin-1 stand for
    themselves, the others follow from U+0100 on.
    """
    model = json.loads(vocabulary)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    read = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
    special = {t["id"] for t in model["added_tokens"]}
    return {bytes(map(read.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if i not in special}


class Coder:
    """Both tokenizers, and the bytes of every token of each."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        ranks = byte_level_tokens(byte_level)
        self._a = tiktoken.Encoding("a", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        b = self._b
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i)
                        else b"" if b.is_control(i) or b.is_unknown(i) else b.id_to_piece(i).replace(BLANK, " ").encode()
                        for i in range(b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        # ids in decimal, each with a place for the mark after it
        text = np.arange(max(len(self.a_bytes), len(self.b_bytes))).astype("S")
        self.digits = np.zeros((len(text), text.dtype.itemsize + 1), np.uint8)
        self.digits[:, :-1] = text.view(np.uint8).reshape(len(text), -1)
        self.n_digits = (self.digits > 0).sum(axis=1)

    def encode(self, content: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids by both; none where the text is empty or either does not spell a blank and the text."""
        if content:
            spelt = b" " + utf8(content)
            text = spelt.decode()
            a, b = np.array(self._a.encode_ordinary(text), np.int64), self._b.encode(text[1:])
            # byte-level tokens are cut out of the text itself: none is missing if their sizes add up
            if self.a_sizes[a].sum() == len(spelt) and b"".join(map(self.b_bytes.__getitem__, b)) == spelt:
                return a, np.array(b, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


_LOADED: dict[int, Coder] = {}


def _coder(byte_level: bytes, pieces: bytes) -> Coder:
    """One per worker process, as loading takes longer than a batch."""
    key = hash((byte_level, pieces))
    if key not in _LOADED:
        _LOADED[key] = Coder(byte_level, pieces)
    return _LOADED[key]


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, compressed."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + zstandard.ZstdCompressor(level=6).compress(x.astype(f"<u{width}").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def _rising(x: np.ndarray) -> bytes:
    return _packed(np.diff(x, prepend=0))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data))


def _factors(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in rising order, and which of them each key is."""
    codes, kinds = pd.factorize(keys)
    order = np.argsort(kinds)
    rank = np.empty(len(kinds), np.int64)
    rank[order] = np.arange(len(kinds))
    return kinds[order], rank[codes]


class Links:
    """The links of a chunk of encoded articles: one for each run of bytes that no token of either begins in.

    Byte by byte of the chunk, flags tell where tokens end; running counts of them number the tokens.
    """

    def __init__(self, row, coder: Coder):
        self.coder, self.ids = coder, list(row["ids"])
        self.n_a, self.n_b = np.array(row["n_a"], np.int64), np.array(row["n_b"], np.int64)
        self.a, self.b = _unpacked(row["a"]), _unpacked(row["b"])
        ends = np.cumsum(coder.a_sizes[self.a]), np.cumsum(coder.b_sizes[self.b])  # texts end together
        size = int(ends[0][-1]) if len(self.a) else 0
        in_a, in_b = (np.zeros(size + 1, bool) for _ in ends)
        in_a[ends[0]], in_b[ends[1]] = True, True
        cut = np.flatnonzero(in_a | in_b)
        self.at_a, self.at_b = ((np.cumsum(x, dtype=np.int32) - x)[cut] for x in (in_a, in_b))
        self.shared = (in_a & in_b)[cut]
        self.pair, self.which = _factors(self.a[self.at_a] * len(coder.b_bytes) + self.b[self.at_b])
        # links lie article by article
        last = np.cumsum(self.n_a) - 1
        upto = np.searchsorted(self.at_a, last, side="right")
        upto[self.n_a == 0] = 0
        self.upto = np.maximum.accumulate(upto) if len(upto) else upto

    def per_article(self, values: np.ndarray) -> np.ndarray:
        """Sums over the links of each article."""
        return np.diff(np.append(0, np.cumsum(values))[np.append(0, self.upto)])

    def counts(self) -> np.ndarray:
        """How many articles of the chunk hold each pair."""
        owner = np.repeat(np.arange(len(self.ids)), np.diff(np.append(0, self.upto)))
        held = pd.unique(owner * max(len(self.pair), 1) + self.which)
        return np.bincount(held % max(len(self.pair), 1), minlength=len(self.pair))

    def groups(self) -> list[str]:
        """The digest of every article's groups; empty without tokens."""
        group = np.cumsum(self.shared) - self.shared  # of links; every token has one at least
        of_a, of_b = (group[np.flatnonzero(np.diff(at, prepend=-1))] for at in (self.at_a, self.at_b))
        n = int(self.shared.sum())
        in_a, in_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        place_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[of_a]
        place_b = np.arange(len(self.b)) + np.cumsum(in_a)[of_b]
        code, mark = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        for place, own, of, end in ((place_a, self.a, of_a, "|"), (place_b, self.b, of_b, ";")):
            code[place], mark[place] = own, np.where(np.append(of[1:], -1)[: len(own)] == of, ord(","), ord(end))
        rows, sizes = self.coder.digits[code], self.coder.n_digits[code]
        rows[np.arange(len(rows)), sizes] = mark
        flat = rows[rows > 0]
        ends = np.append(0, np.cumsum(sizes + 1))[np.append(0, np.cumsum(self.n_a + self.n_b))]
        return [hashlib.sha256(flat[x: y - 1].tobytes()).hexdigest() if y > x else "" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class PerfectHash:
    """A minimal perfect hash of distinct keys, level by level.

    At each level the keys left are hashed into as many bits as they are; those alone on a bit are placed, and
    number themselves by the bits set before. Keys that are never alone (equal hashes) stay in a sorted rest.
    """

    LEVELS = 40

    def __init__(self, keys: np.ndarray | None = None):
        self.levels: list[np.ndarray] = []
        left = np.zeros(0, np.int64) if keys is None else keys
        while len(left) and len(self.levels) < self.LEVELS:
            at = self._place(left, len(self.levels), len(left))
            bits = np.bincount(at, minlength=len(left)) == 1
            self.levels.append(bits)
            left = left[~bits[at]]
        self.rest = np.sort(left)
        self._index()

    def _index(self) -> None:
        self.ranks, n = [], 0
        for bits in self.levels:
            self.ranks.append(n + np.cumsum(bits) - bits)
            n += int(bits.sum())
        self.placed = n

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of a strange key, any number or -1."""
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._place(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            out[left] = np.where(self.rest[at] == keys[left], self.placed + at, -1)
        return out

    def pack(self) -> bytes:
        sizes = np.array([len(x) for x in self.levels], np.int64)
        bits = np.packbits(np.concatenate(self.levels)).tobytes() if self.levels else b""
        head = [_packed(sizes), _rising(self.rest)]
        return b"".join(len(h).to_bytes(4, "little") + h for h in head) + bits

    @staticmethod
    def unpack(data: bytes) -> PerfectHash:
        head, at = [], 0
        for _ in range(2):
            n = int.from_bytes(data[at: at + 4], "little")
            head.append(data[at + 4: at + 4 + n])
            at += 4 + n
        sizes, out = _unpacked(head[0]), PerfectHash()
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=at), count=int(sizes.sum())).astype(bool)
        out.levels = np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else []
        out.rest = _risen(head[1])
        out._index()
        return out


def _encoded(byte_level: bytes, pieces: bytes, chunk_bytes: int):
    """One row per chunk of articles: their ids, and the codes of all their tokens end to end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part, number = _coder(byte_level, pieces), TaskContext.get().partitionId(), 0
        ids, n_a, n_b, a, b, size = [], [], [], [], [], 0

        def chunk() -> pd.DataFrame:
            codes = [_packed(np.concatenate(x)) for x in (a, b)]
            return pd.DataFrame([(f"{part}-{number}", list(ids), list(n_a), list(n_b), *codes)],
                                columns=["chunk", "ids", "n_a", "n_b", "a", "b"])

        for batch in batches:
            for i, content in zip(batch["id"], batch["content"], strict=True):
                found = coder.encode(content)
                ids.append(None if pd.isna(i) else i)
                for codes, sizes, all_codes in zip(found, (n_a, n_b), (a, b), strict=True):
                    sizes.append(len(codes))
                    all_codes.append(codes)
                size += len(content or "") + 16
                if size >= chunk_bytes:
                    yield chunk()
                    number, size = number + 1, 0
                    for x in (ids, n_a, n_b, a, b):
                        x.clear()
        if ids:
            yield chunk()

    return run


def _slice_of(pairs: np.ndarray, width: int, slices: int) -> np.ndarray:
    """All pairs of one token of the first tokenizer share a slice."""
    return (mixed((pairs // width).astype(np.uint64)) % np.uint64(slices)).astype(np.int64)


def _sliced(pairs: np.ndarray, width: int, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts pairs by slice, rising inside; and where each slice begins."""
    part = _slice_of(pairs, width, slices)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(slices + 1))


def _asked(byte_level: bytes, pieces: bytes, slices: int):
    """The distinct pairs of every chunk with their counts in it, slice by slice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(byte_level, pieces)
        for batch in batches:
            for _, row in batch.iterrows():
                links = Links(row, coder)
                pairs, counts = links.pair, links.counts()
                order, begin = _sliced(pairs, len(coder.b_bytes), slices)
                pairs, counts = pairs[order], counts[order]
                out = [(s, row["chunk"], _rising(pairs[x:y]), _packed(counts[x:y]))
                       for s, (x, y) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)) if x < y]
                yield pd.DataFrame(out, columns=["slice", "chunk", "pairs", "counts"])

    return run


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    pairs = reduce(np.union1d, map(_risen, frame["pairs"]))
    return pd.DataFrame([(frame["slice"].iloc[0], frame["team"].iloc[0], _rising(pairs))], columns=["slice", "team", "pairs"])


def _hashed(frame: pd.DataFrame) -> pd.DataFrame:
    """The hash of a slice, and its keys where the hash puts them."""
    pairs = _risen(frame["pairs"].iloc[0])
    perfect = PerfectHash(pairs)
    keys = np.empty(len(pairs), np.int64)
    keys[perfect(pairs)] = pairs
    return pd.DataFrame([(frame["slice"].iloc[0], perfect.pack(), _packed(keys))], columns=["slice", "hash", "keys"])


def _slots(table, pairs: np.ndarray) -> np.ndarray:
    """Where the hash of a slice puts pairs, each verified by the key there."""
    slots = PerfectHash.unpack(table["hash"])(pairs)
    if not np.array_equal(_unpacked(table["keys"])[slots], pairs):
        raise ValueError("a pair is not among the keys of its slice")
    return slots


def _counted(asked: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
    """Counts of one team of chunks as a dense vector over the slots of the slice."""
    if asked.empty or tables.empty:
        return pd.DataFrame(columns=["slice", "team", "counts"])
    table = tables.iloc[0]
    found = [_risen(p) for p in asked["pairs"]]
    slots, sizes = _slots(table, np.concatenate(found)), np.cumsum([len(x) for x in found])
    dense = np.zeros(len(_unpacked(table["keys"])), np.int64)
    for at, counts in zip(np.split(slots, sizes[:-1]), asked["counts"], strict=True):
        dense[at] += _unpacked(counts)  # the pairs of a chunk are distinct
    return pd.DataFrame([(table["slice"], asked["team"].iloc[0], _packed(dense))], columns=["slice", "team", "counts"])


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    total = reduce(np.add, map(_unpacked, frame["counts"]))
    return pd.DataFrame([(frame["slice"].iloc[0], frame["team"].iloc[0], _packed(total))], columns=["slice", "team", "counts"])


def _looked_up(width: int):
    def run(asked: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        """For every chunk of a team: the corpus-wide counts of its pairs, and which are the highest of their token."""
        if asked.empty or tables.empty:
            return pd.DataFrame(columns=["slice", "chunk", "counts", "best"])
        table = tables.iloc[0]
        counts, token = _unpacked(table["counts"]), _unpacked(table["keys"]) // width
        kinds, which = np.unique(token, return_inverse=True)
        most = np.zeros(len(kinds), np.int64)
        np.maximum.at(most, which, counts)
        best = counts == most[which]
        found = [_risen(p) for p in asked["pairs"]]
        slots = np.split(_slots(table, np.concatenate(found)), np.cumsum([len(x) for x in found])[:-1])
        return pd.DataFrame([(table["slice"], chunk, _packed(counts[at]), _packed(best[at].astype(np.int64)))
                             for chunk, at in zip(asked["chunk"], slots, strict=True)], columns=["slice", "chunk", "counts", "best"])

    return run


def _aligned(byte_level: bytes, pieces: bytes, slices: int):
    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if chunks.empty:
            return pd.DataFrame(columns=columns)
        coder = _coder(byte_level, pieces)
        links = Links(chunks.iloc[0], coder)
        answers = answers.sort_values("slice")
        order, _ = _sliced(links.pair, len(coder.b_bytes), slices)
        counts, best = (np.zeros(len(links.pair), np.int64) for _ in range(2))
        if len(order):
            counts[order] = np.concatenate([_unpacked(x) for x in answers["counts"]])
            best[order] = np.concatenate([_unpacked(x) for x in answers["best"]])
        per = links.per_article
        return pd.DataFrame({"id": pd.Series(links.ids, dtype=object), "n_a": links.n_a, "n_b": links.n_b,
                             "n_groups": per(links.shared), "n_links": per(np.ones(len(links.which), np.int64)),
                             "n_best": per(best[links.which]), "count_sum": per(counts[links.which]), "groups_sha256": links.groups()})

    return run


def _tree(rows: DataFrame, step: Callable, schema: str, teams: int, fan_in: int) -> DataFrame:
    """Rows of (slice, team) reduced to one a slice, never more than about ``fan_in`` at once in a task."""
    while True:
        rows = materialise(rows.groupBy("slice", "team").applyInPandas(step, schema), "sums")
        if teams == 1:
            return rows.drop("team")
        teams = -(-teams // fan_in)
        rows = rows.withColumn("team", F.pmod("team", F.lit(teams)))


def align_articles(articles: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = MODEL, key: str = "id", text: str = "content",
                   layout: Layout = Layout()) -> DataFrame:
    """How two tokenizers cut every article: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A is the byte-level vocabulary ``byte_level``, B the model ``pieces``; both read a blank and the text, without
    special tokens, and give ``n_a`` and ``n_b`` tokens. Where tokens of both end, a group ends (``n_groups``). Every
    A and B token whose bytes overlap are linked (``n_links``). The count of a pair of ids is the number of
    articles that hold it linked; ``count_sum`` adds it over the links, and ``n_best`` counts the links whose
    pair has the highest count of its A id, ties included. ``groups_sha256`` digests the ids, written
    ``a1,a2|b1;a3|b2,b3``.

    One pass encodes and stores the articles in chunks. The pairs of all chunks, united by a tree and cut into
    slices by A id, get a minimal perfect hash each; counts are dense vectors over its slots, added by a tree, and
    every key is verified in its slot. Then each chunk is aligned again and gets the counts of its own pairs only.

    Null and empty texts, and texts that either tokenizer does not spell back byte by byte, have no tokens: zeros and
    an empty digest. Repeated rows, also of one id, count each. Other columns are ignored; no rows give no rows.
    """
    kind = dict(narrowed(articles, id=key).dtypes)["id"]
    files = (model_bytes(byte_level), model_bytes(pieces))
    width = sentencepiece.SentencePieceProcessor(model_proto=files[1]).get_piece_size()
    chunks = materialise(narrowed(articles, id=key, content=text).mapInPandas(_encoded(*files, layout.chunk_bytes), (
        f"chunk string, ids array<{kind}>, n_a array<int>, n_b array<int>, a binary, b binary")), "encoded")
    n_chunks, tokens = chunks.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("n_a", F.lit(0).cast("bigint"), lambda s, x: s + x)), F.lit(0))).first()
    slices, teams = max(4, min(-(-tokens // (4 * layout.slice_pairs)), width)), max(1, -(-n_chunks // layout.fan_in))
    asked = materialise(chunks.mapInPandas(_asked(*files, slices), "slice int, chunk string, pairs binary, counts binary")
                        .withColumn("team", F.pmod(F.xxhash64("chunk"), F.lit(teams))), "pairs")
    united = _tree(asked.select("slice", "team", "pairs"), _merged, "slice int, team bigint, pairs binary", teams, layout.fan_in)
    hashes = materialise(united.groupBy("slice").applyInPandas(_hashed, "slice int, hash binary, keys binary"), "hashes")
    every_team = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(teams - 1).cast("bigint"))).alias("team")
    by = ("slice", "team")
    dense = (asked.groupBy(*by).cogroup(hashes.select("*", every_team).groupBy(*by))
             .applyInPandas(_counted, "slice int, team bigint, counts binary"))
    counts = _tree(dense, _summed, "slice int, team bigint, counts binary", teams, layout.fan_in)
    tables = materialise(hashes.join(counts, "slice"), "tables")
    answers = (asked.groupBy(*by).cogroup(tables.select("*", every_team).groupBy(*by))
               .applyInPandas(_looked_up(width), "slice int, chunk string, counts binary, best binary"))
    return (chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_aligned(*files, slices), (
        f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")))
