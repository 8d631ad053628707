"""Near copies of articles: SimHash fingerprints, compared in vertical bit planes.

The news feeds bring one story many times, slightly changed; here all versions of a story get the id of
its first one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tapeloom.session import materialise

from .components import components
from .records import lower_words, narrowed

BITS = 64
KEYS = ["band", "bits", "piece"]
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(content: str | None, shingle: int = 4) -> int:
    """SimHash of a text: bit b is 1 if it is set in over half of the XXH64 hashes (seed 42) of all word shingles.

    A text with fewer words is one shingle; a text without words has fingerprint 0.
    """
    found = lower_words(content)
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(found) - shingle + 1)
    cuts = zip(starts[:n].tolist(), (ends[min(shingle, len(found)) - 1:] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in cuts), np.uint64, n)
    columns = hashes.view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BIT_OF_BYTE for k in range(8)])
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist()))


@F.pandas_udf(T.LongType())
def _fingerprints(content: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in content], np.uint64).view(np.int64))


# ---------------------------------------------------------------- bit planes

def planes(prints: np.ndarray) -> np.ndarray:
    """Row b holds bit b of all prints, 64 prints to a word, the last word filled with zeros."""
    n = -(-len(prints) // BITS) * BITS
    padded = np.zeros(n, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def lanes(words: np.ndarray) -> np.ndarray:
    """Positions of the ones in an array of words."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def _over(counter: list[np.ndarray], spilled: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above the radius: compared digit by digit from the top."""
    above, equal = spilled.copy(), ~spilled
    for k in reversed(range(len(counter))):
        if not radius >> k & 1:
            above |= equal & counter[k]
            equal &= ~counter[k]
        else:
            equal &= counter[k]
    return above


def within(left, right, asked: np.ndarray, radius: int, every: int = 8, bits: int = BITS) -> np.ndarray:
    """Lanes of ``asked`` in which the two prints differ in at most ``radius`` bits.

    ``left(b, at)`` and ``right(b, at)`` give bit plane b for the words ``at``. Differences are added into
    carry-save counters, 64 lanes by one operation; words whose lanes all exceed the radius are abandoned.
    """
    at = np.flatnonzero(asked)
    live = asked[at]
    counter = [np.zeros(len(at), np.uint64) for _ in range(max(1, radius.bit_length()))]
    spilled = np.zeros(len(at), np.uint64)
    for b in range(bits):
        carry = left(b, at) ^ right(b, at)
        for k, digit in enumerate(counter):
            counter[k], carry = digit ^ carry, digit & carry
        spilled |= carry
        if b % every == every - 1:
            live = live & ~_over(counter, spilled, radius)
            kept = np.flatnonzero(live)
            if len(kept) < len(at):
                at, live, spilled, counter = at[kept], live[kept], spilled[kept], [c[kept] for c in counter]
            if not len(at):
                break
    out = np.zeros_like(asked)
    out[at] = live
    return out


def _forest(pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The pairs that join two groups not joined before."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            yield a, b


def _pairs_in_runs(prints: np.ndarray, left_in_run: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Linked rows of short runs: each row against the d-th after it, for all rows at once, d by d."""
    p = planes(prints)
    wide = np.concatenate([p, np.zeros((BITS, 2), np.uint64)], axis=1)
    for d in range(1, int(left_in_run.max(initial=0)) + 1):
        asked = np.zeros(p.shape[1] * BITS, np.uint8)
        asked[: len(prints)] = left_in_run >= d
        asked = np.packbits(asked, bitorder="little").view(np.uint64)
        jump, low = divmod(d, BITS)

        def later(b, at, jump=jump, low=low):
            near = wide[b, at + jump]
            return near if not low else (near >> np.uint64(low)) | (wide[b, at + jump + 1] << np.uint64(BITS - low))

        for i in lanes(within(lambda b, at: p[b, at], later, asked, radius)).tolist():
            yield i, i + d


def _pairs_in_large(prints: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links in a large bucket: each row meets only rows not yet reached."""
    p = planes(prints)
    new = np.packbits(np.arange(p.shape[1] * BITS) < len(prints), bitorder="little").view(np.uint64)
    everything, nothing = np.uint64(2**64 - 1), np.uint64(0)
    for start in range(len(prints)):
        stack = [start] if int(new[start // BITS]) >> start % BITS & 1 else []
        new[start // BITS] &= ~np.uint64(1 << start % BITS)
        while stack:
            i = stack.pop()
            bits = int(prints[i])
            hits = within(lambda b, at: p[b, at], lambda b, at, bits=bits: everything if bits >> b & 1 else nothing,
                          new, radius)
            new &= ~hits
            for j in lanes(hits).tolist():
                stack.append(j)
                yield i, j


def _links(radius: int, short: int = 64, at_once: int = 20_000):
    """Over rows sorted by bucket: links (a, b) of prints inside a bucket that connect all that the radius links."""

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        prints = frame["print"].to_numpy(np.int64).view(np.uint64)
        keys = frame[KEYS].to_numpy(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        sizes = np.diff(np.concatenate([starts, [len(prints)]]))
        behind = np.repeat(starts + sizes, sizes) - np.arange(len(prints)) - 1
        out = list(_forest(_pairs_in_runs(prints, np.where(np.repeat(sizes, sizes) > short, 0, behind), radius)))
        for a, n in zip(starts[sizes > short], sizes[sizes > short], strict=True):
            out += [(a + i, a + j) for i, j in _pairs_in_large(prints[a: a + n], radius)]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        signed = prints.view(np.int64)
        return pd.DataFrame({"a": signed[pairs[:, 0]], "b": signed[pairs[:, 1]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []  # from the first row of a bucket on
        rows = 0
        for batch in batches:
            kept.append(batch)
            rows += len(batch)
            if rows < at_once:
                continue
            frame = pd.concat(kept, ignore_index=True)
            same = (frame[KEYS] == frame[KEYS].iloc[-1]).all(axis=1).to_numpy()
            last = len(frame) - int(np.argmin(same[::-1])) if not same.all() else 0  # this bucket may go on
            if last:
                yield linked(frame[:last])
            kept, rows = [frame[last:]], len(frame) - last
        if rows:
            yield linked(pd.concat(kept, ignore_index=True))

    return run


# ---------------------------------------------------------------- Spark

def print_links(prints: DataFrame, radius: int = 4, parts: int = 6, bucket_rows: int = 8192) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``print`` that connect exactly what the radius connects.

    The 64 bits are cut into ``parts``; prints within the radius agree in ``parts - radius`` of them at
    least, so every such choice of parts is one key. Only prints that share a key are compared. A bucket
    above ``bucket_rows`` is cut into pieces and every two pieces meet in one task, so all of it is
    compared and no task holds more than two pieces. More ``parts`` give longer keys, for more articles.
    """
    if not 0 <= radius < parts <= BITS:
        raise ValueError("parts must lie above the radius, up to 64")
    edges = np.linspace(0, BITS, parts + 1).astype(int).tolist()
    masks = [sum((1 << b) - (1 << a) for a, b in chosen)
             for chosen in combinations(pairwise(edges), parts - radius)]
    signed = [m - (1 << BITS) if m >> 63 else m for m in masks]
    keyed = prints.select("print", F.explode(F.array(*[
        F.struct(F.lit(k).alias("band"), F.col("print").bitwiseAND(F.lit(m).cast("bigint")).alias("bits"))
        for k, m in enumerate(signed)])).alias("_k")).select("print", "_k.*")
    hot = (keyed.groupBy("band", "bits").count().filter(F.col("count") > bucket_rows)
           .select("band", "bits", F.ceil(F.col("count") / bucket_rows).cast("int").alias("_pieces")))
    own = F.pmod(F.xxhash64("print"), F.col("_pieces")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_pieces") - 1), lambda other: (
        F.greatest(own, other) * F.col("_pieces") + F.least(own, other)).cast("bigint"))
    dealt = (keyed.join(hot, ["band", "bits"], "left")
             .withColumn("piece", F.explode(F.when(F.col("_pieces").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(pairs)))
             .select("print", "band", "bits", "piece")
             .repartition("band", "bits", "piece").sortWithinPartitions("band", "bits", "piece"))
    return dealt.mapInPandas(_links(radius), "a bigint, b bigint")


def near_copies(articles: DataFrame, key: str = "id", text: str = "content", radius: int = 4, parts: int = 6,
                bucket_rows: int = 8192) -> DataFrame:
    """Story of every article: (id, fingerprint, story_id), one row per input row.

    ``fingerprint`` is the SimHash of the whole text as 16 hex digits; texts whose fingerprints differ in at
    most ``radius`` bits are linked, and ``story_id`` is the smallest id that links reach.

    Null and blank texts have fingerprint 0 and are linked like any other. Repeated rows and ids stay as
    rows. A null id never is a story id unless the story has no other. An empty table gives no rows;
    columns other than the two named are ignored.
    """
    rows = materialise(narrowed(articles, id=key, content=text)
                       .select("id", _fingerprints("content").alias("print")), "prints")
    prints = materialise(rows.groupBy("print").agg(F.min("id").alias("first_id")), "distinct-prints")
    roots = components(print_links(prints.select("print"), radius, parts, bucket_rows)).withColumnRenamed("node", "print")
    linked = prints.join(roots, "print")
    stories = (roots.join(linked.groupBy("root").agg(F.min("first_id").alias("story_id")), "root")
               .select("print", "story_id"))
    each = prints.join(stories, "print", "left").select("print", F.coalesce("story_id", "first_id").alias("story_id"))
    return (rows.join(each, "print")
            .select("id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "story_id"))
