import random

import numpy as np
import pandas as pd
import xxhash

from tapeloom.llm import near_copies as N

#: the feed column clashes with a result column on purpose
SCHEMA = "id bigint, content string, story_id string"


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def stories(prints, radius=4):
    """Brute force: smallest id reachable over all pairs within the radius."""
    up = {i: i for i, _ in prints}
    for i, a in prints:
        for j, b in prints:
            if bin(a ^ b).count("1") <= radius:
                x, y = i, j
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                up[max(x, y)] = min(x, y)

    def top(x):
        return x if up[x] == x else top(up[x])

    return {i: top(i) for i in up}


def test_fingerprint_is_the_plain_one():
    texts = [None, "", " \n", "One", "one two THREE", "a b c d e f g", "é À z z ß" * 9, "x " * 5000]
    assert [N.fingerprint(t) for t in texts] == [plain(t) for t in texts]


def test_within_equals_popcount():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1, dtype=np.uint64)
    prints = base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 6), dtype=np.uint64), axis=1)
    p = N.planes(prints)
    asked = np.packbits(np.arange(p.shape[1] * 64) < 300, bitorder="little").view(np.uint64)
    for radius in (0, 1, 3, 4, 7, 9):
        bits = int(prints[7])
        got = N.within(lambda b, at: p[b, at], lambda b, at, v=bits: np.uint64(2**64 - 1) if v >> b & 1 else np.uint64(0),
                       asked, radius)
        want = [i for i, x in enumerate(prints.tolist()) if bin(x ^ bits).count("1") <= radius]
        assert N.lanes(got).tolist() == want


def test_links_connect_like_brute_force(spark):
    rng = random.Random(5)
    prints = {0, 2**64 - 1}
    for _ in range(6):  # chains and clusters around a few centres
        at = rng.getrandbits(64)
        for _ in range(120):
            prints.add(at)
            for _ in range(rng.randint(1, 7)):
                at ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    want = stories(list(enumerate(prints)))
    signed = [(p - 2**64 if p >> 63 else p,) for p in prints]
    for limit in (8192, 50):
        df = spark.createDataFrame(signed, "print bigint")
        roots = N.components(N.print_links(df, bucket_rows=limit)).toPandas()
        root = dict(zip([int(x) % 2**64 for x in roots["node"]], roots["root"], strict=True))
        groups = {}
        for i, p in enumerate(prints):
            groups.setdefault(root.get(p, ("alone", i)), set()).add(i)
        assert sorted(map(min, groups.values())) == sorted(set(want.values()))
        assert all(len({want[i] for i in g}) == 1 for g in groups.values())


def test_articles(spark):
    rng = random.Random(2)
    base = [rng.choice("alpha beta gamma delta shares rise fall trial drug".split()) for _ in range(400)]
    rows = [(5, " ".join(base), "x"), (3, " ".join(base).upper(), "x"), (9, " ".join(base), None), (9, " ".join(base), None),
            (4, None, "x"), (8, "", "x"), (1, "quite another text", "x"), (None, "quite another text", "x")]
    for i in range(20, 60):
        v = list(base)
        v[rng.randrange(400)] = f"w{i}"
        rows.append((i, " ".join(v), "x"))
    got = N.near_copies(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert list(got.columns) == ["id", "fingerprint", "story_id"] and len(got) == len(rows)
    prints = {(i, f"{plain(t):016x}") for i, t, _ in rows if i is not None}
    assert prints == {(int(i), f) for i, f in zip(got["id"], got["fingerprint"], strict=True) if not pd.isna(i)}
    want = stories([(i, int(f, 16)) for i, f in prints])
    known = got.dropna(subset=["id"])
    assert dict(zip(known["id"].astype(int), known["story_id"].astype(int), strict=True)) == want
    assert got[got["id"].isna()]["story_id"].tolist() == [1]
    assert N.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
