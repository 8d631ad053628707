import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
import tokenizers

from tapeloom.llm import alignment as A
from tapeloom.llm.pieces import MODEL

COLUMNS = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SCHEMA = "id bigint, content string, slice int, chunk string"


def by_hand(rows):
    """Two libraries, one walk over both lists of tokens, dictionaries."""
    first = tokenizers.Tokenizer.from_file(A.BYTE_LEVEL)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    read = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
    walked = []
    for i, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        in_a = [bytes(read[c] for c in first.id_to_token(x)) for x in a]
        in_b = [bytes([int(second.id_to_piece(x)[3:-1], 16)]) if second.is_byte(x) else second.id_to_piece(x).replace("▁", " ").encode() for x in b]
        links, groups = [], []
        if text and b"".join(in_a) == (" " + text).encode() == b"".join(in_b):
            ends_a, ends_b = np.cumsum([len(x) for x in in_a]).tolist(), np.cumsum([len(x) for x in in_b]).tolist()
            x = y = 0
            group = ([a[0]], [b[0]])
            while True:
                links.append((a[x], b[y]))
                to_a, to_b = ends_a[x] <= ends_b[y], ends_b[y] <= ends_a[x]
                if to_a and to_b:
                    groups.append(group)
                    group = ([], [])
                x, y = x + to_a, y + to_b
                if x == len(a):
                    break
                if to_a:
                    group[0].append(a[x])
                if to_b:
                    group[1].append(b[y])
        else:
            a = b = []
        walked.append((i, a, b, links, groups))
    counts = Counter(p for w in walked for p in set(w[3]))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [(i, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join("|".join(",".join(map(str, s)) for s in g) for g in groups).encode()).hexdigest() if a else "")
            for i, a, b, links, groups in walked]


def checked(spark, rows, layout=A.Layout()):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    got = A.align_articles(df, layout=layout)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(by_hand(rows), key=str)


ODD = ["", None, " ", "a", "▁ sign", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 text émigré", "\u0000 nul", "tab\tnew\nline  two   blanks ", "😀🏳️‍🌈 don't I'LL", "x" * 3000, " nbsp​"]


def test_equals_walk_by_hand(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = docs + [(1000 + n, t) for n, t in enumerate(ODD)] + [(None, "no id"), (5, "twice"), (5, "twice")] + [(9000 + n, "copied text, the same") for n in range(120)]
    checked(spark, rows)


def test_many_small_chunks_and_levels(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "γάμμα", "42", ",", "re-run", "naïve", "<0x0A>", "日本"]
    rows = [(n, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for n in range(200)]
    checked(spark, rows, A.Layout(chunk_bytes=300, slice_pairs=50, fan_in=3))


def test_edges(spark):
    assert A.align_articles(spark.createDataFrame([], SCHEMA)).count() == 0
    got = A.align_articles(spark.createDataFrame([("a", None), ("b", "")], "id string, content string")).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 0, 0, 0, 0, 0, ""), ("b", 0, 0, 0, 0, 0, 0, "")]


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 60_000):
        keys = np.unique(rng.integers(0, 1 << 31, n))
        perfect = A.PerfectHash.unpack(A.PerfectHash(keys).pack())
        assert sorted(perfect(keys).tolist()) == list(range(len(keys)))
    only_rest = type("Rest", (A.PerfectHash,), {"LEVELS": 0})(keys[:50])  # keys that no level placed
    assert sorted(only_rest(keys[:50]).tolist()) == list(range(50)) and only_rest(keys[50:60]).tolist() == [-1] * 10


def test_packing():
    for x in ([], [0], [255, 256], [1 << 40, 3], list(range(1000))):
        assert A._unpacked(A._packed(np.array(x, np.int64))).tolist() == x
