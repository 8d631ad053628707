import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tapeloom.llm import language_model as L


def plain(rows, train, strength):
    """Scores by dictionaries over all texts; rows are (id, text)."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    texts = [(i, low(t).split(), train(i)) for i, t in rows]
    learned = [w + ["</s>"] for _, w, t in texts if t]
    one = Counter(x for w in learned for x in w)
    two = Counter(p for w in learned for p in zip(["<s>", *w], w))  # noqa: B905
    n, v = sum(one.values()), len(one)
    once, twice = (sum(c == k for c in one.values()) for k in (1, 2))
    off = once / (once + 2 * twice) if once and twice else 0.5
    p = lambda w: 1.0 if not n else (one[w] - off if one[w] else off * v) / n
    context = lambda w: len(learned) if w == "<s>" else one[w]
    out = []
    for i, w, _ in texts:
        w = w + ["</s>"]
        out.append((i, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w),
                    sum(math.log10((two[a, x] + strength * p(x)) / (context(a) + strength)) for a, x in zip(["<s>", *w], w))))  # noqa: B905
    total = sum(p(w) for w in one) + (off * v / n if n else 0)
    assert not n or abs(total - 1) < 1e-9
    return out


def rows_of(n=300):
    rng = random.Random(8)
    words = ["Shares", "rose", "fell", "after", "the", "TRIAL", "of", "é", "Drug", "x."]
    return [(i, " ".join(rng.choice(words) if rng.random() < 0.9 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 60)))) for i in range(n)]


def checked(spark, rows, smoothing, parts=3):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id bigint, content string, score string").repartition(parts)
    got = L.log_probabilities(df, F.col("id") % 7 != 2, smoothing=smoothing).collect()
    want = plain(rows, lambda i: i is not None and i % 7 != 2, smoothing.strength)
    key = lambda r: (str(r[0]), r[1], round(r[5], 6))
    assert len(got) == len(rows)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)


def test_like_dictionaries(spark):
    rows = rows_of() + [(400, None), (401, ""), (None, "shares rose"), (9, rows_of()[9][1]), (402, "the " * 30_000)]
    checked(spark, rows, L.Smoothing(strength=50.0, chunk_words=700, bucket_grams=500))
    checked(spark, rows, L.Smoothing(strength=50.0), parts=1)


def test_counts_above_four_bytes():
    frame = pd.DataFrame({"n": [2, 2], "bucket": [0, 0], "chunk": ["a", "b"], "grams": [np.array([5, 9]), np.array([5])],
                          "counts": [np.array([2**31 - 2, 1]), np.array([7])]})
    out = L._answered(frame)
    assert out["counts"][0].dtype == np.int32
    back = out.assign(over=[[{"at": a, "count": c} for a, c in x] for x in out["over"]])
    assert L._counts(back).tolist() == [2**31 + 5, 1, 2**31 + 5]


def test_without_training_rows_or_rows(spark):
    checked(spark, [(2, "a b"), (9, None), (16, "")], L.Smoothing())
    assert L.log_probabilities(spark.createDataFrame([], "id bigint, content string"), F.lit(True)).count() == 0


def test_word_order_counts(spark):
    rows = [(i, "one two three four five six") for i in range(3, 60)] + [(2, "one two three four five six"), (100, "six four two five one three")]
    df = spark.createDataFrame(rows, "id bigint, content string")
    got = {r["id"]: r["score"] for r in L.log_probabilities(df, F.col("id").between(3, 59), smoothing=L.Smoothing(strength=5.0)).collect()}
    assert got[2] > got[100] + 3


def test_packed_numbers():
    values = np.array([0, 0, 255, 3, 256, 2**40, 7, 2**64 - 1], np.uint64)
    blobs = L.packed(values, np.array([0, 2, 3, 5, 8]))
    assert [len(x) for x in blobs] == [1 + 2, 1 + 1, 1 + 2 * 2, 1 + 3 * 8]
    assert np.concatenate([L.unpacked(x) for x in pa.array(blobs, pa.binary())]).tolist() == values.tolist()


def chunk_of(n_texts, length, words):
    rng, texts = random.Random(5), L.Texts()
    for _ in range(n_texts):
        texts.add(" ".join(f"w{int(words * rng.random() ** 3)}" for _ in range(length)))
    texts.ids, texts.train = [pa.array(range(n_texts))], [pa.array([i % 7 != 2 for i in range(n_texts)])]
    return texts.chunk("0-0")


def test_memory_of_a_chunk():
    """Asking for counts and scoring hold a few numbers for each token: two tasks and Spark share an executor."""
    chunk, tokens = chunk_of(400, 299, 60_000), 400 * 300
    tracemalloc.start()
    asked = pa.Table.from_batches(L._asked(4, 9)(iter([chunk])))
    most_asked = tracemalloc.get_traced_memory()[1]
    sent = sum(len(x) for x in asked["grams"].to_pylist()) / (len(L.Chunk(chunk).pairs) + len(L.Chunk(chunk).word_order))
    keys = sorted(set(zip(asked["n"].to_pylist(), asked["bucket"].to_pylist(), strict=True)))
    answers = pa.concat_tables([L._answers(asked.filter((np.array(asked["n"]) == n) & (np.array(asked["bucket"]) == b))) for n, b in keys])
    sums = answers.filter(np.array(answers["n"]) == 1).to_pandas()[["tokens", "kinds", "once", "twice"]].sum()
    totals = L.Totals(*map(int, sums), texts=sum(chunk["train"][0].as_py()))
    tracemalloc.reset_peak()
    scored = L._scored(totals, 500.0)(pa.Table.from_batches([chunk]), answers)
    most_scored = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scored["n_tokens"].to_pylist() == [300] * 400
    assert sent < 7.1 and most_asked < 100 * tokens and most_scored < 140 * tokens, (sent, most_asked / tokens, most_scored / tokens)


def test_more_words_than_two_bytes_tell_apart():
    texts, words = L.Texts(), [f"w{i}" for i in range(70_000)]
    for content in (" ".join(words), None, "w5 w69999"):
        texts.add(content)
    texts.ids, texts.train = [pa.array([2**53 + 1, None, 3])], [pa.array([True, False, True])]
    chunk = L.Chunk(texts.chunk("0-0"))
    assert chunk.ids.to_pylist() == [2**53 + 1, None, 3] and chunk.sizes.tolist() == [70_000, 0, 2] and chunk.texts == 2
    at = {w: c for w, c in zip(words, chunk.tokens.tolist(), strict=False)}
    assert len(set(at.values())) == 70_000 and chunk.tokens[70_000:].tolist() == [chunk.end, chunk.end, at["w5"], at["w69999"], chunk.end]
    assert chunk.before[[0, 70_001, 70_002]].tolist() == [chunk.begin] * 3


def test_more_tasks_than_the_session_deals(spark, monkeypatch):
    monkeypatch.setattr(L, "TASK_TOKENS", 300)
    before = [spark.conf.get(key, None) for key in L.STORING]
    checked(spark, rows_of(), L.Smoothing(strength=50.0, chunk_words=700, bucket_grams=500))
    assert [spark.conf.get(key, None) for key in L.STORING] == before


def test_text_ids(spark):
    rows = [("a", "shares rose"), (None, "shares fell"), ("a", "shares rose"), ("b", None)]
    df = spark.createDataFrame(rows, "id string, content string")
    got = L.log_probabilities(df, F.col("id") == "a").collect()
    assert sorted((str(r["id"]), r["n_tokens"], r["n_known"]) for r in got) == [("None", 3, 2), ("a", 3, 3), ("a", 3, 3), ("b", 1, 1)]
