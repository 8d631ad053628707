import numpy as np
from pyspark.sql import functions as F

from tapeloom.llm import neighbours as N

SCHEMA = "id bigint, vector array<float>, score string"


def brute(rows, asked, k):
    out = {}
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, x in good:
        if asked(q):
            found = sorted(((-float(x @ y), i) for i, y in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def found(spark, rows, k=20, **graph):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = {}
    for r in N.nearest_vectors(df, F.col("id") % 20 == 0, k, graph=N.Graph(**graph)).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(got[r["query"]])
    return got


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 24))
    x = (centres[rng.integers(0, 8, 3000)] + rng.standard_normal((3000, 24))).astype(np.float32)
    x *= rng.uniform(0.5, 1.5, (3000, 1)).astype(np.float32)  # lengths differ, so that inner products are not cosines
    x[2000:2400] = x[7]  # a large group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(spark, rows, leaf=128), brute(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95
    own = dict(enumerate(x.astype(np.float64)))
    for q, near in got.items():
        assert len(near) == 20 and near == sorted(near, key=lambda p: (-p[1], p[0]))
        assert all(abs(s - own[q] @ own[i]) < 1e-9 for i, s in near)
    assert [i for i, _ in got[2000]] == [7, *[i for i in range(2001, 2020)]][:20] or dict(got[2000]).keys() <= dict(want[2000]).keys()


def test_small_and_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [-1.0, 0.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (1, [1.0, 0.0])]
    got = found(spark, rows)
    assert got == {0: [(1, 1.0), (20, 0.5), (8, -1.0)], 20: [(0, 0.5), (1, 0.5), (8, -0.5)]}
    assert found(spark, []) == {} and found(spark, rows[3:5]) == {} and found(spark, [(0, [1.0])]) == {}


def test_queries_that_meet_too_few_are_compared_with_all(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(spark, rows, degree=2, tables=1, leaf=3, rounds=1, beam=3, width=1, steps=1), brute(rows, lambda i: i % 20 == 0, 20)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}
