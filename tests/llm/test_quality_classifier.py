import numpy as np
import pandas as pd

from tapeloom.llm import quality_classifier as C

RNG = np.random.default_rng(3)
WORDS = [f"{a}{b}" for a in ("share", "trial", "growth", "drug", "plan", "city") for b in ("s", "ed", "ing", "", "ly", "al")]


def text(good):
    found = RNG.choice(WORDS, RNG.integers(20, 90)).tolist()
    return " ".join(found) if good else " ".join(w + RNG.choice(["%%", "##"]) for w in found)


def test_contexts_are_the_plain_ones():
    space = C.Space(buckets=50, width=8, window=2)
    signs, table = C.index_signs(space), np.zeros(400, np.int64)
    parts = [C.units(t, space) for t in ("a b c a", "x", "", None, "b a " * 9)]
    C.add_contexts(table, parts, space, signs)
    want = np.zeros((50, 8), np.int64)
    for whole, ends in parts:
        for i in range(len(whole)):
            for j in range(max(0, i - 2), min(len(whole), i + 3)):
                if i != j:
                    for unit in (whole[i], ends[i]):
                        want[unit, signs[0][whole[j]]] += 1
                        want[unit, signs[1][whole[j]]] -= 1
    assert (table.reshape(50, 8) == want).all()


def test_held_out_accuracy_and_calibration(spark):
    good = RNG.random(1500) < 0.8
    rows = [(i, text(g), "x") for i, g in enumerate(good)]
    articles = spark.createDataFrame(rows, "id bigint, content string, score string")
    ratings = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good) if i % 3], "id bigint, quality int")
    got = C.quality_scores(articles, ratings, fit=C.Fit(epochs=30)).toPandas().set_index("id")["score"]
    held = np.arange(0, 1500, 3)
    assert len(got) == 1500 and got.between(0, 1).all()
    assert ((got[held] >= 0.5).to_numpy() == good[held]).mean() > 0.97
    assert abs(got[held].mean() - good[held].mean()) < 0.05


def test_edges(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "a"), (3, " \n", "a"), (None, "some words", "a"), (4, "w " * 100_000, "a")]
    articles = spark.createDataFrame(rows, "id bigint, content string, quality string")
    none = spark.createDataFrame([], "id bigint, quality int")
    got = C.quality_scores(articles, none).toPandas()
    assert len(got) == 6 and (got["score"] == 0.5).all()
    both = spark.createDataFrame([(1, 0), (4, 1), (None, 1), (2, None), (9, 1)], "id bigint, quality int")
    got = C.quality_scores(articles, both).toPandas()
    assert got["score"].between(0, 1).all() and got[got["id"].isin([1, 2, 3])]["score"].nunique() == 1
    assert C.quality_scores(articles.limit(0), both).count() == 0
    assert C.pool(pd.Series(["a b"]), np.zeros((8192, 32), np.float32), C.Space()).shape == (1, 65)
