import numpy as np

from tapeloom.llm import toxicity as X

RNG = np.random.default_rng(5)
WORDS = [f"{a}{b}" for a in ("share", "trial", "growth", "drug", "plan", "city", "board") for b in ("s", "ed", "ing", "", "ly", "al")]
BAD = [f"idio{b}" for b in ("t", "ts", "tic", "cy")] + [f"scumm{b}" for b in ("y", "ier", "iest", "ing")]


def text(toxic):
    found = RNG.choice(WORDS, RNG.integers(10, 80)).tolist()
    for _ in range(RNG.integers(2, 6) if toxic else 0):
        found.insert(RNG.integers(0, len(found)), str(RNG.choice(BAD)).capitalize() + "!")
    return " ".join(found)


def examples(rng, n, features, most, spread):
    """Sizes, terms and counts of random examples end to end; and their vectors as a matrix."""
    idf = np.linspace(1, spread, features)
    found = [np.unique(np.minimum(rng.zipf(1.3, rng.integers(0, most)), features) - 1) for _ in range(n)]
    counts = [rng.integers(1, 4, len(at)) for at in found]
    dense = np.zeros((n, features))
    for i, (at, c) in enumerate(zip(found, counts)):
        dense[i, at] = X.weighted(c, idf[at])
    return np.array([len(at) for at in found]), np.concatenate(found), np.concatenate(counts), idf, dense


def test_nearest_is_brute_force():
    """All cosines, and all ties with the k-th, for blocks and numbers of dense columns that cover all ways through."""
    rng = np.random.default_rng(2)
    for features, most, spread in ((40, 6, 1), (300, 40, 9)):
        sizes, terms, counts, idf, dense = examples(rng, 700, features, most, spread)
        for block, columns in ((4, 8), (64, 128), (5, 400), (1000, 16)):
            index = X.BlockMaxIndex(rng.integers(0, 2, 700), sizes, terms, counts, idf, block, columns).ready()
            assert sorted(index.order.tolist()) == list(range(700))
            chosen = range(0, 700, 7)
            asked = [(np.flatnonzero(dense[i]), dense[i][dense[i] > 0]) for i in chosen]
            for k in (1, 5, 25):
                for i, (docs, cos) in zip(chosen, index.nearest(asked, k)):
                    exact = np.round(dense @ dense[i], 12)
                    ranked = np.sort(exact[exact > 1e-12])[::-1]
                    want = np.flatnonzero((exact >= ranked[min(k, len(ranked)) - 1]) & (exact > 1e-12)) if len(ranked) else []
                    assert sorted(index.order[docs].tolist()) == sorted(want)
                    assert np.allclose(cos, exact[index.order[docs]]) and (np.diff(np.round(cos, 12)) <= 0).all()


def test_blocks_are_skipped():
    rng = np.random.default_rng(4)
    sizes = np.full(4000, 3)
    group = rng.integers(0, 20, 4000)
    terms = np.sort(group[:, None] * 6 + np.array([rng.permutation(6)[:3] for _ in range(4000)]), axis=1)
    index = X.BlockMaxIndex(group % 2, sizes, terms.ravel(), np.ones(12_000, int), np.ones(120)).ready()
    opened, product = [], index.matrix
    class Counted:
        shape = product.shape
        def __getitem__(self, rows):
            opened.append(rows.stop - rows.start)
            return product[rows]
    index.matrix = Counted()
    index.nearest([(terms[0], X.weighted(np.ones(3), np.ones(3)))], 5)
    assert sum(opened) < 1000


def test_vote_and_calibration_by_hand():
    index = X.BlockMaxIndex(np.array([1, 0, 1]), np.array([1, 1, 1]), np.array([0, 0, 1]), np.ones(3, int), np.ones(2)).ready()
    [(vote, docs)] = index.votes([(np.array([0]), np.ones(1))], 25)
    assert vote == 0.5 and sorted(docs.tolist()) == [0, 1]  # equally near
    w = X.weighted(np.array([1, 1]), np.array([3.0, 1.0]))
    [(vote, docs)] = index.votes([(np.array([0, 1]), w)], 25)
    near = 1 / (1.02 - np.array([w[0], w[0], w[1]]))
    assert abs(vote - near[[0, 2]].sum() / near.sum()) < 1e-12 and docs.tolist()[2] == 2
    steps = X.Calibration(np.array([0.1, 0.2, 0.9, np.nan]), np.array([0.0, 0.0, 1.0, 0.0]))
    share = 2 / 6
    assert abs(steps(0.0) - share / 3) < 1e-12 and abs(steps(0.95) - (1 + share) / 2) < 1e-12 and abs(steps(float("nan")) - share / 2) < 1e-12


def test_terms_with_and_without_vocabulary():
    texts = ["Idiots IDIOT idioTS 5x", None, "", "été longwords longword"]
    free = X.Terms(5)(texts)
    vocabulary = np.unique(np.concatenate([a for a, _ in free]))
    for (a, n), (b, m) in zip(free, X.Terms(5, vocabulary)(texts)):
        assert vocabulary[b].tolist() == a.tolist() and n.tolist() == m.tolist()
    named = dict(zip(free[0][0].tolist(), free[0][1].tolist()))
    assert named == {X._hashed("idiots"): 2, X._hashed("idiot"): 1, X._hashed("idiot~"): 2, X._hashed("x"): 1}


def test_held_out(spark):
    toxic = RNG.random(1200) < 0.2
    rows = [(i, text(t), "x") for i, t in enumerate(toxic)]
    articles = spark.createDataFrame(rows, "id bigint, content string, score string")
    moderated = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic) if i % 3], "id bigint, toxic int")
    got = X.toxicity(articles, moderated).toPandas().set_index("id")
    held = np.arange(0, 1200, 3)
    assert len(got) == 1200 and got["score"].between(0, 1).all()
    assert ((got["score"][held] >= 0.7).to_numpy() == toxic[held]).mean() > 0.98
    sure = [i for i in held if toxic[i]][0]
    assert all(toxic[j] for j in got["evidence"][sure]) and len(got["evidence"][sure]) == 3


def test_edges(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "a"), (None, "Idiot idiot", "a"), (4, "w " * 50_000, "a")]
    articles = spark.createDataFrame(rows, "id bigint, content string, toxic string")
    none = spark.createDataFrame([], "id bigint, toxic int")
    got = X.toxicity(articles, none).toPandas()
    assert len(got) == 5 and (got["score"] == 0.5).all() and all(len(e) == 0 for e in got["evidence"])
    some = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1), (2, None), (9, 1)], "id bigint, toxic int")
    assert X.toxicity(articles, some).toPandas()["score"].between(0, 1).all()
    assert X.toxicity(articles.limit(0), some).count() == 0


def test_all_terms_of_the_examples_count(spark):
    # "hated" stands in every toxic example and in more harmless ones; a rare toxic word in two of 40
    rows = [(i, f"hated slur{chr(97 + i % 20)} person", 1) for i in range(40)] + [(100 + i, f"hated weather picnic{chr(97 + i % 20)} rain", 0) for i in range(90)]
    asked = [(1000, "hated weather rain"), (1001, "slurh person"), (1002, "picnicd rain"), (1003, "unheard")]
    articles = spark.createDataFrame([(i, f"{t} {'x' * i}") for i, t, _ in rows] + asked, "id bigint, content string")
    moderated = spark.createDataFrame([(i, k) for i, _, k in rows], "id bigint, toxic int")
    got = X.toxicity(articles, moderated).toPandas().set_index("id")
    assert got["score"][1000] < 0.2 and got["score"][1001] > 0.8 and got["score"][1002] < 0.2
    assert set(got["evidence"][1001]) <= set(range(40)) and set(got["evidence"][1002]) <= set(range(100, 190))
    assert len(got["evidence"][1002]) == 3 and len(got["evidence"][1003]) == 0


def test_text_ids(spark):
    rows = [(f"a{i}", text(i % 4 == 0)) for i in range(200)]
    articles = spark.createDataFrame(rows, "id string, content string")
    moderated = spark.createDataFrame([(f"a{i}", int(i % 4 == 0)) for i in range(150)], "id string, toxic int")
    got = X.toxicity(articles, moderated).collect()
    assert all(e in {r[0] for r in rows} for r in got for e in r["evidence"]) and {r["id"] for r in got} == {r[0] for r in rows}


def test_packed_numbers_are_read_out_of_the_buffers():
    import pyarrow as pa

    from tapeloom.llm.toxicity import _unpacked

    values = [[3, 1], [], None, [2**40], [7, 8, 9]]
    packed = [None if v is None else np.array(v, np.uint64).tobytes() for v in values]
    column = pa.chunked_array([pa.array(packed[:3], pa.binary()).slice(1), pa.array(packed[3:], pa.binary()), pa.array([], pa.binary())])
    sizes, numbers = _unpacked(column, np.uint64)
    assert sizes.tolist() == [0, 0, 1, 3] and numbers.tolist() == [2**40, 7, 8, 9]
    sizes, numbers = _unpacked(column.take(pa.array([3, 0, 2])), np.uint64)
    assert sizes.tolist() == [3, 0, 1] and numbers.tolist() == [7, 8, 9, 2**40]
    assert [len(x) for x in _unpacked(pa.chunked_array([], pa.binary()), np.uint32)] == [0, 0]


def test_texts_of_a_call_are_cut_into_words_together(monkeypatch):
    """Letters of all scripts, no words across texts, words over the borders of spans; no call a word, and none remembered."""
    import re
    from collections import Counter

    monkeypatch.setattr(X, "_SPAN", 16)
    rng = np.random.default_rng(3)
    odd = "".join(chr(c) for c in rng.integers(1, 0x2000, 300)) + "\ud800 ΣΑΣ ΟΔΟΣ İstanbul a_b1c²d ٣x Ⅷ ǅ"
    texts = ["ends open", "open ends", odd, None, "", "x" * 50 + " y", "\n"]
    monkeypatch.setattr(X.xxhash, "xxh64_intdigest", None)
    for each, (at, n) in zip(texts, X.Terms(5)(texts), strict=True):
        words = re.findall(r"[^\W\d_]+", (each or "").lower())
        want = Counter(map(X._hashed, [*words, *[f"{w[:5]}~" for w in words if len(w) > 5]]))
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == want and (np.diff(at.astype(object)) > 0).all()
    assert [len(x) for x in X.Terms(5)([])] == [] and len(X.Terms(5, np.zeros(0, np.uint64))(["a b"])[0][0]) == 0
