import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from tapeloom.llm import lexical as L
from tapeloom.llm.queries import ORACLES, QUERIES

SCHEMA = "id bigint, content string, rank int, number string"
READ = re.compile(L.TERM)


def found(text):
    return READ.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(articles, headlines, k):
    docs = [(i, Counter(found(t))) for i, t in articles]
    docs = [d for d in docs if d[1]]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    out = []
    for search, text in headlines:
        scored = []
        for i, counts in docs:
            m = 50 + (50 * sum(counts.values()) * n) // total
            s = 0
            for t in set(found(text)):
                df = sum(t in c for _, c in docs)
                if df:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(search, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def corpus(n, rng):
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Éa", "ÉA", "é_a", "don't", "x2", "日本", "USD"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 20, 120]))), 1, "z") for i in range(n)]
    copies = [(n + i, rows[7][1] or "w1 w2", 1, "z") for i in range(n // 3)]  # a group of a quarter of all rows
    return rows + copies + [(None, "w1 usd", 1, "z"), (3, None, 1, "z"), (4, rows[4][1], 1, "z")]


def test_equals_scores_by_hand(spark):
    rng = random.Random(2)
    rows = corpus(300, rng)
    heads = [(j, rng.choice(rows)[1] if j % 3 else " ".join(rng.choices(["w1", "w2", "W3", "usd", "Éa", "none"], k=4)), 5) for j in range(25)]
    heads += [(None, "w1", 5), (77, None, 5), (78, "", 5), (79, "...", 5), (5, "w2 w9", 5), (5, "w2 w9", 5)]
    want = by_hand([(r[0], r[1]) for r in rows], [(h[0], h[1]) for h in heads], 20)
    for layout in (L.Layout(), L.Layout(search_bytes=600, block_articles=37, block_postings=500, popped=3)):
        got = L.best_articles(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(heads, "id bigint, headline string, score int"), 20, layout=layout)
        assert got.columns == ["search", "rank", "id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_range_maxima_and_bounds():
    rng = np.random.default_rng(1)
    term, article = np.divmod(np.unique(rng.integers(0, 40 * 300, 3000)), 300)
    impact = rng.integers(1, 50, len(term))
    index = L.Index(term, article, impact, 300)
    for _ in range(300):
        one = rng.integers(len(index.terms))  # ranges lie in one list
        a, b = np.sort(rng.integers(index.begin[one], index.begin[one + 1] + 1, 2))
        at, value = index.greatest(np.array([a]), np.array([b]))
        assert value[0] == (index.impact[a:b].max() if a < b else 0)
    dense = np.zeros((40, 300), np.int64)
    dense[term, article] = impact
    for k in (1, 7, 400):
        asked = rng.choice(45, 6, replace=False)
        places, scores = index.search(asked, k, 1, 4)
        total = dense[asked[asked < 40]].sum(axis=0)
        order = [p for p in np.lexsort((np.arange(300), -total))[:k] if total[p] > 0]
        assert places.tolist() == order and scores.tolist() == total[order].tolist()


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    heads = spark.createDataFrame([("a", "w1 w2")], "id string, headline string")
    assert L.best_articles(none, heads).count() == 0
    assert L.best_articles(spark.createDataFrame([(1, None, 1, "")], SCHEMA), heads).count() == 0
    text_ids = spark.createDataFrame([("b", "w1 " * 100_000), ("a", "w1"), ("c", "q"), (None, "w1")], "id string, content string")
    assert L.best_articles(text_ids, heads.limit(0)).count() == 0
    got = [(r.search, r.rank, r.id) for r in L.best_articles(text_ids, heads).orderBy("rank").collect()]
    assert [g[1] for g in got] == [1, 2, 3] and {g[2] for g in got} == {"a", "b", None} and all(g[0] == "a" for g in got)


def test_query_equals_its_twin(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = QUERIES["op11_search"](spark, "/root/testdata/sf0.001")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLES['op11_search']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 1000
