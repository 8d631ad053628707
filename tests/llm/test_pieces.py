import itertools
from collections import Counter

import numpy as np
import sentencepiece

from tapeloom.llm import pieces as P

MODEL = P.model_bytes()
TEXTS = ["", " ", "a", "Shares rise  10% after trial", "  lead\n\n tail \n", "\n", "a▁b ▁", "tab\there\r\nx\x00y", "日本語 é ß 🎉 ​",
         "<0x0A> <s></s> <unk>", "x" * 3000, " " * 100 + "z", "word " * 4000, "𝒳" * 50]


def test_exact_round_trip_also_by_the_library():
    vocabulary = P.Vocabulary(MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for seed in range(3):
        for text, ids in zip(TEXTS, P.sample(vocabulary, TEXTS, np.full(len(TEXTS), seed, np.uint64)), strict=True):
            assert P.decode(ids, vocabulary.bytes) == text
            assert sp.decode(ids.tolist()) == text


def test_samples_follow_the_weights():
    """Frequencies of the sampled segmentations of a word against the weights of all its segmentations."""
    v = P.Vocabulary(MODEL)
    word = P.BLANK + "trial"
    want = {}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(edges)]
        if all(p in v.weights for p in parts):
            want[tuple(v.ids[p] for p in parts)] = np.prod([v.weights[p] for p in parts])
    total, n = sum(want.values()), 60_000
    got = Counter(tuple(x.tolist()) for x in P.sample(v, ["trial"] * n, np.arange(n).astype(np.uint64)))
    assert set(got) <= set(want)
    for ids, w in want.items():
        p = w / total
        assert abs(got[ids] / n - p) < 5 * np.sqrt(p / n) + 1e-4


def test_articles(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (None, "no id", "x"), (3, TEXTS[3], "x")]
    articles = spark.createDataFrame(rows, "id bigint, content string, pieces string")
    once = P.decode_articles(P.encode_articles(articles)).toPandas()
    again = P.encode_articles(articles.repartition(5)).toPandas()
    assert len(once) == len(rows) and (once["decoded"].fillna("?") == once["content"].fillna("?")).all()
    key = lambda d: sorted((str(i), None if x is None else tuple(x)) for i, x in zip(d["id"], d["pieces"], strict=True))
    assert key(once) == key(again)
    other = P.encode_articles(articles, salt=1).toPandas()
    assert key(other) != key(once)
    assert P.encode_articles(articles.limit(0)).count() == 0


def test_company_of_other_texts_does_not_matter():
    v, texts = P.Vocabulary(MODEL), [f"Trial {j} of {j * 7} went well" for j in range(20)] + [None, ""]
    seeds = np.arange(22).astype(np.uint64)
    alone = [P.sample(v, [t], seeds[i:i + 1])[0] for i, t in enumerate(texts)]
    assert all(a is b is None or (a == b).all() for a, b in zip(P.sample(v, texts, seeds), alone, strict=True))
