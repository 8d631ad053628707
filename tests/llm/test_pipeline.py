"""Each stage against a plain account of what it must do to its own input."""

import re
from collections import Counter

import corpus_pipeline as P
from tapeloom.llm import mixing, pieces
from tapeloom.llm.queries import articles_of
from tapeloom.session import materialise

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (None, "no id here", "en", "src1", 10)], docs.schema)
    docs = materialise(docs.unionByName(extra).unionByName(docs.limit(2)), "docs")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES:
        before, docs = docs, materialise(stage(spark, docs, SF), "stage")
        seen.append((name, before, docs))
        assert name == P.STAGES[-1][0] or docs.columns == columns
    quality, copies, secrets, mixed, coded = seen

    rows = Counter(map(tuple, quality[1].collect()))
    rows.subtract(map(tuple, quality[2].collect()))
    assert min(rows.values()) >= 0 and 0 < sum(rows.values()) < quality[1].count() / 2

    # all pairs of word runs by brute force: one row of each group stays, that of its smallest id
    given = copies[1].collect()
    runs = [frozenset(shingles(r["text"])) for r in given]
    up = list(range(len(given)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(given)):
        for b in range(a):
            if runs[a] == runs[b] or 10 * len(runs[a] & runs[b]) >= 8 * len(runs[a] | runs[b]):
                up[top(a)] = top(b)
    groups = {}
    for i, r in enumerate(given):
        groups.setdefault(top(i), []).append(r)
    kept = Counter(map(tuple, copies[2].collect()))
    assert all(n == 1 for n in kept.values()) and sum(kept.values()) < len(given)
    alone = [g for g in groups.values() if sum(kept[tuple(r)] for r in set(g)) == 1]
    assert len(alone) >= 0.97 * len(groups) and all(any(kept[tuple(r)] for r in g) for g in groups.values())
    for g in alone:
        assert [r["doc_id"] for r in set(g) if kept[tuple(r)]] == [min((r["doc_id"] for r in g if r["doc_id"] is not None), default=None)]

    old = {r["doc_id"]: r for r in secrets[1].collect() if r["doc_id"] is not None}
    for r in secrets[2].collect():
        if r["doc_id"] is None:
            continue
        text, was = r["text"], old[r["doc_id"]]["text"]
        assert r["n_chars"] == len(text) and not re.search(r"AKIA[0-9A-Z]{16}|(token = \"|password=)[0-9a-f]{16}", text)
        if text != was:
            assert re.fullmatch(r"(?s).{16,}".join(map(re.escape, text.split("[SECRET]"))), was)
    assert secrets[2].count() == secrets[1].count()

    want = {r["id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix(articles_of(mixed[1])).collect() if r["id"] is not None and r["size"]}
    got = Counter(r["doc_id"] for r in mixed[2].collect() if r["doc_id"] is not None)
    assert {i: n for i, n in want.items() if n} == {i: n for i, n in got.items() if want.get(i)}

    spelt = pieces.Vocabulary(pieces.model_bytes()).bytes
    text = {r["doc_id"]: r["text"] for r in coded[1].collect()}
    rows = coded[2].collect()
    assert len(rows) == coded[1].count()
    assert all(pieces.decode(r["pieces"], spelt) == text[r["doc_id"]] for r in rows if r["doc_id"] is not None)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = materialise(stage(spark, docs, SF), "empty")
        assert docs.count() == 0
