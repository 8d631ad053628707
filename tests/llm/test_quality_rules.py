import numpy as np

from tapeloom.llm import quality_rules as Q

_RNG = np.random.default_rng(7)
_WORDS = [f"{a}{b}{c}" for a in ("sha", "tri", "gro", "pla") for b in ("re", "al", "wn") for c in ("s", "ed", "ing", "")]
CLEAN = ["".join(" ".join(_RNG.choice(_WORDS, 12)).capitalize() + ".\n" for _ in range(3)) for _ in range(40)]


def plain(text):
    """The counts by their definition."""
    text = text or ""
    for c in "\t\x0b\x0c\r":
        text = text.replace(c, " ")
    lines = text.split("\n")
    found = [w for x in lines for w in x.split(" ") if w]
    windows = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    real = [x for x in lines if x.strip(" ")]
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text),
            sum(x in real[:i] for i, x in enumerate(real)), len(again))


def test_counts_are_the_plain_ones():
    texts = [None, "", " \n ", "a b c a b c d", "a a a a", "x | y\nx | y\n\nx | y", "é#ß $5\u00a0z " * 7, "one\nTwo\x0bthree"]
    for t in texts:
        assert Q.measure(t)[:5] == plain(t)


def test_em_trusts_rules_that_agree():
    """Two kinds of bad articles, each seen by two rules, and a fifth rule that votes at random."""
    rng = np.random.default_rng(1)
    n = 20_000
    kind = rng.choice(3, n, p=[0.85, 0.1, 0.05])
    fires = lambda k: rng.random(n) < np.where(kind == k, 0.9, 0.03)
    votes = [fires(1), fires(1), fires(2), fires(2), rng.random(n) < 0.5]
    code = sum(np.where(rng.random(n) < 0.1, 0, np.where(v, 1, 2)) * 3**k for k, v in enumerate(votes))
    counts = dict(zip(*map(np.ndarray.tolist, np.unique(code, return_counts=True)), strict=True))
    quality, chance = Q.posteriors(counts, 5)
    good = np.array([quality[c] for c in code.tolist()]) > 0.5
    assert (good == (kind == 0)).mean() > 0.955
    assert chance[0, :4].max() < 0.06 and chance[0, 4] > 0.35  # the random rule is wrong about good articles
    assert Q.posteriors({}, 5)[0] == {}


def test_judge(spark):
    junk = ["x | y ## $$ %% && " * 30, "BUY NOW!! " * 60, "word " * 200, "same line here again\n" * 40]
    rows = [(i, " ".join(CLEAN[i:i + 4]), "c") for i in range(36)] + [(100 + i, t, "j") for i, t in enumerate(junk)]
    rows += [(200, None, "n"), (201, "", "n"), (None, "too short", "n"), (0, " ".join(CLEAN[:4]), "c")]
    got = Q.judge(spark.createDataFrame(rows, "id bigint, content string, kept string")).toPandas()
    assert len(got) == len(rows)
    kept = got.set_index("id")["kept"]
    assert got[got["id"] < 100]["kept"].all() and not got[got["id"] >= 100]["kept"].any() and len(kept) == len(rows)
    assert (got["quality"].between(0, 1)).all() and not got[got["base_failed"]]["kept"].any()
    assert Q.judge(spark.createDataFrame([], "id bigint, content string")).count() == 0
