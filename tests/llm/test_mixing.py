import random

from tapeloom.llm import mixing as M

SCHEMA = "id bigint, content string, feed string, target string"


def aims(sizes, weights=(5, 2, 1), ceiling=3.0):
    """Water filling over {feed: words} by hand."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        above = {s for s in free if level * w[s] > ceiling * sizes[s]}
        if not above:
            out |= {s: level * w[s] for s in free}
            break
        out |= {s: ceiling * sizes[s] for s in above}
        free -= above
    return out


def checked(spark, rows):
    got = M.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert list(got.columns) == ["id", "size", "feed_size", "target", "taken"] and len(got) == len(rows)
    return got


def test_targets_and_taken(spark):
    rng = random.Random(3)
    rows, sizes = [], {}
    for i in range(3000):
        feed = rng.choice(["hot"] * 40 + ["a", "b", "c", "d", None, "é", "tiny"])
        n = rng.choice([0, 1, 5, 30, 200])
        rows.append((i, " ".join(["w"] * n), feed, "x"))
        sizes[feed] = sizes.get(feed, 0) + n
    got = checked(spark, rows)
    feed_of = {r[0]: r[2] for r in rows}
    want = aims(sizes)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for feed, target in want.items():
        part = got[[feed_of[int(i)] == feed for i in got["id"]]]
        assert abs(part["target"].iloc[0] - target) < 1e-6 and (part["feed_size"] == sizes[feed]).all()
        assert abs(part["taken"].sum() - target) <= 100.5  # half of the longest article
        assert (part["taken"] <= 3 * part["size"]).all()
        times = (part["taken"] / part["size"].where(part["size"] > 0)).dropna().unique()
        assert len(times) <= 2 and all(float(t).is_integer() for t in times)
    again = checked(spark, rows[::-1])
    assert got.sort_values("id").reset_index(drop=True).equals(again.sort_values("id").reset_index(drop=True))


def test_edges(spark):
    assert checked(spark, []).empty
    rows = [(None, "a b", "x", ""), (None, "a b", "x", ""), (1, None, "x", ""), (1, None, "y", ""), (2, "q " * 50_000, "x", ""), (2, "q " * 50_000, "x", "")]
    got = checked(spark, rows)
    assert (got[got["size"] == 0]["taken"] == 0).all()
    assert len(M.take(spark.createDataFrame(rows, SCHEMA), key="id", text="content", feed="feed").collect()) > 0


def test_rows_without_or_with_one_id_meet_the_target(spark):
    """A source whose rows all lack an id, all share one, or are all equal, is mixed like any other."""
    words = lambda i: " ".join(f"w{i}" for _ in range(50))
    for make in (lambda i: (None, words(i)), lambda i: (7, words(i)), lambda i: (None, words(0)), lambda i: (7, words(0))):
        rows = [(*make(i), "hot", "x") for i in range(400)] + [(1000 + i, words(i), "other", "x") for i in range(600)]
        got = checked(spark, rows)
        feed = got["feed_size"] == 20_000
        want = aims({"hot": 20_000, "other": 30_000})["hot"]
        assert feed.sum() == 400 and abs(got["taken"][feed].sum() - want) <= 25.5
        taken = M.take(spark.createDataFrame(rows, SCHEMA).repartition(6), key="id", text="content", feed="feed")
        assert taken.columns == SCHEMA.replace(",", "").split()[::2]
        assert abs(taken.filter("feed = 'hot'").count() * 50 - want) <= 25.5
        assert sorted(got["taken"].tolist()) == sorted(checked(spark, rows[::-1])["taken"].tolist())
