"""Quality of articles by weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tapeloom.session import materialise

from .records import narrowed, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_STOPS = (b".", b"!", b"?")
_PUNCTUATION = ".,;:!?'\"()[]-\u2013\u2014\u2018\u2019\u201c\u201d\u00ab\u00bb"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stops",
            "n_shouts", "n_distinct", "n_plain")


def repeat_words(found: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    if len(found) < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in found], np.int64)
    pairs = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(names) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    inside = np.zeros(len(found), bool)
    for k in range(3):
        inside[k: k + len(again)] |= again
    return int(inside.sum())


def measure(content: str | None) -> tuple[int, ...]:
    """Counts of a whole text, in the order of ``MEASURES``; a null text counts like an empty one."""
    content = content or ""
    found = words(content)
    lines = [x for x in content.split("\n") if x.strip(BLANKS)]
    raw = content.encode("utf-8", "replace")
    return (len(found), len(content) - sum(map(content.count, BLANKS)), sum(map(content.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(found), len(lines), len(raw) - len(raw.translate(None, _UPPER)),
            sum(w.endswith(_STOPS) for w in found), sum(w.endswith(b"!") for w in found), len(set(found)),
            sum(w.isalpha() for w in (w.strip(_PUNCTUATION) for w in content.split())))


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measures(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in content], columns=MEASURES, dtype="int64")


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, bad where ``bad`` holds, and abstains elsewhere."""

    name: str
    good: str
    bad: str


#: Thresholds per word, letter or line, so that they mean the same for every length. Each kind of fault is
#: seen by two rules or more, as only agreement between rules shows which of them are right.
RULES = (
    Rule("word length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols", "20 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    Rule("plain words", "10 * n_plain >= 9 * n_words", "10 * n_plain < 7 * n_words"),
    Rule("repeated lines", "n_dup_lines = 0 AND n_lines >= 3", "10 * n_dup_lines > 4 * n_lines"),
    Rule("repeated words", "10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("variety", "n_distinct > 4 * sqrt(n_words)", "n_words >= 50 AND n_distinct < 2 * sqrt(n_words)"),
    Rule("sentences", "n_stops > 0 AND n_words BETWEEN 4 * n_stops AND 80 * n_stops", "n_words >= 50 AND n_words > 200 * n_stops"),
    Rule("capitals", "10 * n_upper <= word_chars", "10 * n_upper > 3 * word_chars"),
    Rule("shouts", "50 * n_shouts <= n_words", "3 * n_shouts > n_words"),
)


def vote(rule: Rule) -> Column:
    """0 abstains, 1 is bad, 2 is good."""
    return F.when(F.expr(rule.bad), 1).when(F.expr(rule.good), 2).otherwise(0)


def patterns(rules: tuple[Rule, ...]) -> Column:
    """All votes of a row as one number in base 3, the first rule lowest."""
    return sum((vote(r) * 3**k for k, r in enumerate(rules)), F.lit(0)).cast("int")


def posteriors(seen: dict[int, int], rules: int, rounds: int = 300, good_share: float = 0.85, trust: float = 0.8,
               strength: float = 10.0) -> tuple[dict[int, float], np.ndarray]:
    """Probability of good for every seen pattern; how often each rule votes bad (kind, rule), good articles first.

    Expectation-maximisation over good articles and one kind of bad ones for each rule; given the kind,
    votes are independent and abstentions say nothing. At the start a rule sees its own kind with ``trust``
    and says of other kinds what it says of all articles; ``strength`` pseudo-votes hold it there if
    nothing speaks against, and it must see half of its own kind. The shares of the kinds are drawn towards
    the prior with the weight of the data itself: a kind on which rules agree keeps its share, while a rule
    that fires often and alone is counted as wrong about good articles.
    """
    code = np.array(sorted(seen), np.int64)
    n = np.array([seen[int(c)] for c in code], float)
    votes = code[:, None] // 3 ** np.arange(rules) % 3
    bad, voted = (votes == 1).astype(float), (votes > 0).astype(float)
    start = np.repeat(((n @ bad + 1) / (n @ voted + 2))[None], rules + 1, axis=0)
    start[0] = 1 - trust
    own = np.arange(1, rules + 1), np.arange(rules)
    start[own] = trust
    share0 = np.array([good_share] + [(1 - good_share) / rules] * rules)
    chance, share = start, share0
    for _ in range(rounds):
        kind = np.log(share) + bad @ np.log(chance).T + (voted - bad) @ np.log1p(-chance).T
        kind = np.exp(kind - kind.max(axis=1, keepdims=True))
        kind /= kind.sum(axis=1, keepdims=True)
        weight = kind.T * n
        before = chance
        chance = np.clip((weight @ bad + strength * start) / (weight @ voted + strength), 1e-4, 1 - 1e-4)
        chance[own] = np.maximum(chance[own], 0.5)
        share = (weight.sum(1) + (n.sum() + strength) * share0) / (2 * n.sum() + strength)
        if np.abs(chance - before).max() < 1e-9:
            break
    return dict(zip(code.tolist(), kind[:, 0].tolist(), strict=True)), chance


def judge(articles: DataFrame, key: str = "id", text: str = "content", rules: tuple[Rule, ...] = RULES,
          keep: float = 0.5) -> DataFrame:
    """Counts, hard limits and probable quality of every article, one row per input row.

    Columns: id, ``MEASURES``, base_failed (fewer than 50 words, or over half of them in repeated three-word
    windows), quality (probability of good given the votes of all rules), kept (not failed and quality >=
    ``keep``). Accuracies are estimated over all given articles from the counts of vote patterns, of which
    there are at most ``3 ** len(rules)``, whatever the number of articles; so their table may be broadcast.

    Null and empty texts have zero counts and fail. Repeated rows stay and count as often as they come.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = materialise(narrowed(articles, id=key, content=text)
                       .select("id", _measures("content").alias("m")).select("id", "m.*"), "measures")
    voted = rows.withColumn("pattern", patterns(rules))
    seen = {r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()}
    quality = rows.sparkSession.createDataFrame(list(posteriors(seen, len(rules))[0].items()), "pattern int, quality double")
    return (voted.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
            .join(F.broadcast(quality), "pattern").drop("pattern")
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep)))
