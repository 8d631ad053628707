"""Secrets in articles: candidate strings, and a random forest that removes the false ones.

Only DataFrame and SQL expressions and Spark's own forest are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.session import materialise

from .records import narrowed

_NAMES = r"(pass(word|wd|phrase)?|pwd|secret|token|credentials?|auth(orization)?|(api|access|private|secret)[_\- ]?key)(?![a-z])"
KEYWORD = r"(?i)(?<![a-z])" + _NAMES
_SIGN = r"[\"']?\s*(=>|=|:|is\s)\s*[\"']?"
ASSIGNED = KEYWORD + r"[\w\-]*" + _SIGN + "$"
#: Between a scheme with a user and an at sign.
LINKED = r"://[^\s/:@]+:$"
RUN = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}={0,2}"
_GIVEN = r"(?<![\w\-])[\w\-]*(?<![A-Za-z])(?i:" + _NAMES + r")[\w\-]*" + _SIGN.replace("is", "[iI][sS]")
_LOGIN = r"://[^\s/:@]+:"
#: A candidate is what follows a name with a keyword and a sign, or is the password in a link, a whole JSON web token,
#: or a whole run of at least 16 letters, digits and ``+/_-``, with base64 padding.
CANDIDATE = (_GIVEN + r"[^\s\"'`<>]*[^\s\"'`<>.,;:)\]}?]|" + _LOGIN + r"[^\s/@]+(?=@)"
             r"|(?<![A-Za-z0-9+/_\-])eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]*|" + RUN)
#: What a match of a candidate begins with that is no part of the secret.
OPENING = f"^(?:{_GIVEN}|{_LOGIN})"
#: Without any of these in a text, only runs can be candidates.
MARKED = r"eyJ|://[^\s/:@]+:|" + KEYWORD + r"[\w\-]*[\"']?\s*(=|:|is\s)"
HARMLESS = r"(?i)(?<![a-z])(example|sample|dummy|placeholder|your|checksum|sha\d*|md5|digest|commit|uuid|guid|revision)(?![a-z])\W*\w*\W*$"
FEATURES = ("length", "digits", "uppers", "marks", "transitions", "variety", "coverage", "path", "assigned", "keyword",
            "harmless", "quoted")
TRIGRAMS = 26**3


@dataclass(frozen=True)
class Forest:
    """``examples`` bounds the labelled findings of each class that the forest is fitted on, taken by a hash; ``hosts``
    the texts that lend their words to planted findings."""

    examples: int = 6000
    hosts: int = 400
    known: float = 2e-6       # share of all three-letter strings from which one is in the dictionary
    trees: int = 24
    depth: int = 6
    seed: int = 11
    threshold: float = 0.5


def _cut(text: Column, pattern: Column) -> tuple[Column, Column]:
    """The matches of a text, and the pieces before, between and after them."""
    return F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)


def _pattern(text: Column) -> Column:
    return F.when(text.rlike(MARKED), F.lit(CANDIDATE)).otherwise(F.lit(RUN))


def _opening(match: Column) -> Column:
    return F.regexp_extract(match, OPENING, 0)


def candidates(articles: DataFrame, around: int = 48) -> DataFrame:
    """Every candidate of every text; ``place`` counts them from 1 in a text, and ``text_hash`` tells texts of one id apart.

    (id, text_hash, place, secret, before, after, lead, trail): ``before`` and ``after`` end at the next candidate, ``lead`` and
    ``trail`` are the characters around it in the whole text.
    """
    text = F.coalesce("content", F.lit(""))
    marked = articles.select("id", F.xxhash64("content").alias("text_hash"), text.alias("content"), text.rlike(MARKED).alias("_marked"))
    either = lambda f: F.when(F.col("_marked"), f(CANDIDATE)).otherwise(f(RUN))
    both = marked.select("id", "text_hash", either(lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(0))).alias("match"),
                         either(lambda p: F.split("content", p, -1)).alias("rest")).filter(F.size("match") > 0)
    both = both.withColumn("opening", F.transform("match", _opening)).withColumn("found", F.zip_with(
        "match", "opening", lambda m, o: F.substring(m, F.length(o) + 1, F.length(m))))
    pieces = lambda cut: F.flatten(F.zip_with("rest", F.arrays_zip("opening", "found"), lambda r, c: F.array(
        cut(r, F.lit(around)), F.coalesce(cut(c["opening"], F.lit(around)), F.lit("")), F.coalesce(cut(c["found"], F.lit(around)), F.lit("")))))
    # rest i stands at 3i + 1, its candidate at 3i + 3; a candidate has a character at least
    n, most = F.size("found"), 3 * around + 2
    both = both.withColumns({"_left": pieces(F.right), "_right": pieces(F.left)})
    rows = both.select("id", "text_hash", F.posexplode(F.arrays_zip(
        "found", F.slice(F.zip_with("rest", "opening", lambda r, o: F.right(F.concat(r, F.coalesce(o, F.lit(""))), F.lit(around))), F.lit(1), n).alias("before"),
        F.slice(F.transform("rest", lambda x: F.left(x, F.lit(around))), F.lit(2), n).alias("after"),
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.right(F.array_join(F.slice(
            "_left", F.greatest(F.lit(1), 3 * i + 3 - most), F.least(3 * i + 2, F.lit(most))), ""), F.lit(around))).alias("lead"),
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.left(F.array_join(F.slice(
            "_right", 3 * i + 4, F.lit(most)), ""), F.lit(around))).alias("trail"))).alias("place", "c"))
    return (rows.select("id", "text_hash", (F.col("place") + 1).alias("place"), F.col("c.found").alias("secret"), F.col("c.before").alias("before"),
                        F.coalesce("c.after", F.lit("")).alias("after"), F.col("c.lead").alias("lead"),
                        F.coalesce("c.trail", F.lit("")).alias("trail")).filter("secret <> ''"))


def _without(text: Column, kept: str) -> Column:
    return F.regexp_replace(text, f"[^{kept}]+", "")


def measured(found: DataFrame) -> DataFrame:
    """All features but ``coverage``, which needs a lexicon."""
    c, n = F.col("secret"), F.length("secret").cast("double")
    runs = c
    for kept, mark in (("0-9", "9"), ("A-Z", "A"), ("a-z", "a")):
        runs = F.regexp_replace(runs, f"[{kept}]+", mark)
    flag = lambda x: x.cast("double")
    lead = F.col("lead")
    linked = lead.rlike(LINKED) & F.col("trail").startswith("@")
    return found.withColumns({
        "length": n, "digits": F.length(_without(c, "0-9")) / n, "uppers": F.length(_without(c, "A-Z")) / n,
        "marks": F.length(_without(c, r"+/_=\-")) / n, "transitions": (F.length(runs) - 1) / n,
        "variety": F.size(F.array_distinct(F.split(c, ""))) / n,
        "path": flag((lead.rlike(r"(://|[./\\?&])\S*$") | c.rlike(r"^/|/.*/") | F.col("trail").rlike(r"^(\.[a-z]|/)"))
                     & ~lead.rlike(ASSIGNED) & ~linked),
        "assigned": flag(lead.rlike(r"[=:]\s*[\"']?$")), "keyword": flag(lead.rlike(KEYWORD + r"\W*\w*\W*$") | linked),
        "harmless": flag(lead.rlike(HARMLESS)), "quoted": flag(lead.rlike("[\"'`]$"))})


#: Secrets as they are written, and what looks like them: ``{}`` is the finding. First the finding, then how it stands.
#: Findings are made of random digits (``hex``), of letters and digits (``mixed``), of those and ``+/`` (``base``), or of
#: the words of the text itself (``word``).
PLANTED = (
    ("substr(hex, 1, 40)", 'token = "{}"'), ("substr(mixed, 1, 12)", "password={}"), ("substr(base, 1, 32)", "api_key: '{}'"),
    ("concat('AKIA', upper(substr(mixed, 1, 16)))", "{}"), ("substr(mixed, 1, 11)", "https://user:{}@host.example/home"),
    ("concat('eyJ', substr(mixed, 1, 18), '.eyJ', substr(mixed, 19, 20), '.', substr(mixed, 3, 30))", "Bearer {}"),
    ("substr(base, 1, 40)", "AWS_SECRET_ACCESS_KEY={}"), ("concat(substr(mixed, 1, 6), '!', substr(hex, 1, 4), '$')", "pwd: {}"),
    ("concat(substr(mixed, 1, 9), '&', substr(mixed, 10, 4), '7')", "the passphrase is {}"), ("concat('ghp_', substr(mixed, 1, 36))", "{}"),
    ("substr(hex, 1, 32)", "client_secret: {}"), ("concat('sk-', substr(mixed, 1, 32))", "use {} here"))
DECOYS = (
    ("substr(hex, 1, 40)", "commit {}"), ("hex", "sha256:{}"), ("hex", "checksum = {}"), ("substr(hex, 1, 32)", "/img/{}.png"),
    ("concat_ws('-', substr(hex, 1, 8), substr(hex, 9, 4), substr(hex, 13, 4), substr(hex, 17, 4), substr(hex, 21, 12))", "id {}"),
    ("concat_ws('-', word, word2, substr(hex, 1, 2), word3, word)", "https://site.example/news/{}"), ("concat(word, word2, word3, word2)", "{}"),
    ("concat(word3, '_', word, '_', word2, '_name')", "{} = 5"), ("cast(number % 40 as string)", "the password is {} characters long"),
    ("concat(2000 + number % 30, '-', 10 + number % 3, '-', 10 + number % 20)", "token: {} was issued"), ("concat(number % 100, '%')", "secret: {} of it"),
    ("cast(number % 9 as string)", "auth: {} factors"), ("word", "the token is {}"), ("word2", "password: {}"), ("concat(word, '-', word3)", "secret is {}"),
    ("concat('$', number % 900, ',', 100 + number % 800)", "token: {}"), ("concat(number % 24, ':', 10 + number % 50)", "auth is {}"))


def planted(articles: DataFrame, hosts: int) -> DataFrame:
    """Findings whose label is known, as they were put into pieces of real texts: (features but ``coverage``, label).

    Each of at most ``hosts`` texts, chosen by a hash, lends the words around and the words inside.
    """
    word = lambda k: F.regexp_replace(F.element_at("_words", (F.pmod(F.xxhash64("content", F.lit(k)), F.size("_words")) + 1).cast("int")), "[^A-Za-z]", "")
    lettered, place = articles.filter("content RLIKE '[A-Za-z]'").select("content"), F.xxhash64("content")
    # few enough by their hashes before any of them travels
    share = min(1.0, 4 * hosts / max(1, lettered.count()))
    few = lettered.filter(F.pmod(place, F.lit(1 << 40)) < int(share * (1 << 40))).dropDuplicates()
    own = (few.orderBy(place, "content").limit(hosts)
           .withColumn("_words", F.filter(F.split("content", r"\s+"), lambda w: w.rlike("[A-Za-z]"))))
    own = own.withColumns({"word": word(1), "word2": word(2), "word3": word(3),
                           "_at": (F.pmod(F.xxhash64("content", F.lit(4)), F.length("content")) + 1).cast("int")})
    kinds = [(1.0, *k) for k in PLANTED] + [(0.0, *k) for k in DECOYS]
    made = own.select("*", F.posexplode(F.array(*[F.struct(F.lit(label).alias("label"), F.lit(shown).alias("shown")) for label, _, shown in kinds])).alias("k", "kind"))
    made = made.withColumns({"hex": F.sha2(F.concat(F.col("k").cast("string"), "content"), 256), "number": F.pmod(F.xxhash64("content", "k"), F.lit(10_000))})
    made = made.withColumn("base", F.base64(F.unhex(F.concat("hex", F.sha2("hex", 256)))))
    made = made.withColumn("mixed", F.translate("base", "+/=", "4Qz"))
    secret = F.expr("CASE k " + " ".join(f"WHEN {n} THEN {finding}" for n, (_, finding, _) in enumerate(kinds)) + " END")
    made = made.withColumn("planted", secret)
    text = F.concat_ws(" ", F.expr("substr(content, greatest(1, _at - 80), least(80, _at - 1))"), F.expr("replace(kind.shown, '{}', planted)"), F.expr("substr(content, _at, 80)"))
    texts = made.select(F.struct("k", "planted", F.col("kind.label").alias("label")).alias("id"), text.alias("content"))
    return measured(candidates(texts)).filter("secret = id.planted").withColumn("label", F.col("id.label"))


def _letters(at: Column, text: Column) -> Column:
    return F.ascii(F.substring(text, at, F.lit(1))) - 97


def lexicon(texts: DataFrame, share: float) -> list[int]:
    """1 for each three-letter string (a-z) that makes up at least such a share of those in the words of all texts
    outside long runs; 17,576 numbers for any input."""
    outside = F.lower(F.regexp_replace("content", RUN, " "))
    word = (texts.select(F.explode(F.split(outside, "[^a-z]+")).alias("w")).filter("length(w) >= 3")
            .groupBy("w").agg(F.count("*").alias("n")))
    parts = word.select("n", F.explode(F.expr("transform(sequence(1, length(w) - 2), i -> substring(w, i, 3))")).alias("t"))
    t = F.col("t")
    number = (_letters(F.lit(1), t) * 676 + _letters(F.lit(2), t) * 26 + _letters(F.lit(3), t)).alias("at")
    counts = {r["at"]: r["n"] for r in parts.groupBy(number).agg(F.sum("n").alias("n")).collect()}
    least = share * sum(counts.values())
    return [int(i in counts and counts[i] >= least) for i in range(TRIGRAMS)]


def coverage(known: list[int]) -> Column:
    """Share of a candidate's three-character strings that the lexicon has."""
    table = F.lit(known)
    low = F.lower("secret")

    def has(i: Column) -> Column:
        a, b, c = (_letters(i + k, low) for k in range(3))
        inside = a.between(0, 25) & b.between(0, 25) & c.between(0, 25)
        return F.when(inside, F.element_at(table, F.greatest(F.lit(1), a * 676 + b * 26 + c + 1))).otherwise(0)

    n = F.length("secret") - 2
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), F.lit(0), lambda acc, i: acc + has(i)) / n).otherwise(0.0)


def find_secrets(articles: DataFrame, labelled: DataFrame | None = None, key: str = "id", text: str = "content",
                 forest: Forest = Forest()) -> DataFrame:
    """Candidates that the forest holds for secrets: (id, text_hash, place, secret, length, score), one row per finding.

    Candidates are long runs of letters, digits and ``+/_-`` in whole texts, whole JSON web tokens, and of any length
    what follows a name with a keyword and ``=``, ``:`` or ``is``, or is the password in a link. The forest looks at their length,
    kinds of characters and changes between them, the share covered by a dictionary, signs of a path, and
    the words before. ``labelled`` (id, secret, is_secret) are findings that people judged; at most ``forest.examples`` of
    each class are used. Without them, or without both classes, it learns from findings planted into pieces of the texts
    (``PLANTED``, ``DECOYS``), whose labels are known by construction. The dictionary counts the words of all texts, and all
    candidates are scored. A plain word after a keyword is held for prose.

    Null and empty texts have no findings. A secret that a text repeats is a finding each time; ``place`` counts the candidates
    of the text. Repeated rows have the same findings, rows of one id and other texts another ``text_hash``. Other columns are
    ignored; no rows give no rows.
    """
    texts = narrowed(articles, id=key, content=text)
    found = materialise(measured(candidates(texts)), "candidates")
    known = lexicon(texts, forest.known)
    order = F.xxhash64("secret", "lead", "place")
    used = [*FEATURES, "label", "secret"]
    train = None
    if labelled is not None:
        judged = labelled.groupBy("id", "secret").agg(F.max(F.col("is_secret").cast("double")).alias("label"))
        examples = found.join(judged, ["id", "secret"])
        picked = [examples.filter(F.col("label") == k).orderBy(order, "secret").limit(forest.examples) for k in (0, 1)]
        train = materialise(picked[0].unionByName(picked[1]).withColumn("coverage", coverage(known)).select(used), "labelled-findings")
    if train is None or train.select("label").distinct().count() < 2:
        more = planted(texts, forest.hosts).withColumn("coverage", coverage(known)).select(used)
        train = materialise(more if train is None else more.unionByName(train), "planted-findings")
    columns = ("id", "text_hash", "place", "secret", F.col("length").cast("int").alias("length"))
    scored = found.withColumn("coverage", coverage(known))
    if train.select("label").distinct().count() < 2:  # no text has a letter
        return scored.select(*columns, F.lit(0.0).alias("score")).limit(0)
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    model = RandomForestClassifier(featuresCol="_features", labelCol="label", probabilityCol="_chance", rawPredictionCol="_raw",
                                   predictionCol="_said", numTrees=forest.trees, maxDepth=forest.depth, seed=forest.seed
                                   ).fit(assemble.transform(train.orderBy(F.xxhash64(*used), "secret").coalesce(1)))
    score = F.element_at(vector_to_array("_chance"), 2)
    return model.transform(assemble.transform(scored)).select(*columns, score.alias("score")).filter(F.col("score") >= forest.threshold)


def redact(articles: DataFrame, found: DataFrame, key: str = "id", text: str = "content", mark: str = "[SECRET]") -> DataFrame:
    """The articles with every finding replaced by ``mark`` at its place and nowhere else; other columns and rows stay as
    they are. ``found`` are findings of these articles: a row takes those of its id and its own text."""
    places = found.groupBy("id", "text_hash").agg(F.collect_set("place").alias("places"))
    rows = articles.select(F.struct(*[F.col(f"`{c}`") for c in articles.columns]).alias("row"), F.col(f"`{key}`").alias("key"),
                           F.col(f"`{text}`").alias("content"))
    joined = rows.join(places, rows["key"].eqNullSafe(places["id"]) & (F.xxhash64(rows["content"]) == places["text_hash"]), "left")
    # by the same matches, in the same order, as they were found
    match, rest = _cut(F.col("content"), _pattern(F.col("content")))
    parts = F.zip_with(match, F.sequence(F.lit(1), F.size(match)), lambda m, i: F.when(
        F.array_contains("places", i), F.concat(_opening(m), F.lit(mark))).otherwise(m))
    clean = F.array_join(F.flatten(F.zip_with(rest, parts, lambda r, p: F.array(r, F.coalesce(p, F.lit(""))))), "")
    changed = joined.withColumn("content", F.when(F.col("places").isNull(), F.col("content")).otherwise(clean))
    return changed.select(*[F.col("content").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in articles.columns])
