"""Registered queries of the package: given tables to article records, results back to the table's names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.session import configure

from .alignment import align_articles
from .language_model import log_probabilities
from .lexical import TERM, best_articles
from .link_rules import PATTERNS, SiteRule, judge_links
from .main_text import extract_articles
from .mixing import mix
from .near_copies import near_copies
from .neighbours import nearest_vectors
from .pieces import decode_articles, encode_articles
from .quality_classifier import quality_scores
from .quality_rules import judge
from .records import remainder
from .secrets import find_secrets
from .toxicity import toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as articles; their source is the feed they came from."""
    return articles_of(spark.read.parquet(f"{sf}/documents.parquet"))


def articles_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"),
                            F.col("source").alias("feed"))


@query("op1_near_copies")
def _near_copies(spark: SparkSession, sf: str) -> DataFrame:
    return near_copies(articles(spark, sf)).select(
        F.col("id").alias("doc_id"), "fingerprint", F.col("story_id").alias("component_id"))


@query("op10_mixing")
def _mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix(articles(spark, sf)).select(F.col("id").alias("doc_id"), "size", F.col("feed_size").alias("source_size"),
                                           "target", "taken")


@query("op3_quality_rules")
def _quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return judge(articles(spark, sf)).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                             "n_repeat_words", "base_failed", "kept", "quality")


SITES = (SiteRule("allow", "com"), SiteRule("block", "example.com", "/en/"), SiteRule("allow", "www.example.com", "/en/"),
         SiteRule("block", "net", "/es/"), SiteRule("block", "net", "/fr/"))


def _links_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    sites = sorted(SITES, key=lambda r: -len(r.label))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.label}'" for r in sites)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in sites)
    spam = " OR ".join(
        "regexp_matches(w, '{}')".format("(^|[^0-9a-z])" * p.pattern[0].isalnum() + ".*".join(p.pattern.split("*"))
                                         + "([^0-9a-z]|$)" * p.pattern[-1].isalnum()) for p in PATTERNS)
    return f"""
    WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    c AS (SELECT *, translate(host || path, '{upper}', '{lower}') AS w FROM b)
    SELECT page_id, host, path, CASE {rule} END AS rule,
        CASE {verdict} WHEN {spam} THEN 'block' ELSE 'allow' END AS verdict FROM c"""


@query("op5_link_rules", _links_sql())
def _link_rules(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("page"), "url")
    return judge_links(pages, SITES).withColumnRenamed("page", "page_id")


def labels(spark: SparkSession, sf: str, label: str, but: tuple[int, int]) -> DataFrame:
    """Labels to learn from: those whose id, hashed modulo but[0], does not leave but[1]."""
    every = spark.read.parquet(f"{sf}/labels.parquet")
    return every.filter(remainder("doc_id", but[0]) != but[1]).select(F.col("doc_id").alias("id"), label)


def held_out(scored: DataFrame, of: int, rest: int, threshold: float, *more: str) -> DataFrame:
    return scored.select(F.col("id").alias("doc_id"), (remainder("id", of) == rest).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


@query("op8_quality_classifier")
def _quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return held_out(quality_scores(articles(spark, sf), labels(spark, sf, "quality", (5, 0))), 5, 0, 0.3)


@query("op7_pieces")
def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    both = decode_articles(encode_articles(articles(spark, sf)))
    return both.select(F.col("id").alias("doc_id"), F.size("pieces").cast("bigint").alias("n_pieces"),
                       F.xxhash64("pieces").alias("pieces_hash"), F.slice("pieces", 1, 8).alias("first_pieces"),
                       F.col("decoded").eqNullSafe(F.col("content")).alias("lossless"))


@query("op2_toxicity")
def _toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return held_out(toxicity(articles(spark, sf), labels(spark, sf, "toxic", (3, 1))), 3, 1, 0.7, "evidence")


@query("op9_secrets")
def _secrets(spark: SparkSession, sf: str) -> DataFrame:
    return find_secrets(articles(spark, sf)).select(
        F.col("id").alias("doc_id"), "place", F.sha2("secret", 256).alias("secret_sha256"), "length", F.round("score", 6).alias("score"))


@query("op4_language_model")
def _language_model(spark: SparkSession, sf: str) -> DataFrame:
    train = remainder("id", 7) != 2
    return log_probabilities(articles(spark, sf), train).select(
        F.col("id").alias("doc_id"), (remainder("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op6_neighbours")
def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest_vectors(items, F.col("id") % 20 == 0).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def _search_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = lambda text: f"regexp_extract_all(translate({text}, '{upper}', '{lower}'), '{TERM}')"
    return f"""
    WITH found AS (SELECT doc_id, unnest({terms("text")}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY ALL),
    docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
    totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
    weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
        FROM tf, totals GROUP BY term),
    asked AS (SELECT DISTINCT item_id, unnest({terms("text")}) AS term FROM benchmark),
    scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
        FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN docs USING (doc_id), totals GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scores WHERE score > 0 QUALIFY rank <= 50"""


@query("op11_search", _search_sql())
def _search(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("id"), F.col("text").alias("headline"))
    return best_articles(articles(spark, sf), items).select(F.col("search").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


@query("op12_alignment")
def _alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align_articles(articles(spark, sf)).withColumnRenamed("id", "doc_id")


@query("op13_main_text")
def _main_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("id"), "url", F.col("html").alias("content"))
    return extract_articles(pages).withColumnRenamed("id", "page_id")
