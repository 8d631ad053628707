"""Queries over articles, verdicts and reference data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom import constants as K
from tapeloom.functions import scores as C, text as X
from tapeloom.operators import news as N
from tapeloom.sources import market, news as feed, reference

from . import views as V
from .core import query
from .views import with_views


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_of(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {sql_list([w])})" for w in words) + ")"


def first_of(col: str, words) -> str:
    return "CASE " + " ".join(f"WHEN contains({col}, {sql_list([w])}) THEN {sql_list([w])}" for w in words) + " END"


def exact(x: str, digits: int) -> str:
    return f"CAST(format('{{:.{digits}f}}', {x}) AS DOUBLE)"


ANCHOR = f"""coalesce(list_filter(list_transform(regexp_extract_all(headline, '{K.SHARES_OF_PATTERN.replace("'", "''")}', 1), lambda p: trim(p)),
    lambda p: p <> '' AND NOT list_contains([{sql_list(K.MARKET_WIDE_OPENERS)}], lower(p)))[1],
    nullif(regexp_extract(headline, '{K.COMPANY_NAME_PATTERN.replace("'", "''")}', 1), ''))"""
RELEVANT = r"""SELECT * FROM (SELECT *, lower(ticker) AS lt, lower(anchor) AS la, lower(headline || ' ' || summary) AS body FROM anchored)
    WHERE num_symbols < 3 OR anchor IS NULL OR regexp_matches(body, '\b' || lt || '\b') OR contains(la, lt) OR contains(lt, la)"""
TOKENS = """SELECT id, field, text, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM texts"""
LEX = """SELECT id, field, s / sqrt(s * s + 15) AS compound, pos_words, neg_words,
    CASE WHEN pos_words + neg_words > 0 THEN (pos_words - neg_words) / (pos_words + neg_words) ELSE 0 END AS polarity
    FROM (SELECT id, field, coalesce(sum(valence), 0) AS s, count(*) FILTER (is_pos) AS pos_words, count(*) FILTER (is_neg) AS neg_words
    FROM tokens LEFT JOIN lexicon USING (word) GROUP BY id, field)"""
TEXTS = """SELECT id, 'headline' AS field, headline AS text FROM news_once UNION ALL
    SELECT id, 'summary', CASE WHEN trim(summary) = '' THEN headline ELSE summary END FROM news_once"""
FLAGGED = f"""SELECT t.id, t.field, t.text, compound, pos_words, neg_words, {first_of('lower(text)', K.RED_FLAG_PHRASES)} AS red_flag
    FROM texts t JOIN lex USING (id, field)"""
PROBS = f"""SELECT *, {exact('CASE WHEN red_flag IS NOT NULL THEN 1e0 ELSE 1 - (compound + 1) / 2 END', 4)} AS neg,
    {exact('CASE WHEN red_flag IS NULL AND pos_words >= 2 AND neg_words = 0 THEN least(1e0, (compound + 1) / 2 + 0.05e0) ELSE (compound + 1) / 2 END', 4)} AS pos
    FROM flagged"""
SCORED = f"""SELECT id, field, red_flag, CASE WHEN blank THEN 0.5e0 ELSE neg END AS p_negative, CASE WHEN blank THEN 0.5e0 ELSE pos END AS p_positive,
    CASE WHEN blank THEN 1e0 ELSE neu END AS p_neutral, CASE WHEN blank THEN 'neutral' WHEN neg >= 0.5 AND neg >= pos THEN 'negative'
    WHEN pos >= 0.5 THEN 'positive' ELSE 'neutral' END AS label, CASE WHEN blank THEN 0e0 ELSE greatest(neg, pos, neu) END AS confidence
    FROM (SELECT *, trim(text) = '' AS blank, {exact('greatest(0e0, 1 - greatest(neg, pos))', 4)} AS neu FROM probs)"""
GATE = """SELECT id, max(p_negative) AS worst_negative, min(p_positive) AS worst_positive,
    coalesce(max(red_flag) FILTER (field = 'headline'), max(red_flag) FILTER (field = 'summary')) AS red_flag,
    max(p_negative) < 0.30 AND min(p_positive) > 0.65 AS sentiment_ok FROM scored GROUP BY id"""
TRUTH = """CASE json_type(raw_json, '$.is_stale_or_secondhand') WHEN 'BOOLEAN' THEN json_extract_string(raw_json, '$.is_stale_or_secondhand') = 'true'
    WHEN 'VARCHAR' THEN json_extract_string(raw_json, '$.is_stale_or_secondhand') <> '' ELSE false END"""
TRUTH_FDA = TRUTH.replace("raw_json", "fda_json").replace("is_stale_or_secondhand", "is_explicit_approval")
VERDICTS = f"""SELECT id, CASE WHEN ok THEN catalyst END AS catalyst, CASE WHEN ok THEN confidence END AS confidence,
    CASE WHEN ok THEN reasoning END AS reasoning, ok AND secondhand AS is_secondhand, fda_ok AND approval AS is_approval,
    CASE WHEN fda_ok THEN fda_confidence END AS fda_confidence, ok, fda_ok FROM (
    SELECT *, coalesce(catalyst IN ('positive', 'negative', 'neutral') AND confidence IN ('high', 'medium', 'low'), false) AS ok,
    coalesce(fda_confidence IN ('high', 'medium', 'low'), false) AS fda_ok FROM (
    SELECT id, lower(trim(json_extract_string(j, '$.catalyst'))) AS catalyst, lower(trim(json_extract_string(j, '$.confidence'))) AS confidence,
    trim(json_extract_string(j, '$.reasoning')) AS reasoning, coalesce(j IS NOT NULL AND secondhand, false) AS secondhand,
    lower(trim(json_extract_string(fda_json, '$.confidence'))) AS fda_confidence, coalesce({TRUTH_FDA}, false) AS approval
    FROM (SELECT id, fda_json, CASE WHEN json_valid(raw_json) THEN raw_json END AS j,
          CASE WHEN json_valid(raw_json) THEN {TRUTH} END AS secondhand FROM verdicts_raw)))"""
DECIDED = f"""SELECT n.id, n.ticker, n.created_at, n.headline, n.summary, n.num_symbols, v.catalyst, v.confidence, v.reasoning,
    CASE WHEN NOT {any_of("low", K.FDA_EXCLUDE_PHRASES)} AND {any_of("low", K.FDA_APPROVAL_PHRASES)} AND coalesce(v.is_approval, false)
      AND v.fda_confidence <> 'low' THEN 'FDA_APPROVAL_FASTPATH'
    WHEN {any_of("lower(headline)", K.STALE_RECAP_PHRASES)} THEN 'DROP_STALE_RECAP' WHEN coalesce(NOT v.ok, true) THEN 'DROP_NO_VERDICT'
    WHEN v.is_secondhand THEN 'DROP_SECONDHAND' WHEN v.catalyst <> 'positive' THEN 'DROP_NOT_POSITIVE'
    WHEN v.confidence = 'high' THEN 'PASS_HIGH_CONFIDENCE' WHEN coalesce(g.sentiment_ok, false) THEN 'PASS_BOTH_TIERS'
    ELSE 'DROP_SENTIMENT' END AS decision
    FROM (SELECT *, lower(headline || ' ' || summary) AS low FROM {{source}}) n LEFT JOIN verdicts v USING (id) LEFT JOIN gate g USING (id)"""
TONE = {"texts": TEXTS, "tokens": TOKENS, "lex": LEX, "flagged": FLAGGED, "probs": PROBS, "scored": SCORED, "gate": GATE}
WATCH = "SELECT DISTINCT 'T' || (user_id % 5) AS ticker FROM events WHERE event_type = 'signup'"
CATEGORY = "CASE " + " ".join(f"WHEN {any_of('body', words)} THEN '{name}'" for name, _, words in K.NEWS_CATEGORY_TIERS) + " ELSE 'uncategorized' END"
CATEGORY_SCORE = "CASE category " + " ".join(f"WHEN '{name}' THEN {score}e0" for name, score, _ in K.NEWS_CATEGORY_TIERS) + " ELSE 0.3e0 END"
LINKS = r"""SELECT page_id, list_transform(regexp_extract_all(replace('<a href="' || url || '">' || html, '&', '&&'),
    '[?&](?:ref|utm_source|page)=([A-Za-z][A-Za-z\.\-]{0,5})[&"'']', 1), lambda t: upper(t)) AS found FROM pages"""
LINK_PARAM = "ref|utm_source|page"


def watchlist(spark, sf):
    return V.fundamentals_snapshots(spark, sf).select("ticker").distinct()


def tagged(spark, sf):
    n = V.news_once(spark, sf)
    return n.withColumn("num_symbols", F.size("symbols").cast("bigint")).withColumn("ticker", F.explode("symbols"))


def pages(spark, sf):
    link = F.concat(F.lit('<a href="'), "url", F.lit('">'), "html")
    return V.table(spark, sf, "pages").select("page_id", link.alias("html"))


# ---------------------------------------------------------------- sources

@query("src_screener_tickers", f"""SELECT ticker, first_page, pos AS first_pos FROM (SELECT t.ticker, page_id AS first_page, t.pos, row_number() OVER (
    PARTITION BY t.ticker ORDER BY page_id, t.pos) AS rn FROM ({LINKS}) l, LATERAL (SELECT unnest(found) AS ticker, unnest(range(len(found))) AS pos) t) WHERE rn = 1""")
def src_screener_tickers(spark, sf):
    out = reference.tickers_from_pages(pages(spark, sf), LINK_PARAM)
    return out.withColumn("first_pos", F.col("first_pos").cast("bigint"))


@query("src_screener_page_check", f"SELECT page_id, len(list_distinct(found)) AS tickers, len(found) = 0 AS is_empty FROM ({LINKS})")
def src_screener_page_check(spark, sf):
    out = reference.tickers_per_page(pages(spark, sf), LINK_PARAM)
    return out.withColumn("tickers", F.col("tickers").cast("bigint"))


@query("agg_distinct_tickers", with_views("news_once", """SELECT ticker, min(id) AS first_id FROM (SELECT unnest(symbols) AS ticker, id
    FROM news_once) GROUP BY ticker"""))
def agg_distinct_tickers(spark, sf):
    n = V.news_once(spark, sf).select("id", F.explode("symbols").alias("ticker"))
    return n.groupBy("ticker").agg(F.min("id").alias("first_id"))


@query("src_fundamentals", with_views("share_counts", """SELECT ticker, float_shares, CAST(replace(short_float, '%', '') AS DOUBLE) AS short_float_pct,
    CAST(short_ratio AS DOUBLE) AS days_to_cover, CAST(left(avg_volume, -1) AS DOUBLE) * 1000 AS avg_volume FROM share_counts"""),
       doubles="float_shares short_float_pct days_to_cover avg_volume")
def src_fundamentals(spark, sf):
    return reference.parse_fundamentals(V.fundamentals_text(spark, sf)).drop("market_cap")


@query("flt_watchlist_screen", with_views("share_counts", """SELECT ticker FROM share_counts WHERE float_shares < 10000000 AND market_cap < 300000000
    AND CAST(left(avg_volume, -1) AS DOUBLE) * 1000 > 92000 ORDER BY ticker"""))
def flt_watchlist_screen(spark, sf):
    from tapeloom.config import Screen
    return reference.watchlist_screen(reference.parse_fundamentals(V.fundamentals_text(spark, sf)),
                                      Screen(min_avg_volume=92_000.0)).select("ticker").orderBy("ticker")


@query("src_news_history", with_views("quotes adv news_once", """SELECT id, ticker, created_at FROM (SELECT id, unnest(symbols) AS ticker, created_at FROM news_once
    WHERE created_at BETWEEN TIMESTAMP '2024-01-25' - INTERVAL 18 DAY AND TIMESTAMP '2024-01-25')
    WHERE ticker IN (SELECT ticker FROM quotes WHERE last > previous_close)"""), stamps="created_at")
def src_news_history(spark, sf):
    risers = V.quotes(spark, sf).filter(F.col("last") > F.col("previous_close"))
    return feed.history(V.news_once(spark, sf), risers, "2024-01-25").select("id", "ticker", "created_at")


RECONCILED = "SELECT id, min(created_at) AS created_at, min_by(headline, created_at) AS headline FROM news GROUP BY id"


@query("src_news_reconcile", with_views("news", "SELECT id, created_at, md5(headline) AS headline_md5 FROM r", r=RECONCILED), stamps="created_at")
def src_news_reconcile(spark, sf):
    out = feed.reconcile(V.news_once(spark, sf), V.backfill(spark, sf))
    return out.select("id", "created_at", F.md5(F.encode("headline", "UTF-8")).alias("headline_md5"))


@query("set_union_feeds", with_views("news", "SELECT id, created_at FROM r", r=RECONCILED), stamps="created_at")
def set_union_feeds(spark, sf):
    return feed.first_of_each(V.news(spark, sf)).select("id", "created_at")


@query("join_news_watchlist", with_views("news_tickers", "SELECT id, ticker, num_symbols FROM news_tickers WHERE ticker IN (SELECT ticker FROM w)",
                                         w=WATCH))
def join_news_watchlist(spark, sf):
    out = N.tag_watchlist(V.news_once(spark, sf), watchlist(spark, sf))
    return out.select("id", "ticker", F.col("num_symbols").cast("bigint").alias("num_symbols"))


@query("anti_scored_articles", with_views("news_once", "SELECT id, created_at FROM news_once WHERE id NOT IN (SELECT doc_id FROM labels)"),
       stamps="created_at")
def anti_scored_articles(spark, sf):
    scored = V.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return V.news_once(spark, sf).join(scored, "id", "left_anti").select("id", "created_at")


# ---------------------------------------------------------------- text

@query("flt_stale_recap", with_views("news_once", f"SELECT id FROM news_once WHERE {any_of('lower(headline)', K.STALE_RECAP_PHRASES)}"))
def flt_stale_recap(spark, sf):
    return V.news_once(spark, sf).filter(X.is_stale_recap(F.col("headline"))).select("id")


@query("flt_fda_candidate", with_views("news_once", f"""SELECT id FROM (SELECT id, lower(headline || ' ' || summary) AS t FROM news_once)
    WHERE NOT {any_of('t', K.FDA_EXCLUDE_PHRASES)} AND {any_of('t', K.FDA_APPROVAL_PHRASES)}"""))
def flt_fda_candidate(spark, sf):
    return V.news_once(spark, sf).filter(X.is_fda_candidate(F.concat_ws(" ", "headline", "summary"))).select("id")


@query("prj_red_flag", with_views("news_once", f"SELECT id, {first_of('t', K.RED_FLAG_PHRASES)} AS red_flag FROM (SELECT id, lower(headline || ' ' || summary) AS t FROM news_once)"))
def prj_red_flag(spark, sf):
    return V.news_once(spark, sf).select("id", X.red_flag(F.concat_ws(" ", "headline", "summary")).alias("red_flag"))


@query("score_lexicon", with_views("news_once lexicon", "SELECT id, field, compound, pos_words, neg_words, polarity FROM lex", **TONE),
       doubles="compound polarity")
def score_lexicon(spark, sf):
    n = V.news_once(spark, sf)
    summary = F.when(X.is_blank(F.col("summary")), F.col("headline")).otherwise(F.col("summary"))
    texts = n.select("id", F.lit("headline").alias("field"), F.col("headline").alias("text")).unionByName(
        n.select("id", F.lit("summary").alias("field"), summary.alias("text")))
    return N.lexicon_scores(texts, V.lexicon(spark), ("id", "field"))


@query("prj_text_score", with_views("news_once lexicon", "SELECT * FROM scored", **TONE), doubles="p_negative p_positive p_neutral confidence")
def prj_text_score(spark, sf):
    return N.text_scores(V.news_once(spark, sf), V.lexicon(spark))


@query("flt_sentiment_gate", with_views("news_once lexicon", "SELECT * FROM gate", **TONE), doubles="worst_negative worst_positive")
def flt_sentiment_gate(spark, sf):
    return N.sentiment_gate(V.news_once(spark, sf), V.lexicon(spark))


@query("prj_company_anchor", with_views("news_once", f"SELECT id, {ANCHOR} AS anchor FROM news_once"))
def prj_company_anchor(spark, sf):
    return V.news_once(spark, sf).select("id", X.company_anchor(F.col("headline")).alias("anchor"))


ANCHORED = f"SELECT *, {ANCHOR} AS anchor FROM news_tickers"


@query("flt_ticker_relevance", with_views("news_tickers", "SELECT id, ticker, num_symbols FROM relevant", anchored=ANCHORED, relevant=RELEVANT))
def flt_ticker_relevance(spark, sf):
    return N.relevant(tagged(spark, sf)).select("id", "ticker", "num_symbols")


@query("prj_news_normalize", r"""SELECT id, headline, md5(full_text) AS summary_md5, length(full_text) AS summary_chars FROM (
    SELECT page_id AS id, replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'),
      '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS headline,
    trim(url || chr(10) || chr(10) || trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS full_text FROM pages)""")
def prj_news_normalize(spark, sf):
    p = V.table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("headline"),
        F.col("url").alias("summary"), F.col("html").alias("content"), F.lit(None).cast("timestamp").alias("created_at"))
    n = N.normalise(p)
    return n.select("id", "headline", F.md5(F.encode("summary", "UTF-8")).alias("summary_md5"),
                    F.char_length("summary").cast("bigint").alias("summary_chars"))


@query("prj_verdict_parse", with_views("verdicts_raw", """SELECT id, ok, catalyst, confidence, reasoning, is_secondhand, fda_ok, is_approval, fda_confidence
    FROM verdicts""", verdicts=VERDICTS))
def prj_verdict_parse(spark, sf):
    v = N.parse_verdicts(V.verdicts_raw(spark, sf))
    return v.select("id", F.col("verdict").isNotNull().alias("ok"), "verdict.catalyst", "verdict.confidence", "verdict.reasoning",
                    F.coalesce("verdict.is_secondhand", F.lit(False)).alias("is_secondhand"), F.col("fda").isNotNull().alias("fda_ok"),
                    F.coalesce("fda.is_approval", F.lit(False)).alias("is_approval"), F.col("fda.confidence").alias("fda_confidence"))


@query("join_verdicts", with_views("news_once verdicts_raw", """SELECT id, coalesce(catalyst, 'none') AS catalyst,
    coalesce(catalyst = 'positive' AND NOT is_secondhand, false) AS is_bullish FROM news_once LEFT JOIN verdicts USING (id)""", verdicts=VERDICTS))
def join_verdicts(spark, sf):
    out = V.news_once(spark, sf).join(N.parse_verdicts(V.verdicts_raw(spark, sf)), "id", "left")
    bullish = (F.col("verdict.catalyst") == "positive") & ~F.col("verdict.is_secondhand")
    return out.select("id", F.coalesce("verdict.catalyst", F.lit("none")).alias("catalyst"),
                      F.coalesce(bullish, F.lit(False)).alias("is_bullish"))


def decided(spark, sf, check_recycled=False):
    return N.decide(tagged(spark, sf), N.parse_verdicts(V.verdicts_raw(spark, sf)),
                    N.sentiment_gate(V.news_once(spark, sf), V.lexicon(spark)), check_recycled=check_recycled)


@query("flt_verdict_gate", with_views("news_tickers lexicon verdicts_raw", "SELECT id, ticker, decision FROM decided",
                                      **TONE, verdicts=VERDICTS, decided=DECIDED.format(source="news_tickers")))
def flt_verdict_gate(spark, sf):
    return decided(spark, sf).select("id", "ticker", "decision")


@query("win_recycled_headline")
def win_recycled_headline(spark, sf):
    return N.recycled_headlines(tagged(spark, sf))


@query("score_verdict", with_views("news_once verdicts_raw", r"""SELECT id, 0.7e0 * CASE confidence WHEN 'high' THEN 1e0 WHEN 'medium' THEN 0.6e0 ELSE 0.3e0 END
    + 0.3e0 * least(len(list_filter(regexp_split_to_array(summary, '\s+'), lambda w: w <> '')) / 40e0, 1e0) AS verdict_score
    FROM news_once LEFT JOIN verdicts USING (id)""", verdicts=VERDICTS), doubles="verdict_score")
def score_verdict(spark, sf):
    out = V.news_once(spark, sf).join(N.parse_verdicts(V.verdicts_raw(spark, sf)), "id", "left")
    return out.select("id", C.verdict_score(F.col("verdict.confidence"), F.col("summary")).alias("verdict_score"))


@query("score_news_category", with_views("news_once", f"""SELECT id, category, {CATEGORY_SCORE} AS score FROM (SELECT id, {CATEGORY} AS category
    FROM (SELECT id, lower(headline || ' ' || summary) AS body FROM news_once))"""), doubles="score")
def score_news_category(spark, sf):
    return V.news_once(spark, sf).select("id", F.inline(F.array(C.news_category(F.col("headline"), F.col("summary")))))


@query("score_float", with_views("share_counts", """SELECT ticker, CASE WHEN float_shares > 0 THEN greatest(0e0, least(1e0, 1 - float_shares / 1e7))
    ELSE 0.5e0 END AS float_score FROM share_counts"""), doubles="float_score")
def score_float(spark, sf):
    f = reference.parse_fundamentals(V.fundamentals_text(spark, sf))
    return f.select("ticker", C.float_score(F.col("float_shares")).alias("float_score"))


# ---------------------------------------------------------------- quote payloads and account data

PAYLOADS = """SELECT event_id, 'T' || (user_id % 5) AS ticker, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events"""


def payloads(spark, sf):
    e = V.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    blank = F.col("event_type") == "error"
    quote = F.struct(
        F.when(~blank, F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value"))).alias("lastPrice"),
        F.when(~blank & (k >= 50), F.col("value") + 1).alias("mark"), F.when(~blank, F.col("value") / 2).alias("closePrice"),
        F.when(~blank, F.col("value") - 1).alias("bidPrice"), F.when(~blank, F.col("value") + 1).alias("askPrice"),
        F.when(~blank, k).alias("totalVolume"), F.when(~blank, "Normal").alias("securityStatus"))
    fundamental = F.struct(k.alias("avg10DaysVolume"), F.when(F.col("event_type") != "signup", F.col("value")).alias("avg1YearVolume"))
    ticker = F.concat(F.lit("T"), F.col("user_id") % 5)
    node = F.create_map(ticker, F.struct(quote.alias("quote"), fundamental.alias("fundamental")))
    return e.select("event_id", ticker.alias("ticker"), F.to_json(node).alias("payload"))


LAST = "CASE WHEN event_type NOT IN ('error', 'view') AND value <> 0 THEN value WHEN event_type <> 'error' AND k >= 50 THEN value + 1 WHEN event_type <> 'error' THEN value / 2 END"


@query("src_quote_flatten", f"""SELECT event_id, ticker, {LAST} AS last, CASE WHEN event_type <> 'error' THEN value - 1 END AS bid,
    CASE WHEN event_type <> 'error' THEN k END AS total_volume, CASE WHEN event_type <> 'error' THEN value / 2 END AS previous_close
    FROM ({PAYLOADS})""", doubles="last bid total_volume previous_close")
def src_quote_flatten(spark, sf):
    return market.quote_of(payloads(spark, sf), F.col("ticker")).select(
        "event_id", "ticker", "last", "bid", "total_volume", "previous_close")


@query("src_quotes_batch", f"SELECT event_id, ticker, {LAST} AS last, value + 1 AS ask FROM ({PAYLOADS}) WHERE event_type <> 'error'", doubles="last ask")
def src_quotes_batch(spark, sf):
    return market.quotes_of(payloads(spark, sf).drop("ticker")).select("event_id", "ticker", "last", "ask")


@query("src_adv", f"""SELECT * FROM (SELECT event_id, ticker, coalesce(nullif(k, 0), CASE WHEN event_type <> 'signup' THEN nullif(value, 0) END) AS adv
    FROM ({PAYLOADS})) WHERE adv IS NOT NULL""", doubles="adv")
def src_adv(spark, sf):
    return market.volume_averages(payloads(spark, sf).drop("ticker"))


@query("src_bars", """SELECT l_partkey AS ticker, l_shipdate AS ts, l_extendedprice AS close, l_quantity AS volume FROM lineitem
    WHERE l_tax <> 0 AND l_shipdate BETWEEN TIMESTAMP '1999-01-01' - INTERVAL 365 DAY AND TIMESTAMP '1999-01-01'""", stamps="ts", doubles="close volume")
def src_bars(spark, sf):
    raw = V.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("ticker"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("datetime"),
        *[F.col("l_extendedprice").alias(c) for c in ("open", "high", "low", "close")],
        F.when(F.col("l_tax") != 0, F.col("l_quantity")).alias("volume"))
    return market.bars_from_candles(raw, "1999-01-01", 365 * V.DAY).select("ticker", "ts", "close", "volume")


@query("src_buying_power", """SELECT c_name AS account, coalesce(b, cash, z) AS buying_power,
    CASE WHEN b IS NOT NULL THEN 'buyingPower' WHEN cash IS NOT NULL THEN 'cashAvailableForWithdrawal' WHEN z IS NOT NULL THEN 'cashBalance' END AS field,
    coalesce(b IS NULL AND cash IS NOT NULL, false) AS is_expected,
    CASE WHEN b IS NULL AND cash IS NULL AND z IS NULL THEN 'MISSING' WHEN b IS NOT NULL OR cash IS NULL THEN 'UNEXPECTED_FIELD'
         WHEN cash <= 0 THEN 'NOT_POSITIVE' END AS problem,
    CASE WHEN b IS NULL AND cash > 0 THEN cash / 10 END AS per_slot
    FROM (SELECT c_name, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS b, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal * 2 END AS cash,
    CASE WHEN c_custkey % 5 <> 0 THEN 0e0 END AS z FROM customer)""", doubles="buying_power per_slot")
def src_buying_power(spark, sf):
    return reference.buying_power(V.balances(spark, sf))


# ---------------------------------------------------------------- sets and monitoring

ACKED = "SELECT DISTINCT l_partkey AS ticker FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40"
SCREENED = "SELECT DISTINCT p_partkey AS ticker FROM part WHERE p_size < 30"


def acked(spark, sf):
    line = V.table(spark, sf, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))
    return line.select(F.col("l_partkey").alias("ticker")).distinct()


def screened(spark, sf):
    return V.table(spark, sf, "part").filter(F.col("p_size") < 30).select(F.col("p_partkey").alias("ticker"))


@query("set_unconfirmed", f"SELECT ticker FROM ({SCREENED}) WHERE ticker NOT IN (SELECT ticker FROM ({ACKED}))")
def set_unconfirmed(spark, sf):
    from tapeloom.operators.monitor import unconfirmed
    return unconfirmed(screened(spark, sf), acked(spark, sf))


@query("set_ack_union", f"SELECT ticker FROM ({ACKED}) UNION SELECT ticker FROM ({SCREENED})")
def set_ack_union(spark, sf):
    from tapeloom.operators.monitor import acknowledged
    return acknowledged([acked(spark, sf), screened(spark, sf)])


@query("agg_monitor_snapshot", with_views("news_once holdings", f"""SELECT (SELECT count(*) FROM w) AS watchlist, (SELECT count(*) FROM a) AS acked,
    (SELECT count(*) FROM m) AS unconfirmed, (SELECT string_agg(ticker, ',' ORDER BY ticker) FROM (SELECT CAST(ticker AS VARCHAR) AS ticker FROM m ORDER BY 1 LIMIT 5)) AS first_unconfirmed,
    (SELECT count(*) FROM holdings WHERE entry_time <= TIMESTAMP '2024-01-20' AND exit_time > TIMESTAMP '2024-01-20') AS open_positions,
    epoch(TIMESTAMP '2024-01-20') - epoch((SELECT max(created_at) FROM news_once WHERE created_at <= TIMESTAMP '2024-01-20')) AS seconds_since_news,
    (SELECT count(*) FROM holdings WHERE entry_time <= TIMESTAMP '2024-01-20' AND exit_time > TIMESTAMP '2024-01-20') > 0 AS is_paused""",
                                          w=SCREENED, a=ACKED, m="SELECT ticker FROM w WHERE ticker NOT IN (SELECT ticker FROM a)"), doubles="seconds_since_news")
def agg_monitor_snapshot(spark, sf):
    from tapeloom.operators.monitor import snapshot
    return snapshot(screened(spark, sf), acked(spark, sf), V.holdings(spark, sf), V.news_once(spark, sf), "2024-01-20")


@query("sort_candidates", with_views("bars_wild", """SELECT DISTINCT ticker FROM bars_wild ORDER BY ticker LIMIT 100"""))
def sort_candidates(spark, sf):
    from tapeloom.operators.monitor import seed_batch
    return seed_batch(V.bars_wild(spark, sf))
