"""Word lists and patterns.

Everything in this file is a fixed value: results only agree with the specified semantics when
these phrases, tier scores and patterns are exactly these, in this order.
"""

# --- fixed values: news category tiers (name, score, phrases), best tier first ---
NEWS_CATEGORY_TIERS = (
    ("regulatory_approval", 1.0, (
        "fda approval", "fda approves", "ema approval", "ce mark", "regulatory approval",
        "granted approval", "marketing authorization",
    )),
    ("ma_acquisition", 0.9, (
        "to be acquired", "acquisition of", "merger agreement", "buyout", "tender offer",
        "definitive merger", "agrees to acquire", "to acquire",
    )),
    ("major_financing_contract", 0.7, (
        "multi-year contract", "definitive agreement", "strategic partnership", "million contract",
        "billion contract", "supply agreement", "licensing agreement", "government contract",
    )),
    ("uplisting_squeeze_setup", 0.6, (
        "uplist", "nasdaq listing", "short squeeze", "reverse stock split",
    )),
    ("earnings_guidance", 0.4, (
        "beats estimates", "raises guidance", "record revenue", "raises full-year", "tops estimates",
        "beats revenue estimates",
    )),
)
NEWS_CATEGORY_BASELINE = ("uncategorized", 0.3)

# --- fixed values: headlines that only retell a move that already happened ---
STALE_RECAP_PHRASES = (
    "why shares of", "why is", "why are shares", "here's why", "here's what's driving",
    "shares surge:", "shares soar:", "shares jump:", "shares are up today", "shares are down today",
    "stocks moving today", "stocks that moved", "explained:", "stocks that have gone up",
    "stocks that have gone down", "stocks to watch today", "stocks in focus", "roundup:",
    "here's what's behind",
)

# --- fixed values: drug approval phrases, and phrases that rule an approval out ---
FDA_APPROVAL_PHRASES = (
    "fda approval", "fda approves", "receives fda approval", "granted fda approval",
    "approved by the fda", "fda grants approval", "nda approved", "new drug application approved",
    "bla approved", "biologics license application approved", "fda clearance",
    "accelerated approval",
)
FDA_EXCLUDE_PHRASES = (
    "breakthrough therapy designation", "fast track designation", "orphan drug designation",
    "priority review", "pdufa date", "seeking approval", "expects approval", "up for approval",
    "fda to review",
)

# --- fixed values: hard-negative phrases, first match in this order is reported ---
RED_FLAG_PHRASES = (
    "bankruptcy", "chapter 11", "chapter 7 filing", "going concern", "delisting", "delisted",
    "deficiency notice", "restatement", "restates", "material weakness", "materially misstated",
    "fraud", "sec subpoena", "sec investigation", "sec charges", "class action lawsuit",
    "insolvency", "insolvent", "liquidation", "receivership", "covenant breach", "debt default",
    "defaults on", "auditor resignation", "resignation of auditor", "non-reliance", "clawback",
    "trading halt pending news", "cease trading", "dilutive offering", "going private",
)

# --- fixed values: phrases before "shares" that name the market, not a company ---
MARKET_WIDE_OPENERS = (
    "nasdaq", "dow", "s&p", "s&p 500", "russell", "market", "markets", "stocks", "wall street",
    "futures",
)

# --- fixed values: patterns that find the company a headline is about ---
SHARES_OF_PATTERN = r"([A-Z][A-Za-z0-9&'.\-]*(?:\s+[A-Z][A-Za-z0-9&'.\-]*){0,5})\s+[Ss]hares\b"
COMPANY_NAME_PATTERN = r"\b([A-Z][A-Za-z&'.\-]*(?:\s+[A-Z][A-Za-z&'.\-]*){0,4}\s+(?:Inc|Incorporated|Corp|Corporation|Co|Company|Ltd|Limited|Holdings?|Group|Technologies|Pharmaceuticals|Therapeutics|Biotechnology|Biotech|Solutions|International|Global|Industries|Systems)\.?)\b"

# --- fixed values: screener link pattern ({param} is the parameter's name), balance fields in lookup order, order states ---
TICKER_LINK_PATTERN = r"""[?&](?:{param})=([A-Za-z][A-Za-z\.\-]{0,5})(?=[&"'])"""
BALANCE_FIELDS = ("buyingPower", "cashAvailableForWithdrawal", "cashBalance")
EXPECTED_BALANCE_FIELD = "cashAvailableForWithdrawal"
TRADE_LOG_COLUMNS = ("event", "ticker", "time", "price", "value", "reason", "headline")

# --- fixed values: reason labels carried by signals and exits ---
REASON_FDA = "FDA_APPROVAL_FASTPATH"
REASON_NEWS = "SENTIMENT_AND_TICK_VOLUME_CONFIRMED"
REASON_BREAKOUT = "ROLLING_HIGH_BREAKOUT"
REASON_HALT = "HALT_REOPEN_CONFIRMED"
EVENT_ENTRY = "ENTRY"
EVENT_EXIT = "EXIT"
EVENT_ENTRY_UNFILLED = "ENTRY_ATTEMPT_UNFILLED"
EVENT_EXIT_UNFILLED = "EXIT_ATTEMPT_UNFILLED"
