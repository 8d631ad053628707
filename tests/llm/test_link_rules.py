import random
import re

from tapeloom.llm import link_rules as L
from tapeloom.llm.queries import SITES


def plain(url, sites, patterns):
    if url is None:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    host = low(host)
    fits = [r for r in sites if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.label))
        return host, path, best.label, best.verdict
    return host, path, None, "block" if any(re.search(p.regex, low(host + path)) for p in patterns) else "allow"


def links(spark, urls, sites=SITES, patterns=L.PATTERNS):
    df = spark.createDataFrame(list(enumerate(urls)), "page bigint, url string").selectExpr("*", "url AS verdict", "page AS token")
    return {r["page"]: tuple(r)[1:] for r in L.judge_links(df.drop("verdict").withColumnRenamed("token", "host"), sites, patterns).collect()}


def test_like_plain(spark):
    rng = random.Random(4)
    hosts = ["example.com", "WWW.Example.com", "a.b.www.example.com", "badexample.com", "x.net", "net", "casino-win.org", "casinos.org",
             "free-bets.org", "org", "com", "", "ads.track.org", "é.net:80", "u@example.com"]
    paths = ["", "/", "/en/", "/en", "/EN/1", "/es/2", "/fr/ads/3", "/de/ads-track", "/poker/x?y=/es/", "?q", "#/en/", "/xxx1/", "/my.pills.html"]
    urls = [f"{s}{h}{p}" for s in ("http://", "https://", "", "://", "a://b://") for h in hosts for p in paths] + [None, "", "x\ny://net/es/", "h://net/\nes/"]
    rng.shuffle(urls)
    urls += urls[:50]
    got = links(spark, urls)
    assert len(got) == len(urls)
    assert got == {i: plain(u, SITES, L.PATTERNS) for i, u in enumerate(urls)}


def test_wildcards_and_rules_without_literals(spark):
    patterns = (L.PatternRule("*ad*-*.gif"), L.PatternRule("track*/pixel/"), L.PatternRule("***"), L.PatternRule("-_"))
    assert [p.literals for p in patterns] == [["gif"], ["pixel"], [], []]
    urls = ["h://x.org/bad-1.gif", "h://x.org/track99/pixel/", "h://x.org/pixel/", "h://x.org/a-_b", None]
    for chosen in (patterns[:2], patterns[3:], patterns):
        assert links(spark, urls, (), chosen) == {i: plain(u, (), chosen) for i, u in enumerate(urls)}
    assert links(spark, urls, (), ()) == {i: plain(u, (), ()) for i, u in enumerate(urls)}
    assert links(spark, []) == {}
