import html
import random

import pytest

from tapeloom.llm import main_text as M

LONG = "The company said on Monday that its second trial, which began in May, met the main goal, and that a filing follows."
MORE = "Analysts, who had asked for such data, called the outcome clear, though the sample was small, and the price rose."


def page(body, head="<title>Other title</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>Markets</a></li></ul></nav>"
FOOT = "<footer>&copy; 2024 Some Site, all rights reserved, imprint, terms</footer>"

CASES = {
    "article": (page(f"{NAV}<div class='ad'>Buy now, cheap, today only, and more.</div><article><h1>Head</h1><p>{LONG}</p><p>{MORE}</p></article>{FOOT}"),
                f"Head {LONG} {MORE}"),
    "divs": (page(f"<div id='top-menu'><a href='/'>x</a></div><div id='wrap'><div class='story'><div>{LONG}</div><div>Short.</div><div>{MORE}</div></div>"
                  f"<div class='sidebar-right'><p>{LONG}</p></div></div>"), f"{LONG} Short. {MORE}"),
    "breaks": (page(f"<div class='header'>Logo</div><div>{LONG}<br><br>{MORE}<br/>End.</div><div class='footer'>imprint</div>"), f"{LONG} {MORE} End."),
    "comments": (page(f"<article><p>{LONG}</p></article><section id='comments'>" + "".join(
        f"<article class='comment'><p>{MORE} I think, too, that it is so.</p></article>" for _ in range(9)) + "</section>"), LONG),
    "comments inside": (page(f"<main><article><p>{LONG}</p><div class='comment-list'><p>{MORE}</p><p>{MORE}</p></div></article></main>"), LONG),
    "form and aside": (page(f"<main><h1>Head</h1><p>{LONG}</p><form><p>Mail, please: <input> {MORE}</p></form><aside><p>{MORE}</p></aside><p>{MORE}</p></main>"),
                       f"Head {LONG} {MORE}"),
    "raw": (page(f"<script>var a = '<p>x</p></div>';</script><style>p {{ }}</style><noscript><p>{MORE}</p></noscript><p>{LONG}</p><script>never ends <p>"), LONG),
    "inline": (page(f"<div><p>a<b>b</b>c <i>d</i>e<span>f</span> <span class='ad'>buy</span><a href='x'>link</a>, {LONG}</p></div>"),
               f"abc def link, {LONG}"),
    "references": (page(f"<p>{LONG} 5 &lt; 6 &amp;amp; &eacute;&#233;&#x1F600;&nbsp;x&unknown; AT&T</p>"), f"{LONG} 5 < 6 &amp; éé😀 x&unknown; AT&T"),
    "broken": (f"<p><b>{LONG}<br><p>{MORE}</div></section><p>Last, one", f"{LONG} {MORE} Last, one"),
    "lists": (page(f"{NAV}<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><pre>x\n  y</pre>"
                   f"<blockquote>{MORE}</blockquote></article>"), f"{LONG} one two a b c x y {MORE}"),
    "layout table": (page(f"<table><tr><td><a href='/1'>One</a><br><a href='/2'>Two</a></td><td><p>{LONG}</p><p>{MORE}</p></td></tr></table>"), f"{LONG} {MORE}"),
    "menu list": (page(f"<div><ul><li><a href=1>Alpha</a><li><a href=2>Beta</a><li><a href=3>Gamma</a></ul><p>{LONG}</p><p>{MORE}</p></div>"), f"{LONG} {MORE}"),
    "sections": (page(f"<article><section><h2>A</h2><p>{LONG}</p><p>{MORE}</p></section><section><h2>B</h2><p>No.</p></section></article>"),
                 f"A {LONG} {MORE} B No."),
    "article header": (page(f"<header><h1>The Site</h1>{NAV}</header><article><header><h1>Head</h1><p>3 min read</p></header><p>{LONG}</p></article>"), f"Head {LONG}"),
    "hidden": (page(f"<article><p hidden>secret</p><p style='display: none'>secret</p><p aria-hidden='true'>secret</p><p>{LONG}</p></article>"), LONG),
    "notices": (page(f"<div class='cookie-notice'><p>We use cookies, {MORE}</p></div><div role='alert'>{MORE}</div><div class='content has-sidebar'><p>{LONG}</p></div>"), LONG),
    "named against": (page(f"<div class='comments'><p>{LONG}</p></div>"), LONG),
    "two articles": (page(f"<article><p>{LONG}</p><p>{MORE}</p></article><article><p>{MORE}</p><p>{LONG}</p></article>"), f"{LONG} {MORE} {MORE} {LONG}"),
    "plain text": ("no  markup\n at all & so on", "no markup at all & so on"),
    "less than": (page(f"<p>{LONG} if a < b and b <c then <a <b>x</b></p>"), f"{LONG} if a < b and b <c then <a x"),
    "quoted": (page(f"<p title='a > b' data-x=\"</p>\">{LONG}</p>"), LONG),
    "only menus": (page(NAV + FOOT), ""),
    "comment marks": (page(f"<!-- <p>no</p> --><!--> <p>{LONG}</p><!-- open <p>{MORE}</p>"), LONG),
    "upper case": (f"<HTML><BODY><DIV CLASS='Ad'>x</DIV><P>{LONG}</P><SCRIPT>x</SCRIPT></BODY></HTML>", LONG),
    "none": (None, ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    given, want = CASES[name]
    assert M.main_text(given) == want


def test_long_deep_and_odd_pages():
    many = "".join(f"<p>{LONG} {i}</p>" for i in range(20_000))
    assert M.main_text(page(f"{NAV}<article>{many}</article>")) == " ".join(f"{LONG} {i}" for i in range(20_000))
    assert M.main_text("<div>" * 3000 + LONG) == LONG
    assert M.main_text("<a " * 50_000) == " ".join(["<a"] * 50_000)
    rng = random.Random(5)
    bits = ["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<td>", "<li>", "</ul>", "<b>", "<script>", "</script>", "<!--", "-->", "x, y ", "&lt;", "<", ">", "\"", "<header>", "</header>", "<h1>"]
    for _ in range(500):
        assert isinstance(M.main_text("".join(rng.choices(bits, k=rng.randint(1, 60)))), str)


def test_given_pages_equal_their_article_element(spark):
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = M.extract_articles(pages, key="page_id", page="html").collect()
    given = {r.page_id: r for r in pages.collect()}
    assert len(got) == len(given)
    for row in got:
        inner = given[row.id].html.split("<article>")[1].split("</article>")[0]
        want = " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(h1|p|br)>", " ", inner))).split())
        assert (row.url, row.text, row.n_chars) == (given[row.id].url, want, len(want))


def test_rows(spark):
    schema = "id bigint, url string, content string, text string, n_chars int"
    rows = [(1, "u", page(f"<p>{LONG}</p>"), "x", 1)] * 2 + [(None, None, None, None, None), (2, "v", "", "", 0)]
    got = sorted(M.extract_articles(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert [r.text for r in got if r.id == 1] == [LONG] * 2
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.id != 1) and len(got) == 4
    assert M.extract_articles(spark.createDataFrame([], schema)).count() == 0
