"""The article in a web page: paragraphs give points to the elements around them, the best element is kept."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

_ATTRIBUTE = r"""[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)?)?"""
#: A comment, a declaration, or a tag; what begins like a tag but never ends is text.
_MARK = re.compile(rf"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|{_ATTRIBUTE}|["'=])*+)>""", re.S)
_NAMED = re.compile(r"""(?:^|[\s/])(class|id|role|style|hidden|aria-hidden|itemprop|href|type)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_COMMA = re.compile("[,،、，]")


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


#: What their end tags alone end: nothing in them is markup.
RAW = _set("script style noscript iframe noembed noframes template textarea title xmp svg math")
VOID = _set("area base br col embed frame hr img input link meta param source track wbr")
INLINE = _set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike "
              "strong sub sup time tt u var wbr img")
#: Never part of an article.
OUTSIDE = RAW | _set("head nav aside footer form button input select option datalist object embed canvas audio video dialog menu applet map link meta frame frameset")
#: Elements that gather points; the others pass them on.
CONTAINERS = _set("html body main article section div td center details fieldset")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
#: A start tag of the left ends open elements of the right, up to the nearest container or list.
CLOSES = {"li": _set("li"), "dt": _set("dt dd"), "dd": _set("dt dd"), "tr": _set("tr td th"), "td": _set("td th"), "th": _set("td th"),
          "tbody": _set("tr td th thead tbody"), "tfoot": _set("tr td th tbody"), "option": _set("option")}
ROLES = _set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form note")
#: Words in classes and ids that tell what is not part of an article.
NAMES = _set(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promos promotion promoted "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups overlay modal paywall "
    "newsletter subscribe subscription signup login signin register search searchbox "
    "comment comments commentlist commenting disqus respond reply replies discussion "
    "sidebar sidebars aside rail menu menus nav navbar navigation navi breadcrumb breadcrumbs pagination pager paging toc topbar toolbar "
    "share sharing social related recommended recommendations trending popular footer foot footnav header masthead banner banners skip widget widgets")
_HEADERS = _set("header masthead")
#: Before such a name: it tells of what is or is not there.
_ABOUT = _set("has with no without is not js show hide")
_READER = _set("comment comments commentlist disqus reply replies respond discussion")
_FRONT = _set("teaser promo related recommended sponsored ad advert advertisement")
_MAIN = _set("article articlebody post entry story content main body text")


class _Element:
    """An element of the page: its children in order, points, and the text below it."""

    __slots__ = ("tag", "up", "children", "dropped", "name", "points", "chars", "linked", "loose", "items")

    def __init__(self, tag: str, up: _Element | None, dropped: bool = False, name: frozenset[str] = frozenset()):
        self.tag, self.up, self.dropped, self.name = tag, up, dropped, name
        self.children: list[_Element | str] = []
        self.points, self.chars, self.linked, self.loose, self.items = 0.0, 0, 0, 0, 0


def _names(value: str) -> tuple[frozenset[str], frozenset[str]]:
    """The words of a class or id; and all words of those that don't tell of something else."""
    plain, telling = set(), set()
    for word in value.split():
        parts = [p.lower() for p in _SPLIT.split(word) if p]
        plain.add("".join(parts))
        if parts and parts[0] not in _ABOUT:
            telling |= {p.rstrip("0123456789") for p in parts} | {"".join(parts)}
    return frozenset(plain), frozenset(telling)


def _about(tag: str, attributes: str) -> tuple[bool, bool, frozenset[str]]:
    """Is an element outside of any article: by what it is, by what it is called; and its plain names."""
    plain: frozenset[str] = frozenset()
    sure, called = False, False
    for name, *values in _NAMED.findall(attributes):
        name, value = name.lower(), html.unescape("".join(values))
        if name in ("class", "id", "itemprop"):
            own, telling = _names(value)
            plain |= own
            known = telling & NAMES
            if tag in ("article", "main"):
                known &= _READER | _FRONT
            called |= bool(known) and tag not in ("html", "body") and name != "itemprop"
        elif name == "role":
            sure |= value.strip().lower() in ROLES and tag not in ("html", "body", "main", "article")
        elif name == "hidden":
            sure |= value.strip().lower() != "until-found"
        elif name == "aria-hidden":
            sure |= value.strip().lower() == "true"
        elif name == "style":
            sure |= bool(_HIDDEN.search(value))
    return sure, called, plain


def _tree(page: str, by_name: bool) -> _Element:
    """The page as blocks: inline tags leave only their text, of links with a mark, and ``br`` a space.

    Forgiving: end tags without a start are passed over, missing ones added, ``p`` ends where a block begins.
    """
    root = here = _Element("html", None)
    links, at, hidden = 0, 0, 0  # open inline elements that hide their text
    inline: list[tuple[str, bool]] = []
    lowered = None

    def text(raw: str) -> None:
        if raw and not hidden and not here.dropped:
            said = html.unescape(raw) if "&" in raw else raw
            here.children.append(said)
            n = len(said) - said.count(" ") - said.count("\n")
            here.loose += n
            if links:
                here.linked += n

    while (mark := _MARK.search(page, at)) is not None:
        text(page[at: mark.start()])
        at = mark.end()
        tag = (mark[2] or "").lower()
        if not tag:
            continue
        if mark[1]:
            if tag in INLINE:
                for k in range(len(inline) - 1, -1, -1):
                    if inline[k][0] == tag:
                        _, hides = inline.pop(k)
                        hidden, links = hidden - hides, links - (tag == "a")
                        break
            elif tag in ("br", "p") and not _open(here, tag):
                here.children.append(" ")
            elif (open_one := _open(here, tag)) is not None:
                here = open_one.up or root
            if tag not in INLINE:
                inline = [] if not hidden else inline
                links = sum(t == "a" for t, _ in inline)
            continue
        sure, called, plain = _about(tag, mark[3]) if mark[3] and not mark[3].isspace() else (False, False, frozenset())
        drop = sure or (called and by_name)
        if tag in RAW:
            if lowered is None:  # one copy a page; lowering keeps ASCII places only if no character grows
                lowered = page.lower() if len(page.lower()) == len(page) else page
            end = lowered.find(f"</{tag}", at)
            at = len(page) if end < 0 else end
            if end >= 0 and (close := page.find(">", end)) >= 0:
                at = close + 1
        elif tag in VOID:
            if tag in ("br", "hr"):
                here.children.append(" ")
        elif tag in INLINE:
            inline.append((tag, drop))
            hidden, links = hidden + drop, links + (tag == "a")
        else:
            if (opened := _open(here, "p")) is not None:
                here = opened.up or root
            for other in CLOSES.get(tag, ()):
                if (opened := _open(here, other)) is not None:
                    here = opened.up or root
            if tag in HEADINGS and here.tag in HEADINGS:
                here = here.up or root
            if tag in ("html", "body") and here.up is None:
                continue
            inside = here.dropped
            site_header = tag == "header" or (by_name and plain & _HEADERS and tag not in HEADINGS)
            here = _Element(tag, here, inside or tag in OUTSIDE or drop, plain | ({"header"} if site_header else frozenset()))
            if site_header and not inside and _inside(here, ("article",)):
                here.dropped = sure  # an article's own header: its headings stay
            elif site_header:
                here.dropped = True
            here.up.children.append(here)
            if not hidden:
                inline, links = [x for x in inline if x[0] == "a"], links
    text(page[at:])
    return root


#: An end tag looks no further up than here.
_SCOPE = _set("html body main article section div td th table aside nav header footer form ul ol dl blockquote")


def _open(here: _Element, tag: str) -> _Element | None:
    """The nearest open element of a tag: for parts of text and lists, inside the present block; else anywhere."""
    near = tag in ("p", "li", "dt", "dd", "option") or tag in HEADINGS
    one: _Element | None = here
    while one is not None and one.up is not None:
        if one.tag == tag or (tag in HEADINGS and one.tag in HEADINGS):
            return one
        if near and one.tag in _SCOPE or tag in ("tr", "td", "th", "tbody", "thead") and one.tag == "table":
            return None
        one = one.up
    return None


def _inside(one: _Element, tags: tuple[str, ...]) -> bool:
    while one.up is not None:
        one = one.up
        if one.tag in tags:
            return True
    return False


def _kept(root: _Element) -> list[_Element]:
    """Elements that count, parents first."""
    out, todo = [], [root]
    while todo:
        one = todo.pop()
        if one.dropped:
            continue
        out.append(one)
        todo += [c for c in reversed(one.children) if isinstance(c, _Element)]
    return out


def _score(root: _Element) -> list[_Element]:
    """Points from every run of text to the containers around it: the full, a half, a third of them, and so on.

    A run passes one point, one for each comma and one for each hundred characters, less its share of links. A
    block without blocks in it is a paragraph, whatever its tag.
    """
    kept = _kept(root)
    for one in reversed(kept):
        one.chars += one.loose
        one.items += one.tag == "li"
        if one.up is not None:
            one.up.chars, one.up.linked, one.up.items = one.up.chars + one.chars, one.up.linked + one.linked, one.up.items + one.items
    for one in kept:
        if not one.loose:
            continue
        said = "".join(c for c in one.children if isinstance(c, str))
        leaf = not any(isinstance(c, _Element) and not c.dropped for c in one.children)
        points = 1 + len(_COMMA.findall(said)) + one.loose / 100
        points *= 1 - (one.linked / one.loose if leaf else one.linked / max(one.chars, 1))
        to = one.up if leaf and one.up is not None else one
        level = 1
        while to is not None:
            if to.tag in CONTAINERS:
                to.points += points / level
                level += 1
            to = to.up
    return kept


def _density(one: _Element) -> float:
    return one.linked / one.chars if one.chars else 0.0


def _is_menu(one: _Element) -> bool:
    """A list of short links and nothing else."""
    return one.tag in ("ul", "ol", "dl") and one.items >= 3 and _density(one) > 0.9 and one.chars < 40 * one.items


def _chosen(kept: list[_Element]) -> list[_Element]:
    """The best container and those of its siblings that read like it, in page order."""
    best = max((e for e in kept if e.tag in CONTAINERS), key=lambda e: e.points * (1 - _density(e)), default=None)
    if best is None or not best.chars:
        return kept[:1]
    up: _Element | None = best
    found = {}
    while up is not None:
        found.setdefault("article" if up.tag == "article" else "main" if up.tag == "main" or up.name & _MAIN and up.tag != "body" else "", up)
        up = up.up
    whole = found.get("article") or found.get("main")
    best = whole or best
    if best.up is None:
        return [best]
    least = 0.2 * best.points * (1 - _density(best))
    out = []
    for one in best.up.children:
        if one is best:
            out.append(one)
        elif isinstance(one, _Element) and not one.dropped and one.chars:
            if one.tag in CONTAINERS:
                good = (whole is None or one.tag == best.tag) and one.points * (1 - _density(one)) >= least
            else:
                good = one.tag == "h1" or whole is None and (one.tag in HEADINGS or _density(one) < 0.25 and not _is_menu(one))
            if good and _density(one) < 0.5:
                out.append(one)
        elif isinstance(one, str) and whole is None and best.up.tag in CONTAINERS and one.strip():
            out.append(one)
    return out


def _said(chosen: list[_Element | str]) -> str:
    """The text of the chosen parts, white space as one space, a space wherever a block begins or ends."""
    parts: list[str] = []
    todo: list[tuple[_Element | str, bool]] = [(c, False) for c in reversed(chosen)]
    while todo:
        one, in_header = todo.pop()
        if isinstance(one, str):
            if not in_header:
                parts.append(one)
            continue
        if one.dropped or _is_menu(one):
            parts.append(" ")
            continue
        parts.append(" ")
        todo.append((" ", False))
        inner = ("header" in one.name or in_header) and one.tag not in HEADINGS
        todo += [(c, inner) for c in reversed(one.children)]
    return " ".join("".join(parts).split())


def main_text(page: str | None) -> str:
    """The article of one page."""
    if not page:
        return ""
    for by_name in (True, False):  # a page whose names tell against all of it is read by its structure alone
        kept = _score(_tree(page, by_name))
        said = _said(_chosen(kept))
        if said:
            return said
    return ""


@F.pandas_udf(T.StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract_articles(pages: DataFrame, key: str = "id", link: str = "url", page: str = "content") -> DataFrame:
    """The main text of article pages: (id, url, text, n_chars), one row per input row.

    Works on the article records of the feeds, whose ``content`` is the page at ``url``. A run of text passes points
    for length and commas, less its share of links, to the containers around it: all of them to the nearest,
    a half to the next, a third to the one after. The container with most points, again less its share of links, is the article, or the
    ``article`` or main element around it; siblings with a fifth of its points, or paragraphs among few links, go
    with it. Scripts, styles, menus, site headers, footers, sidebars, notices, adverts, forms, hidden parts and readers' comments
    are told by their tags, roles and names and never count. Inside, white space is one space, and so is the end of a
    block or a line break; character references are decoded once.

    ``text`` is empty where a page is null, empty or without an article; ``n_chars`` counts its code points.
    Markup may be broken anywhere; nothing is cut off. Repeated rows give equal rows. Other columns are
    ignored; no rows give no rows.
    """
    rows = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{link}`").alias("url"), _main_text(F.col(f"`{page}`")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))
