"""Main text of HTML pages: flat text blocks, neighbours' word counts and link densities, and a small decision tree."""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karakuri.llm.common import table

# HTML element names by their part in the flow of text.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
RAW = "script style textarea iframe title"  # their text is not markup; left open, they run to the end of the page
HIDDEN = set("noscript template select option button svg math object canvas audio video".split())  # only up to their end tag
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLE = {"article", "main"}
BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
# Words in class, id or role that name a part of a page.
BOILER_WORDS = set("ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget pagination pager toolbar comment comments reply replies discussion respond disqus copyright legal disclaimer skip hidden contentinfo complementary search".split())
ARTICLE_WORDS = set("article content main post entry story body articlebody".split())

TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
STOP = re.compile("[\"'<>]")
LEFT_OPEN = re.compile(r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s*/?|\s[^<]*=[^<]*)\Z")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW.split()}
NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
UNSEEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "named", "article", "heading")
# Labelled blocks, written by hand: words and link density of the block, of the one before and of the one after; then
# whether class words name its part as boilerplate, whether it stands in an article part, in a heading; last whether it
# is main text. Blocks in boilerplate elements, and in headers outside of articles, are no candidates and only count as
# neighbours.
LABELLED = [
    (2, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (8, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0), (25, 0.0, 40, 0.0, 30, 0.0, 1, 0, 0, 0),
    (15, 0.0, 70, 0.0, 20, 0.0, 1, 1, 0, 0), (3, 0.0, 60, 0.0, 2, 1.0, 1, 1, 0, 0), (9, 0.0, 8, 0.0, 30, 0.0, 0, 1, 1, 1),
    (2, 0.0, 8, 0.0, 60, 0.0, 0, 1, 1, 1), (1, 0.0, 50, 0.0, 70, 0.0, 0, 1, 1, 1), (30, 0.0, 9, 0.0, 55, 0.0, 0, 1, 0, 1),
    (80, 0.05, 30, 0.0, 20, 0.0, 0, 1, 0, 1), (5, 0.0, 80, 0.0, 60, 0.0, 0, 1, 0, 1), (1, 0.0, 40, 0.0, 12, 0.0, 0, 1, 0, 1),
    (3, 0.0, 4, 0.0, 2, 0.0, 0, 1, 0, 1), (60, 0.2, 40, 0.0, 11, 0.1, 0, 1, 0, 1), (18, 0.3, 60, 0.0, 25, 0.2, 0, 1, 0, 1),
    (2, 0.0, 9, 0.0, 0, 0.0, 0, 1, 0, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (7, 0.0, 0, 0.0, 40, 0.0, 0, 1, 1, 1),
    (12, 0.0, 4, 0.0, 35, 0.0, 0, 1, 0, 1), (4, 0.0, 0, 0.0, 35, 0.0, 0, 1, 1, 1), (140, 0.0, 2, 0.0, 110, 0.0, 0, 1, 0, 1),
    (55, 0.0, 90, 0.0, 2, 0.0, 0, 1, 0, 1), (33, 0.0, 45, 0.0, 8, 0.0, 0, 1, 0, 1), (1, 0.0, 2, 0.0, 14, 0.0, 0, 1, 0, 1),
    (2, 0.0, 33, 0.0, 1, 0.0, 0, 1, 0, 1), (4, 0.0, 2, 0.0, 16, 0.1, 0, 1, 0, 1), (6, 0.0, 10, 0.0, 7, 0.0, 0, 1, 0, 1),
    (20, 0.0, 3, 0.0, 4, 1.0, 0, 1, 0, 1), (11, 0.0, 70, 0.0, 5, 0.3, 0, 1, 0, 1), (3, 0.0, 6, 0.0, 1, 0.0, 0, 1, 1, 1),
    (10, 0.0, 25, 0.0, 2, 0.0, 0, 1, 1, 1), (65, 0.0, 7, 0.0, 19, 0.0, 0, 1, 0, 1), (8, 0.0, 9, 0.0, 200, 0.0, 0, 1, 1, 1),
    (250, 0.0, 180, 0.0, 90, 0.0, 0, 1, 0, 1), (42, 0.0, 1, 1.0, 6, 0.0, 0, 1, 0, 1), (45, 0.0, 2, 1.0, 60, 0.0, 1, 0, 0, 0),
    (1, 0.0, 9, 0.0, 44, 0.0, 1, 0, 0, 0), (30, 0.0, 12, 0.0, 90, 0.0, 1, 1, 0, 0), (7, 0.0, 30, 0.0, 33, 0.0, 1, 0, 1, 0),
    (2, 0.0, 40, 0.0, 3, 1.0, 0, 1, 0, 1), (9, 0.0, 60, 0.0, 8, 0.8, 0, 1, 0, 1), (5, 0.0, 4, 0.0, 2, 1.0, 0, 1, 0, 1),
    (14, 0.0, 33, 0.0, 12, 0.6, 0, 1, 0, 1), (1, 0.0, 70, 0.0, 1, 1.0, 0, 1, 0, 1), (3, 0.0, 9, 0.0, 5, 0.9, 0, 1, 1, 1),
    (3, 1.0, 50, 0.0, 2, 1.0, 0, 1, 0, 0), (2, 1.0, 3, 1.0, 2, 1.0, 0, 1, 0, 0), (4, 0.9, 60, 0.0, 12, 0.1, 0, 1, 0, 0),
    (45, 0.0, 30, 0.0, 60, 0.0, 0, 0, 0, 1), (22, 0.1, 50, 0.0, 40, 0.0, 0, 0, 0, 1), (18, 0.0, 8, 0.0, 44, 0.0, 0, 0, 0, 1),
    (30, 0.0, 35, 0.0, 3, 1.0, 0, 0, 0, 1), (9, 0.0, 40, 0.0, 60, 0.0, 0, 0, 0, 1), (6, 0.0, 30, 0.0, 50, 0.0, 0, 0, 1, 1),
    (8, 0.0, 2, 1.0, 40, 0.0, 0, 0, 1, 1), (4, 0.0, 6, 0.0, 45, 0.0, 0, 0, 1, 1), (70, 0.2, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (16, 0.0, 0, 0.0, 40, 0.0, 0, 0, 0, 1), (24, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 1), (2, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0),
    (4, 1.0, 30, 0.0, 3, 1.0, 0, 0, 0, 0), (20, 0.8, 3, 1.0, 18, 0.9, 0, 0, 0, 0), (12, 0.6, 40, 0.0, 9, 0.7, 0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (5, 0.0, 3, 1.0, 4, 0.0, 0, 0, 0, 0), (7, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 5, 0.0, 0, 0, 1, 0), (3, 0.0, 4, 0.0, 2, 1.0, 0, 0, 1, 0), (2, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0),
    (6, 0.2, 5, 0.0, 4, 0.5, 0, 0, 0, 0), (130, 0.0, 3, 0.0, 90, 0.0, 1, 0, 0, 1), (160, 0.05, 40, 0.0, 20, 0.0, 1, 0, 0, 1),
    (210, 0.1, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (120, 0.0, 8, 0.0, 2, 1.0, 1, 0, 0, 1), (60, 0.0, 20, 0.0, 30, 0.0, 1, 0, 0, 0),
    (35, 0.0, 50, 0.0, 25, 0.0, 1, 0, 0, 0), (80, 0.0, 40, 0.0, 60, 0.0, 1, 0, 0, 0), (140, 0.0, 60, 0.0, 40, 0.0, 1, 1, 0, 0),
    (100, 0.7, 4, 1.0, 6, 1.0, 1, 0, 0, 0), (4, 0.0, 60, 0.0, 55, 0.0, 0, 0, 0, 1), (2, 0.0, 45, 0.0, 38, 0.0, 0, 0, 0, 1),
    (6, 0.0, 70, 0.0, 3, 0.0, 0, 0, 0, 1), (3, 0.0, 25, 0.0, 30, 0.0, 0, 0, 0, 1), (5, 0.0, 4, 0.0, 80, 0.0, 0, 0, 0, 1),
    (8, 0.0, 9, 0.0, 60, 0.0, 0, 0, 0, 1), (4, 0.0, 2, 1.0, 50, 0.0, 0, 0, 0, 1), (7, 0.0, 3, 1.0, 44, 0.0, 0, 0, 0, 1),
    (5, 0.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0), (9, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (8, 0.0, 40, 0.0, 2, 1.0, 0, 0, 0, 0),
    (6, 0.0, 55, 0.0, 1, 1.0, 0, 0, 0, 0), (10, 0.0, 30, 0.9, 4, 1.0, 0, 0, 0, 0), (9, 0.0, 3, 0.0, 5, 0.0, 0, 0, 0, 0),
    (5, 0.0, 6, 0.0, 7, 0.0, 0, 0, 0, 0), (12, 0.0, 2, 1.0, 6, 0.0, 0, 0, 0, 0), (14, 0.0, 6, 0.0, 50, 0.0, 0, 0, 0, 1),
    (20, 0.0, 1, 1.0, 30, 0.0, 0, 0, 0, 1), (19, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 1), (28, 0.2, 35, 0.1, 2, 1.0, 0, 0, 0, 1),
    (40, 0.5, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (25, 0.4, 3, 0.9, 20, 0.8, 0, 0, 0, 0), (35, 0.5, 60, 0.0, 70, 0.0, 0, 0, 0, 1),
    (22, 0.45, 50, 0.0, 45, 0.1, 0, 0, 0, 1), (12, 0.4, 8, 0.8, 9, 0.9, 0, 0, 0, 0), (30, 0.6, 70, 0.0, 50, 0.0, 0, 1, 0, 1),
    (25, 0.5, 40, 0.0, 60, 0.0, 0, 1, 0, 1), (8, 0.5, 50, 0.0, 40, 0.0, 0, 1, 0, 1), (15, 1.0, 60, 0.0, 30, 0.0, 0, 1, 0, 0),
    (6, 1.0, 5, 1.0, 7, 1.0, 0, 1, 0, 0), (3, 0.0, 80, 0.0, 3, 1.0, 1, 0, 0, 0), (3, 0.0, 90, 0.0, 70, 0.0, 1, 0, 0, 0),
    (3, 0.0, 12, 0.0, 45, 0.0, 1, 0, 0, 0), (3, 0.0, 2, 1.0, 50, 0.0, 1, 0, 0, 0), (3, 0.0, 9, 0.0, 11, 0.0, 1, 0, 0, 0),
    (3, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0, 0), (10, 0.0, 80, 0.0, 3, 1.0, 1, 0, 0, 0), (10, 0.0, 90, 0.0, 70, 0.0, 1, 0, 0, 0),
    (10, 0.0, 12, 0.0, 45, 0.0, 1, 0, 0, 0), (10, 0.0, 2, 1.0, 50, 0.0, 1, 0, 0, 0), (10, 0.0, 9, 0.0, 11, 0.0, 1, 0, 0, 0),
    (10, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0, 0), (15, 0.0, 80, 0.0, 3, 1.0, 1, 0, 0, 0), (15, 0.0, 90, 0.0, 70, 0.0, 1, 0, 0, 0),
    (15, 0.0, 12, 0.0, 45, 0.0, 1, 0, 0, 0), (15, 0.0, 2, 1.0, 50, 0.0, 1, 0, 0, 0), (15, 0.0, 9, 0.0, 11, 0.0, 1, 0, 0, 0),
    (15, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0, 0), (26, 0.1, 80, 0.0, 3, 1.0, 1, 0, 0, 0), (26, 0.1, 90, 0.0, 70, 0.0, 1, 0, 0, 0),
    (26, 0.1, 12, 0.0, 45, 0.0, 1, 0, 0, 0), (26, 0.1, 2, 1.0, 50, 0.0, 1, 0, 0, 0), (26, 0.1, 9, 0.0, 11, 0.0, 1, 0, 0, 0),
    (26, 0.1, 70, 0.0, 0, 0.0, 1, 0, 0, 0), (50, 0.0, 80, 0.0, 3, 1.0, 1, 0, 0, 0), (50, 0.0, 90, 0.0, 70, 0.0, 1, 0, 0, 0),
    (50, 0.0, 12, 0.0, 45, 0.0, 1, 0, 0, 0), (50, 0.0, 2, 1.0, 50, 0.0, 1, 0, 0, 0), (50, 0.0, 9, 0.0, 11, 0.0, 1, 0, 0, 0),
    (50, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0, 0), (90, 0.0, 80, 0.0, 3, 1.0, 1, 0, 0, 0), (90, 0.0, 90, 0.0, 70, 0.0, 1, 0, 0, 0),
    (90, 0.0, 12, 0.0, 45, 0.0, 1, 0, 0, 0), (90, 0.0, 2, 1.0, 50, 0.0, 1, 0, 0, 0), (90, 0.0, 9, 0.0, 11, 0.0, 1, 0, 0, 0),
    (90, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0, 0), (11, 0.0, 120, 0.0, 0, 0.0, 0, 0, 0, 1), (6, 0.0, 80, 0.0, 9, 0.0, 0, 0, 0, 1),
    (13, 0.0, 70, 0.0, 20, 0.0, 0, 0, 0, 1), (3, 0.0, 100, 0.0, 4, 0.0, 0, 0, 0, 1), (15, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0, 0),
    (25, 0.0, 0, 0.0, 6, 0.0, 0, 0, 0, 1), (18, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0, 1), (40, 0.0, 3, 0.0, 60, 0.0, 0, 0, 0, 1),
    (80, 0.0, 0, 0.0, 50, 0.0, 0, 0, 0, 1), (30, 0.0, 5, 0.0, 45, 0.0, 0, 0, 0, 1), (60, 0.1, 2, 1.0, 70, 0.0, 0, 0, 0, 1),
    (24, 0.0, 0, 0.0, 90, 0.0, 0, 0, 0, 1), (22, 0.0, 4, 0.0, 38, 0.0, 0, 0, 0, 1), (50, 0.0, 1, 1.0, 20, 0.0, 0, 0, 0, 1),
    (33, 0.0, 6, 0.0, 70, 0.1, 0, 0, 0, 1),
]


def fit_tree(rows=LABELLED, depth: int = 7):
    """A CART tree (Gini impurity; first feature and lowest threshold on ties) as nested (feature, threshold, low, high) or 0/1."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def gini(part):
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for k in range(len(FEATURES)):
        values = sorted({r[k] for r in rows})
        for lo, hi in zip(values, values[1:]):
            cut = (lo + hi) / 2
            parts = [r for r in rows if r[k] <= cut], [r for r in rows if r[k] > cut]
            cost = gini(parts[0]) + gini(parts[1])
            if best is None or cost < best[0] - 1e-12:
                best = (cost, k, cut, parts)
    if best is None:
        return int(2 * ones >= len(rows))
    _, k, cut, (low, high) = best
    return (k, cut, fit_tree(low, depth - 1), fit_tree(high, depth - 1))


def is_main(tree, features) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


def _part(name: str, attrs: str) -> str:
    """Which part of a page an element opens: boiler, named (boilerplate by its class words alone), article, header or none.

    Class words of both kinds on one element say nothing.
    """
    if name in BOILER or UNSEEN.search(attrs):
        return "boiler"
    if name == "header":
        return "header"
    if name in ARTICLE:
        return "article"
    said = {w for m in NAMED.findall(attrs) for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(m)).lower())}
    if name in ("html", "body"):
        return ""
    if said & BOILER_WORDS and not said & ARTICLE_WORDS:
        return "header" if said & BOILER_WORDS <= {"header", "masthead"} else "named"
    return "article" if said & ARTICLE_WORDS and not said & BOILER_WORDS else ""


def _tag_end(html: str, start: int) -> int:
    """Where the tag that starts here ends, quotes counted; the place of a "<" before that; -1 if there is no end."""
    at = start + 1
    while m := STOP.search(html, at):
        if m[0] == ">":
            return m.end()
        if m[0] == "<":
            return m.start()
        close = html.find(m[0], m.end())
        if close < 0:
            break
        at = close + 1
    return html.find(">", start) + 1 or -1


def _tokens(html: str) -> list[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page in order: text, open and close. One scan from the left; what has no end
    is looked for once, and after that not again."""
    out: list[tuple[str, str, str]] = []
    at, n, ends, sections = 0, len(html), True, True  # whether a ">", and the end of a CDATA section, may still come
    while at < n:
        start = html.find("<", at)
        if start < 0 or not ends:
            out.append(("text", html[at:], ""))
            break
        if start > at:
            out.append(("text", html[at:start], ""))
        at = start + 1
        if html.startswith("<!--", start):
            close = html.find("-->", start + 4)
            at = close + 3 if close >= 0 else n
            continue
        if sections and html.startswith("<![CDATA[", start):
            close = html.find("]]>", start)
            sections = close >= 0
            if sections:
                at = close + 3
                continue
        m = TAG.match(html, start)
        if not m:
            if html.startswith(("<!", "<?", "</"), start):
                close = html.find(">", start)
                ends = close >= 0
                if ends:
                    at = close + 1
                    continue
            out.append(("text", "<", ""))
            continue
        end = _tag_end(html, start)
        ends = end >= 0
        if not ends or html[end - 1] != ">" and not LEFT_OPEN.match(html[start:end]):
            out.append(("text", "<", ""))
            continue
        name, attrs, at = m[1].lower(), html[m.end() : end].rstrip(">"), end
        if html[start + 1] == "/":
            out.append(("close", name, ""))
        elif name in RAW_END:
            if not attrs.endswith("/"):
                m = RAW_END[name].search(html, end)
                at = m.end() if m else n
        else:
            out.append(("open", name, attrs))
    return out


def blocks(html: str) -> list[tuple[str, list]]:
    """The page's text blocks in order, but for those in boilerplate elements and page headers, each with its features. Block-level tags
    end a block, inline tags don't; a link goes on to its end tag, or where it has none to the end of its block."""
    found, stack, text, linked = [], [], [], 0
    link = heading = 0
    closed = False  # whether the present link has an end tag
    parts = {"boiler": 0, "named": 0, "article": 0, "header": 0, "": 0}

    def flush():
        nonlocal linked
        tokens = unescape("".join(text)).split()
        if tokens:
            candidate = not parts["boiler"] and (parts["article"] > 0 or not parts["header"])
            found.append((candidate, " ".join(tokens), len(tokens), min(1.0, linked / len(tokens)), int(parts["named"] > 0), int(parts["article"] > 0), int(heading > 0)))
        text.clear()
        linked = 0

    tokens_ = _tokens(html)
    opened, ends = {}, {}  # hidden elements left open so far, by name; where those that are closed end
    links, last = set(), None  # links that have an end tag
    for k, (kind, name, attrs) in enumerate(tokens_):
        if name in HIDDEN and kind == "close":
            if opened.get(name):
                ends[opened[name].pop()] = k
        elif name in HIDDEN and kind == "open" and not attrs.endswith("/"):
            opened.setdefault(name, []).append(k)
        elif name == "a" and kind == "open":
            last = k
        elif name == "a" and kind == "close" and last is not None:
            links.add(last)
            last = None
    until = -1
    for k, (kind, name, attrs) in enumerate(tokens_):
        if k <= until:
            continue
        if k in ends:
            until = ends[k]
            continue
        if kind == "text":
            text.append(name)
            if link:
                linked += len(name.split())
            continue
        if name in HIDDEN:
            continue
        if name == "a":
            link, closed = int(kind == "open"), k in links
        if name == "br":
            text.append(" ")
        if name in INLINE:
            continue
        flush()
        link = int(link and closed)
        if name in HEADINGS:
            heading = int(kind == "open")
        if kind == "close":
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if at is not None:
                for _, part in stack[at:]:
                    parts[part] -= 1
                del stack[at:]
        elif name not in VOID and name not in HEADINGS and name not in ("p", "li") and not attrs.endswith("/"):
            stack.append((name, part := _part(name, attrs)))
            parts[part] += 1
        elif name in ("p", "li") and (part := _part(name, attrs)):
            stack.append((name, part))
            parts[part] += 1
    flush()
    out = []
    for k, (candidate, words_, n, share, *flags) in enumerate(found):
        before = found[k - 1][2:4] if k else (0, 0.0)
        after = found[k + 1][2:4] if k + 1 < len(found) else (0, 0.0)
        if candidate:
            out.append((words_, [n, share, *before, *after, *flags]))
    return out


def main_text(html: str | None, tree) -> str:
    return " ".join(text for text, features in blocks(html or "") if is_main(tree, features))


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages without html_col, plus text_col: the blocks that the tree calls main text, joined by one space.

    The tree is fitted on LABELLED when the operator is called. A null or empty page gives an empty text; pages of any
    length are read whole, in one scan; repeated rows and null keys stay; a column already named text_col is replaced,
    other columns keep their names; an empty table gives an empty result.
    """
    tree = fit_tree()
    kept = [c for c in pages.columns if c not in (html_col, text_col)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*kept, text_col])

    schema = pages.select(*kept).withColumn(text_col, F.lit("")).schema
    return pages.select(F.col(html_col).cast("string"), *kept).mapInArrow(run, schema)


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
