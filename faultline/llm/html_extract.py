"""HTML main text by two-pass block rules.

A page is cut into blocks at its block-level tags.  Blocks in a boilerplate container (menus,
headers, footers, sidebars, notices, adverts, forms, comments) are boilerplate.  Pass one
decides what any other block's own density of stop words, length and density of links decide.
That the markup calls a region the article is one feature more: a longer block with few stop
words is kept there if its nearest judged neighbour in the region, on either side, is prose,
and its short blocks look to their own region.  Pass two gives each undecided short block the
label of its nearest decided neighbours; where they differ it is boilerplate, unless the
good one is the nearer.  A main region without a good block counts for nothing on a page
that has good blocks elsewhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map

#: Lengths in code points and densities, as parts of a block's code points or words.
SHORT = 70
LONG = 200
STOP_LOW = 0.15
STOP_HIGH = 0.30
MAX_LINKS = 0.5
#: Stop words tell prose where blocks of at least STOP_LOW hold this part of the page's longer
#: text; below it the page's language isn't among the lists, and length and links decide.
KNOWN_SHARE = 0.1

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
the of and to in is that it was for on are as with be by this at from or an not have which
der die das und ist nicht von mit den sich des auf für ein eine einer dem zu im als auch es
le la les et un une est que qui dans pour pas du au sur avec par plus ce il ne se
el los las y una en por con para su del lo como más al o pero sus no
""".split())

# Elements by how they are read.
RAW = "script|style"
#: Dropped with what they hold up to their own end tag; without one only the tag is.
SKIPPED = frozenset("""
title textarea iframe noscript template svg select button noframes object canvas video audio annotation annotation-xml
""".split())
BLOCKS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody
td tfoot th thead tr ul
""".split())
#: Blocks that may hold others and so are followed on a stack.
CONTAINERS = BLOCKS - frozenset("p hr h1 h2 h3 h4 h5 h6 option li dt dd td th tr tbody thead tfoot caption".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog head fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
BAD_NAMES = frozenset("""
ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent cookie
cookies copyright discussion disqus footer form gdpr login menu modal nav navbar navigation newsletter notice notices
overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing
sidebar signup skip social sponsor sponsored subscribe toolbar widget
""".split())
HEADER_NAMES = frozenset(["header", "masthead", "topbar"])
COMMENT_NAMES = frozenset(["comment", "comments", "discussion", "disqus", "replies", "reply", "respond"])
#: What makes an article or main element itself boilerplate.
BAD_ARTICLE_NAMES = COMMENT_NAMES | frozenset(["ad", "ads", "advert", "promo", "related", "sponsored", "teaser"])
MAIN_NAMES = frozenset(["article", "content", "entry", "main", "post", "story"])

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^<>\"']*+(?:\"[^\"]*\"[^<>\"']*+|'[^']*'[^<>\"']*+)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>", re.S | re.I)
_SKIPPED = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)({'|'.join(sorted(SKIPPED, key=len, reverse=True))})(?=[\s/>])"
    r"((?:[^<>\"']*+(?:\"[^\"]*\"[^<>\"']*+|'[^']*'[^<>\"']*+)*+>)|[^>]*+>)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=)|display\s*:\s*none", re.I)
_NAME = re.compile(r"[a-z0-9]+")
#: Layout names such as with-sidebar say what a page has, not what an element is.
_LAYOUT = re.compile(r"\b(?:has|with|no|without)[-_][a-z0-9]+")

NEUTRAL, MAIN, BAD = 0, 1, 2


@dataclass
class Block:
    text: str
    region: int
    group: int  # of a main region: its number
    heading: bool
    links: float  # part of the text inside links
    label: str = ""


def _region(tag: str, attributes: str, inside: int, in_comments: bool) -> tuple[int, bool]:
    """The region that an element opens, and whether it holds comments."""
    names, role = set(), ""
    for key, a, b, c in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        value = (a or b or c).lower()
        if key.lower() == "role":
            role = value
        else:
            names.update(_NAME.findall(_LAYOUT.sub(" ", value)))
    if tag in ("html", "body"):
        return inside, in_comments
    comments = in_comments or bool(names & COMMENT_NAMES)
    if tag in ("article", "main") or role == "main":
        return (BAD if comments or names & BAD_ARTICLE_NAMES else MAIN), comments
    if comments or tag in BAD_TAGS or role in BAD_ROLES or names & BAD_NAMES or _HIDDEN.search(attributes):
        return BAD, comments
    if (tag == "header" or names & HEADER_NAMES) and inside != MAIN:
        return BAD, comments
    if names & MAIN_NAMES and inside != BAD:
        return MAIN, comments
    return inside, comments


def _skipped(html: str, end: int) -> dict[int, int]:
    """Where elements whose content isn't read begin, and where their own end tags end."""
    opened: dict[str, list[int]] = {}
    out = {}
    for m in _SKIPPED.finditer(html, 0, end):
        if name := (m[3] or "").lower():
            if m[2]:
                if opened.get(name):
                    out[opened[name].pop()] = m.end()
            elif not (name == "svg" and m[4].endswith("/>")):
                opened.setdefault(name, []).append(m.start())
    return out


def _left_open(m: re.Match) -> bool:
    """Whether a comment or a raw element reaches to the end of the page without an end of its own."""
    if m[1]:
        return re.search(rf"</{m[1]}\s*>\Z", m[0], re.I) is None
    return m[0].startswith("<!--") and not m[0].endswith("-->", 4)


def blocks_of(html: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int]] = [("", NEUTRAL, False, 0)]
    parts: list[str] = []
    linked = in_link = groups = 0
    heading = False

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, stack[-1][1], stack[-1][3], heading, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(" ".join(text.split()))

    # No tag ends after the last ">": what follows is text, unless a comment or a raw element is open.
    end = html.rfind(">") + 1
    ends = _skipped(html, end)
    last = 0
    while last < end and (m := _TAG.search(html, last, end)):
        if m.start() > last:
            add(html[last:m.start()])
        last = m.end()
        if last == end and _left_open(m):
            last = len(html)
            break
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing = bool(m[2] or m[5])
        if tag in SKIPPED:
            last = max(last, ends.get(m.start(), 0))
            if tag in ("iframe", "object", "video", "audio", "canvas", "textarea", "select"):
                parts.append(" ")
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in BLOCKS:
            close()
            heading = tag[0] == "h" and tag[1:].isdigit() and not closing
            in_link = 0
            if tag in CONTAINERS:
                if closing:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
                else:
                    region, comments = _region(tag, m[4] or m[7] or "", stack[-1][1], stack[-1][2])
                    group = stack[-1][3]
                    if region == MAIN and stack[-1][1] != MAIN:
                        groups += 1
                        group = groups
                    stack.append((tag, region, comments, group))
            elif not closing:
                if len(stack) > 1 and stack[-1][0] in ("p", tag):
                    stack.pop()  # a paragraph or item ends where the next begins
                # it can be boilerplate by its own name
                attributes = m[4] or m[7] or ""
                if "=" in attributes and _region(tag, attributes, stack[-1][1], stack[-1][2])[0] == BAD:
                    stack.append((tag, BAD, stack[-1][2], 0))
            elif closing and len(stack) > 1 and stack[-1][0] == tag:
                stack.pop()
    comment = html.find("<!--", max(last, end))
    if last < len(html):
        add(html[last:comment if comment >= 0 else len(html)])
    close()
    return out


def _stop_density(text: str) -> float:
    words = [w.strip(".,;:!?()[]\"'“”„«»#*$%&") for w in text.lower().split()]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def classify(blocks: list[Block]) -> list[Block]:
    """Both passes; every block's label becomes ``good`` or ``bad``."""
    density = [_stop_density(b.text) for b in blocks]
    judged = [(len(b.text), d) for b, d in zip(blocks, density)
              if b.region != BAD and b.links <= MAX_LINKS and len(b.text) >= SHORT]
    dense = sum(n for n, d in judged if d >= STOP_LOW)
    known = dense > 0 and dense >= KNOWN_SHARE * sum(n for n, _ in judged)
    for b, stop in zip(blocks, density):
        n = len(b.text)
        if b.region == BAD:
            b.label = "bad"
        elif b.links > MAX_LINKS and not (b.region == MAIN and b.heading):
            b.label = "bad"
        elif n < SHORT:
            b.label = "short"
        elif stop >= STOP_HIGH or not known:
            b.label = "good" if n > LONG else "near"
        elif stop >= STOP_LOW:
            b.label = "near"
        else:
            b.label = "weak" if b.region == MAIN else "bad"
    _inherit(blocks)
    return blocks


def _nearest(blocks: list[Block], labels: tuple[str, ...], same=lambda b, x: True):
    """For each block the nearest ones before and after it of those labels, as (distance, label);
    the search ends there, also where ``same(block, other)`` says that it doesn't count."""
    n = len(blocks)
    before, after = [-1] * n, [-1] * n
    for k in range(1, n):
        before[k] = k - 1 if blocks[k - 1].label in labels else before[k - 1]
    for k in range(n - 2, -1, -1):
        after[k] = k + 1 if blocks[k + 1].label in labels else after[k + 1]
    return [[(abs(k - x), blocks[x].label) for x in (before[k], after[k]) if x >= 0 and same(b, blocks[x])]
            for k, b in enumerate(blocks)]


def _inherit(blocks: list[Block]) -> None:
    own = lambda b, x: b.region == x.region == MAIN and b.group == x.group
    given = {}
    if any(b.label in ("near", "weak") for b in blocks):
        decided = _nearest(blocks, ("good", "bad"), lambda b, x: b.region != MAIN or own(b, x))
        fit = _nearest(blocks, ("good", "near", "bad"), own)
        for k, b in enumerate(blocks):
            if b.label == "near":
                alone = len(decided[k]) == 2 and {x for _, x in decided[k]} == {"bad"}
                given[k] = "bad" if b.region != MAIN and alone and len(b.text) < LONG / 2 else "good"
            elif b.label == "weak":  # few stop words: it stays beside the prose of its own article
                given[k] = "good" if any(x != "bad" for _, x in fit[k]) else "bad"
    for k, label in given.items():
        blocks[k].label = label

    # a main region is the article if it holds a good block, or if nothing else on the page does
    articles = {b.group for b in blocks if b.region == MAIN and b.label == "good"}
    if not any(b.label == "good" for b in blocks):
        articles = {b.group for b in blocks if b.region == MAIN}
    in_article = lambda b: b.region == MAIN and b.group in articles
    given = {}
    for k, near in enumerate(_nearest(blocks, ("good", "bad"),
                                      lambda b, x: own(b, x) if in_article(b) else not in_article(x))):
        b, labels = blocks[k], {x for _, x in near}
        if b.label != "short":
            continue
        if in_article(b):
            # the article keeps what its own neighbours don't make boilerplate on both sides
            given[k] = "bad" if labels == {"bad"} and len(near) == 2 else "good"
        elif len(labels) == 1:
            given[k] = labels.pop()
        else:
            given[k] = "good" if near and min(near) == (min(near)[0], "good") and near[0][0] != near[-1][0] else "bad"
    for k, label in given.items():
        blocks[k].label = label


def main_text(html: str) -> str:
    return "\n".join(b.text for b in classify(blocks_of(html)) if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row ``id_col, url_col, text``: the good blocks in page order, joined by newlines.

    Character references are decoded, white space in a block is one space.  A null or empty
    page, or one without a good block, has the empty text.  Broken markup (tags left open,
    stray or cut off) is read as far as it goes, a page without markup is one block, judged like any other.
    Repeated rows give a row each, an empty table none; other columns are not read.  Narrow:
    no shuffle, whole pages."""
    def rows(ids, urls, htmls):
        for lo in range(0, len(ids), 256):
            part = slice(lo, lo + 256)
            yield ids[part], urls[part], [main_text(h) if h else "" for h in htmls[part]]

    kind = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return arrow_map(pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("_h")), rows,
                     f"{id_col} {kind[id_col]}, {url_col} {kind[url_col]}, text string")
