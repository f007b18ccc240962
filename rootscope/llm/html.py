"""Operator 9, main text of web pages by their line-block distribution.

Markup is stripped to lines, one for each block of text in page order. Lines of menus, headers,
footers, sidebars, notices, adverts, forms and comments are no text. Such parts are known by
their tags and by whole names in class, id and role; inside an article only by clear classes
and roles.

Where the page has articles, tags decide: the text is all lines of the articles of the main
flow. Left out are articles that are mostly links and those of under ``SHORT`` characters that
have not ``SHARE`` of the largest one. An article in a part known by names counts if no other
article is there.

In a page without an article window sums decide. A line's weight is its length, that of a
line that is mostly links nothing; weights are summed over windows of ``WINDOW`` neighbouring
lines. A stretch starts where the sums surge from nothing, and ends at the dive back to nothing;
links amid its lines stay. The text goes from the first to the last stretch that holds over
``SHARE`` of the largest, with the shorter ones between.

One page is read at a time, in one pass over its characters; no shuffle.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootscope.llm.common import map_texts, whole_text

WINDOW, SHARE = 3, 0.2
#: Characters from which an article is kept beside any other.
SHORT = 10
ASIDE, SHUT = -1, -2

#: A comment, a declaration, or a tag; quoted values may hold ``>`` while they are not very long.
_MARKUP = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]{0,5000}"|'[^']{0,5000}')*+|[^>]*+)>)""", re.S
)
#: Elements whose content is no text of the page. Without an end tag the first run to the end of the page; of the others, the tag alone is left out.
TO_THE_END = {"script", "style", "textarea", "title"}
NESTED = {"noscript", "template", "iframe", "svg", "canvas", "object", "select", "datalist", "annotation", "annotation-xml"}
SKIPPED = {"nav", "aside", "footer", "form", "menu", "dialog", "button"}
OUTER = {"article", "main", "header", "head", "section", "div", "ul", "ol", "dl", "table", "body", "html", "figure", "figcaption", "blockquote"} | SKIPPED
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr",
}
#: Parts of formulas stand apart in their line.
MATH = {
    "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded",
    "mphantom", "mfenced", "menclose", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mtable", "mtr", "mtd",
}
#: Whole names in class, id and role that mark what is not the article.
_ASIDE = re.compile(
    r"""ads?|advert\w*|sponsor\w*|promo\w*|(?:ad|cookies?|consent|promo|notice|popup|modal|share|sharing|social|newsletter|subscri\w+|signup|login|"""
    r"""search|nav|menu|footer|comments?|related|recommend\w*|sidebar)-(?:notice|banner|bar|box|popup|modal|overlay|buttons?|links?|icons?|list|"""
    r"""area|form|section|widget|wrapper|container|unit|slot|menu|posts|articles|signup|inner)|banner|cookies?|consent|notice|popup|modal|"""
    r"""sidebar|side-bar|breadcrumbs?|menu|nav|navbar|navigation|(?:main|site|top|page|sub|primary|secondary)-(?:nav|navigation|menu|footer|header)|"""
    r"""footer|comments?|replies|respond|disqus|related|recommend\w*|share|sharing|social|newsletter|subscribe|subscription|signup|login|"""
    r"""search|toolbar|pagination|masthead|complementary|contentinfo"""
)
#: Those among the classes and roles that are clear inside an article too, where a name may be a subject of the text.
_CLEAR = re.compile(
    r"""ads?|advert|adverts|advertisement|advertising|adsbygoogle|sponsored|ad-(?:banner|box|container|slot|unit|wrapper)|"""
    r"""(?:cookies?|consent)-(?:notice|banner|bar|popup|overlay)|(?:share|sharing|social|social-share)-(?:bar|buttons?|links?|icons?)|"""
    r"""newsletter-(?:signup|form|box)|comments|comments-area|comments?-(?:list|form)|related-(?:posts|articles)|breadcrumbs?|pagination|navbar|sidebar|"""
    r"""navigation|complementary"""
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in TO_THE_END}
#: Tags of such an element; comments and scripts, that tags in them do not count; and, but for two that may hold a page's parts, edges that none spans.
_NESTED = {
    name: re.compile(
        r"""<!--.*?(?:--!?>|\Z)|<(script|style|textarea|title)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)|"""
        rf"""<(/?)({name}{"" if name in ("noscript", "template") else "|article|main|body"})(?=[\s/>])((?:[^>"']++|"[^"]{{0,5000}}"|'[^']{{0,5000}}')*+|[^>]*+)>""",
        re.I | re.S,
    )
    for name in NESTED
}


def _attributes(text: str) -> dict[str, str]:
    """Lower-case values by name; of equal names the first holds."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), "".join(values).lower())
    return found


def _kind(name: str, attributes: str, in_article: bool) -> int:
    """``SHUT`` if neither it nor an article in it is text, ``ASIDE`` if only articles in it may be, else 0."""
    if name in SKIPPED:
        return ASIDE if name == "form" else SHUT
    own = _attributes(attributes) if attributes else {}
    if own and name not in ("html", "body", "article", "main"):
        classes = own.get("class", "").split()
        unseen = "hidden" in classes and not any(":" in c for c in classes)
        if unseen or "hidden" in own or own.get("aria-hidden") == "true" or _HIDDEN.search(own.get("style", "")):
            return SHUT
        if in_article:
            return ASIDE if any(map(_CLEAR.fullmatch, classes + own.get("role", "").split())) else 0
        if any(map(_ASIDE.fullmatch, classes + own.get("id", "").split() + own.get("role", "").split())):
            return ASIDE
    return ASIDE if name == "header" and not in_article else 0


def _ends(page: str, name: str, at: int) -> dict[int, int]:
    """Where elements of this name end, by the end of their start tag; those without an end tag of their own are left out."""
    ends: dict[int, int] = {}
    open_: list[int] = []
    for mark in _NESTED[name].finditer(page, at):
        if mark[3] is None:
            continue
        if mark[3].lower() != name:
            open_.clear()
        elif not mark[2]:
            if not mark[4].endswith("/"):
                open_.append(mark.end())
        elif open_:
            ends[open_.pop()] = mark.end()
    return ends


def lines(page: str) -> list[tuple[str, int, int, int]]:
    """``(text, length, length of links, article)`` of each block; article 0 is none, -1 and -2 are outside all text.

    Articles inside a part that is marked as no text have numbers below.
    """
    found: list[tuple[str, int, int, int]] = []
    parts: list[str] = []
    linked, link_depth = 0, 0
    # open outer elements with the article they are in
    stack: list[tuple[str, int]] = []
    articles = 0
    ends: dict[str, dict[int, int]] = {}

    def close_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                found.append((text, len(text), linked, stack[-1][1] if stack else 0))
            parts.clear()
        linked = 0

    at = 0
    while at < len(page):
        mark = _MARKUP.search(page, at)
        piece = page[at : mark.start()] if mark else page[at:]
        if piece:
            parts.append(piece)
            if link_depth:
                linked += len(piece)
        if not mark:
            break
        at = mark.end()
        name = mark[2]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                link_depth = 0 if mark[1] else 1
            continue
        if name in MATH:
            parts.append(" ")
            continue
        close_line()
        if name in TO_THE_END:
            if not mark[1] and not mark[3].endswith("/"):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in NESTED:
            if not mark[1] and not mark[3].endswith("/"):
                if name not in ends:
                    ends[name] = _ends(page, name, mark.start())
                at = ends[name].get(at, at)
            continue
        if name == "option":
            # its end tag may be left out, and it holds nothing but text
            if not mark[1]:
                following = _MARKUP.search(page, at)
                at = following.start() if following else len(page)
            continue
        if name not in OUTER:
            continue
        if mark[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif not mark[3].endswith("/"):
            inside = stack[-1][1] if stack else 0
            if inside != SHUT:
                kind = _kind(name, mark[3], inside not in (0, ASIDE))
                if name in ("article", "main") and inside in (0, ASIDE):
                    articles += 1
                    inside = SHUT - articles if inside else articles
                elif kind:
                    inside = kind
            stack.append((name, inside))
            link_depth = 0
    close_line()
    return found


def _surges(weight: list[int]) -> list[tuple[int, int]]:
    """From each surge to its dive: stretches whose window sums stay above nothing, without the weightless ends."""
    sums = [sum(weight[i : i + WINDOW]) for i in range(len(weight))]
    stretches, start = [], None
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i
        elif not s and start is not None:
            while not weight[start]:
                start += 1
            stretches.append((start, i))
            start = None
    return stretches


def _chosen(found: list[tuple[str, int, int, int]]) -> set[int]:
    """Articles of the main flow, but for lists of links and such as are both short and small beside the largest."""
    totals: dict[int, int] = {}
    links: dict[int, int] = {}
    for _, size, linked, article in found:
        if article > 0:
            totals[article] = totals.get(article, 0) + size
            links[article] = links.get(article, 0) + linked
    most = max(totals.values(), default=0)
    return {a for a, t in totals.items() if t == most or (2 * links[a] <= t and (t >= SHARE * most or t >= SHORT))}


def main_text(page: str) -> str:
    found = lines(page)
    articles = _chosen(found)
    if not articles:
        weight = [size if article == 0 and 2 * linked <= size else 0 for _, size, linked, article in found]
        # an article in a marked part counts if it is more than all that is unmarked
        totals: dict[int, int] = {}
        for _, size, _, article in found:
            if article < SHUT:
                totals[article] = totals.get(article, 0) + size
        best = max(totals, key=lambda a: (totals[a], a), default=0)
        if best and totals[best] > sum(weight):
            articles = {best}
    if articles:
        return " ".join(text for text, _, _, article in found if article in articles)
    stretches = _surges(weight)
    most = max((sum(weight[a:b]) for a, b in stretches), default=0)
    large = [k for k, (a, b) in enumerate(stretches) if sum(weight[a:b]) >= SHARE * most]
    kept = stretches[large[0] : large[-1] + 1] if large else []
    return " ".join(found[i][0] for a, b in kept for i in range(a, b) if found[i][3] == 0)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every row.

    A null or empty page, or one without text, gives an empty text. Character references are
    decoded once, white space in a block becomes one space, and blocks are joined by one space.
    Repeated rows give repeated results, an empty table none; other columns are not read.
    """
    rows = pages.select("page_id", "url", whole_text("html").alias("text"))
    renamed = rows.select("page_id", "url", "text")
    found = map_texts(renamed, ["page_id", "url"], lambda b: {"main": pa.array([main_text(p) for p in b], pa.string())}, "main string")
    return found.select("page_id", "url", F.col("main").alias("text"), F.length("main").cast("bigint").alias("n_chars"))
