"""Main text of web pages from a streaming parser's events.

The parser's events become lines: one for each block element, with its text, the tags that met it, its links, and the
element that it is in. Lines inside navigation, headers, footers, asides, forms, scripts, notices, adverts and comments are
set aside. The ratio of text to tags of each other line is smoothed with a Gaussian, and lines above a threshold (the
standard deviation of the smoothed ratios) form the clusters of text, which select the content region.

Where a page marks its text as an article, that is the region: every article and main element, of any size, but teasers of
other pages. An article is a teaser if its class says so. So is one beside an article of the page's own whose heading links
elsewhere and that has no line in a cluster. Where no article is marked, the region is all around the clusters but groups
without a line in them that are menus or footers by their links and words. Every line of the region is content, so that short
paragraphs, headings and lists are never lost.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("head script style noscript template nav footer aside form button select textarea iframe object svg canvas audio video menu dialog title option label input".split())
_REGION = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = _BLOCKS - {"html", "body", "option", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
_SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd", ("dl",)), "dt": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("th", ("tr",)), "option": ("option", ("select",))}
_NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|masthead|footer|sidebar|side|aside|related|widget|comment|comments|disqus|replies|cookie|cookies|consent|notice|notices|popup|modal|newsletter|subscribe|share|sharing|social|pagination|pager|login|signup|search|skip)(?:$|[\s_-])", re.I)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comment|comments|disqus|reply|replies)(?:$|[\s_-])", re.I)
_TEASER = re.compile(r"(?:^|\s)(?:(?:article|post|story|news|node)(?:--view-mode)?[_-]+)?teasers?(?:$|[\s_-])", re.I)
_TAG = re.compile(r"<([a-zA-Z][^\t\n\r\f />\x00]*)")
_COMMENT_END = re.compile("--!?>")
_SIGNS = re.compile(r"[\W_]+")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


class _Line(NamedTuple):
    text: str
    tags: int  # tags met since the line before
    at: int  # the element that it ends in
    links: int  # links to other pages
    linked: int  # letters and digits in them


class _Lines(HTMLParser):
    """Lines, and of each element its parent and the region around it. Every event costs a bounded number of steps, however deep the elements are nested."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # tag, number, set aside
        self.open: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is
        self.parent = [0]
        self.region = [0]  # the nearest article or main around or at each element
        self.articles: set[int] = set()
        self.lines: list[_Line] = []
        self.teasers: set[int] = set()  # articles named so
        self.headed: set[int] = set()  # articles whose heading is a link to another page
        self.text: list[str] = []
        self.tags = self.links = self.linked = 0
        self.sections = True
        self.closing: tuple[int, int] | None = None  # the length of what is read, and where its last tag can end

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't used

    # What isn't closed before the page's end: read once, and not again from each of its characters.

    def parse_comment(self, i: int, report: bool = True) -> int:
        found = _COMMENT_END.search(self.rawdata, i + 4)
        return found.end() if found else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        if self.rawdata.startswith("<![CDATA[", i) and self.sections:
            if (k := self.rawdata.find("]]>", i)) >= 0:
                return k + 3
            self.sections = False
        return self.parse_pi(i)

    def parse_pi(self, i: int) -> int:
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        k = super().parse_endtag(i)
        return k if k >= 0 else len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        if self.closing is None or self.closing[0] != len(self.rawdata):
            self.closing = len(self.rawdata), self.rawdata.rfind(">")
        if i > self.closing[1]:
            return len(self.rawdata)
        k = super().parse_starttag(i)
        if k < 0:  # a quote that nothing ends
            k = self.rawdata.find(">", i) + 1
            tag = _TAG.match(self.rawdata, i)[1].lower()
            self.handle_starttag(tag, [])
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)
        return k

    def flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                self.lines.append(_Line(line, self.tags, self.stack[-1][1] if self.stack else 0, self.links, self.linked))
                self.tags = self.links = self.linked = 0
            self.text = []

    def _cut(self, k: int) -> None:
        """Close the element at k of the stack and all inside it."""
        while len(self.stack) > k:
            self.open[self.stack.pop()[0]].pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self.flush()
        self.tags += 1
        if tag in _CLOSES_P:
            self._close("p", ("button", "td", "th", "table", "article", "section", "div"))
        if tag in _SIBLINGS:
            self._close(*_SIBLINGS[tag])
        if tag in _VOID:
            if tag == "br":
                self.text.append(" ")
            return
        around = self.stack[-1][1] if self.stack else 0
        aside = bool(self.stack) and self.stack[-1][2]
        out = aside or tag in _SKIP
        given = dict(attrs) if attrs else {}
        if given and not out:
            out = self._marked(tag, given)
        if tag == "header" and not out:  # a page's header; an article's own holds its title
            out = not self.region[around]
        if tag == "body" and aside:  # a head that was never closed
            out, around = False, 0
            self._cut(0)
        number = len(self.parent)
        self.parent.append(around)
        self.region.append(number if tag in _REGION else self.region[around])
        self.open[tag].append(len(self.stack))
        self.stack.append((tag, number, out))
        if tag == "a":
            self.links += not out and (given.get("href") or "#")[0] != "#"
        elif tag == "article":
            self.articles.add(number)
            if _TEASER.search(given.get("class") or ""):
                self.teasers.add(number)

    def _marked(self, tag: str, given: dict[str, str | None]) -> bool:
        if tag in ("html", "body"):
            return False
        if "hidden" in given or (given.get("aria-hidden") or "").lower() == "true" or (given.get("role") or "").lower() in _ROLES:
            return True
        named = " ".join(filter(None, (given.get("class"), given.get("id"))))
        return bool(named and (_COMMENTS if tag in _REGION else _NAMES).search(named))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _last(self, tag: str) -> int:
        at = self.open.get(tag)
        return at[-1] if at else -1

    def _close(self, tag: str, fence: tuple[str, ...]) -> None:
        k = self._last(tag)
        if k >= 0 and k > max(map(self._last, fence)):
            self._cut(k)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.flush()
        self.tags += 1
        if (k := self._last(tag)) >= 0:
            self._cut(k)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][2]:
            return
        if self.links and self._last("a") >= 0 and data.strip():
            self.linked += len(_SIGNS.sub("", data))
            if max(map(self._last, _HEADINGS)) >= 0 and not any(t.strip() for t in self.text) and (k := self._last("article")) >= 0:
                self.headed.add(self.stack[k][1])
        self.text.append(data)


def _smooth(values: list[float], radius: int) -> list[float]:
    weights = [math.exp(-(k * k) / (2.0 * radius * radius)) for k in range(-2 * radius, 2 * radius + 1)]
    out = []
    for i in range(len(values)):
        top = under = 0.0
        for k, w in enumerate(weights, i - 2 * radius):
            if 0 <= k < len(values):
                top, under = top + w * values[k], under + w
        out.append(top / under)
    return out


def clusters(lines: list[_Line], radius: int) -> list[bool]:
    """Which lines are in clusters of text: those whose smoothed ratio of text to tags reaches the ratios' standard deviation, or the largest of them."""
    ratios = _smooth([len(x.text) / max(1, x.tags) for x in lines], radius)
    mean = sum(ratios) / len(ratios)
    limit = min(math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)), max(ratios))
    return [r >= limit for r in ratios]


def _apart(parser: _Lines, inside: list[bool]) -> list[bool]:
    """Which lines are in menus or footers that nothing names.

    A group is a largest element, or a line by itself, without a line in a cluster. It is a menu if all its lines are
    mostly links to other pages and it has three or more, and a footer if it comes after the last line in a cluster and begins
    with a copyright mark. Everything else is text, however short.
    """
    holds = [False] * len(parser.parent)
    for x, yes in zip(parser.lines, inside, strict=True):
        e = x.at
        while yes and not holds[e]:
            holds[e] = True
            e = parser.parent[e]
    root = [0] * len(holds)
    for e in range(1, len(holds)):
        up = parser.parent[e]
        root[e] = e if not holds[e] and holds[up] else root[up]
    last = max((k for k, yes in enumerate(inside) if yes), default=-1)
    groups: dict[tuple[int, int], list[int]] = defaultdict(list)
    before = -1
    for k, (x, yes) in enumerate(zip(parser.lines, inside, strict=True)):
        if not yes:
            if holds[x.at]:  # a line by itself: with its neighbours that are so, too
                before = before if before >= 0 else k
                groups[(0, before)].append(k)
                continue
            groups[(root[x.at], -1)].append(k)
        before = -1
    out = [False] * len(inside)
    for rows in groups.values():
        mine = [parser.lines[k] for k in rows]
        menu = sum(x.links for x in mine) >= 3 and all(x.linked >= 0.8 * len(_SIGNS.sub("", x.text)) for x in mine)
        if menu or (rows[0] > last and _RIGHTS.match(mine[0].text)):
            for k in rows:
                out[k] = True
    return out


def _teasers(parser: _Lines, inside: list[bool]) -> set[int]:
    """Articles that only point to other pages: named so or, beside an article that is neither, headed by a link and without a line in a cluster."""
    with_lines = {parser.region[x.at] for x in parser.lines}
    doubtful = (with_lines & parser.articles & parser.headed) - parser.teasers
    if not doubtful or with_lines & parser.articles <= parser.teasers | doubtful:
        return parser.teasers
    return parser.teasers | (doubtful - {parser.region[x.at] for x, yes in zip(parser.lines, inside, strict=True) if yes})


def extract(html: str | None, radius: int = 1) -> str:
    """The main text; empty for a null or empty page, or one without content lines.

    Repeated lines stay. Pages that end early, leave elements open or close what was never opened are read as far as they go.
    Time is linear in the page's length, however deep its elements are nested.
    """
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    inside = clusters(lines, radius)
    regions = {parser.region[x.at] for x in lines} - {0}
    teasers = _teasers(parser, inside) if regions & parser.articles else set()
    # of each region whether a teaser holds it, and whether one that counts does; outer ones have smaller numbers
    state: dict[int, tuple[bool, bool]] = {0: (False, False)}
    for r in range(1, len(parser.parent)) if regions else ():
        if parser.region[r] == r:
            dull, good = state[parser.region[parser.parent[r]]]
            state[r] = (dull or r in teasers, good or r not in teasers)
    chosen = [state[parser.region[x.at]] for x in lines] if regions else []
    if any(good and not dull for dull, good in chosen):
        keep = [good and not dull for dull, good in chosen]
    else:
        keep = [True] * len(lines)
    if not any(k and parser.region[x.at] in parser.articles for k, x in zip(keep, lines, strict=True)):
        keep = [k and not a for k, a in zip(keep, _apart(parser, inside), strict=True)]
    return "\n".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", radius: int = 1) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars. Null ids and urls stay null; repeated rows stay; other columns are not read. One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), radius) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_text(pages: DataFrame) -> DataFrame:
    return main_text(pages)
