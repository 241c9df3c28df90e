"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. Text gathers in lines, one for each
block of the page; each line knows how many tags stand in it, how much of it is links, and the
element it stands in. A line's ratio is its unlinked text by its tags. Names weigh on it: parts
that HTML or a whole class name calls an advert, a menu, comments and the like weigh nothing,
parts with a doubtful name a fifth, and parts called article or main double.

No ratio counts for more than the median of lines as long as a sentence, so that one very long
paragraph doesn't raise the threshold over others, or its neighbours over it. The weighted
ratios are smoothed by a Gaussian within each part. Lines over a threshold are content, and
cluster: lines between them, beside them in the same box, between boxes of one parent that have
them, or in the article that they are in belong to their region. Nothing but the ratio tells
content from the rest where a page has no names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(
    "script style noscript template head title svg math canvas object iframe audio video map select textarea button"
    " datalist noframes noembed applet".split()
)
ASIDE = frozenset("nav footer aside dialog search".split())
#: Asides unless they hold most of the page's text, as where a server wraps the whole page in a form.
HOLDERS = frozenset("form fieldset menu".split())
#: Elements that are boxes if they hold other blocks; text-level blocks belong to the box around them.
BOXES = frozenset("address article body center details dialog div dir fieldset form frameset html main menu section td th".split())
#: Elements whose end isn't written; a new one of the group ends the open one.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
#: Where a search for an open element of CLOSES stops.
SCOPES = frozenset("ul ol dl table select article section div body nav main aside header footer form menu".split())
MAIN_ROLES = frozenset({"main", "article"})
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Words of class and id that say a part isn't the article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot adunit banner banners sponsor sponsored sponsors"
    " promo promos promotion promotions sidebar sidebars sidenav topnav subnav mainnav cookie cookies cookiebar consent gdpr popup modal"
    " newsletter signup paywall comment comments commentlist disqus replies respond breadcrumb breadcrumbs nav navbar navigation footer"
    " masthead pagination pager toolbar login".split()
)
#: Words that may say so.
DOUBTFUL_WORDS = frozenset(
    "notice notices overlay rail related recommended recommendations reply share sharing skip social subscribe subscription menu menus toc widget"
    " widgets".split()
)
#: Words that say where or of what kind a part is; a name of these and aside words alone is that of an aside.
PLACE_WORDS = frozenset(
    "area article articles bar block blog body bottom box btn button buttons col column container content entry form global group icon icons inner"
    " item items left link links list main message module outer page panel post posts reader right section site slot story text thread title top unit user"
    " wrap wrapper".split()
)
#: The whole of a class or id that names the page's header.
HEADERS = frozenset({"header", "siteheader", "pageheader", "topbar", "topheader", "globalheader"})
MAIN_WORDS = re.compile(
    r"^(?:(?:post|article|entry|story|main|page)[-_]?(?:content|body|text)|articlebody|content|article|post|entry|story|main)$", re.I
)

SIGMA = 1.0
#: Lines count as content from this share of the ratios' mean.
SHARE = 0.5
#: Unlinked characters of a line that tell how long the page's lines of text are; no ratio counts for more than their median.
SENTENCE = 40
#: A line that its neighbours lift over the threshold has at least this share of the largest ratio by itself.
OWN = 0.1
#: What names weigh: none for asides, and these for doubtful names and for what is called article or main.
DOUBTFUL, MAIN = 0.2, 2.0
#: Lines between two clusters that are still one, at most.
GAP = 2


@dataclass(slots=True)
class Line:
    """A block's text and what the ratio needs."""

    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    node: int = 0
    text: str = ""


@dataclass(slots=True)
class Node:
    """An element that is or could be a part of its own: its place in the tree, and what it says. -1 is no element."""

    tag: str
    up: int = -1
    aside: bool = False
    main: bool = False  # it, or an element around it
    named: int = -1  # the innermost element called article or main
    doubtful: int = -1  # the innermost element of a doubtful name
    holder: int = -1  # the innermost form, fieldset or menu
    blocks: bool = False


class PageLines(HTMLParser):
    """Lines of a page in order, with the tree of elements that they stand in. Every step takes constant time over the whole page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.nodes = [Node("")]
        self.open: list[tuple[str, int]] = [("", 0)]
        self.places: dict[str, list[int]] = {}  # of each name, its places in open
        self.scopes: list[int] = []
        self.silent = self.links = 0
        self.line = Line()
        self.no_end: set[str] = set()

    def read(self, html: str) -> list[Line]:
        self.last = html.rfind(">")
        self.feed(html)
        self.close()
        self._cut()
        return self.lines

    # What is cut off by the page's end, or only looks like a declaration, is skipped.

    def _to(self, mark: str, i: int) -> int:
        at = -1 if mark in self.no_end else self.rawdata.find(mark, i)
        if at < 0:
            self.no_end.add(mark)
            return -1
        return at + len(mark)

    def parse_starttag(self, i: int) -> int:
        return len(self.rawdata) if i > self.last else super().parse_starttag(i)

    def parse_endtag(self, i: int) -> int:
        return len(self.rawdata) if i > self.last else super().parse_endtag(i)

    def parse_comment(self, i: int, report: bool = True) -> int:
        if self.rawdata.startswith((">", "->"), i + 4):  # an empty comment
            return self.rawdata.index(">", i) + 1
        at = self._to("-->", i + 4)
        return at if at >= 0 else len(self.rawdata)

    def parse_pi(self, i: int) -> int:
        return len(self.rawdata) if i > self.last else self.rawdata.index(">", i) + 1

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<![CDATA[", i) and (at := self._to("]]>", i)) >= 0:
            return at
        return self.parse_pi(i)

    def _cut(self) -> None:
        line = self.line
        line.text = " ".join("".join(line.parts).split())
        if line.text:
            self.lines.append(line)
            self.line = Line()
        else:
            self.line = Line(tags=line.tags)  # tags without text weigh on what follows

    def _named(self, attrs: dict[str, str | None]) -> tuple[bool, bool, bool]:
        """Whether an element's attributes say aside, main, or perhaps aside."""
        role = (attrs.get("role") or "").lower()
        if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return True, False, False
        style = (attrs.get("style") or "").lower().replace(" ", "")
        if "display:none" in style or "visibility:hidden" in style:
            return True, False, False
        aside, doubtful = role in ASIDE_ROLES, False
        main = role in MAIN_ROLES or "articlebody" in (attrs.get("itemprop") or "").lower()
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
            words = {w for w in map(str.lower, _WORDS.findall(name)) if not w.isdigit()} - PLACE_WORDS
            if MAIN_WORDS.match(name):
                main = True
            elif words and words <= ASIDE_WORDS or name.lower().replace("-", "").replace("_", "") in HEADERS:
                aside = True
            elif words and words <= ASIDE_WORDS | DOUBTFUL_WORDS:
                doubtful = True
        return aside and not main, main, doubtful and not main

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.line.parts.append(" ")
        if tag in CLOSES:
            self._close_open(CLOSES[tag])
        if tag in BLOCKS:
            if self.open[-1][0] == "p" or tag == "p":
                self._close_open(("p",))
            self._cut()
            self.nodes[self.open[-1][1]].blocks = True
        self.line.tags += 1
        if tag in VOID:
            return
        up = self.open[-1][1]
        around = self.nodes[up]
        aside, main, doubtful = tag in ASIDE, False, False
        if tag == "header":
            aside = not around.main  # of the page, not of an article
        if attrs and tag not in SILENT and tag not in ("html", "body"):
            named, main, doubtful = self._named(dict(attrs))
            aside = aside or named
        main = (main or tag in ("article", "main")) and not aside
        here = up
        if aside or main or doubtful or tag in BOXES or tag in HOLDERS:
            here = len(self.nodes)
            self.nodes.append(
                Node(
                    tag, up, aside or around.aside, main or around.main, here if main else around.named,
                    here if doubtful else around.doubtful, here if tag in HOLDERS else around.holder,
                )
            )
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in SCOPES:
            self.scopes.append(len(self.open))
        self.open.append((tag, here))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def _last(self, names: tuple[str, ...]) -> int:
        """The place of the innermost open element of the names; 0 without one."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def _close_open(self, names: tuple[str, ...]) -> None:
        place = self._last(names)
        if place > (self.scopes[-1] if self.scopes else 0):
            self._pop(place)

    def _pop(self, place: int) -> None:
        """Close the element at a place, and all that is open within."""
        if any(tag in BLOCKS for tag, _ in self.open[place:]):
            self._cut()
        for tag, _ in self.open[place:]:
            self.places[tag].pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        del self.open[place:]
        while self.scopes and self.scopes[-1] >= place:
            self.scopes.pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        if tag in VOID:
            return
        place = self._last((tag,))
        if place:
            # a stray end doesn't close the block it stands in
            if tag in BLOCKS or place > (self.scopes[-1] if self.scopes else 0):
                self._pop(place)
        elif tag == "p":
            self._cut()

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        self.line.parts.append(data)
        if data.strip():
            self.line.node = self.open[-1][1]
            if self.links:
                self.line.linked += len(data)


def smooth(values: np.ndarray, part: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing of each value with those of its own part that stand near; the weights that are there count alone."""
    total, whole = values.copy(), np.ones(len(values))
    for by in range(1, max(1, round(3 * sigma)) + 1):
        k = np.exp(-0.5 * (by / sigma) ** 2)
        same = part[by:] == part[:-by]
        total[by:] += k * same * values[:-by]
        total[:-by] += k * same * values[by:]
        whole[by:] += k * same
        whole[:-by] += k * same
    return total / whole


def weights(lines: list[Line], nodes: list[Node]) -> np.ndarray:
    """What each line's names weigh. A form, fieldset or menu weighs nothing unless it holds most of the unlinked text that weighs."""
    own = [0.0 if n.aside else DOUBTFUL if n.doubtful > n.named else MAIN if n.main else 1.0 for n in nodes]
    held = [0] * len(nodes)
    for x in lines:
        held[x.node] += max(0, len(x.text) - x.linked) if own[x.node] else 0
    for i in range(len(nodes) - 1, 0, -1):
        held[nodes[i].up] += held[i]
    for i, n in enumerate(nodes[1:], 1):
        if n.holder == i and held[i] * 2 <= held[0] or n.holder >= 0 and not own[n.holder]:
            own[i] = 0.0
    return np.array([own[x.node] for x in lines])


def content_lines(lines: list[Line], nodes: list[Node], weight: np.ndarray, sigma: float = SIGMA, share: float = SHARE) -> np.ndarray:
    """Whether each line's smoothed ratio, as weighted by names, is over the threshold."""
    out = np.zeros(len(lines), bool)
    on = np.flatnonzero(weight)
    if not len(on):
        return out
    ratio = np.array([weight[i] * max(0, len(lines[i].text) - 2 * lines[i].linked) / max(1, lines[i].tags) for i in on])
    texts = ratio[[len(lines[i].text) - lines[i].linked >= SENTENCE for i in on]]
    level = np.minimum(ratio, np.median(texts)) if len(texts) else ratio
    smoothed = smooth(level, np.array([nodes[lines[i].node].doubtful for i in on]), sigma)
    out[on] = (smoothed >= share * smoothed.mean()) & (smoothed > 0) & (level >= OWN * level.max())
    return out


def regions(lines: list[Line], nodes: list[Node], weight: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Whether each line is in a region: it is content, or belongs to content by place.

    A line belongs to content if it stands in an article or main part with most of the
    content, directly in a box that has content of its own, or between two content lines that
    are at most GAP lines apart. A line that isn't mostly links also belongs if its box stands
    between two boxes of the same parent that have content of their own. Lines that weigh
    nothing never belong, and lines of a part with a doubtful name belong to content of that
    part alone. Where no line is content, unlinked or not, all that an article or main part
    has is its region.
    """
    if not content.any():
        return np.array([w > 0 and nodes[x.node].named >= 0 and nodes[x.node].doubtful <= nodes[x.node].named for x, w in zip(lines, weight, strict=True)], bool)
    mass, boxed = [0] * len(nodes), [False] * len(nodes)
    box = [0] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        box[i] = i if n.tag in BOXES and n.blocks else box[n.up]
    around = [box[n.up] if i and box[i] == i else -1 for i, n in enumerate(nodes)]  # of each box, the one it stands in
    row: dict[int, tuple[int, int]] = {}  # of each parent, the first and last content directly in a box of its own
    for i, (x, c) in enumerate(zip(lines, content, strict=True)):
        if c:
            mass[x.node] += len(x.text)
            boxed[box[x.node]] = True
            parent = around[box[x.node]]
            row[parent] = (row.get(parent, (i, i))[0], i)
    for i in range(len(nodes) - 1, 0, -1):
        mass[nodes[i].up] += mass[i]
    meant = [False] * len(nodes)
    for kinds in (("article",), None):  # what the page calls article goes before what it calls main
        within, top = [False] * len(nodes), 0
        for i, n in enumerate(nodes[1:], 1):
            part = n.named == i and mass[i] > 0 and (kinds is None or n.tag in kinds)
            within[i] = within[n.up] or part
            top += mass[i] if part and not within[n.up] else 0
        if top and top * 2 >= mass[0]:
            meant = within
            break
    out = content.copy()
    last, since = -1, 0
    for i, x in enumerate(lines):
        n = nodes[x.node]
        if content[i]:
            if last >= 0 and 0 < since <= GAP:
                for j in range(last + 1, i):
                    out[j] = out[j] or weight[j] > 0 and nodes[lines[j].node].doubtful == n.doubtful == nodes[lines[last].node].doubtful
            last, since = i, 0
        elif weight[i]:
            since += 1
            own = n.doubtful < 0 or mass[n.doubtful] > 0
            before, after = row.get(around[box[x.node]], (i, i)) if 2 * x.linked <= len(x.text) else (i, i)
            out[i] = out[i] or own and (meant[x.node] or boxed[box[x.node]] or before < i < after)
    return out


def main_text(html: str | None) -> str:
    """The blocks of the page's main text, joined by an empty line."""
    page = PageLines()
    lines = page.read(html or "")
    weight = weights(lines, page.nodes)
    kept = regions(lines, page.nodes, weight, content_lines(lines, page.nodes, weight))
    return "\n\n".join(x.text for x, k in zip(lines, kept, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """pages with the main text (empty if none) and its number of code points; all rows and columns stay.

    Null and empty pages have an empty text. Broken markup is read as far as the parser makes
    sense of it; what the page's end cuts off is skipped. Time grows with the page's length,
    whatever its nesting. Lines whose ratios tie at the threshold are content. Columns of the
    results' names are replaced. Each page is read by itself, so repeated rows come out alike,
    and an empty table gives none.
    """

    @F.pandas_udf("string")
    def text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in pages:
            yield pd.Series([main_text(h) for h in x], dtype=object)

    return pages.withColumn(text_col, text(F.col(html_col).cast("string"))).withColumn(
        chars_col, F.length(text_col).cast("long")
    )
