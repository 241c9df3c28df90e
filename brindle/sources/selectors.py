"""Fields of listing pages by CSS selectors, from the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator, Mapping
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:=[\"']?[^\"'\]]*[\"']?)?\])*)$", re.I)
_PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def parse(selector: str) -> tuple[list[tuple[str, list]], str | None]:
    """Steps (name, conditions) of a selector with blanks between them, and the attribute that "@name" at its end asks for."""
    path, _, attribute = selector.partition("@")
    steps = []
    for word in path.split():
        m = _STEP.match(word)
        if m is None:
            raise ValueError(f"not a selector: {selector}")
        steps.append(((m[1] or "*").lower(), _PART.findall(m[2])))
    if not steps:
        raise ValueError(f"not a selector: {selector}")
    return steps, attribute or None


def _fits(step: tuple[str, list], tag: str, attrs: dict[str, str]) -> bool:
    name, conditions = step
    if name not in ("*", tag):
        return False
    for sign, word, attribute, value in conditions:
        if sign == "." and word not in attrs.get("class", "").split() or sign == "#" and attrs.get("id") != word:
            return False
        if attribute and (attribute not in attrs or value and attrs[attribute] != value):
            return False
    return True


class _Fields(HTMLParser):
    """The first match of each selector in one pass; an element knows for each selector how many steps are met at it."""

    def __init__(self, selectors: list[tuple[list, str | None]]) -> None:
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.open: list[tuple[str, list[int]]] = [("", [0] * len(selectors))]
        self.depth: dict[str, int] = {}
        self.found: list[str | None] = [None] * len(selectors)
        self.reading: dict[int, tuple[int, list[str]]] = {}  # selector -> depth of its element, and its text

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own, met = {k: v or "" for k, v in attrs}, list(self.open[-1][1])
        for i, (steps, attribute) in enumerate(self.selectors):
            if not _fits(steps[min(met[i], len(steps) - 1)], tag, own):
                continue
            if met[i] + 1 < len(steps):
                met[i] += 1
            elif self.found[i] is None and i not in self.reading:
                if attribute:
                    self.found[i] = own.get(attribute)
                elif tag not in VOID:
                    self.reading[i] = (len(self.open), [])
        if tag not in VOID:
            self.open.append((tag, met))
            self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.depth.get(tag):
            return
        while True:
            name, _ = self.open.pop()
            self.depth[name] -= 1
            self._close()
            if name == tag:
                return

    def _close(self) -> None:
        for i, (depth, parts) in list(self.reading.items()):
            if depth >= len(self.open):
                self.found[i] = " ".join("".join(parts).split()) or None
                del self.reading[i]

    def handle_data(self, data: str) -> None:
        for _, parts in self.reading.values():
            parts.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        at = self.rawdata.find(">", i)
        return at + 1 if at >= 0 else len(self.rawdata)


def fields(html: str | None, selectors: list[tuple[list, str | None]], references: Collection[str] | None = None) -> list[str | None]:
    """The text (or attribute) of the first element of each selector, with white space as one blank; null without one or if it's empty.

    references names the character references that are decoded, such as "amp" for "&amp;"; all of HTML's if it's null.
    """
    page, html, stands = _Fields(selectors), html or "", None
    if references is not None:  # the signs before all others pass the parser as one that the page hasn't
        stands = next(c for c in map(chr, range(0xF0000, 0xFFFFE)) if c not in html)
        html = re.sub("&(?!(?:" + "|".join(map(re.escape, references)) + ");)" if references else "&", stands, html)
    page.feed(html)
    page.close()
    while len(page.open) > 1:
        page.open.pop()
        page._close()
    return page.found if stands is None else [f and f.replace(stands, "&") for f in page.found]


def select(html: Column, selectors: Mapping[str, str], references: Collection[str] | None = None) -> Column:
    """A struct with a text for each named selector, such as "article h1", ".job #pay", "a[rel=next]@href"; for references see fields()."""
    parsed = [parse(s) for s in selectors.values()]
    names = list(selectors)

    @F.pandas_udf(", ".join(f"`{n}` string" for n in names))
    def found(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in pages:
            yield pd.DataFrame([fields(h, parsed, references) for h in x], columns=names, dtype=object)

    return found(html)
