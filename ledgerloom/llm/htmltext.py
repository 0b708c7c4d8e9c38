"""Main text of web pages: parser events to lines, text-to-tag ratios, smoothing and threshold clusters.

The standard library's parser streams events; text between block tags becomes a line that knows
its tags, its linked characters and the elements around it.  A line's ratio is its unlinked text for
each tag; linked text counts little.  Names of elements and classes act on ratios alone: inside
elements that never hold an article (navigation, forms, adverts, comments, ...) each character
brings tags with it, so that no line there reaches the floor; where an ``article`` or ``main`` holds
most of the area under the ratios, so it is outside, and lines inside have its mean ratio at least.

A Gaussian smooths the ratios over neighbouring lines of the same surroundings: what lies in
another container, in another marked element or in a list of links is too far away to lend its
ratio.  Lines whose smoothed ratio reaches the threshold and the floor form clusters, one for each
run of lines of the same surroundings.  The clusters with a large area under their ratios choose the
content region, which is the innermost element with most of that area, and the clustered lines of
the region are the main text.  Short lines beside long ones are lifted by them and stay; nothing
else is dropped.

Defined results: null or empty html gives an empty text; so does a page without unmarked text;
broken markup is read as the parser reads it; a page of any length or depth is read whole, in time
proportional to it; repeated rows are extracted again, each on its own row.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

#: Spread of the smoothing in lines; share of the mean ratio, and characters for each tag, that a clustered line reaches.
SIGMA, THRESHOLD, FLOOR = 1.0, 0.05, 0.5
#: Share of the largest cluster's area that makes a cluster large, and of the large clusters' area that makes a region; what lines in a row lend each other.
LARGE, REGION, LENT = 0.5, 0.9, 2.0
#: What a linked character counts; the share of linked characters that makes a line a link; lines that surroundings part by; tags for each character where names say so.
LINKED, MOSTLY, APART, NAMED = 0.05, 0.8, 10.0, 100.0

# Elements and words of class names, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("head script style noscript template svg canvas iframe object audio video math map".split())
BOILERPLATE = frozenset("nav footer aside form button select textarea dialog menu fieldset".split())
HOLDERS = frozenset("article main".split())
NEVER_MARKED = frozenset("html body article main".split())
CONTAINERS = frozenset("html body article main div section aside nav header footer form td th fieldset details".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promoted promotion banner banners cookie cookies consent gdpr notice notices disclaimer alert popup modal overlay sidebar sidebars rail comment comments commentlist reply replies respond disqus discussion menu menus nav navbar navigation breadcrumb breadcrumbs related recommended recommendations share sharing social newsletter subscribe subscription signup login footer foot bottom header masthead topbar search pagination pager widget widgets toolbar toc copyright".split()
)
MASTHEADS = frozenset("header masthead banner".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
_PARTS = re.compile(r"[A-Za-z]+")
_WITHOUT = frozenset("no has with without is".split())


class Element:
    __slots__ = ("block", "free", "holder", "name", "number", "up", "why")

    def __init__(self, name: str, number: int, up: Element | None, why: str):
        self.name, self.number, self.up, self.why = name, number, up, why
        self.holder = name in HOLDERS or bool(up and up.holder)
        #: the nearest element that is not inline, and the nearest that no boilerplate element holds
        self.block = up.block if up and name in INLINE else self
        self.free = up.free if up and why == "boilerplate" else self


class Line:
    __slots__ = ("element", "linked", "parts", "tags")

    def __init__(self, element: Element):
        self.element, self.parts, self.tags, self.linked = element, [], 1, 0


class Lines(HTMLParser):
    """Collects the lines of a page in page order; text of scripts, styles and the like is never one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = Element("", 0, None, "")
        self.elements = [self.at]
        self.open: Counter[str] = Counter()
        self.lines: list[Line] = []
        self.line: Line | None = None

    def _leave(self, to: Element) -> None:
        while self.at is not to:
            self.open[self.at.name] -= 1
            self.at = self.at.up

    def _mark(self, name: str, attrs: list) -> str:
        """Why the text of an element is no article text: '' if it may be."""
        if name in SILENT:
            return "silent"
        if name in NEVER_MARKED:
            return ""
        if name in BOILERPLATE or name == "header" and not self.at.holder:
            return "boilerplate"
        for key, value in attrs:
            value = (value or "").lower()
            if key == "role" and value.strip() in ROLES:
                return "boilerplate"
            if key == "hidden" or key == "style" and "display:none" in value.replace(" ", "") or key == "aria-hidden" and value == "true":
                return "boilerplate"
            if key in ("class", "id"):
                for word in value.split():
                    parts = _PARTS.findall(word)
                    for part in {*parts[:1], *parts[-1:]} & MARKS if parts and not (len(parts) > 1 and parts[0] in _WITHOUT) else ():
                        if part not in MASTHEADS or not self.at.holder:
                            return "boilerplate"
        return ""

    def handle_starttag(self, name: str, attrs: list) -> None:
        if name in BLOCKS:
            self.line = None
        if name in VOID:
            if self.line:
                self.line.tags += 1
            return
        if name in HOLDERS:  # an article is never inside an element that someone forgot to close
            self._leave(self.at.free)
        elif name in ("p", "li") and self.at.block.name == name:
            self._leave(self.at.block.up)
        self.at = Element(name, len(self.elements), self.at, self.at.why or self._mark(name, attrs))
        self.elements.append(self.at)
        self.open[name] += 1
        if self.line:
            self.line.tags += 1

    def handle_startendtag(self, name: str, attrs: list) -> None:
        self.handle_starttag(name, attrs)
        if name not in VOID:
            self.handle_endtag(name)

    def handle_endtag(self, name: str) -> None:
        if name in BLOCKS:
            self.line = None
        elif self.line:
            self.line.tags += 1
        if self.open[name]:
            while self.at.name != name:
                self._leave(self.at.up)
            self._leave(self.at.up)

    def handle_data(self, data: str) -> None:
        if self.at.why == "silent":
            return
        if self.line is None:
            if data.isspace():
                return
            self.line = Line(self.at)
            self.lines.append(self.line)
        self.line.parts.append(data)
        if self.open["a"]:
            self.line.linked += len(data)


def smooth(values: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Gaussian means over neighbours; ``at`` are the places of the lines, at least one apart (one apart by default)."""
    at = np.arange(float(len(values))) if at is None else at
    total, weight = values.copy(), np.ones(len(values))
    for k in range(1, min(len(values), int(3 * SIGMA) + 1)):
        near = np.exp(-0.5 * ((at[k:] - at[:-k]) / SIGMA) ** 2)
        total[k:] += near * values[:-k]
        total[:-k] += near * values[k:]
        weight[k:] += near
        weight[:-k] += near
    return total / weight


class Tree:
    """The elements of a page: sums over their lines, and which lines they hold."""

    def __init__(self, elements: list[Element], lines: list[Line]):
        self.elements = elements
        self.up = [e.up.number if e.up else 0 for e in elements]
        self.own = np.array([x.element.number for x in lines])
        last = list(range(len(elements)))
        for i in range(len(elements) - 1, 0, -1):
            last[self.up[i]] = max(last[self.up[i]], last[i])
        self.last = last

    def sums(self, weight: np.ndarray) -> np.ndarray:
        out = np.bincount(self.own, weight, len(self.elements)).tolist()
        for i in range(len(out) - 1, 0, -1):
            out[self.up[i]] += out[i]
        return np.array(out)

    def inside(self, number: int) -> np.ndarray:
        return (self.own >= number) & (self.own <= self.last[number])

    def containers(self) -> np.ndarray:
        """For each line, the nearest container around it that holds other lines too."""
        n = self.sums(np.ones(len(self.own)))
        of = [0] * len(self.elements)
        for i, e in enumerate(self.elements):
            of[i] = i if e.name in CONTAINERS and n[i] > 1 else of[self.up[i]]
        return np.array(of)[self.own]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = [(line, text) for line in parser.lines if (text := " ".join("".join(line.parts).split()))]
    if not lines:
        return ""
    tree = Tree(parser.elements, [line for line, _ in lines])
    size = np.array([len(t) for _, t in lines], float)
    linked = np.minimum(1.0, np.array([line.linked / sum(map(len, line.parts)) for line, _ in lines]))
    marked = np.array([bool(line.element.why) for line, _ in lines])
    plain = size * (1 - linked + LINKED * linked)
    tags = np.array([line.tags for line, _ in lines], float)
    ratio = ratios(plain, tags, marked)
    around, links = tree.containers(), linked > MOSTLY
    if (holder := _holder(tree, ratio)) is not None:
        within = tree.inside(holder)
        ratio = ratios(plain, tags, marked | ~within)
        ratio = np.where(within & ~marked, np.maximum(ratio, ratio[within & ~marked].mean()), ratio)
        around[within], links[within] = holder, False
    links[1:] &= links[:-1] | np.append(links[2:], False)  # one link alone is no list
    kind = np.stack([around, marked, links])
    parts = np.append(0, np.cumsum((kind[:, 1:] != kind[:, :-1]).any(0)))
    ratio = smooth(ratio, np.arange(len(parts)) + APART * parts)
    kept = ratio >= max(FLOOR, THRESHOLD * ratio.mean())
    if not kept.any():
        return ""
    kept &= tree.inside(_region(tree, around, parts, np.where(kept, ratio, 0)))
    return " ".join(lines[i][1] for i in np.flatnonzero(kept))


def ratios(plain: np.ndarray, tags: np.ndarray, named: np.ndarray) -> np.ndarray:
    """Characters for each tag; where names tell that no article is, each character brings ``NAMED`` tags with it."""
    return plain / (tags + NAMED * plain * named)


def _holder(tree: Tree, ratio: np.ndarray) -> int | None:
    """The innermost article-like element with at least half of the area under the ratios."""
    sums = tree.sums(ratio)
    return max((i for i, e in enumerate(tree.elements) if e.name in HOLDERS and sums[i] >= 0.5 * sums[0]), default=None)


def _region(tree: Tree, around: np.ndarray, parts: np.ndarray, ratio: np.ndarray) -> int:
    """The innermost container of lines with most of the area of the large clusters.

    A cluster is a run of clustered lines of the same surroundings; its area is that under its smoothed
    ratios, more where its lines have neighbours, so that lines in a row outweigh one line of their length.
    """
    n = np.bincount(parts)
    by = np.bincount(parts, ratio) * (1 + LENT * (1 - 1 / n))
    sums = tree.sums(np.where(by[parts] >= LARGE * by.max(), ratio, 0))
    some = np.unique(np.append(tree.containers(), around))
    enough = some[sums[some] >= REGION * sums[0]]
    return int(enough[-1]) if len(enough) else 0


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the ``keep`` columns, text, n_chars.  Narrow: one pass, no shuffle."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h.as_py()) for h in batch.column(len(keep))]
        columns = [*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return map_batches(pages.select(*keep, html_col), lambda: step, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars bigint"]))
