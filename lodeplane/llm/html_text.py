"""Main text of web pages.

The standard library's parser streams events; they are cut into blocks (lines) with their text-to-tag ratio. The ratios
are smoothed with a Gaussian, and blocks over a threshold of their spread cluster into content runs. The runs choose the
region: of pages with article or main elements, those of them that hold a run (all, if none does); of other pages, the
innermost container that holds all runs, and containers around it that add headings and blocks of runs only. Blocks of the
region stay, but for menus: blocks of links outside of the runs. Markup that never is content (menus, forms, scripts, ...)
is left out before, by element, role and class names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeplane.llm.common import map_texts

# Fixed values of HTML: elements without an end tag, elements that begin a block, elements that are never main text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
NEVER = {"aside", "audio", "button", "canvas", "datalist", "dialog", "embed", "footer", "form", "frame", "frameset", "head", "iframe", "input", "label", "legend", "map", "menu", "nav", "noscript", "object", "option", "script", "select", "style", "svg", "template", "textarea", "title", "video"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"article", "main", "section", "div", "td", "body"}
#: Elements that end where a sibling begins, and the elements that a search for that sibling does not leave.
SIBLINGS = {"li", "dd", "dt", "option", "tr", "td", "th"}
SCOPES = {"ul", "ol", "dl", "table", "select", "menu"}
#: Words in class, id and role names of page parts that are not the article.
PARTS = {"ad", "ads", "adbox", "adsense", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "discussion", "disqus", "donate", "footer", "gdpr", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription", "toolbar", "topbar", "trending", "widget", "widgets"}
#: Of these, words that the id of a section of an article's own text may have, and words that make an article element itself a part.
AMBIGUOUS = {"discussion", "related", "responses", "search", "social"}
FOREIGN = {"ad", "advert", "advertisement", "comment", "promo", "recommended", "related", "reply", "sponsored", "teaser"}
#: An open p ends where one of these begins.
ENDS_P = BLOCK - {"html", "body", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Settings:
    #: Standard deviation of the smoothing in blocks, and the threshold in standard deviations of the smoothed ratios.
    sigma: float = 1.0
    threshold: float = 0.5
    #: A block outside of a content run whose text is links to this share is a menu.
    links: float = 0.7


@dataclass
class Block:
    text: str
    tags: int
    linked: int
    heading: bool
    #: Number of the innermost container, -1 for none.
    inside: int


@dataclass
class Container:
    kind: str
    parent: int
    #: The article or main element around it or itself, -1 for none.
    marked: int
    #: Its blocks: from `first` up to, but without, `end`.
    first: int
    end: int = -1


@dataclass
class Part:
    """An element that its names hide."""

    place: tuple[int, int]
    parent: int
    #: Its names may be those of a section of the article that it is in.
    may_stay: bool
    #: Characters in it but not in parts of it: all, and those of links.
    chars: int = 0
    linked: int = 0


class _Blocks(HTMLParser):
    """Blocks in page order, and the containers around them.

    The open elements' places are kept by element, so that no event looks through the stack: time is in proportion to the
    page, whatever its nesting.
    """

    def __init__(self, shown: frozenset = frozenset(), unclosed: frozenset = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        #: Places of elements that stay in spite of their names, and of hidden ones that end where an article begins.
        self.shown, self.unclosed = shown, unclosed
        self.stack: list[tuple[str, int, int, tuple[int, int]]] = []  # element, 1 if hidden by itself or 2 if by its names, container or -1, place in the page
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack by element
        self.open_blocks: list[int] = []
        self.open_containers: list[int] = []
        self.open_hidden: list[int] = []
        self.open_parts: list[int] = []  # numbers of parts
        self.blocks: list[Block] = []
        self.containers: list[Container] = []
        self.parts_found: list[Part] = [Part((0, 0), -1, False)]  # the first stands for what is outside of all parts
        self.articles_in: dict[tuple[int, int], bool] = {}  # hidden open elements by place: whether an article begins inside
        self.lost: set[tuple[int, int]] = set()  # hidden elements with an article but without an end tag
        self._new()

    def _new(self) -> None:
        self.text: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append(Block(text, self.tags, self.linked, any(self.open[h] for h in HEADINGS), self.stack[self.open_containers[-1]][2] if self.open_containers else -1))
        self._new()

    def _pop(self, k: int, ended: bool) -> None:
        """Closes the stack from place k on; ended: by the end tag of the element at k."""
        while len(self.stack) > k:
            tag, own, number, place = self.stack.pop()
            self.open[tag].pop()
            if tag in BLOCK:
                self.open_blocks.pop()
            if own:
                self.open_hidden.pop()
                article = self.articles_in.pop(place, False)
                if article and not (ended and len(self.stack) == k):
                    self.lost.add(place)
                if article and self.open_hidden:
                    self.articles_in[self.stack[self.open_hidden[-1]][3]] = True
                if own == 2:
                    self.open_parts.pop()
            if number >= 0:
                self.open_containers.pop()
                self.containers[number].end = len(self.blocks)

    def finish(self) -> _Blocks:
        self.close()
        self.flush()
        self._pop(0, False)
        return self

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag in ENDS_P and self.open_blocks and self.stack[self.open_blocks[-1]][0] == "p":
            self._pop(self.open_blocks[-1], True)
        if tag in ("article", "main", "body"):
            # a menu or form whose end tag is missing does not swallow the article
            k = next((k for k in self.open_hidden if self.stack[k][3] in self.unclosed), None) if self.unclosed else None
            if k is not None:
                self._pop(k, True)
            if self.open_hidden:
                self.articles_in[self.stack[self.open_hidden[-1]][3]] = True
        elif tag in SIBLINGS and self.open[tag]:
            scopes = SCOPES | {"tr"} if tag in ("td", "th") else SCOPES
            if self.open[tag][-1] > max((self.open[x][-1] for x in scopes if x != tag and self.open[x]), default=-1):
                self._pop(self.open[tag][-1], True)
        own = self._hides(tag, attrs)
        number = -1
        at = len(self.stack)
        if tag in CONTAINERS:
            number = len(self.containers)
            parent = self.stack[self.open_containers[-1]][2] if self.open_containers else -1
            marked = self.containers[parent].marked if parent >= 0 else -1
            self.containers.append(Container(tag, parent, marked if marked >= 0 and tag != "article" else number if tag in ("article", "main") else -1, len(self.blocks)))
            self.open_containers.append(at)
        place = self.getpos()
        self.stack.append((tag, own, number, place))
        self.open[tag].append(at)
        if tag in BLOCK:
            self.open_blocks.append(at)
        if own:
            self.open_hidden.append(at)
        if own == 2:
            self.open_parts.append(len(self.parts_found) - 1)

    def _in_article(self) -> bool:
        return bool(self.open["article"] or self.open["main"])

    def _hides(self, tag: str, attrs: list) -> int:
        if tag in NEVER:
            return 1
        if tag in ("html", "body", "main") or tag in HEADINGS:
            return 0
        if tag == "header":
            return int(not self._in_article())
        if not attrs:
            return 0
        given = dict(attrs)
        if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in (given.get("style") or "").replace(" ", "").lower():
            return 1
        names = " ".join(given.get(k) or "" for k in ("class", "id", "role"))
        if not names.strip() or self.getpos() in self.shown:
            return 0
        words = {w.lower() for w in _NAME.findall(names)}
        named = words & (FOREIGN if tag == "article" else PARTS)
        if not named and not ("header" in words and not self._in_article()):
            return 0
        by_class = {w.lower() for w in _NAME.findall(f"{given.get('class') or ''} {given.get('role') or ''}")} & PARTS
        own_section = tag == "section" and bool(named) and not by_class and named <= AMBIGUOUS and self._in_article()
        self.parts_found.append(Part(self.getpos(), self.open_parts[-1] if self.open_parts else 0, own_section))
        return 2

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do: the slash means nothing but in void elements

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if self.open[tag]:
            k = self.open[tag][-1]
            # an inline end tag doesn't close a container
            if tag in CONTAINERS or tag in BLOCK or not self.open_containers or self.open_containers[-1] < k:
                self._pop(k, True)

    def handle_data(self, data: str) -> None:
        size, link = len(data.strip()), bool(self.open["a"])
        if len(self.open_hidden) == len(self.open_parts):
            part = self.parts_found[self.open_parts[-1] if self.open_parts else 0]
            part.chars += size
            part.linked += size * link
        if self.open_hidden:
            return
        self.text.append(data)
        if link:
            self.linked += size


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing within three standard deviations; at the ends over the blocks that are there."""
    r = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[r : r + len(ratios)]
    return full / np.convolve(np.ones_like(ratios), kernel)[r : r + len(ratios)]


def parsed(html: str) -> _Blocks:
    """The page's blocks; a second reading follows if the first shows that hidden elements should stay or end earlier."""
    p = _Blocks()
    p.feed(html)
    p.finish()
    found = p.parts_found
    shown = {x.place for x in found if x.may_stay and 2 * x.linked < x.chars}
    plain = [x.chars - x.linked for x in found]
    most = max(range(len(found)), key=plain.__getitem__)
    if 2 * plain[most] > sum(plain):
        # what holds most of the page's text is a layout, not a part, whatever its names say
        while most > 0:
            shown.add(found[most].place)
            most = found[most].parent
    if shown or p.lost:
        p = _Blocks(frozenset(shown), frozenset(p.lost))
        p.feed(html)
        p.finish()
    return p


def content_runs(blocks: list[Block], settings: Settings) -> tuple[list[bool], list[bool]]:
    """Which blocks are in a content run, by the smoothed text-to-tag ratio, and which of these are over the threshold unsmoothed.

    All are where none is over the threshold.
    """
    plain = np.array([len(b.text) for b in blocks], float) / np.maximum([b.tags for b in blocks], 1)
    smooth = smoothed(plain, settings.sigma)
    least = settings.threshold * smooth.std()
    run = smooth > least
    if not (run & (plain > least)).any():
        run[:] = plain[:] = True
        least = 0
    return run.tolist(), (run & (plain > least)).tolist()


def region(blocks: list[Block], boxes: list[Container], chosen: list[int], fits: list[bool]) -> tuple[int, int]:
    """Range of the blocks of the innermost container that holds all chosen blocks, and of those around it that add only blocks that fit."""
    inner = blocks[chosen[0]].inside
    while inner >= 0 and boxes[inner].end <= chosen[-1]:
        inner = boxes[inner].parent
    if inner < 0:
        return 0, len(blocks)
    misfits = np.cumsum([0, *(not x for x in fits)]).tolist()
    first, end = boxes[inner].first, boxes[inner].end
    while (inner := boxes[inner].parent) >= 0:
        f, e = boxes[inner].first, boxes[inner].end
        if misfits[e] - misfits[f] > misfits[end] - misfits[first]:
            break
        first, end = f, e
    return first, end


def main_text(html: str | None, settings: Settings = Settings()) -> str:
    """The article of one page; empty for null, empty and text-less pages."""
    if not html:
        return ""
    p = parsed(html)
    blocks, boxes = p.blocks, p.containers
    if not blocks:
        return ""
    run, core = content_runs(blocks, settings)
    linky = [b.linked >= settings.links * len(b.text) for b in blocks]
    menu = [x and not r for x, r in zip(linky, run, strict=True)]
    # runs of links choose nothing, unless there are no others
    chosen = [k for k, (c, x) in enumerate(zip(core, linky, strict=True)) if c and not x] or [k for k, c in enumerate(core) if c]
    marked = [boxes[b.inside].marked if b.inside >= 0 else -1 for b in blocks]
    # an article with a run of its own, or one that lies in a run with all its blocks
    cut_by = {m for m, r, x in zip(marked, run, linky, strict=True) if not r or x}
    regions = ({marked[k] for k in chosen} | (set(marked) - cut_by)) - {-1} or set(marked) - {-1}
    if regions:
        # of a main element around articles, what is outside of them stays too, but for menus
        seen = set()
        for x in list(regions):
            while (x := boxes[x].parent) >= 0 and x not in seen:
                seen.add(x)
                if boxes[x].marked == x:
                    regions.add(x)
        nested = any(boxes[x].kind == "article" for x in regions)
        keep = [m in regions and (boxes[m].kind == "article" or not (nested and x)) for m, x in zip(marked, menu, strict=True)]
    else:
        first, end = region(blocks, boxes, chosen, [not x and (r or b.heading) for x, r, b in zip(linky, run, blocks, strict=True)])
        keep = [first <= k < end and not x for k, x in enumerate(menu)]
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(df: DataFrame, html_col: str = "html", keep_cols: tuple[str, ...] = ("page_id", "url"), settings: Settings = Settings()) -> DataFrame:
    """keep_cols, text and n_chars for each row: one pass, no shuffle, the whole html of each page.

    Null and empty html, and pages without text, give an empty text. Character references are decoded, white space in a
    block becomes one space, blocks are joined in page order by a line feed. Broken markup never fails. Time is in
    proportion to the page's length, however long or deeply nested. Blocks of equal ratios are treated alike. Repeated rows,
    and rows without an id, are extracted each; an empty table gives no rows. Other columns are ignored.
    """

    def task():
        def run(pages: list) -> list:
            text = [main_text(h, settings) for h in pages]
            return [text, [len(t) for t in text]]

        return run

    return map_texts(df, list(keep_cols), F.col(html_col), task, "text string, n_chars long")
