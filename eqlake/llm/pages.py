"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams events. Block tags cut them into lines; a
line knows its text, how much of it is link text, its tags, and the elements around it. Lines
inside elements that say by tag, role or name what they are (menus, adverts, comments and so on)
are out. Of the others, the ratio of plain text to tags is smoothed over
neighbouring lines by a Gaussian, and a threshold clusters lines into content and rest. Content
lines choose the regions of the page; a chosen region's lines are all kept, short ones too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

#: Lines over which the Gaussian has its standard deviation, and the threshold as a share of the mean smoothed ratio of all text.
SIGMA, SHARE = 2.0, 0.25

#: Share of the content's characters that the region around it must hold where no element names itself the article.
HELD = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold text and aren't boxes around a region.
LEAVES = HEADINGS | frozenset("address blockquote caption dd details dl dt figcaption figure hgroup legend li ol p pre summary ul".split())

#: Elements whose content is no text of the page, and such as never hold the article.
SILENT = frozenset("script style noscript template head title svg canvas iframe object audio video map datalist".split())
APART = frozenset("nav footer aside form dialog menu search button select textarea fieldset option".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split())

#: Words in a class or id that name parts around an article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promos promoted promotion banner cookie cookies consent gdpr "
    "notice notices notification popup modal overlay newsletter subscribe subscription signup paywall comment comments commentlist disqus reply replies respond "
    "discussion sidebar rail widget widgets nav navbar navigation navlinks menu menus breadcrumb breadcrumbs crumbs footer foot colophon header masthead topbar toolbar share sharing "
    "sharebar social related recommended recommendations trending popular pagination pager login search searchbox skip copyright legal disclaimer alert taboola outbrain".split()
)
#: Names that an article's own head or title may bear, and marks of a state and not of a part.
OF_ARTICLE = frozenset("header banner masthead".split())
STATE = re.compile(r"\b(?:has|with|no|without|is|hide|show)[-_]\w+", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: A start of one of these ends an open one of the others, up to the nearest of the bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
CLOSES |= {t: ({"td", "th"}, {"tr", "table"}) for t in ("td", "th")} | {"tr": ({"tr", "td", "th"}, {"table"})}


class Line(NamedTuple):
    """A block's text with white space made one, its link characters, its tags, the boxes around it, the outermost article and main element, and whether it is a heading."""

    text: str
    links: int
    tags: int
    around: tuple
    article: int | None
    main: int | None
    heading: bool


def names_apart(tag: str, attrs: list[tuple[str, str | None]], inside: bool, names: bool = True) -> bool:
    """Whether an element says by tag, role, state or name that it isn't part of an article; ``inside``: it stands in one."""
    if tag in APART or tag == "header" and not inside:
        return True
    found = {}
    for name, value in attrs:
        found.setdefault(name, value or "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.IGNORECASE):
        return True
    roles = set(found.get("role", "").lower().split())
    if roles & ROLES and not (inside and roles <= {"banner"}):
        return True
    if not names or tag in ("html", "body", "main") or tag in HEADINGS and inside:
        return False
    words = {w.lower() for w in WORD.findall(STATE.sub(" ", f"{found.get('class', '')} {found.get('id', '')}"))} & NAMES
    if tag == "article":
        return bool(words & {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "sponsored", "related", "promo"})
    return bool(words - OF_ARTICLE if inside else words)


class Open(NamedTuple):
    """An open element: what it says of all within it. ``apart`` is 1 in a form, which may hold a whole page, 2 in what never holds an article."""

    tag: str
    silent: bool
    apart: int
    article: int | None
    main: int | None
    around: tuple


class Events(HTMLParser):
    """Lines of a page, in page order, without what is apart; ``names``: classes and ids tell too."""

    def __init__(self, names: bool = True):
        super().__init__(convert_charrefs=True)
        self.names = names
        self.lines: list[Line] = []
        self.stack = [Open("", False, 0, None, None, ())]
        self.open, self.count = Counter(), 0
        self.parts: list[str] = []
        self.links = self.tags = 0
        self.heading = False

    def end_line(self):
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1]
            self.lines.append(Line(text, self.links, max(1, self.tags), top.around, top.article, top.main, self.heading))
        self.parts, self.links, self.tags, self.heading = [], 0, 0, False

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        if block:
            self.end_line()
            self.implied(tag)
        self.tags += 1
        if tag in ("br", "hr"):
            self.parts.append(" ")
        if tag in VOID:
            return
        top, self.count = self.stack[-1], self.count + 1
        inside = top.article is not None or top.main is not None
        apart, article, main = top.apart, top.article, top.main
        if names_apart(tag, attrs, inside, self.names):
            apart = max(apart, 1 if tag == "form" else 2)
        elif apart < 2 and (tag in ("article", "main") or any(k == "role" and (v or "").lower() == "main" or k == "itemprop" and v == "articleBody" for k, v in attrs)):
            apart = 0
            article, main = (self.count if article is None else article, main) if tag == "article" else (article, self.count if main is None else main)
        around = (*top.around[-63:], self.count) if block and tag not in LEAVES else top.around
        self.stack.append(Open(tag, top.silent or tag in SILENT, apart, article, main, around))
        self.open[tag] += 1
        self.heading = self.heading or tag in HEADINGS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def implied(self, tag):
        """What a block's start ends without saying so: an open paragraph, or an item of its own kind."""
        closes, bounds = CLOSES.get(tag, ({"p"}, BLOCKS - {"p"}))
        if any(self.open[t] for t in closes):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in closes:
                    return self.shrink(k)
                if self.stack[k].tag in bounds:
                    return None
        return None

    def shrink(self, size):
        while len(self.stack) > size:
            self.open[self.stack.pop().tag] -= 1

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            at = self.stack[k].tag
            if at == tag:
                self.shrink(k)
                return
            if tag not in BLOCKS and at in BLOCKS:  # an inline end doesn't end blocks
                return

    def handle_data(self, data):
        top = self.stack[-1]
        if not top.silent and not top.apart:
            if self.open["a"]:
                self.links += len(data.strip())
            self.parts.append(data)

    def finished(self):
        self.close()
        self.end_line()
        return self


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian mean of each line's neighbourhood, over the lines that there are."""
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    middle = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[middle] / np.convolve(np.ones(len(ratios)), kernel)[middle]


def content(lines: list[Line], sigma: float = SIGMA, share: float = SHARE) -> np.ndarray:
    """Which lines a threshold on the smoothed ratio of plain text to tags puts with the content; never those of which half is links."""
    plain = np.array([max(0, len(x.text) - x.links) for x in lines], float)
    smooth = smoothed(plain / np.array([x.tags for x in lines], float), sigma)
    weights = np.maximum(plain, 1e-9)
    return (smooth >= min(smooth.max(), share * float((smooth * weights).sum() / weights.sum()))) & (plain * 2 > np.array([len(x.text) for x in lines]))


def selected(lines: list[Line]) -> list[str]:
    """The texts of the lines that make the article."""
    if not lines:
        return []
    good = content(lines)
    chars = np.array([len(x.text) - x.links for x in lines], float) * good
    total = chars.sum()
    # elements that name themselves: articles, if they hold half of the content; else main
    for named, least in (([x.article for x in lines], 0.5), ([x.main for x in lines], 0.0)):
        held = Counter()
        for k, n in zip(named, chars, strict=True):
            if k is not None:
                held[k] += n
        if held and sum(held.values()) >= least * total:
            return [x.text for x, k in zip(lines, named, strict=True) if k is not None and (held[k] or not total)]
    # else the deepest box around nearly all content, from the first content line to the last, with the lines beside them in the same box
    around, depths = Counter(), {}
    for x, n in zip(lines, chars, strict=True):
        for depth, k in enumerate(x.around):
            around[k] += n
            depths[k] = depth
    root = max((k for k in around if around[k] >= HELD * total), key=lambda k: (depths[k], -k), default=None)
    inner = [k for k, x in enumerate(lines) if root is None or root in x.around]
    marked = [k for k in inner if good[k]]
    if not marked:
        return [lines[k].text for k in inner]
    first, last = marked[0], marked[-1]

    def beside(k, edge):
        return k in held_lines and lines[k].around[-1:] == lines[edge].around[-1:] and lines[k].links * 2 < len(lines[k].text)

    held_lines, low, high = set(inner), first, last
    while beside(low - 1, first):
        low -= 1
    while beside(high + 1, last):
        high += 1
    first, last = low, high
    return [lines[k].text for k in inner if first <= k <= last]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, joined by one space; empty where there is none."""
    for names in (True, False):  # a page whose names put everything apart is read by its tags
        page = Events(names)
        page.feed(html or "")
        if page.finished().lines:
            return " ".join(selected(page.lines))
    return ""


def pages_text(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) of ``pages`` (page_id, url, html), one for each.

    A null or empty page has an empty text. Each page stands alone, read whole;
    nothing is shuffled. Character references are decoded and white space in a
    block, no-break spaces too, becomes one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            # a reference can stand for half of a surrogate pair, which isn't text
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    ship(pages.sparkSession)
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
