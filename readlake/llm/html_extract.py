"""Main text of web pages by text-to-tag ratios.

Events of the standard library's streaming parser become lines, one per block of the page, each with its characters, its tags and
the characters inside links. The ratio of characters to tags, smoothed by a Gaussian over neighbouring lines, is split in two
clusters; lines of the upper one vote for the container they stand in, and a container with votes is a content region, with all that
lies inside it. Lines of page furniture (menus, forms, adverts, ...) have ratio zero, never vote and are never given out.
"""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.words import column, tables

#: The HTML standard's void elements.
VOID = frozenset({
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
})
BLOCK = frozenset({
    "address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details", "dialog", "dir",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search",
    "section", "select", "summary", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "tr", "ul",
})
#: Elements whose text is never part of an article.
FURNITURE = frozenset({
    "aside", "audio", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "iframe", "input", "menu",
    "nav", "noscript", "object", "option", "script", "search", "select", "style", "svg", "template", "textarea", "title",
    "video",
})
#: Elements that may hold an article; the nearest one is a line's container.
CONTAINER = frozenset({
    "article", "body", "div", "html", "main", "section", "table", "td",
})
#: Words of a class, id or role that mark furniture.
MARKS = frozenset({
    "ad", "ads", "adsense", "advert", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disqus", "dialog", "disclaimer",
    "footer", "form", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notification", "overlay", "paywall", "popup", "promo", "promoted", "recommended", "related", "replies", "reply",
    "rail", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags",
    "toolbar", "topbar", "widget",
})
#: Those that tell a list inside an article to be no part of it; other lists, paragraphs and words there stay, whatever their class.
LIST_MARKS = frozenset({
    "breadcrumb", "breadcrumbs", "comment", "comments", "menu", "nav", "replies", "share", "sharing", "social",
})
LISTS = frozenset({
    "dl", "ol", "ul",
})
#: Lines of links in a row, outside articles, that make a menu.
MENU = 3
#: Elements that end an open paragraph, as browsers close it.
CLOSES_P = BLOCK - {"br", "button", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup"}
SPREAD = 1.0
REACH = 2


def _marked(attrs: list[tuple[str, str | None]], inside: bool, marks: frozenset = MARKS) -> bool:
    for name, value in attrs:
        if name == "hidden":
            return True
        if value and name in ("class", "id", "role"):
            for word in value.lower().replace("_", "-").split():
                first, _, rest = word.partition("-")
                if first in ("no", "has", "with", "without"):
                    continue
                if first in marks or rest and rest.rpartition("-")[2] in marks:
                    return True
                if not inside and (first == "header" or rest == "header"):
                    return True
        elif name == "aria-hidden" and value == "true":
            return True
    return False


class Lines(HTMLParser):
    """Lines of a page: (text, characters, tags, characters in links, container, furniture, inside an article)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, bool, bool]] = []
        self.open: list[tuple[str, bool, int]] = []  # (tag, furniture, container that was current before)
        self.furniture = self.links = self.articles = 0
        self.dropped = 0  # furniture inside a line, whose text is no part of it
        self.container = self.containers = 0
        self.parents: dict[int, int] = {}  # of containers outside articles: the container each stands in
        self.roots = {0}  # containers that hold the whole page
        self.text: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, len(text), self.tags, self.linked, self.container, self.furniture > 0, self.articles > 0))
                self.tags = 0
            self.text, self.linked = [], 0

    def leave(self, to: int) -> None:
        while len(self.open) > to:
            tag, furniture, container = self.open.pop()
            self.furniture -= furniture
            self.dropped -= furniture and tag not in BLOCK
            self.container = container
            if tag == "a":
                self.links -= 1
            elif tag == "article" or tag == "main":
                self.articles -= 1

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P:
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] == "p":
                        self.leave(i)
                        break
                    if self.open[i][0] in BLOCK:
                        break
            if tag == "li" or tag == "dt" or tag == "dd":
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] in ("li", "dt", "dd"):
                        self.leave(i)
                        break
                    if self.open[i][0] in ("ul", "ol", "dl", "menu") or self.open[i][0] in CONTAINER:
                        break
        self.tags += 1
        if tag in VOID:
            return
        inside = self.articles > 0
        furniture = tag in FURNITURE or (tag == "header" and not inside)
        if attrs and not furniture and tag not in ("article", "main", "body", "html"):
            if not inside or tag in CONTAINER:
                furniture = _marked(attrs, inside)
            else:  # inside an article a class tells of a list at most, and `hidden` of anything
                furniture = _marked(attrs, inside, LIST_MARKS if tag in LISTS else frozenset())
        self.open.append((tag, furniture, self.container))
        self.furniture += furniture
        self.dropped += furniture and tag not in BLOCK
        if tag == "a":
            self.links += 1
        elif tag in CONTAINER:
            if tag == "article" or tag == "main":
                self.articles += 1
            if tag == "article" or tag == "main" or not inside:
                self.containers += 1  # what stands inside an article is part of it
                if not self.articles:
                    self.parents[self.containers] = self.container
                    if tag == "body" or tag == "html":
                        self.roots.add(self.containers)
                self.container = self.containers

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, a slash does not close other than void elements

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            held = self.open[i][0]
            if held == tag:
                self.leave(i)
                return
            if held in CONTAINER and tag not in BLOCK:
                return  # an inline end tag closes nothing outside its block

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        self.text.append(data)
        if self.links:
            self.linked += len(data)


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """A Gaussian over each line and the `REACH` lines on either side; at an end over the lines there are."""
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SPREAD) ** 2)
    if len(ratio) < len(kernel):
        padded = np.concatenate((ratio, np.zeros(len(kernel) - len(ratio))))
        there = np.concatenate((np.ones(len(ratio)), np.zeros(len(kernel) - len(ratio))))
    else:
        padded, there = ratio, np.ones(len(ratio))
    return (np.convolve(padded, kernel, "same") / np.maximum(np.convolve(there, kernel, "same"), 1e-9))[: len(ratio)]


def threshold(values: np.ndarray) -> float:
    """The middle between two clusters of the values' square roots (two means, from the extremes)."""
    root = np.sqrt(values)
    low, high = float(root.min()), float(root.max())
    for _ in range(20):
        upper = root > (low + high) / 2
        if not upper.any() or upper.all():
            break
        now = float(root[~upper].mean()), float(root[upper].mean())
        if now == (low, high):
            break
        low, high = now
    return ((low + high) / 2) ** 2


def main_text(html: str | None) -> str:
    """Article text of one page, blocks joined by line feeds; empty if there is none."""
    page = Lines()
    page.feed(html or "")
    page.close()
    page.flush()
    lines = page.lines
    fair = [x for x in lines if not x[5]]
    if not fair:
        return ""
    ratio = np.array([0.0 if x[5] else (x[1] - x[3]) / max(1, x[2]) for x in lines])
    smooth = smoothed(ratio)
    content = smooth >= threshold(smooth)
    votes: dict[int, float] = {}
    for x, c in zip(lines, content.tolist(), strict=True):
        if c and not x[5]:
            votes[x[4]] = votes.get(x[4], 0) + x[1] - x[3]
    most = max(votes.values(), default=0)
    regions = {k for k, v in votes.items() if v >= 0.2 * most and v > 0}
    # Parts that stand beside the winning one under one parent stay, however short.
    won = {page.parents[k] for k, v in votes.items() if v == most and v > 0 and k in page.parents}
    regions |= {k for k, v in votes.items() if v > 0 and page.parents.get(k) in won}
    if not regions:
        regions = {x[4] for x in fair}

    def stays(container: int) -> bool:
        """In a region, or inside one that is not the whole page."""
        if container in regions:
            return True
        while (container := page.parents.get(container, 0)) not in page.roots:
            if container in regions:
                return True
        return False

    kept = [x for x in fair if stays(x[4])]
    link = [not x[6] and x[3] >= 0.8 * x[1] and x[2] > 1 and x[1] < 60 for x in kept]
    out, run = [], []
    for x, is_link in zip([*kept, None], [*link, False], strict=True):
        if is_link:
            run.append(x[0])
            continue
        out += run if len(run) < MENU else []
        run = []
        if x is not None:
            out.append(x[0])
    return "\n".join(out)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; null html is an empty page with empty text. Repeated rows stay repeated."""

    def run(batches):
        for table in tables(batches):
            held = column(table, "html")
            texts = [main_text(held[i].as_py()) for i in range(table.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [column(table, "page_id"), column(table, "url"), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    read = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")
