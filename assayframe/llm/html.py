"""Main text of web pages by tag-path ratios.

A page is scanned into its elements and text nodes, each node with its
root-to-leaf tag path (tag names with class and id).  Per path the text length,
the punctuation and the link text are summed and divided by its nodes; both
ratios are smoothed over the paths of the same container (the path without its
leaf) and fused by their geometric mean.  Paths of at least ``LEVEL`` times the
page's best select content nodes; the smallest element that holds most of
their text is the content container, and all of its text stays, short list
items, cells and captions too.  Selected nodes before the container stay, such
behind it only if they share a path with what is selected inside.

Elements that surround a text, by tag or by a word of class, id or role, take no
part, unless they are a wrapper: one that holds the page's <main>, or (forms and
elements marked by a word) most of its punctuated text together with its
heading or article, or with nothing comparable outside on a page without either.
Words of many meanings (``MAYBE`` in a compound, ``WEAK`` anywhere) mark an
element only by its place: one that has selected text before and behind it in
the same parent, and is not mostly links, is part of the text.  So is a label
or button inside a sentence.  A list of links is left out unless it lies
between selected text or, behind its beginning, in an <article> or <main>.

Defined cases: a null page is empty and has the empty text; a page without any
path that qualifies has the empty text; unclosed and cut-off markup is read as
far as it goes; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm._spark import small_batches

LEVEL, MOST, LINKED = 0.1, 0.8, 0.6  # of the best path; of the selected text; of a block's text in links
# fixed values: HTML's own element classes
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
OUTSIDE = {"nav", "footer", "header", "aside", "form", "menu", "button", "select", "option", "input", "label", "dialog", "fieldset", "head", "object", "canvas", "audio", "video", "search"}
CONTAINERS = {"article", "body", "center", "div", "fieldset", "form", "html", "main", "section", "td"}
ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
# fixed values: words of class, id and role that mark what surrounds a text
AROUND = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "sidenav", "social", "sponsor", "sponsored", "subscribe", "tags", "toc", "toolbar", "widget"}
# fixed values: those that have other meanings beside other words, and words that have them even alone
MAYBE = {"comment", "comments", "footer", "header", "menu", "notice", "notices", "pager", "related", "replies", "respond", "search", "share", "social", "tags", "toc", "widget"}
WEAK = {"alert", "alerts", "discussion", "feedback", "rail", "reactions", "responses", "reviews"}
INLINE = {"button", "label"}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# fixed values: what a class says that is about a part elsewhere, not about its own element
MODIFIERS = {"has", "no", "with", "without", "is", "js", "not", "hide", "show", "open", "enabled", "disabled"}
_PARTS = re.compile(r"[^a-z]+")
_PUNCT = re.compile(r"[^\w\s]")


def surrounds(names: str) -> int:
    """Whether a word of class, id or role marks what surrounds a text: 2 if so, 1 if its place must tell, 0 if not."""
    out = 0
    for token in names.lower().split():
        parts = [p for p in _PARTS.split(token) if p]
        if MODIFIERS.intersection(parts):
            continue
        found = AROUND.intersection(parts)
        if found - MAYBE or found and len(parts) == 1:
            return 2
        if found or WEAK.intersection(parts):
            out = 1
    return out


class Page:
    """The elements (parent, tag, path, suspect, weakly so) and text nodes (element, in a link, block, text) of a page."""

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.suspect, self.weak = [-1], [""], [()], [False], [False]
        self.nodes: list[tuple[int, bool, int, str]] = []
        self._scan(html)

    def _scan(self, html: str) -> None:
        stack, links, block, at, end = [0], 0, 0, 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            stop = m.start() if m else end
            if stop > at:
                self.nodes.append((stack[-1], links > 0, block, html[at:stop]))
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag == "br":
                self.nodes.append((stack[-1], False, block, " "))
            if m[1]:
                if tag in BLOCK:
                    block += 1
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] == tag:
                        del stack[i:]
                        break
                    if self.tag[stack[i]] in ("article", "section", "body", "td") and tag not in BLOCK:
                        break
                links = sum(self.tag[x] == "a" for x in stack) if tag == "a" or tag in BLOCK else links
                continue
            if tag in RAW:
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)", re.I).search(html, at)
                at = close.start() if close else end
                if m[0].rstrip(">").endswith("/"):
                    at = m.end()
                continue
            if tag in BLOCK:
                block += 1
            if tag in VOID:
                continue
            for tags, scope in self._ends(tag):
                self._close(stack, tags, scope)
            names = " ".join(a or b or c for a, b, c in _ATTR.findall(m[3])) if m[3] else ""
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.path.append((*self.path[stack[-1]], f"{tag}.{names.lower()}" if names else tag))
            mark = surrounds(names) if tag not in ("body", "html", "main") else 0
            self.suspect.append(tag in OUTSIDE or mark > 0)
            self.weak.append(tag not in OUTSIDE and mark == 1)
            stack.append(len(self.tag) - 1)
            links = sum(self.tag[x] == "a" for x in stack)

    @staticmethod
    def _ends(tag: str):
        """What a start tag closes: tags, and the tags that keep them open."""
        if tag in ENDS_P or tag == "p":
            yield {"p"}, {"table", "td", "th", "button", "div", "article", "section", "li", "body"}
        if tag == "li":
            yield {"li"}, {"ul", "ol", "menu"}
        elif tag in ("dt", "dd"):
            yield {"dt", "dd"}, {"dl"}
        elif tag in ("td", "th"):
            yield {"td", "th"}, {"tr", "table"}
        elif tag == "tr":
            yield {"tr"}, {"table"}

    def _close(self, stack: list[int], tags: set, scope: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] in tags:
                del stack[i:]
                return
            if self.tag[stack[i]] in scope:
                return

    def sums(self, values: list[float]) -> list[float]:
        """Values of elements added up over all that is in them."""
        out = list(values)
        for e in range(len(out) - 1, 0, -1):  # parents come before their children
            out[self.parent[e]] += out[e]
        return out

    def inherited(self, marks: list[bool]) -> list[bool]:
        """Whether an element or one around it is marked."""
        out = list(marks)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out


def path_scores(nodes) -> dict[tuple, float]:
    """The fused ratio of each path of ``nodes``: (path, length, punctuation, link length)."""
    sums = defaultdict(lambda: [0, 0, 0, 0])
    for path, length, punct, link in nodes:
        s = sums[path]
        s[0] += 1
        s[1] += length
        s[2] += punct
        s[3] += link
    groups = defaultdict(list)
    ratio = {}
    for path, (n, length, punct, link) in sums.items():
        ratio[path] = (max(0, length - 2 * link) / n, (1 + punct) / n)
        groups[_container(path)].append(path)
    out = {}
    for paths in groups.values():
        text = sum(ratio[p][0] for p in paths) / len(paths)
        marks = sum(ratio[p][1] for p in paths) / len(paths)
        for p in paths:
            out[p] = ((ratio[p][0] + text) / 2 * ((ratio[p][1] + marks) / 2)) ** 0.5
    return out


def _container(path: tuple) -> tuple:
    """The path up to the block that holds the leaf's block."""
    while path and path[-1].partition(".")[0] not in BLOCK:
        path = path[:-1]
    return path[:-1]


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks joined by blank lines."""
    if not html:
        return ""
    page = Page(html)
    nodes = [(e, link, block, text, text.strip()) for e, link, block, t in page.nodes for text in (unescape(t),)]
    boilerplate = _boilerplate(page, nodes)
    outside = page.inherited(boilerplate)
    scores = path_scores((page.path[e], len(t), len(_PUNCT.findall(t)), len(t) if link else 0) for e, link, _, _, t in nodes if t and not outside[e])
    if not scores:
        return ""
    floor = LEVEL * max(scores.values())
    selected = [scores.get(page.path[e], 0.0) >= floor and not outside[e] for e, *_ in nodes]
    run = _within_run(page, nodes, selected)
    outside = page.inherited([x and not (page.weak[e] and run[e]) for e, x in enumerate(boilerplate)])
    inside = page.inherited(_container_of(page, nodes, selected))
    paths = {page.path[e] for (e, *_), mine in zip(nodes, selected, strict=True) if mine and inside[e]}
    last = max((i for i, (e, *_) in enumerate(nodes) if inside[e]), default=-1)
    selected = [mine and (inside[e] or i < last or page.path[e] in paths) for i, ((e, *_), mine) in enumerate(zip(nodes, selected, strict=True))]
    linked = page.inherited(_link_blocks(page, nodes, selected))
    blocks: dict[int, list[str]] = {}
    for (e, _, block, text, t), mine in zip(nodes, selected, strict=True):
        if not t or mine or (inside[e] and not outside[e] and not linked[e]):
            blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n\n".join(x for x in joined if x)


def _boilerplate(page: Page, nodes) -> list[bool]:
    """Suspect elements that are no wrapper of the page's text."""
    size = len(page.tag)
    held, best = [0.0] * size, [0.0] * size
    for e, link, _, _, t in nodes:
        if t and not link and _PUNCT.search(t):
            held[e] += len(t)
            best[e] = max(best[e], len(t))
    total = sum(held)
    held = page.sums(held)
    heading = page.sums([float(tag == "h1" or tag == "article" and not odd) for tag, odd in zip(page.tag, page.suspect, strict=True)])
    main = page.sums([float(tag == "main") for tag in page.tag])
    out = list(page.suspect)
    block_text, own, block_of = defaultdict(int), [0] * size, {}
    for e, _, block, _, t in nodes:
        block_text[block] += len(t.split())
        own[e] += len(t.split())
        block_of.setdefault(e, block)
    for e in (e for e in range(1, size) if out[e]):
        if main[e]:
            out[e] = False
        elif page.tag[e] in INLINE and e in block_of:
            around = block_text[block_of[e]] - own[e]
            out[e] = around < 3 or 2 * own[e] > around
        elif held[e] > total / 2 and page.tag[e] not in OUTSIDE - {"form", "fieldset"}:
            inner, outer = 0.0, 0.0
            within = _within(page, e)
            for x in range(size):
                inner, outer = (max(inner, best[x]), outer) if within[x] else (inner, max(outer, best[x]))
            out[e] = not (heading[e] or not heading[0] and outer < inner / 2)
    return out


def _within(page: Page, top: int) -> list[bool]:
    return page.inherited([e == top for e in range(len(page.tag))])


def _container_of(page: Page, nodes, selected: list[bool]) -> list[bool]:
    """Marks the smallest element that holds MOST of the selected text."""
    size = len(page.tag)
    held = [0.0] * size
    for (e, _, _, _, t), mine in zip(nodes, selected, strict=True):
        held[e] += len(t) if mine else 0
    need = MOST * sum(held)
    held = page.sums(held)
    top = 0
    for e in range(1, size):  # children come after their parents
        if page.parent[e] == top and held[e] >= need:
            top = e
    # a paragraph alone is no container
    while top and page.tag[top] not in CONTAINERS:
        top = page.parent[top]
    return [e == top for e in range(size)]


class Surroundings:
    """Where each element's text lies among the selected nodes, and how much of it is in links."""

    def __init__(self, page: Page, nodes, selected: list[bool]):
        size = len(page.tag)
        self.page = page
        self.first, self.last = [len(nodes)] * size, [-1] * size
        text, link = [0.0] * size, [0.0] * size
        for i, (e, is_link, _, _, t) in enumerate(nodes):
            self.first[e], self.last[e] = min(self.first[e], i), i
            text[e] += len(t)
            link[e] += len(t) if is_link else 0
        for e in range(size - 1, 0, -1):  # parents come before their children
            up = page.parent[e]
            self.first[up], self.last[up] = min(self.first[up], self.first[e]), max(self.last[up], self.last[e])
        self.text, self.link = page.sums(text), page.sums(link)
        self.upto = [0, *accumulate(map(int, selected))]

    def linked(self, e: int) -> bool:
        return self.link[e] >= LINKED * self.text[e]

    def follows(self, e: int, top: int) -> bool:
        """Whether selected text of ``top`` lies before an element in it."""
        return self.upto[self.first[e]] > self.upto[self.first[top]]

    def between(self, e: int) -> bool:
        """Whether selected text lies before and behind an element in its parent."""
        up = self.page.parent[e]
        return self.follows(e, up) and self.upto[self.last[up] + 1] > self.upto[self.last[e] + 1]


def _within_run(page: Page, nodes, selected: list[bool]) -> list[bool]:
    """Marks elements between selected text that are not mostly links."""
    at = Surroundings(page, nodes, selected)
    return [e > 0 and at.text[e] > 0 and not at.linked(e) and at.between(e) for e in range(len(page.tag))]


def _link_blocks(page: Page, nodes, selected: list[bool]) -> list[bool]:
    """Marks blocks without selected text that are mostly links, but for those between selected text or behind such in an article."""
    at = Surroundings(page, nodes, selected)
    article, out = [-1], [False]  # the outermost article or main around an element
    for e in range(1, len(page.tag)):
        up = article[page.parent[e]]
        article.append(up if up >= 0 else e if page.tag[e] in ("article", "main") else -1)
        listed = page.tag[e] in BLOCK and at.text[e] > 0 and at.linked(e) and at.upto[at.last[e] + 1] == at.upto[at.first[e]]
        out.append(listed and not at.between(e) and not (article[e] >= 0 and at.follows(e, article[e])))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` as page_id, url, text, n_chars."""

    small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
