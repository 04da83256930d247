"""Main text of web pages by tag-path ratios.

Operator: `main_text`.  A page becomes a sequence of text blocks, each with the path of
elements (with their names) from the root to it.  Per path, text length and punctuation
outside links are summed and divided by its blocks (the two path ratios).  Both ratios are
smoothed along the page with a Gaussian window and multiplied; blocks whose fused ratio
reaches the page's standard deviation are content.  The content marks the page's main
element: the innermost section that holds all of it (or an article around that).  All blocks
of that element outside furniture are the text, so short paragraphs and headings of the
article are kept.

Furniture are elements whose tag says so (FURNITURE_TAGS) and elements that are named so,
unless they hold most of the page's text: a name tells nothing of what surrounds the article.
A name counts in full if all its words are furniture or plain parts of a page (FURNITURE,
PLAIN: cookie-notice, main-nav).  One with other words too (share-price, no-sidebar) counts
for a container outside an article only, and never beside a word for content (CONTENT).

Cases: a null or empty html, or a page without text, gives an empty text; unclosed and stray
tags are repaired as browsers do for paragraphs, list items and cells; pages of any length
are read whole; rows with null or repeated page_ids are rows like others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from trajectra.llm.common import in_batches

# Elements of HTML by role, and the names by which furniture calls itself.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "select", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SECTIONS = {"html", "body", "main", "article", "section", "div", "td", "tr", "tbody", "table", "center"}
LISTS = {"ul", "ol", "dl", "nav", "aside", "footer", "header", "form", "blockquote"}
FURNITURE_TAGS = {"nav", "footer", "aside", "button", "menu", "dialog"}
FURNITURE = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "form", "header", "login",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "related", "replies", "reply", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}

PLAIN = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "global", "group", "holder", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "primary", "reader",
    "right", "row", "secondary", "section", "site", "slot", "text", "title", "top", "user", "wrap", "wrapper",
}
CONTENT = {"article", "body", "content", "entry", "main", "page", "post", "story", "text"}
#: Words that turn the name they stand before around, or make it a state of something else.
ASIDE = {"has", "no", "non", "not", "with", "without"}

_TOKEN = r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)(%s)>|<[/A-Za-z][^<>]*>?|[^<]+|<"""
TOKEN = re.compile(_TOKEN % r"""(?:[^>"']|"[^"]*"|'[^']*')*+""", re.S)
#: For what follows a tag that no > closes outside quotes: there quotes hide nothing.
BROKEN = re.compile(_TOKEN % "[^<>]*", re.S)
CAMEL = re.compile(r"([a-z])([A-Z])")
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"hidden|display\s*:\s*none", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡«»\"“”()]")
SIGMA = 1.0


def named(attributes: str) -> tuple[str, int]:
    """The words of an element's names, and how far they say furniture: 0 no, 1 in part, 2 in full."""
    words, strength, content = [], 0, False
    for found in NAMES.findall(attributes):
        for name in "".join(found).split():
            own = [w for w in re.split(r"[^a-z]+", CAMEL.sub(r"\1 \2", name).lower()) if w]
            words += own
            content |= bool(own) and CONTENT.issuperset(own)
            if FURNITURE.intersection(own) and not ASIDE.intersection(own):
                strength = max(strength, 2 if all(w in FURNITURE or w in PLAIN for w in own) else 1)
    return ".".join(words), min(strength, 0 if content and strength < 2 else 2)


def hidden(attributes: str) -> bool:
    """Whether an element's own attributes hide it; their values may hold such words for other reasons."""
    if not HIDDEN.search(attributes):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).strip().lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


class Page:
    """The elements of a page, parents before their children, and its text blocks."""

    def __init__(self, html: str):
        self.tag, self.parent = ["html"], [0]
        self.path, self.hard, self.soft, self.article = [0], [False], [0], [False]
        #: (element, text, characters outside links) in page order
        self.blocks: list[tuple[int, str, int]] = []
        self._paths: dict[tuple, int] = {}
        self._read(html)

    def _element(self, name: str, attributes: str, parent: int) -> int:
        words, strength = named(attributes) if attributes else ("", 0)
        inside = self.article[parent]
        self.hard.append(self.hard[parent] or name in FURNITURE_TAGS or bool(attributes) and hidden(attributes) or name == "header" and not inside)
        # in part a name counts for containers outside an article; a form may hold the whole page
        strength = max(strength, 2 * (name == "form"))
        partly = name in SECTIONS or name in LISTS
        self.soft.append(0 if name == "body" else strength if strength == 2 or partly and not inside else 0)
        self.tag.append(name)
        self.parent.append(parent)
        self.path.append(self._paths.setdefault((self.path[parent], name, words), len(self._paths) + 1))
        self.article.append(inside or name in ("article", "main"))
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        pieces: list[tuple[str, bool]] = []
        open_ = defaultdict(int)  # names of the open elements
        unclosed: set[str] = set()
        at, links, pos = 0, 0, 0

        def flush() -> None:
            if pieces:
                text = " ".join("".join(p for p, _ in pieces).split())
                if text:
                    self.blocks.append((at, text, sum(len(p) for p, linked in pieces if not linked)))
                pieces.clear()

        def leave(to: int) -> int:
            """`to`, after closing all elements below it."""
            e = at
            while e != to:
                open_[self.tag[e]] -= 1
                e = self.parent[e]
            return to

        token_at = TOKEN
        while m := token_at.match(html, pos):
            pos = m.end()
            token = m[0]
            if token[0] != "<" or token == "<":
                pieces.append((entities.unescape(token), links > 0))
                continue
            name = (m[2] or "").lower()
            if not name:
                if token[1] not in "!?":
                    token_at = BROKEN
                continue
            if name in RAW:
                if not m[1]:
                    end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, pos)
                    if end:
                        pos = end.end()
                    else:
                        unclosed.add(name)
                        pos = pos if name == "head" else len(html)
                continue
            if name in INLINE:
                if name == "a":
                    links = max(0, links - 1) if m[1] else 1
                elif name in ("br", "img", "wbr"):
                    pieces.append((" ", False))
                continue
            flush()
            links = 0
            if name in VOID:
                continue
            if m[1]:
                if open_[name]:
                    e = at
                    while self.tag[e] != name:
                        e = self.parent[e]
                    at = leave(self.parent[e])
                continue
            if name == "html" and self.tag[at] in ("html", "body"):
                continue
            closes = CLOSES.get(name, ())
            if open_["p"] or any(open_[c] for c in closes):  # a block ends an open paragraph; items and cells end each other
                e = at
                while e:
                    own = self.tag[e]
                    if own == "p" or own in closes:
                        at = leave(self.parent[e])
                    elif own in SECTIONS or own in LISTS:
                        if not (name in ("td", "th", "tr") and own in ("td", "tr") and own in closes):
                            break
                    e = self.parent[e]
            at = self._element(name, m[3] or "", at)
            open_[name] += 1
        flush()

    def summed(self, values: list[tuple[int, int]]) -> list[int]:
        """Per element the sum of (element, value) over all that is below it."""
        out = [0] * len(self.tag)
        for e, v in values:
            out[e] += v
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def furniture(self) -> list[bool]:
        """Per element whether it is furniture or lies in some."""
        plain = self.summed([(e, n) for e, _, n in self.blocks if not self.hard[e]])
        out = list(self.hard)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]] or self.soft[e] > 0 and 2 * plain[e] <= plain[0]
        return out


def path_ratios(page: Page) -> np.ndarray:
    """The fused, smoothed path ratio of every block."""
    path = np.array([page.path[e] for e, _, _ in page.blocks])
    length = np.array([n for _, _, n in page.blocks])
    marks = np.array([len(PUNCTUATION.findall(text)) if n else 0 for _, text, n in page.blocks])
    nodes = np.maximum(1, np.bincount(path))
    ratios = np.stack([(np.bincount(path, weights=v) / nodes)[path] for v in (length, marks)], axis=1)
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    padded = np.pad(ratios, ((3, 3), (0, 0)), mode="edge")
    smooth = sum(w * padded[i : i + len(ratios)] for i, w in enumerate(kernel / kernel.sum()))
    return smooth[:, 0] * (smooth[:, 1] + 0.01)


def extracted(html: str) -> str:
    """The main text of one page, blocks joined by an empty line."""
    page = Page(html)
    furniture = page.furniture()
    shown = [not furniture[e] for e, _, _ in page.blocks]
    if not any(shown):
        return ""
    fused = path_ratios(page)
    limit = min(fused.std(), max(f for f, s in zip(fused, shown) if s))
    mass = page.summed([(e, n + 1) for f, s, (e, _, n) in zip(fused, shown, page.blocks) if s and f >= limit])
    # elements with all of the content lie on one path: the innermost section, or an article around it
    whole = [e for e in range(len(mass)) if mass[e] == mass[0]]
    main = next((e for e in whole if page.tag[e] in ("article", "main")), max(e for e in whole if page.tag[e] in SECTIONS))
    inside = [False] * len(mass)
    for e in range(len(inside)):
        inside[e] = e == main or e > 0 and inside[page.parent[e]]
    return "\n\n".join(text for s, (e, text, _) in zip(shown, page.blocks) if s and inside[e])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of pages(page_id, url, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [extracted(x) if x else "" for x in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": text, "n_chars": [len(t) for t in text]})

    return in_batches(pages).select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op7_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
