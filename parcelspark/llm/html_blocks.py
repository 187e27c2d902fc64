"""Main text of web pages by classified text blocks.

A page becomes a flat list of text blocks. Each block is described by its word count and link density,
those of the blocks before and behind it, and by the kind of container it lies in; a decision tree
trained on a small labelled table (``html_labels``) decides which blocks are main text. The tree is
flattened into arrays and walked for all blocks of a batch at once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelspark.llm.html_labels import LABELLED_PAGES
from parcelspark.llm.store import arrow_rows

# element kinds (fixed values)
BLOCK = frozenset("""address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main math menu nav noscript object ol
    optgroup option p pre section select summary svg table tbody td template tfoot th thead tr ul video audio""".split())
BREAK = frozenset(["hr"])                                     # a block ends here, nothing opens
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())      # content is not markup
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# a start tag ends an open element of the first set, unless one of the second set lies between
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
        "option": ({"option"}, {"select"})}
ASIDE_TAGS = frozenset("""nav footer aside form head noscript template menu dialog select button label option optgroup fieldset legend
    object canvas svg math video audio""".split())
ASIDE_ROLES = frozenset("navigation contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset("""nav navbar navigation menu menubar topbar footer sidebar sidebars aside rail ad ads adv advert adverts
    advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promoted promotion cookie cookies consent
    gdpr notice notices notification alert banner comment comments commentlist disqus reply replies respond discussion share sharing
    social related recommended recommendations teaser teasers breadcrumb breadcrumbs pagination pager paging widget widgets popup
    modal overlay newsletter subscribe subscription signup login search searchbox form toolbar skip copyright disclaimer""".split())
CONTENT_WORDS = frozenset("article content post entry story maincontent posttext articlebody".split())
# containers that never hold an article: an article that opens inside one shows that its end tag is missing
NO_ARTICLE = frozenset("nav header footer head noscript button label select".split())

TOKEN = re.compile(r"""<(?:(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>|(!--)|([!?/]))""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LABEL = re.compile(r"\sdata-main(?:\s|=|$)")

FEATURES = ["words", "links", "words_before", "links_before", "words_behind", "links_behind", "aside", "content", "has_content",
            "heading"]


@dataclass(frozen=True)
class Place:
    """Where text lies: inside an aside container, an article element, a container named like content."""

    aside: bool = False
    article: bool = False
    content: bool = False
    heading: bool = False
    labelled: bool = False


@lru_cache(maxsize=4096)
def _named(attributes: str) -> tuple[frozenset[str], frozenset[str], bool]:
    """Words of the class and id names, roles, and whether the element carries a training label."""
    names, roles = set(), set()
    for kind, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if kind.lower() == "role":
            roles.update(value.lower().split())
        else:
            names.update(w.lower() for w in NAME.findall(value))
    return frozenset(names), frozenset(roles), bool(LABEL.search(attributes))


def _inside(place: Place, tag: str, attributes: str) -> Place:
    names, roles, labelled = _named(attributes)
    aside, article, content = place.aside, place.article, place.content
    wide = tag in ("html", "body")
    if tag in ("article", "main") or roles & {"main", "article"}:
        aside = aside or bool(names & {"comment", "comments", "reply"})
        article = article or not aside
    elif not wide:
        aside = aside or tag in ASIDE_TAGS or bool(names & ASIDE_WORDS) or bool(roles & ASIDE_ROLES)
        # a header belongs to the page, unless it is the article's own
        at_top = tag == "header" or "header" in names or "masthead" in names or "banner" in roles
        aside = aside or (at_top and not (article or content))
        content = content or (not aside and bool(names & CONTENT_WORDS))
    return Place(aside, article, content, place.heading or tag in HEADING, place.labelled or labelled)


@dataclass
class Blocks:
    """Text blocks of one page in page order."""

    texts: list[str]
    words: list[int]
    linked: list[int]          # words inside links
    places: list[Place]


class _Page:
    """One pass over a page's markup that collects its text blocks."""

    def __init__(self, text: str):
        self.out = Blocks([], [], [], [])
        self.stack: list[tuple[str, Place]] = [("", Place())]
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = 0
        self.link_level = 0                                   # stack height at the open link, 0: no link
        self._read(text)
        self._end_block()

    def _end_block(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                self.out.texts.append(" ".join(words))
                self.out.words.append(len(words))
                self.out.linked.append(min(self.linked, len(words)))
                self.out.places.append(self.stack[-1][1])
            self.parts = []
            self.linked = 0

    def _text(self, raw: str) -> None:
        value = html.unescape(raw) if "&" in raw else raw
        self.parts.append(value)
        if self.link_level:
            self.linked += len(value.split())

    def _pop_to(self, height: int) -> None:
        while len(self.stack) > height:
            self.open[self.stack.pop()[0]] -= 1
        if self.link_level > height:
            self.link_level = 0

    def _start(self, tag: str, attributes: str) -> None:
        self._end_block()
        if self.stack[-1][0] == "p":
            self._pop_to(len(self.stack) - 1)
        if tag in ENDS:
            ended, between = ENDS[tag]
            if any(self.open.get(t) for t in ended):
                for k in range(len(self.stack) - 1, 0, -1):
                    name = self.stack[k][0]
                    if name in ended:
                        self._pop_to(k)
                        break
                    if name in between:
                        break
        elif tag in ("article", "main", "body"):
            for k in range(1, len(self.stack)):
                if self.stack[k][0] in NO_ARTICLE:
                    self._pop_to(k)
                    break
        place = _inside(self.stack[-1][1], tag, attributes)
        self.stack.append((tag, place))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        self._end_block()
        if self.open.get(tag):
            height = len(self.stack) - 1
            while self.stack[height][0] != tag:
                height -= 1
            self._pop_to(height)

    def _read(self, text: str) -> None:
        last_end, at, size = text.rfind(">"), 0, len(text)
        while at < size:
            lt = text.find("<", at)
            if lt < 0:
                self._text(text[at:])
                return
            if lt > at:
                self._text(text[at:lt])
            token = TOKEN.match(text, lt) if lt < last_end else None
            if token is None:
                if lt > last_end and text[lt + 1:lt + 2].isalpha() or text.startswith(("</", "<!"), lt) and lt > last_end:
                    return                                    # markup that is cut off at the end of the page
                self._text("<")
                at = lt + 1
                continue
            closing, tag, attributes, comment, other = token.groups()
            if comment:
                end = text.find("-->", lt + 4)
                if end < 0:
                    return
                at = end + 3
            elif other:
                at = text.index(">", lt) + 1
            else:
                at = token.end()
                at = self._tag(text, at, bool(closing), tag.lower(), attributes)
                if at < 0:
                    return

    def _tag(self, text: str, at: int, closing: bool, tag: str, attributes: str) -> int:
        """Handle one tag and return where to go on (-1: nothing behind it is text)."""
        if tag in RAW:
            if closing:
                return at
            end = _raw_end(tag).search(text, at)
            return end.end() if end else -1
        if tag == "br":
            self.parts.append(" ")
        elif tag in BREAK:
            self._end_block()
        elif tag in BLOCK:
            if closing:
                self._end(tag)
            elif not attributes.endswith("/") or tag not in ("svg", "math"):
                self._start(tag, attributes)
        elif tag == "a":
            self.link_level = 0 if closing else len(self.stack)
        return at


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I)


def blocks(page: str) -> Blocks:
    return _Page(page).out


def describe(page: Blocks) -> np.ndarray:
    """Feature matrix of a page's blocks (see ``FEATURES``); missing neighbours have 0 words, density 0."""
    n = len(page.texts)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    words = np.array(page.words, dtype=float)
    links = np.array(page.linked, dtype=float) / words
    out[:, 0], out[:, 1] = words, links
    out[1:, 2], out[1:, 3] = words[:-1], links[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], links[1:]
    out[:, 6] = [p.aside for p in page.places]
    article = np.array([p.article for p in page.places])
    out[:, 7] = article if article.any() else [p.content for p in page.places]
    out[:, 8] = out[:, 7].any()
    out[:, 9] = [p.heading for p in page.places]
    return out


@dataclass
class Tree:
    """A binary decision tree in arrays: go right where ``x[feature] > limit``; leaves point at themselves."""

    feature: np.ndarray
    limit: np.ndarray
    right: np.ndarray          # the left child is the next node
    left: np.ndarray
    share: np.ndarray          # share of main blocks in the node

    def main(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(len(self.feature)):
            after = np.where(x[np.arange(len(x)), self.feature[at]] > self.limit[at], self.right[at], self.left[at])
            if (after == at).all():
                break
            at = after
        return self.share[at] > 0.5


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """Classification tree by least Gini impurity; limits lie midway between neighbouring values, ties go
    to the first feature and the smallest limit."""
    rows: list[list[float]] = []

    def split(inside: np.ndarray, level: int) -> int:
        node, labels = len(rows), y[inside]
        rows.append([0, np.inf, node, node, labels.mean()])
        if level == depth or labels.min() == labels.max():
            return node
        best = None
        for f in range(x.shape[1]):
            order = np.argsort(x[inside, f], kind="stable")
            value, label = x[inside, f][order], labels[order]
            left = np.arange(1, len(value))
            hit = np.cumsum(label)[:-1]
            rest = label.sum() - hit
            impurity = hit * (left - hit) / left + rest * (len(value) - left - rest) / (len(value) - left)
            impurity[value[1:] == value[:-1]] = np.inf
            k = int(np.argmin(impurity)) if len(impurity) else 0
            if len(impurity) and np.isfinite(impurity[k]) and (best is None or impurity[k] < best[0] - 1e-12):
                best = (impurity[k], f, (value[k] + value[k + 1]) / 2)
        if best is None:
            return node
        _, f, limit = best
        goes = x[inside, f] > limit
        rows[node][0], rows[node][1] = f, limit
        rows[node][3] = split(inside[~goes], level + 1)
        rows[node][2] = split(inside[goes], level + 1)
        return node

    split(np.arange(len(x)), 0)
    table = np.array(rows)
    return Tree(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4])


def train(pages: list[str] = LABELLED_PAGES) -> Tree:
    """Tree of the labelled table: pages whose main blocks carry the attribute ``data-main``."""
    read = [blocks(p) for p in pages]
    x = np.concatenate([describe(b) for b in read])
    y = np.concatenate([[float(p.labelled) for p in b.places] for b in read])
    return grow(x, y)


def main_text(pages: list[str | None], tree: Tree) -> list[str]:
    """Main text of each page: its main blocks, joined by newlines."""
    read = [blocks(p or "") for p in pages]
    bounds = np.cumsum([0, *[len(b.texts) for b in read]])
    x = np.concatenate([describe(b) for b in read]) if bounds[-1] else np.zeros((0, len(FEATURES)))
    main = tree.main(x)
    return ["\n".join(t for t, m in zip(b.texts, main[lo:hi]) if m) for b, lo, hi in zip(read, bounds[:-1], bounds[1:])]


def _extract(tree: Tree) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                texts = main_text(part.column("html").to_pylist(), tree)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: ``page_id, url, text, n_chars``.

    White space inside a block is one space; blocks stand in page order, joined by a newline. Null and
    empty pages, and pages without main text, have an empty text. Pages are read one by one, so repeated
    rows get equal results; markup that is cut off or never closed ends with the page. Other columns are
    ignored.
    """
    arrow_rows(pages.sparkSession)
    slim = pages.select(*[F.col(c).cast(k).alias(c) for c, k in (("page_id", "long"), ("url", "string"), ("html", "string"))])
    return slim.mapInArrow(_extract(tree or train()), "page_id long, url string, text string, n_chars long")
