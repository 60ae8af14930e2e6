"""Main text of web pages: flat text blocks, shallow features, a small decision tree.

A page is cut at block-level tags into text blocks. A block is described by its word count
and link density, those of its two neighbours, and what it stands in: article elements,
and containers whose tag or class names say menu, header, advert, comment and so on. A
decision tree, trained on ``LABELLED`` (a small hand-labelled table of pages), keeps or
drops each block. No other block is lost or cut.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>",
    re.S,
)
#: Elements whose content is never text.
_RAW = frozenset("script style noscript template svg iframe object canvas math textarea".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search"
    " section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are followed to their end tag.
_CONTAINER = frozenset(
    "article aside blockquote body button dialog div dl fieldset figure footer form head header html li main menu nav ol"
    " search section select span table td title tr ul p".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER_TAGS = frozenset("nav footer aside form head title menu button select dialog search".split())
_ARTICLE_TAGS = frozenset(("article", "main"))
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Words of class, id and role names that mark what is not the article.
BOILER_NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments complementary"
    " consent contentinfo cookie cookies copyright disclaimer discussion disqus dropdown feedback footer form gdpr hidden"
    " login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager paging"
    " pagination popup promo promoted promotion recommended register related replies reply respond rss search share sharing"
    " shoutbox sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar tracking"
    " warning widget widgets".split()
)
#: Names of wrappers that only mention such a part ("with-sidebar").
_MENTIONS = frozenset("with has no without wrapper layout".split())
#: Page headers; inside an article they hold its title and stay.
HEADER_NAMES = frozenset(("header", "heading", "top"))


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    boiler: bool
    label: str | None = None


@dataclass
class _Open:
    tag: str
    article: bool
    boiler: bool
    label: str | None


def _names(attributes: str) -> set[str]:
    found = set()
    for m in _ATTRIBUTE.finditer(attributes):
        found.update(w.lower() for w in _NAME.findall(m[2] or m[3] or m[4] or ""))
    return set() if found & _MENTIONS else found


_LABEL = re.compile(r"data-label=\"(\w+)\"")


def blocks(page: str | None) -> list[Block]:
    """Text blocks of a page in order; white space inside one is single spaces."""
    page = page or ""
    out: list[Block] = []
    stack = [_Open("", False, False, None)]
    parts: list[tuple[str, bool]] = []
    in_link = 0

    def flush() -> None:
        if not parts:
            return
        words = " ".join(references.unescape("".join(t for t, _ in parts)).split())
        if words:
            linked = sum(len(references.unescape(t).split()) for t, link in parts if link)
            n, top = words.count(" ") + 1, stack[-1]
            out.append(Block(words, n, min(n, linked), top.article, top.boiler, top.label))
        parts.clear()

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            if at < len(page):
                parts.append((page[at:], in_link > 0))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], in_link > 0))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] if m[2] else (m[6] or "")
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in _BLOCK:
            flush()
        if tag == "a":
            in_link = 0 if closing else 1
        if tag not in _CONTAINER or tag in _VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag == "span" and i < len(stack) - 1:
                        break
                    flush()
                    del stack[i:]
                    break
            continue
        if attributes.endswith("/"):
            continue
        top = stack[-1]
        if top.tag == "p" and tag in _BLOCK or top.tag == tag == "li":
            stack.pop()
            top = stack[-1]
        names = _names(attributes) if "=" in attributes and tag not in ("html", "body") else set()
        article = top.article or tag in _ARTICLE_TAGS
        header = (tag == "header" or bool(names & HEADER_NAMES) or "banner" in names) and not top.article
        if tag == "span" and not (names & BOILER_NAMES):
            continue
        boiler = top.boiler or tag in _BOILER_TAGS or header or bool(names & (BOILER_NAMES - ({"banner"} if header else set())))
        if boiler != top.boiler:
            flush()
        label = _LABEL.search(attributes) if "data-label" in attributes else None
        stack.append(_Open(tag, article, boiler, label[1] if label else top.label))
    flush()
    return out


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "boiler")


def features(found: list[Block]) -> np.ndarray:
    """One row per block; beyond the page's ends a neighbour has no words."""
    own = np.array([(b.words, b.linked / b.words) for b in found], dtype=float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, own])[:-1], np.vstack([own, edge])[1:]
    place = np.array([(b.article, b.boiler) for b in found], dtype=float).reshape(-1, 2)
    return np.hstack([own, before, after, place])


@dataclass
class Tree:
    """Binary splits on features, grown by Gini impurity."""

    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    keep: bool = False

    @staticmethod
    def grow(x: np.ndarray, y: np.ndarray, depth: int = 5) -> Tree:
        leaf = Tree(keep=bool(2 * y.sum() > len(y)))
        if depth == 0 or y.all() or not y.any():
            return leaf
        best = (2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for cut in (values[1:] + values[:-1]) / 2:
                side = x[:, j] <= cut
                gini = sum(s.mean() * 2 * y[s].mean() * (1 - y[s].mean()) for s in (side, ~side))
                best = min(best, (gini, j, float(cut)))
        if best[1] < 0:
            return leaf
        side = x[:, best[1]] <= best[2]
        return Tree(best[1], best[2], Tree.grow(x[side], y[side], depth - 1), Tree.grow(x[~side], y[~side], depth - 1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.keep)
        if self.feature >= 0 and len(x):
            side = x[:, self.feature] <= self.cut
            out[side], out[~side] = self.low.predict(x[side]), self.high.predict(x[~side])
        return out


def _w(n: int) -> str:
    return " ".join(f"w{i}" for i in range(n))


def _links(n: int, words: int = 1) -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">{_w(words)}</a></li>' for i in range(n)) + "</ul>"


#: Labelled pages. data-label names what a container's blocks are: main or other. Written
#: by hand; word contents do not matter, only their number does.
LABELLED = (
    f'<body data-label="other"><nav>{_links(6)}</nav><div class="ad">{_w(8)}</div><article data-label="main"><h1>{_w(6)}</h1>'
    f'<p>{_w(90)}</p><p>{_w(2)}</p><p>{_w(1)}</p><p>{_w(30)}</p><p><a href="/l">{_w(14)}</a></p><p>{_w(2)} <a href="/m">{_w(26)}</a></p></article><footer>{_w(9)}</footer></body>',
    f'<body data-label="other"><header><h2>{_w(3)}</h2>{_links(4, 2)}</header><main data-label="main"><h1>{_w(8)}</h1><p>{_w(45)} '
    f'<a href="/x">{_w(4)}</a></p>{_links(3, 5)}<p>{_w(3)}</p><aside data-label="other"><p>{_w(40)}</p></aside></main>'
    f'<div id="sidebar">{_links(8, 3)}<p>{_w(60)}</p></div></body>',
    f'<body data-label="other"><div class="cookie-notice">{_w(35)}<button>{_w(1)}</button></div><article data-label="main"><p>{_w(12)}</p>'
    f'<p><a href="/s">{_w(3)}</a></p><form data-label="other">{_w(14)}</form><p>{_w(70)}</p></article>'
    f'<section class="comments"><p>{_w(55)}</p><p>{_w(5)}</p><p>{_w(120)}</p></section></body>',
    f'<body data-label="other"><p>{_w(2)}</p>{_links(5)}<div data-label="main"><h1>{_w(7)}</h1><p>{_w(60)}</p><p>{_w(80)}</p><p>{_w(25)}</p></div>'
    f'{_links(6, 2)}<p>{_w(4)}</p></body>',
    f'<body data-label="other"><p><a href="/">{_w(3)}</a></p><div data-label="main"><p>{_w(120)}</p><p>{_w(35)}</p><p>{_w(18)} <a href="/y">{_w(2)}</a></p>'
    f'<p>{_w(50)}</p></div><p>{_w(3)} <a href="/z">{_w(9)}</a></p><p>{_w(3)}</p></body>',
    f'<body data-label="other"><div class="site-header">{_w(5)}</div><article data-label="main"><header><h1>{_w(9)}</h1></header><p>{_w(40)}</p>'
    f'<p>{_w(7)}</p><div class="share" data-label="other">{_links(4)}</div><div class="related" data-label="other">{_links(5, 7)}</div></article>'
    f'<div class="comment-list"><p>{_w(33)}</p><p>{_w(2)}</p></div><footer>{_links(3)}<p>{_w(45)}</p></footer></body>',
)


#: An article of many sizes of paragraphs, some of them links; and a page of links and scraps.
_SIZES = (6, 55, 1, 3, 14, 9, 80, 2, 21, 130, 4, 11, 17, 60, 5, 8, 35, 1, 12, 7, 26, 100, 16, 10)
LABELLED += (
    '<body data-label="other"><article data-label="main">'
    + "".join(f'<p><a href="/">{_w(n)}</a></p>' if i % 6 == 4 else f"<p>{_w(n)}</p>" for i, n in enumerate(_SIZES))
    + "</article></body>",
    '<body data-label="other">' + "".join(f'<p><a href="/">{_w(n)}</a></p><p>{_w(n // 2 + 1)}</p>' for n in _SIZES if n < 20) + "</body>",
)


def train(pages: tuple[str, ...] = LABELLED) -> Tree:
    x, y = [], []
    for page in pages:
        found = blocks(page)
        x.append(features(found))
        y.extend(b.label == "main" for b in found)
    return Tree.grow(np.vstack(x), np.array(y))


@dataclass
class Extractor:
    tree: Tree = field(default_factory=train)

    def text(self, page: str | None) -> str:
        found = blocks(page)
        if not found:
            return ""
        return " ".join(b.text for b, keep in zip(found, self.tree.predict(features(found))) if keep)


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for ``(page_id, url, html)``, one row per input row.

    Null and empty html give an empty text; ids and urls pass through, null or repeated.
    A page of any length is read whole. An empty table gives no rows; other columns are
    not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(Extractor())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = shared.value.text
        for batch in batches:
            texts = [extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    narrow = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return narrow.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
