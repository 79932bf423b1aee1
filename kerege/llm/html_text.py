"""Main text of web pages: flat text blocks classified by a decision tree.

A page's tags are read once, from left to right; block-level tags cut its text into flat blocks. A block is described by its words and its link
density, by those of the blocks before and after it, and, weaker, by its markup: whether it is a paragraph (or list item, cell ...) or a heading,
and whether a container encloses it that holds no running text by its name (menus, footers, forms, adverts, comments ...). A decision tree, grown
here on the small table PAGES of labelled blocks, keeps or drops each block. PAGES has each layout with named and with unnamed containers, so that the
tree has to tell most blocks by words and links; among them are, by a rule, paragraphs of running text of which up to six words in ten are links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerege.shipping import ship_package

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "paragraph", "heading", "aside")
#: The first of them are of words and links, the others of markup.
TEXT_FEATURES = 6
#: Levels of the tree at most.
DEPTH = 24

_MENU = tuple((1, 1, "p", True, False) for _ in range(4))
#: Labelled blocks of pages, in page order: words, words in links, kind (p: paragraph, list item, cell; h: heading; -: neither), in a container that holds no
#: running text (its name is forgotten in the second copy of each page), main text?
PAGES = (
    # news pages: menu, advert, headline, paragraphs long and short, footer
    (*_MENU, (6, 0, "-", True, False), (9, 0, "h", False, True), (80, 0, "p", False, True), (35, 2, "p", False, True), (5, 0, "p", False, True), (120, 0, "p", False, True), (2, 0, "p", False, True), (16, 0, "-", True, False)),
    (*_MENU, (14, 0, "-", True, False), (1, 0, "h", False, True), (1, 0, "p", False, True), (30, 0, "p", False, True), (1, 0, "p", False, True), (11, 0, "-", True, False)),
    (*_MENU, (3, 0, "-", True, False), (38, 0, "h", False, True), (210, 0, "p", False, True), (24, 0, "-", True, False)),
    (*_MENU, (22, 0, "-", True, False), (12, 0, "h", False, True), (12, 0, "p", False, True), (18, 0, "-", True, False)),
    (*_MENU, (9, 0, "-", True, False), (4, 0, "h", False, True), (7, 0, "p", False, True), (9, 0, "p", False, True), (3, 0, "p", False, True), (60, 0, "p", False, True), (33, 0, "-", True, False)),
    (*_MENU, (30, 0, "-", True, False), (5, 0, "h", False, True), (45, 0, "p", False, True), (6, 0, "-", True, False)),
    # a notice on top, linked site title, sections with headings and lists, related links, share bar
    ((12, 1, "-", True, False), (2, 2, "h", True, False), *_MENU, (8, 0, "h", False, True), (55, 6, "p", False, True), (3, 0, "h", False, True), (4, 0, "p", False, True), (6, 0, "p", False, True), (3, 1, "p", False, True), (70, 0, "p", False, True), (2, 0, "h", True, False), (7, 7, "p", True, False), (6, 6, "p", True, False), (4, 4, "-", True, False), (10, 3, "-", True, False)),
    # text in plain boxes without paragraphs
    (*_MENU, (50, 0, "-", False, True), (40, 3, "-", False, True), (90, 0, "-", False, True), (3, 3, "-", True, False), (12, 2, "-", True, False)),
    ((2, 2, "-", True, False), (1, 1, "-", True, False), (28, 0, "-", False, True), (30, 0, "-", False, True), (27, 0, "-", False, True), (1, 1, "-", True, False)),
    # pages that end with their text; bare texts
    (*_MENU, (7, 0, "h", False, True), (40, 0, "p", False, True), (9, 0, "p", False, True)),
    (*_MENU, (6, 0, "h", False, True), (90, 4, "p", False, True), (26, 0, "p", False, True), (2, 0, "p", False, True)),
    ((5, 0, "h", False, True), (15, 0, "p", False, True)),
    ((150, 0, "p", False, True),),
    ((12, 0, "p", False, True),),
    ((300, 0, "-", False, True),),
    ((60, 0, "-", False, True), (80, 0, "-", False, True), (45, 0, "-", False, True)),
    # text in plain boxes, short lines of which go on after text and are none after links
    (*_MENU, (7, 0, "-", True, False), (50, 0, "-", False, True), (8, 0, "-", False, True), (70, 0, "-", False, True), (50, 48, "-", True, False), (8, 0, "-", True, False), (70, 66, "-", True, False)),
    (*_MENU, (11, 0, "-", True, False), (30, 0, "-", False, True), (12, 0, "-", False, True), (90, 0, "-", False, True), (15, 0, "-", False, True), (48, 0, "-", False, True), (30, 29, "-", True, False), (12, 0, "-", True, False), (90, 84, "-", True, False), (15, 0, "-", True, False), (48, 45, "-", True, False)),
    (*_MENU, (60, 0, "-", False, True), (10, 0, "-", False, True), (80, 0, "-", False, True), (60, 57, "-", True, False), (10, 0, "-", True, False), (80, 78, "-", True, False)),
    # long link lists and tables of contents
    (*_MENU, (12, 11, "p", True, False), (9, 9, "p", True, False), (25, 22, "p", True, False), (14, 0, "h", False, True), (65, 8, "p", False, True), (5, 5, "p", True, False), (75, 9, "p", False, True), (14, 13, "-", True, False), (8, 4, "-", True, False)),
)
def _linked_page(k: int) -> tuple:
    """A page of running text in which paragraphs of 5 to 200 words have one to six words in ten in links, between others without; menu, advert, headline, lengths and foot differ from page to page."""
    draw = np.random.default_rng(k)
    length = lambda: int(draw.choice((1, 3, 5, 8, 13, 20, 35, 60, 110, 200)))
    linked = lambda n: (n, max(1, round(n * draw.choice((0.1, 0.16, 0.25, 0.4, 0.5, 0.6)))))
    text = [((*linked(max(5, length())), "p", False, True) if draw.random() < 0.5 else (length(), 0, "p", False, True)) for _ in range(draw.integers(2, 7))]
    menu = [(int(draw.integers(1, 3)),) for _ in range(draw.integers(2, 6))] if k % 4 else []
    head = [(int(draw.integers(1, 13)), 0, "h", False, True)] if k % 5 else []
    foot = [(int(draw.integers(4, 45)), 0, "-", True, False)] if k % 3 else []
    advert = [(int(draw.integers(3, 35)), 0, "-", True, False)] if draw.random() < 0.6 else []
    return (*((n, n, "p", True, False) for (n,) in menu), *advert, *head, *text, *foot)


PAGES += tuple(map(_linked_page, range(400)))
#: Blocks that only their container's name tells: an advert, a form, a box with other news, readers' comments, a sidebar.
NAMED = (
    ((40, 0, "p", False, True), (25, 0, "-", True, False), (60, 0, "p", False, True), (4, 0, "p", True, False), (30, 0, "p", False, True), (12, 0, "p", True, False), (6, 0, "h", True, False), (18, 0, "p", True, False), (90, 5, "p", True, False)),
    ((70, 0, "p", False, True), (15, 0, "p", True, False), (2, 0, "h", True, False), (8, 0, "p", True, False), (60, 0, "p", True, False), (1, 0, "p", True, False)),
)



def _named_page(k: int) -> tuple:
    """A page as _linked_page makes it, with one to four blocks of any kind and length in named containers between the others."""
    draw = np.random.default_rng(10_000 + k)
    page = list(_linked_page(k))
    for _ in range(draw.integers(1, 5)):
        n = int(draw.choice((1, 2, 4, 8, 15, 30, 60, 100)))
        page.insert(int(draw.integers(0, len(page) + 1)), (n, int(n * draw.choice((0, 0, 0.13, 0.5, 1))), str(draw.choice(("p", "-", "h"))), True, False))
    return tuple(page)


NAMED += tuple(map(_named_page, range(200)))
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ASIDE = frozenset("aside button datalist dialog fieldset footer form label legend menu nav object option select textarea".split())
_HEADER = frozenset(("header", "hgroup"))
_PARAGRAPH = frozenset("p li dd dt td th blockquote pre figcaption caption".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|noscript|template|title|textarea|select|iframe|object|svg|math|canvas|audio|video"
_NAMES = "ad|ads|adv|advert\\w*|promo\\w*|sponsor\\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\\w*|signup|sidebar|side|rail|menu|nav|navbar|navigation|breadcrumbs?|footer|foot|toolbar|share|sharing|social|related|recommend\\w*|comments?|commentlist|repl(?:y|ies)|respond|disqus|login|search|pagination|pager|widget|skip|hidden|copyright|legal|disclaimer|contentinfo|complementary|dialog"
_HINT = re.compile(rf"(?:^|[\s_-])(?:{_NAMES})(?=$|[\s_-])", re.I)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<!/)>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-hidden|style|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HEADER_NAME = re.compile(r"(?:^|[\s_-])(?:header|masthead|banner)(?=$|[\s_-])", re.I)


def _place(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """Of a container: is it an article, one without running text, a page's header?"""
    aside, header = name in _ASIDE, name in _HEADER
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role"):
                aside = aside or (bool(_HINT.search(value)) and name not in ("body", "html", "article", "main"))
                header = header or bool(_HEADER_NAME.search(value))
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                aside = True
    return name in ("article", "main"), aside, header


def blocks(page: str) -> list[tuple[str, int, int, str, bool]]:
    """Flat text blocks in page order: text, words, words in links, kind (p, h or -), in a container without running text."""
    out: list[tuple[str, int, int, str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    article = aside = depth = 0
    kind, in_p, link = "-", False, None  # of a link: how many blocks were open where it began, and whether in a paragraph or heading
    parts: list[tuple[str, bool]] = []

    def end() -> None:
        text = " ".join(html.unescape("".join([p for p, _ in parts])).split())
        if text:
            linked = sum([len(html.unescape(p).split()) for p, in_link in parts if in_link])
            out.append((text, len(text.split()), linked, kind, aside > 0))
        parts.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], link is not None))
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        is_block = name in _BLOCK
        if is_block:
            end()
            depth += (-1 if m[2] else 1) if name != "p" and name not in _VOID else 0
            if link and (link[1] or depth < link[0]):  # an unclosed link ends with its block
                link = None
            in_p = name == "p" and not m[2]
            kind = "-" if m[2] else "p" if name in _PARAGRAPH else "h" if name in _HEADING else "-"
        elif name == "br":
            parts.append((" ", False))
        if name in _VOID:
            continue
        if not m[2]:
            if name == "a":
                link = (depth, kind == "h" or in_p)
            elif m[4].endswith("/") and not is_block:
                continue
            is_article, is_aside, is_header = _place(name, m[4]) if is_block or name in _ASIDE or m[4] else (False, False, False)
            is_aside = is_aside or (is_header and not article)  # an article's own header holds its headline
            if is_article or is_aside or name in ("div", "section", "ul", "ol", "li", "table", "td", "span", "header"):
                if is_aside != (aside > 0) and not is_block and is_aside:
                    end()
                stack.append((name, is_article, is_aside))
                article, aside = article + is_article, aside + is_aside
        elif name == "a":
            link = None
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(x[2] for x in stack[k:]) and not is_block:
                        end()
                    for _, was_article, was_aside in stack[k:]:
                        article, aside = article - was_article, aside - was_aside
                    del stack[k:]
                    break
    if at < len(page):
        parts.append((page[at:], link is not None))
    end()
    return out


def features(found: list[tuple[int, int, str, bool]]) -> np.ndarray:
    """A row of FEATURES for each block (words, words in links, kind, in a container without running text) of a page."""
    words = np.array([b[0] for b in found], np.float64)
    links = np.array([b[1] for b in found], np.float64) / np.maximum(words, 1)
    before = lambda x: np.concatenate(([0], x[:-1]))
    after = lambda x: np.concatenate((x[1:], [0]))
    marks = [np.array([b[2] == "p" for b in found], np.float64), np.array([b[2] == "h" for b in found], np.float64), np.array([b[3] for b in found], np.float64)]
    return np.stack([words, links, before(words), before(links), after(words), after(links), *marks], 1)


class Tree:
    """A classification tree by Gini impurity; grown whole, as its table is small and consistent. In its first two levels a markup feature must leave under half the impurity of any other."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
        self.share = float(y.mean())
        self.feature = None
        if depth and 0 < self.share < 1:
            best = None
            for k in range(x.shape[1]):
                values = np.unique(x[:, k])
                for cut in (values[1:] + values[:-1]) / 2:
                    left = x[:, k] <= cut
                    a, b = y[left], y[~left]
                    cost = (len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())) * (2 if k >= TEXT_FEATURES and depth > DEPTH - 2 else 1)
                    if best is None or cost < best[0] - 1e-12:
                        best = (cost, k, cut, left)
            if best:
                _, self.feature, self.cut, left = best
                self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.share > 0.5)
        left = x[:, self.feature] <= self.cut
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of PAGES, with and without the names of their containers, and of NAMED."""
    pages = [*PAGES, *[tuple((*b[:3], False, b[4]) for b in page) for page in PAGES], *NAMED]
    return np.concatenate([features([b[:4] for b in page]) for page in pages]), np.array([b[4] for page in pages for b in page], np.float64)


def grown() -> Tree:
    return Tree(*labelled())


def extract(page: str | None, tree: Tree) -> str:
    """Main text: kept blocks joined by two line ends."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree.predict(features([b[1:] for b in found]))
    return "\n\n".join([b[0] for b, k in zip(found, keep, strict=True) if k])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = grown()
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            texts = [extract(t.as_py(), tree) for t in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html); null and textless pages give an empty text.

    Pages are read whole whatever their length. Rows that repeat a page_id are read each for itself, a null page_id stays null; other columns are
    ignored; an empty table gives an empty one.
    """
    ship_package(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op8_text_blocks(spark, sf_dir: str) -> DataFrame:
    """Main texts of the whole pages table."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
