"""Main text of web pages: flat text blocks with features of themselves and their neighbours, classified by a decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, tidy

# Tag names of HTML, by what they do here.
RAW = frozenset("script style textarea iframe".split())
SKIPPED = RAW | frozenset("noscript template svg annotation annotation-xml object canvas head select button".split())
HEAD = frozenset("html head meta link base basefont bgsound".split())
HIDDEN = frozenset("title script style noscript template".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
NESTED = BLOCKS - frozenset("p hr li dt dd tr td th thead tbody tfoot html body h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("nav footer aside form menu dialog search fieldset".split())
MAIN = frozenset("article main".split())
# Words in class, id and role names, by what they hint at; a name with a word of ABSENT hints at nothing.
ASIDE_NAMES = frozenset(
    "ad ads adsense advert advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer discussion disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice overlay pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
MAIN_NAMES = frozenset("article body content entry main post story text".split())
ABSENT = frozenset("free has hide no not with without".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_WHITE = re.compile(r"\s*+")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_MAIN_ROLE = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "around_words", "around_links", "in_main", "in_aside", "hint", "heading", "item")
#: Seed and number of the labelled pages, least blocks of a leaf, depth of the tree.
SEED, PAGES, LEAST_LEAF, DEPTH = 3, 600, 3, 12
#: Words that a neighbour counts with at most: beyond it a paragraph is long.
MANY = 60


@dataclass
class Block:
    text: str
    words: int
    linked: int
    around: int  # the element that holds the block with its neighbours
    in_main: bool
    in_aside: bool
    hint: int
    heading: bool
    item: bool
    label: int | None = None


@lru_cache(4096)
def _hint(attrs: str) -> int:
    """What the names of an element hint at: -1 what surrounds an article, 1 an article, 0 nothing."""
    out = 0
    for name in " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)).split():
        parts = {x.lower() for x in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", name)}
        if parts & ABSENT:
            continue
        if parts & ASIDE_NAMES:
            return -1
        out = out or int(bool(parts & MAIN_NAMES))
    return out


@lru_cache(64)
def _tags(tag: str) -> re.Pattern:
    """Start and end tags of a name; group 1 is filled at the end tags."""
    return re.compile(rf"<(?:(/){tag}(?:[\s/][^>]*+)?+|{tag}(?:[\s/](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)?+)>", re.I)


@lru_cache(64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?:[\s/][^>]*+)?+>", re.I)


class _Skips:
    """Where skipped elements of a page end."""

    def __init__(self, page: str):
        self.page, self.ends = page, {}

    def end(self, m: re.Match) -> int:
        """The end of the element whose start tag is m. One without an end tag is its start tag alone, but raw text goes on to the end of the page."""
        tag = m["tag"].lower()
        if tag == "head":
            return self._head(m.end())
        if tag in RAW:
            x = _raw_end(tag).search(self.page, m.end())
            return x.end() if x else len(self.page)
        if tag not in self.ends:
            self.ends[tag], started = {}, []
            for x in _tags(tag).finditer(self.page):
                if not x[1]:
                    if not (tag in ("svg", "math") and x[0].endswith("/>")):
                        started.append(x.start())
                elif started:
                    self.ends[tag][started.pop()] = x.end()
        return self.ends[tag].get(m.start(), m.end())

    def _head(self, at: int) -> int:
        """The end of a head: its end tag, or else what comes before the first text or tag of the body."""
        while m := _TOKEN.match(self.page, at + len(_WHITE.match(self.page, at)[0])):
            tag = (m["tag"] or "").lower()
            if m["end"] and tag in ("body", "html", "br") or tag and not m["end"] and tag not in HEAD | HIDDEN:
                return at
            at = self.end(m) if tag in HIDDEN and not m["end"] else m.end()
            if m["end"] and tag == "head":
                return at
        return at


@dataclass(frozen=True)
class _Open:
    """An open element that encloses blocks."""

    tag: str = ""
    number: int = 0
    in_main: bool = False
    in_aside: bool = False
    hint: int = 0

    def inner(self, tag: str, attrs: str, number: int) -> _Open:
        main = tag in MAIN or bool(_MAIN_ROLE.search(attrs))
        own = 0 if main or tag == "body" else _hint(attrs)  # an article's own names say nothing about it
        aside = tag in ASIDE or tag == "header" and not self.in_main
        return _Open(tag, number, self.in_main or main, self.in_aside or aside, _joined(self.hint, own))


def _joined(outer: int, own: int) -> int:
    return -1 if -1 in (outer, own) else own or outer


def text_blocks(page: str) -> list[Block]:
    """The text blocks of a whole page in order, with what encloses them."""
    blocks: list[Block] = []
    stack = [_Open()]
    number, hint, heading, item = 0, 0, False, False
    parts: list[tuple[str, bool]] = []
    in_link, label, at = False, None, 0

    def close() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                linked = sum(len(html.unescape(t).split()) for t, k in parts if k)
                words = text.count(" ") + 1
                top = stack[-1]
                blocks.append(Block(text, words, min(linked, words), top.number, top.in_main, top.in_aside, hint, heading, item, label))
            parts = []

    skips = _Skips(page)
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            parts.append((page[at : m.start()], in_link))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SKIPPED and not m["end"]:
            at = skips.end(m)
        elif tag == "a":
            in_link = not m["end"]
        elif tag == "br":
            parts.append((" ", False))
        elif tag in BLOCKS:
            close()
            hint = stack[-1].hint
            if tag in NESTED:
                if m["end"]:
                    k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), None)
                    if k is not None:
                        del stack[k:]
                elif not m["attrs"].endswith("/"):
                    number += 1
                    stack.append(stack[-1].inner(tag, m["attrs"], number))
                hint = stack[-1].hint
            elif not m["end"]:
                hint = _joined(hint, _hint(m["attrs"]))
            heading, item, in_link = not m["end"] and tag in ("h1", "h2", "h3", "h4", "h5", "h6"), not m["end"] and tag in ("li", "dt", "dd"), False
            x = re.search(r'data-y="(\d)"', m["attrs"]) if "data-y" in m["attrs"] else None
            label = int(x[1]) if x else None
    if at < len(page):
        parts.append((page[at:], in_link))
    close()
    return blocks


def features(blocks: list[Block], hints: bool = True) -> np.ndarray:
    """A row per block, in the order of FEATURES: its words and link density, those of its neighbours and of all blocks of its element, and where it stands."""
    x = np.zeros((len(blocks), len(FEATURES)))
    if blocks:
        words = np.array([b.words for b in blocks], float)
        linked = np.array([b.linked for b in blocks], float)
        links, few = linked / words, np.minimum(words, MANY)
        x[:, 0], x[:, 1] = few, links
        x[1:, 2], x[1:, 3], x[:-1, 4], x[:-1, 5] = few[:-1], links[:-1], few[1:], links[1:]
        place = np.unique([b.around for b in blocks], return_inverse=True)[1]
        total, in_links = np.bincount(place, words), np.bincount(place, linked)
        x[:, 6], x[:, 7] = np.minimum(total, 4 * MANY)[place], (in_links / total)[place]
        x[:, 8:] = [[b.in_main, b.in_aside, b.hint if hints else max(b.hint, 0), b.heading, b.item] for b in blocks]
    return x


class Tree:
    """A binary classification tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
        self.share = float(y.mean()) if len(y) else 0.0
        self.feature = None
        if depth and 0 < self.share < 1:
            best = min((self._split(x[:, f], y, f) for f in range(x.shape[1])), default=None)
            if best and best[0] < np.inf:
                _, self.feature, self.cut = best
                low = x[:, self.feature] <= self.cut
                self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    @staticmethod
    def _split(v: np.ndarray, y: np.ndarray, f: int) -> tuple[float, int, float]:
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        ends = np.flatnonzero(v[1:] > v[:-1])
        ends = ends[(ends + 1 >= LEAST_LEAF) & (len(y) - ends - 1 >= LEAST_LEAF)]
        if not len(ends):
            return np.inf, f, 0.0
        n, ones, total = ends + 1, np.cumsum(y)[ends], y.sum()
        m, rest = len(y) - n, total - ones
        impurity = ones * (n - ones) / n + rest * (m - rest) / m
        k = int(impurity.argmin())
        return float(impurity[k]), f, float((v[ends[k]] + v[ends[k] + 1]) / 2)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.share)
        low = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


class _Pages:
    """Small labelled pages made from a rule: every block says in data-y whether it is main text (1) or not (0).

    Half of them name their parts by elements or classes, the others must be told by words and links alone.
    """

    def __init__(self, seed: int):
        self.rng = np.random.Generator(np.random.PCG64(seed))

    def one(self, *choices):
        return choices[int(self.rng.integers(len(choices)))]

    def text(self, least: int, most: int, links: float = 0.0) -> str:
        """Words, a share of which stands in links of one to four words."""
        n, out = int(self.rng.integers(least, most + 1)), []
        while len(out) < n:
            run = ["w" * int(self.rng.integers(1, 10)) for _ in range(int(self.rng.integers(1, 5)))][: n - len(out)]
            if self.rng.random() < links:
                run[0], run[-1] = "<a href=x>" + run[0], run[-1] + "</a>"
            out += run
        return " ".join(out)

    def block(self, y: int, text: str, tag: str = "p", attrs: str = "") -> str:
        return f'<{tag} {attrs} data-y="{y}">{text}</{tag}>'

    def wrapped(self, inner: str, tag: str, attrs: str = "") -> str:
        return f"<{tag} {attrs}>{inner}</{tag}>"

    def links(self, named: bool) -> str:
        """A menu or list of links."""
        items = "".join(self.block(0, f"<a href=x>{self.text(1, 6)}</a>", self.one("li", "li", "p")) for _ in range(int(self.rng.integers(2, 9))))
        return self.wrapped(items, *(self.one(("nav", ""), ("div", "class=menu"), ("ul", "id=nav")) if named else (self.one("ul", "div"), "")))

    def teasers(self, named: bool) -> str:
        """Short texts that mostly link elsewhere."""
        items = "".join(self.block(0, f"<a href=x>{self.text(2, 14)}</a> {self.text(0, 10)}", "p") for _ in range(int(self.rng.integers(1, 5))))
        return self.wrapped(items, *(self.one(("aside", ""), ("div", 'class="related-posts"'), ("section", "class=teaser")) if named else ("div", "")))

    def notice(self, named: bool) -> str:
        """An advert, a notice, a form or comments: long texts are named, others are a few words."""
        if not named:
            return self.wrapped(self.block(0, self.text(1, 6, self.one(0, 0, 0.5)), "p"), "div")
        kind = self.one(("div", "class=ad"), ("div", 'class="cookie-notice"'), ("form", ""), ("section", "id=comments"), ("div", 'class="comment-list"'), ("aside", ""), ("div", "id=sidebar"), ("div", "role=complementary"))
        return self.wrapped("".join(self.block(0, self.text(1, 80, self.one(0, 0.1))) for _ in range(int(self.rng.integers(1, 4)))), *kind)

    def foot(self, named: bool) -> str:
        return self.wrapped(self.block(0, self.text(1, 40 if named else 8, self.one(0, 0.4)), "p"), *(self.one(("footer", ""), ("div", "class=footer")) if named else ("div", "")))

    def story(self, named: bool) -> str:
        """An article: paragraphs of all lengths, at least one of them long where no element says that it is an article."""
        parts = [self.block(1, self.text(1, 12), self.one("h1", "h2"))] if self.rng.random() < 0.8 else []
        n = int(self.rng.integers(1, 7))
        sizes = [int(self.rng.integers(1, 120)) if self.rng.random() < 0.6 else int(self.rng.integers(1, 10)) for _ in range(n)]
        if not named:
            sizes[int(self.rng.integers(n))] = 80
        for size in sizes:
            parts.append(self.block(1, self.text(max(1, size // 2), size, self.one(0, 0, 0.1, 0.2) if size > 8 else self.one(0, 0, 0, 1) if named else 0), self.one("p", "p", "p", "blockquote", "pre")))
            if self.rng.random() < 0.15:
                parts.append(self.wrapped("".join(self.block(1, self.text(2, 14), "li") for _ in range(3)), "ul"))
            if named and self.rng.random() < 0.2:
                parts.append(self.one(self.notice, self.teasers)(True))
            if self.rng.random() < 0.1:
                parts.append(self.block(1, self.text(1, 6), "h2") + self.block(1, self.text(15, 90)))
        return self.wrapped("".join(parts), *(self.one(("article", ""), ("main", ""), ("article", 'class="related-post"'), ("div", 'class="post-content"')) if named else (self.one("div", "section"), "")))

    def page(self) -> str:
        named = bool(self.rng.random() < 0.5)
        before = [self.one(self.links, self.links, self.teasers, self.notice)(named if self.rng.random() < 0.7 else True) for _ in range(int(self.rng.integers(0, 4)))]
        after = [self.one(self.links, self.teasers, self.notice, self.foot)(named if self.rng.random() < 0.7 else True) for _ in range(int(self.rng.integers(0, 4)))]
        return "<body>" + "".join([*before, self.story(named), *after])


def labelled(seed: int = SEED, pages: int = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features and labels of the blocks of small pages."""
    make, x, y = _Pages(seed), [], []
    for _ in range(pages):
        blocks = text_blocks(make.page())
        x.append(features(blocks))
        y += [b.label for b in blocks]
    return np.concatenate(x), np.array(y, float)


@lru_cache(1)
def trained() -> Tree:
    """The tree, trained on the labelled table."""
    return Tree(*labelled())


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """The main text of a page: its content blocks, in order, joined by an empty line.

    Where nothing is left, names may have misled: the page is read again without those that hint at other things.
    """
    blocks, tree = text_blocks(page or ""), tree or trained()
    if not blocks:
        return ""
    keep = tree.predict(features(blocks)) >= 0.5
    if not keep.any():
        keep = tree.predict(features(blocks, hints=False)) >= 0.5
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Main text of whole pages: the columns in keep (default page_id, url), text, n_chars, n_blocks.

    Null and empty html give an empty text. Rows are independent of each other, repeated rows
    included. Columns of pages named like the new ones are left out of keep.
    """
    arrow_rows(pages.sparkSession, 512)
    names = [c for c in (keep or ["page_id", "url"]) if c not in ("text", "n_chars", "n_blocks")]
    tree = pages.sparkSession.sparkContext.broadcast(trained())  # some hundred nodes
    schema = pages.select(*names).schema.add("text", "string").add("n_chars", "long").add("n_blocks", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x, tree.value) for x in b.column("_html").to_pylist()]
            counts = [[len(t) for t in text], [t.count("\n\n") + 1 if t else 0 for t in text]]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(text, pa.string()), *[pa.array(c, pa.int64()) for c in counts]], names=[*names, "text", "n_chars", "n_blocks"])

    return pages.select(*names, F.col("html").alias("_html")).mapInArrow(tidy(run), schema)
