"""Main text of web pages by text-to-tag ratios.

`Events` takes the parser's events as they come and keeps blocks and their lines: a line ends where its block or the source's
line does. Lines' text-to-tag ratios (link text doesn't count) are smoothed along the page with a Gaussian and clustered in two.
Blocks of upper lines are content; where they lie decides the page's region, and within it which parts belong to the text:
those that hold content, and single blocks that stand beside it, but no parts of links. What elements call themselves is a hint
on top: side matter by name (menus, headers, footers, sidebars, notices, adverts, forms, comments) is left out unless it holds
nearly all of the page, and an article or main element that holds most of the content is the region.

All passes are linear in the page, however deeply it is nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenspan.llm.runtime import slices

#: What HTML calls things.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head title script style noscript template iframe object svg math canvas audio video select textarea button datalist nav header footer aside dialog menu".split())
#: Side matter by its tag, but some pages are one form.
SIDE = frozenset(("form",))
HOLDS = frozenset("article main section div body td".split())
BOILER = frozenset("ad ads adsbygoogle advert adverts advertisement advertisements adsense adslot sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall comment comments commentlist commentary respond replies disqus discussion sidebar sidebars widget widgets menu menus nav navbar navigation navigator breadcrumb breadcrumbs topbar masthead header footer share sharing shares social related recommended recommendations toolbar pagination pager login search skiplink disclaimer copyright".split())
BOILER_BEGINS = ("advert", "comment", "cookie", "newsletter", "sidebar", "sponsor")
#: An element called has-sidebar or no-comments is none.
WITH = ("has", "with", "no-", "no_", "layout", "page-with", "col-")
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_LISTS = frozenset(("ul", "ol"))
_NONE: frozenset[str] = frozenset()
_AROUND_INLINE = HOLDS | {"p", "li"}


class Events(HTMLParser):
    """Blocks of a page (text parts, node), their lines (block, characters outside links, tags), and the tree of its nodes:
    elements that hold blocks or hide what is in them.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[list[str], int]] = []
        self.lines: list[list[int]] = []
        self.parent, self.kind = [0], [""]
        self.hard, self.soft, self.shown = [False], [False], [False]  # hidden, with all that it holds; hidden by its class, id or as a form; holds an article
        self.open: list[tuple[str, int, bool]] = []  # tag, the node around it, whether it mutes its block's text
        self.places: dict[str, list[int]] = {}  # of each tag's open elements in open
        self.node = 0
        self.links = 0
        self.muted = 0
        self.cut()

    def cut(self) -> None:
        self.now: list[str] | None = None
        self.end_line()

    def end_line(self) -> None:
        self.line: list[int] | None = None
        self.tags = 1

    def count(self, n: int, links: bool) -> None:
        if self.line is None:
            self.line = [len(self.blocks) - 1, 0, self.tags]
            self.lines.append(self.line)
        if not links:
            self.line[1] += n

    def tagged(self) -> None:
        if self.line is not None:
            self.line[2] += 1
        elif self.now is not None:
            self.tags += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "br" and self.now is not None:
                self.now.append(" ")
            elif tag == "hr":
                self.cut()
            self.tagged()
            return
        if tag in CLOSES_P:
            self.close_to("p", HOLDS)
        if tag == "li":
            self.close_to("li", _LISTS)
        inline = tag in INLINE
        if inline:
            self.tagged()
        else:
            self.cut()
        hard, soft = self.hides(tag, attrs) if attrs or not inline else (False, False)
        mutes = inline and (hard or soft)  # what an inline element hides is left out of its block
        self.muted += mutes
        self.links += tag == "a"
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, self.node, mutes))
        if not inline and (hard or soft or tag in HOLDS):
            self.parent.append(self.node)
            self.kind.append(tag)
            self.hard.append(hard or self.hard[self.node])
            self.soft.append(soft)
            self.shown.append(tag in ("article", "main") and not soft)
            self.node = len(self.parent) - 1

    def hides(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        if tag in NEVER:
            return True, False
        soft = tag in SIDE
        for name, value in attrs:
            v = (value or "").lower()
            if name == "hidden" and v != "until-found" or name == "aria-hidden" and v == "true" or name == "role" and v in ROLES or name == "style" and _HIDDEN.search(v):
                return True, False
            if name in ("class", "id") and tag not in ("html", "body", "main"):
                soft = soft or any(w in BOILER or w.startswith(BOILER_BEGINS) for token in v.split() if not token.startswith(WITH) for w in _NAME.findall(token))
        return False, soft

    def close_to(self, tag: str, stop: frozenset[str]) -> None:
        """End the innermost open `tag`, unless one of `stop` is between."""
        if (own := self.places.get(tag)) and own[-1] >= max((p[-1] for t in stop if (p := self.places.get(t))), default=-1):
            self.pop(own[-1])

    def pop(self, i: int) -> None:
        for tag, _, mutes in self.open[i:]:
            if tag not in INLINE:
                self.cut()
            self.muted -= mutes
            self.links -= tag == "a"
        for tag, _, _ in reversed(self.open[i:]):
            self.places[tag].pop()
        self.node = self.open[i][1]
        del self.open[i:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.places.get("p"):
            self.cut()
        self.close_to(tag, _AROUND_INLINE if tag in INLINE else _NONE)

    def handle_data(self, data: str) -> None:
        blank = not data.strip()
        if self.muted or self.now is None and blank:
            return
        if self.now is None:
            self.now = []
            self.blocks.append((self.now, self.node))
        self.now.append(data)
        if "\n" not in data:
            if not blank:
                self.count(len(data), self.links > 0)
            return
        for i, piece in enumerate(data.split("\n")):
            if i:
                self.end_line()
            if piece and not piece.isspace():
                self.count(len(piece), self.links > 0)


def two_clusters(x: np.ndarray) -> float:
    """The value between the lower and the upper of two clusters (Lloyd's rounds from the extremes)."""
    low, high = float(x.min()), float(x.max())
    for _ in range(32):
        at = (low + high) / 2
        upper = x > at
        if not upper.any() or upper.all():
            break
        new = float(x[~upper].mean()), float(x[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    r = int(3 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    return np.convolve(np.pad(x, r, mode="edge"), k, mode="valid")


def upper(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Which lines are in the upper cluster of their smoothed ratios, and not only because of their neighbours."""
    raw = np.log1p(ratio)
    smooth = smoothed(raw, sigma)
    bound = two_clusters(smooth)
    both = (smooth >= bound) & (raw >= bound)
    return both if both.any() else smooth >= bound


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The main text of a page: blocks joined by an empty line, white space inside a block as one space. Null, empty pages and
    pages without content give an empty text.
    """
    if not html:
        return ""
    page = Events()
    page.feed(html)
    page.close()
    texts = [_SPACE.sub(" ", "".join(parts)).strip() for parts, _ in page.blocks]
    node = [n for _, n in page.blocks]
    parent, nodes = page.parent, range(1, len(page.parent))

    def summed(weights: Iterable[tuple[int, int]]) -> list[int]:
        """Of each node, with all that it holds."""
        out = [0] * len(parent)
        for n, w in weights:
            out[n] += w
        for n in reversed(nodes):
            out[parent[n]] += out[n]
        return out

    held = summed((n, len(t)) for n, t in zip(node, texts, strict=True) if not page.hard[n])
    shows = summed((n, 1) for n in nodes if page.shown[n])
    visible = [True] * len(parent)
    for n in nodes:  # nearly all of the page is no side matter, whatever its name
        visible[n] = visible[parent[n]] and not page.hard[n] and (not page.soft[n] or shows[n] > 0 or 10 * held[n] >= 9 * held[0])
    stays = [bool(t) and visible[n] for n, t in zip(node, texts, strict=True)]
    if not any(stays):
        return ""

    owner, chars, tags = np.array([x for x in page.lines if texts[x[0]]], np.int64).reshape(-1, 3).T
    chars = np.where(np.array(stays)[owner], chars, 0)
    plain = np.bincount(owner, chars, len(texts))  # characters outside links
    high = np.bincount(owner, chars * upper(chars / tags, sigma), len(texts))
    content = np.flatnonzero((plain > 0) & (2 * high >= plain)).tolist() or [i for i, s in enumerate(stays) if s]
    votes = summed((node[i], len(texts[i])) for i in content)
    best = lambda kind: max((n for n in nodes if page.kind[n] == kind), key=lambda n: (votes[n], -n), default=0)
    region = next((n for n in (best("article"), best("main")) if n and 2 * votes[n] >= votes[0]), None)
    inside = [False] * len(parent)
    if region is not None:
        for n in range(region, len(parent)):
            inside[n] = n == region or inside[parent[n]]
        return "\n\n".join(t for t, n, s in zip(texts, node, stays, strict=True) if s and inside[n])
    region = max(n for n in range(len(parent)) if votes[n] == votes[0])  # the innermost element that holds all of the content
    own = summed((n, int(p)) for n, p in zip(node, plain.tolist(), strict=True))
    inside[region] = True
    apart = [0] * len(parent)  # the outermost node around a node, inside the region, that holds no content; 0: none
    for n in range(region + 1, len(parent)):
        inside[n] = inside[parent[n]]
        apart[n] = apart[parent[n]] or (0 if votes[n] else n)
    first, last = content[0], content[-1]

    def belongs(i: int) -> bool:
        """A part without content belongs to the text if it isn't links only and stands in a part with content or between such."""
        if part := apart[node[i]]:
            return own[part] > 0 and (parent[part] != region or first <= i <= last)
        return first <= i <= last or plain[i] > 0

    return "\n\n".join(t for i, t in enumerate(texts) if stays[i] and inside[node[i]] and belongs(i))


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """df's other columns with `text` and `n_chars` (code points) in place of its page and of columns of these names.

    Null and empty pages give an empty text. Rows stay as they are, repeated or not; an empty table gives no rows. Pages are
    taken whole, in time and memory proportional to their length, however deeply they are nested.
    """
    rest = [c for c in df.columns if c not in (html, "text", "n_chars")]
    schema = df.select(*(f"`{c}`" for c in rest)).schema.add("text", "string").add("n_chars", "long")

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                texts = [main_text(x) for x in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[*rest, "text", "n_chars"]
                )

    return df.select(*(f"`{c}`" for c in [*rest, html])).mapInArrow(kernel, schema)
