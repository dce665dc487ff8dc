"""Main text of web pages by text-to-tag ratios.

The page streams through the standard library's parser. Blocks (runs of text between block-level
tags) are the lines; a line's ratio is its characters outside links over its tags. Ratios are
smoothed with a Gaussian, and lines whose smoothed ratio reaches the threshold (the smoothed
ratios' standard deviation) form the clusters. A line is *strong* if it is in a cluster and has
as many characters of its own, so that a short line beside the text isn't taken for it. The smallest
container with all strong lines is the content region, whatever it is called; but one of its parts
that has nine tenths of the strong characters, beside nothing but parts of one line each, is the
region in its place. All of its lines
are the result, short ones included, but for parts without a strong line that are mostly links,
and, where the text is spread over several parts of the region, parts before the first and after
the last of them. A page's h1 right before the region belongs to it.

Marks come first: what its tags and roles, or class names and ids, mark as menu, header, footer,
sidebar, notice, advert, form or comments counts as no text. Class names count as whole words, of
which each part must be such a word; they mark no ``article``, ``main`` or ``body``, nothing that is
called content as well, and nothing at all on a page that would be left without text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that hold no text of the page's.
_QUIET = frozenset("script style noscript template button select option textarea input iframe object svg canvas head title".split())
#: Elements beside the text.
_BESIDE = frozenset("nav footer aside form dialog menu".split())
_BLOCK = _BESIDE | frozenset("address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_REGION = frozenset("article main section div td body html".split())
_UNMARKED = frozenset("article main body html".split())
_CLOSES_P = _BLOCK - {"html", "body"}
_SAME = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsense sponsor sponsored sponsors promo promos promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets footer masthead header cookie cookies consent notice notices popup modal newsletter subscribe subscription signup share sharing social comment comments replies reply respond disqus related recommended pagination pager login search skip toolbar".split()
)
_PLACE = frozenset("site page global main primary secondary top bottom left right side box block list item items wrap wrapper container section area bar inner outer link links button buttons panel slot unit form thread content".split())
_CONTENT = frozenset("article post entry story content body text main".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SPACE = re.compile(r"[ \t\n\r\f\v\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f\x85]+")
_HARD, _SOFT = 1, 2
#: Of the strong characters, the share of a part beside which lines that stand alone aren't text.
MOST = 0.9


def noisy(names: str) -> bool:
    """Whether class names or ids mark an element as something beside the text."""
    words = names.lower().split()
    if any(w in _CONTENT for w in words):
        return False
    for word in words:
        parts = [x for x in re.split(r"[-_]+", word) if x]
        if any(x in _NOISE for x in parts) and all(x in _NOISE or x in _PLACE or x.isdigit() for x in parts):
            return True
    return False


@dataclass
class Line:
    text: str
    node: int
    tags: int
    linked: int  # characters in links
    title: bool  # an h1


class _Page(HTMLParser):
    """Lines of a page, and the containers and marked elements that they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, its node, whether its text is none
        self.count: Counter[str] = Counter()  # open elements of a tag
        self.parent, self.mark = [-1], [0]  # of nodes; a parent comes before its children
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.linked = 0  # since the last line

    def _now(self) -> tuple[int, bool]:
        return self.open[-1][1:] if self.open else (0, False)

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip(" ")
        if text:
            self.lines.append(Line(text, self._now()[0], self.tags, self.linked, self.count["h1"] > 0))
            self.tags = 0
        self.text = []
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self._flush()
        if tag in _CLOSES_P:
            self._close("p", ("article", "main", "section", "div", "td", "body", "blockquote", "li"))
        if tag in _SAME:
            self._close(tag, _SAME[tag])
            if tag in ("dt", "dd"):
                self._close("dd" if tag == "dt" else "dt", _SAME[tag])
        self.tags += 1
        if tag == "br":
            self.text.append("\n")
        if tag in _VOID:
            return
        node, quiet = self._now()
        a = dict(attrs)
        mark = 0
        if tag not in ("html", "body"):
            if tag in _BESIDE or (a.get("role") or "").lower() in _ROLES or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true":
                mark = _HARD
            elif tag == "header" and not (self.count["article"] or self.count["main"]):
                mark = _HARD  # a header is the page's unless it opens an article
            elif tag not in _UNMARKED and noisy(f"{a.get('class') or ''} {a.get('id') or ''}"):
                mark = _SOFT
        if tag in _QUIET or mark and tag not in _BLOCK:
            quiet = True
        elif tag in _REGION or mark:
            self.parent.append(node)
            self.mark.append(mark)
            node = len(self.parent) - 1
        self.count[tag] += 1
        self.open.append((tag, node, quiet))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        self.tags += 1
        self._close(tag, ())

    def _close(self, tag: str, bounds: tuple[str, ...]) -> None:
        if not self.count[tag]:
            return
        k = len(self.open) - 1
        while self.open[k][0] != tag:
            if self.open[k][0] in bounds:
                return
            k -= 1
        if self._now()[0] != (self.open[k - 1][1] if k else 0):
            self._flush()  # text of one container doesn't run into what follows
        for t, _, _ in self.open[k:]:
            self.count[t] -= 1
        del self.open[k:]

    def handle_data(self, data: str) -> None:
        if self._now()[1]:
            return
        self.text.append(data)
        if self.count["a"]:
            self.linked += len(_SPACE.sub(" ", data).strip(" "))

    def finish(self) -> None:
        self.close()
        self._flush()


def smooth(x: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing, weights renormalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(reach + 1)]
    out = []
    for i in range(len(x)):
        lo, hi = max(0, i - reach), min(len(x), i + reach + 1)
        ws = [w[abs(i - k)] for k in range(lo, hi)]
        out.append(sum(a * b for a, b in zip(ws, x[lo:hi], strict=True)) / sum(ws))
    return out


def strong_lines(lines: list[Line]) -> list[bool]:
    """Whether each line is in a cluster of smoothed ratios, and long enough itself."""
    own = [len(x.text) - min(x.linked, len(x.text)) for x in lines]
    ratios = smooth([n / max(1, x.tags) for n, x in zip(own, lines, strict=True)])
    mean = sum(ratios) / max(1, len(ratios))
    limit = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)) if len(ratios) > 2 else 0.0
    return [max(r, n) >= limit and n >= limit and n > 0 and x.linked * 2 <= len(x.text) for r, n, x in zip(ratios, own, lines, strict=True)]


def extract(html: str | None) -> str:
    """The main text: blocks in page order, joined by two line feeds; empty if there is none."""
    if not html:
        return ""
    at = html.rfind("<")
    if at > html.rfind(">") and re.match(r"<[a-zA-Z/!?]", html[at : at + 2]):
        html = html[:at]  # a tag the page breaks off in
    page = _Page()
    page.feed(html)
    page.finish()
    n, parent = len(page.parent), page.parent
    hard, soft = [False] * n, [False] * n
    for k in range(n):
        hard[k] = page.mark[k] == _HARD or (k > 0 and hard[parent[k]])
        soft[k] = page.mark[k] == _SOFT or (k > 0 and soft[parent[k]])
    lines = [x for x in page.lines if not hard[x.node] and not soft[x.node]] or [x for x in page.lines if not hard[x.node]]
    if not lines:
        return ""
    strong = strong_lines(lines)
    # of each container: strong lines, characters and linked characters below it
    rich, weight, count, size, linked = ([0] * n for _ in range(5))
    children: list[list[int]] = [[] for _ in range(n)]
    for x, s in zip(lines, strong, strict=True):
        rich[x.node] += s
        weight[x.node] += s * len(x.text)
        count[x.node] += 1
        size[x.node] += len(x.text)
        linked[x.node] += x.linked
    direct = rich[:]
    for k in range(n - 1, 0, -1):
        children[parent[k]].append(k)
        rich[parent[k]] += rich[k]
        weight[parent[k]] += weight[k]
        count[parent[k]] += count[k]
        size[parent[k]] += size[k]
        linked[parent[k]] += linked[k]
    if not rich[0]:
        return "\n\n".join(x.text for x in lines)
    region = max(k for k in range(n) if rich[k] == rich[0])  # these lie below each other, and the last is the smallest
    while not direct[region]:
        below = [k for k in children[region] if rich[k]]
        main = max(below, key=weight.__getitem__)
        if weight[main] < MOST * weight[region] or any(count[k] > 1 for k in below if k != main):
            break
        region = main
        while not direct[region] and sum(rich[k] > 0 for k in children[region]) == 1:
            region = next(k for k in children[region] if rich[k])
    # the part of the region that each container belongs to: a child of the region, or the region itself
    part = [-1] * n
    part[region] = region
    for k in range(region + 1, n):
        part[k] = k if parent[k] == region else part[parent[k]]
    inside = [i for i, x in enumerate(lines) if part[x.node] >= 0]
    first, last = (f(i for i in inside if strong[i]) for f in (min, max))
    kept = []
    for i in inside:
        x = lines[i]
        k = part[x.node]
        if k != region and not rich[k]:
            keep = linked[k] * 2 <= size[k] and (direct[region] > 0 or first < i < last)
        else:
            keep = x.linked * 2 <= len(x.text) or first < i < last
        if keep:
            kept.append(i)
    if kept[0] == inside[0]:
        above = next((i for i in range(inside[0] - 1, max(-1, inside[0] - 3), -1) if lines[i].title), None)
        if above is not None and not any(lines[i].title for i in kept):
            kept.insert(0, above)
    return "\n\n".join(lines[i].text for i in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [extract(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["row", "text", "n_chars"])


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns with text and n_chars (code points).

    Null or empty pages, and pages without content, give an empty text. Very long pages are parsed
    whole, in time that grows with their length. Rows that repeat give rows that repeat; an empty
    table gives no rows; a column named text or n_chars isn't looked at.
    """
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(html).alias("html"))
    out = rows.mapInArrow(_extract, f"row {rows.schema['row'].dataType.simpleString()}, text string, n_chars long")
    return out.select("row.*", "text", "n_chars")
