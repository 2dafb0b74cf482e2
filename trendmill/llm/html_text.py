"""Main text of web pages by the distribution of text over lines.

Markup is stripped so that every block of text is a line.  What a line weighs is its length without the
text of links.  The weight of a sliding window of lines surges where the content begins and dives where it
ends; the text between stays.  Elements that are no content by their name, or whose class is named as such
outright, are left out; other mentions in a class only make the text lighter.  The element that holds most of
the heaviest region lends its short paragraphs to the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
#: Elements whose content is no text at all; they end at their own end tag only.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "select",
        "canvas", "audio", "video"}
#: Elements that hold no part of an article.
_ASIDE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset", "label"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
          "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
          "thead", "tr", "ul", "aside", "menu", "dialog", "title", "head"}
#: Words in class, id or role that mark what is no article; classes are split at signs and case.
_NOISE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
          "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "nav",
          "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "comment",
          "comments", "reply", "replies", "respond", "disqus", "share", "sharing", "social", "related", "recommended",
          "newsletter", "subscribe", "subscription", "signup", "login", "search", "widget", "toolbar", "pagination",
          "pager", "copyright", "disclaimer", "masthead", "complementary", "contentinfo", "skip", "hidden"}
_HEADER = {"header", "topbar"}
#: Words that hide or mark nothing unless they are a class of their own (hidden-xs, skip-lines).
_ALONE = {"hidden", "skip"}
#: Words that name a part of a page's frame; behind a listed word they leave its meaning alone (sidebar-left, ad-slot).
_FRAME = {"area", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "form",
          "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "panel", "posts",
          "primary", "right", "row", "secondary", "section", "slot", "stories", "thread", "title", "top", "unit", "wrap",
          "wrapper"}
#: Words before which a noise word tells what else is or isn't on the page.
_ABOUT = {"no", "not", "has", "with", "without", "hide"}
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Blocks that hold one line of text.
_LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSES_P = _BLOCK - {"html", "body"}
#: Elements that end at the next one of these, up to these around them.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Lines of the sliding window; the weight at which it surges and dives, at most and as a share of the heaviest.
WINDOW, SURGE, DIVE, SURGE_SHARE, DIVE_SHARE = 3, 86, 45, 1 / 4, 1 / 8
#: The weight of text under a class that mentions noise, and the share of the rest that an article has to weigh.
LIGHT, ARTICLE = 0.25, 0.25
_CONTENT, _MENTION, _NO_CONTENT, _HIDDEN = range(4)


def _class_kind(name: str, value: str) -> int:
    """What a class, id or role says.

    Noise is a class that is a listed word, or a first class of a listed word and words for parts of a
    frame; any other class with a listed word only mentions it (notice-board, share-price).
    """
    kind = _CONTENT
    for at, single in enumerate(value.strip("\"'").split()):
        parts = [p.lower() for p in _PART.findall(single)]
        for i, part in enumerate(parts):
            if not (part in _NOISE or part in _HEADER and name != "h1"):
                continue
            framed = all(p in _NOISE or p in _FRAME or p in _HEADER for p in parts[1:])
            if len(parts) == 1 or at == i == 0 and framed and part not in _ALONE:
                return _NO_CONTENT
            if part not in _ALONE and not _ABOUT & set(parts[:i]):
                kind = _MENTION
    return kind


def _kind(name: str, attributes: str) -> int:
    kind = _NO_CONTENT if name in _ASIDE else _CONTENT
    if not attributes or name in ("html", "body", "article", "main"):
        return kind
    for key, value in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and "true" in value:
            return _HIDDEN
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return _HIDDEN
        if key in ("class", "id", "role", "itemtype"):
            kind = max(kind, _class_kind(name, value))
    return kind


class _Line(NamedTuple):
    text: str = ""
    weight: float = 0.0
    inside: bool = False  # an article element
    heading: bool = False
    place: int = -1  # the element around the line's own block
    own: bool = False  # a paragraph of its own
    around: tuple[int, ...] = ()  # that element and three more around it


class _Open(NamedTuple):
    name: str
    noise: bool
    light: bool
    article: bool
    link: bool
    serial: int


class _Page:
    """Lines of a page and what is open; an empty line parts what doesn't belong together.

    ``loose`` takes elements that are no content as lighter text and links as text.
    """

    def __init__(self, loose: bool) -> None:
        self.loose = loose
        self.lines: list[_Line] = []
        self.part: list[str] = []
        self.linked = 0
        self.stack: list[_Open] = []
        self.noise = self.light = self.article = self.links = 0
        self.heading = False
        self.count = 0
        # Where each name is open and where any block is, so that no tag has to walk the stack.
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.open_link = -1

    def last(self, *names: str) -> int:
        """The depth of the innermost open element of these names; -1 if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def add(self, text: str) -> None:
        if self.noise:
            return
        self.part.append(text)
        if self.links and not self.loose:
            self.linked += len(" ".join(html.unescape(text).split()))

    def end(self) -> None:
        if self.part and not self.noise:
            text = " ".join(html.unescape("".join(self.part)).split())
            if text:
                weight = max(0, len(text) - self.linked) * (LIGHT if self.light else 1)
                # A paragraph or heading lies in the element around it, bare text in the innermost block.
                depth = len(self.blocks) - 1
                block = self.stack[self.blocks[depth]].name if depth >= 0 else ""
                if block in _LEAF:
                    depth -= 1
                around = tuple(self.stack[i].serial for i in self.blocks[max(0, depth - 3):depth + 1])
                self.lines.append(_Line(text, weight, self.article > 0, self.heading, around[-1] if around else -1,
                                        block == "p", around))
            self.part, self.linked = [], 0

    def gap(self) -> None:
        self.end()
        if not self.noise:
            self.lines.append(_Line())

    def open(self, name: str, attributes: str) -> None:
        kind = _kind(name, attributes)
        if self.loose and kind == _NO_CONTENT:
            kind = _MENTION
        article = name in ("article", "main") and not self.noise and kind != _HIDDEN
        if kind != _CONTENT or article:
            self.gap()
        link = name == "a" and "href" in attributes.lower()
        depth = len(self.stack)
        self.count += 1
        self.stack.append(_Open(name, kind > _MENTION, kind == _MENTION, article, link, self.count))
        self.at.setdefault(name, []).append(depth)
        if name in _BLOCK:
            self.blocks.append(depth)
        if link:
            self.open_link = depth
        self.noise += kind > _MENTION
        self.light += kind == _MENTION
        self.article += article
        self.links += link

    def close(self, depth: int) -> None:
        """Close all that is open from ``depth`` on."""
        for x in reversed(self.stack[depth:]):
            self.at[x.name].pop()
        for x in self.stack[depth:]:
            if x.light or x.article:
                self.gap()
            self.noise -= x.noise
            self.light -= x.light
            self.article -= x.article
            self.links -= x.link
            if x.noise:
                self.gap()
        del self.stack[depth:]
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
        if self.open_link >= depth:
            self.open_link = -1

    def imply_ends(self, name: str) -> None:
        """Close what a start tag ends without an end tag."""
        if name in _CLOSES_P:
            depth = self.last("p")
            if depth >= 0 and depth == self.blocks[-1] and depth > self.last("button"):
                self.close(depth)
        if name in _CLOSES:
            ends, around = _CLOSES[name]
            depth = self.last(*ends)
            if depth > self.last(*around):
                self.close(depth)
        if name == "a" and self.open_link >= 0:  # links don't nest
            self.stack[self.open_link] = self.stack[self.open_link]._replace(link=False)
            self.links -= 1
            self.open_link = -1


def to_lines(page: str, loose: bool = False) -> list[_Line]:
    out, at, size = _Page(loose), 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        if not token:
            break
        if token.start() > at:
            out.add(page[at:token.start()])
        at = token.end()
        name = (token[1] or token[3] or "").lower()
        if not name:
            continue
        if page[token.start() + 1] != "/":
            attributes = token[2] or token[4] or ""
            if name in _RAW and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else size
                if name != "title":
                    out.add(" ")
                continue
            if name in _BLOCK:
                out.end()
                out.heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
            elif name == "br":
                out.add(" ")
            out.imply_ends(name)
            if name not in _VOID:
                out.open(name, attributes)
        else:
            depth = out.last(name)
            if name in _BLOCK:
                out.end()
                out.heading = False
            if depth < 0:
                continue
            if name not in _BLOCK and name not in _ASIDE:  # an inline end closes no block around it
                if out.blocks and out.blocks[-1] > depth:
                    continue
            out.close(depth)
    if at < size:
        out.add(page[at:])
    out.end()
    return out.lines


def _window_weights(lines: list[_Line], begin: int, end: int) -> list[float]:
    return [sum(x.weight for x in lines[max(begin, i - WINDOW + 1):i + 1]) for i in range(begin, end)]


def _regions(lines: list[_Line], begin: int, end: int, weights: list[float], surge: float, dive: float) -> list:
    """(begin, end) of each region between a surge and a dive in lines without a gap.

    A surge takes along headings and lines of some weight in its window.  Only a full window can dive, and
    a region whose next one follows after short lines, not links, goes on.
    """
    out, start = [], None
    for i, weight in zip(range(begin, end), weights):
        if start is None:
            if weight > 0 and weight >= surge:
                start, least = i, dive / WINDOW
                floor = max(begin, i - WINDOW + 1, out[-1][1] if out else begin)
                while start > floor and (lines[start - 1].heading or lines[start - 1].weight > least):
                    start -= 1
        elif i - WINDOW + 1 > start and weight <= dive:
            out.append((start, i - WINDOW + 1))
            start = None
    if start is not None:
        out.append((start, end))
    joined = []
    for a, b in out:
        while b - 1 > a and not lines[b - 1].weight:  # links at the end
            b -= 1
        between = lines[joined[-1][1]:a] if joined else []
        if joined and 2 * sum(x.weight for x in between) >= sum(len(x.text) for x in between):
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    return joined


def _lone_links(lines: list[_Line]) -> list[_Line]:
    """An article's paragraphs that are one link, apart from lists of links, weigh as text."""
    homes = {x.place for x in lines if x.inside and x.weight and x.own}
    return [x._replace(weight=float(len(x.text)))
            if x.inside and x.own and not x.weight and x.text and x.place in homes
            and not (i and lines[i - 1].text and not lines[i - 1].weight)
            and not (i + 1 < len(lines) and lines[i + 1].text and not lines[i + 1].weight) else x
            for i, x in enumerate(lines)]


def _with_neighbours(lines: list[_Line], a: int, b: int, begin: int, end: int, home: int,
                     tail: float) -> tuple[int, int]:
    """A region together with the text beside it in the element that holds the content, without a light end outside it."""
    while b - 1 > a and lines[b - 1].weight <= tail and home not in lines[b - 1].around:
        b -= 1
    while a > begin and lines[a - 1].weight and lines[a - 1].place == home:
        a -= 1
    while b < end and lines[b].weight and lines[b].place == home:
        b += 1
    return a, b


def _choose(lines: list[_Line]) -> str:
    inside = sum(x.weight for x in lines if x.inside)
    article = any(x.inside for x in lines) and inside >= ARTICLE * sum(x.weight for x in lines if not x.inside)
    if article:
        lines = _lone_links([x if x.inside else _Line() for x in lines])
    segments, begin = [], None
    for i, line in enumerate([*lines, _Line()]):
        if line.text and begin is None:
            begin = i
        elif not line.text and begin is not None:
            segments.append((begin, i, _window_weights(lines, begin, i)))
            begin = None
    peak = max((max(weights) for _, _, weights in segments), default=0)
    # All text of an article but its links is content; elsewhere content has to stand out.
    surge, dive = (0, 0) if article else (min(SURGE, peak * SURGE_SHARE), min(DIVE, peak * DIVE_SHARE))
    found = [(_regions(lines, a, b, weights, surge, dive), a, b) for a, b, weights in segments]
    totals = {r: sum(x.weight for x in lines[r[0]:r[1]]) for regions, _, _ in found for r in regions}
    if not totals:
        return ""
    # In an article what notices cut apart belongs together; else the heaviest region, its like, and what
    # shares the heaviest region's element.
    first, last = max(totals, key=totals.get)
    mass: dict[int, float] = {}
    for x in lines[first:last]:
        mass[x.place] = mass.get(x.place, 0.0) + x.weight
    home = max(mass, key=mass.get)
    least = 0 if article else totals[first, last] / 10
    chosen: set[int] = set()
    for regions, begin, end in found:
        for a, b in regions:
            if totals[a, b] >= least or any(x.place == home for x in lines[a:b]):
                chosen.update(range(*_with_neighbours(lines, a, b, begin, end, home, -1 if article else dive)))
    if not article and chosen:
        # Short paragraphs of that element that a notice cut off from the rest.
        chosen.update(i for i, x in enumerate(lines) if x.place == home and x.own and x.weight)
    return "\n".join(lines[i].text for i in sorted(chosen))


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by newlines; empty for null and empty pages.

    A page that has text in menus, forms, links and the like only is judged by that text.
    """
    return _choose(to_lines(page or "")) or _choose(to_lines(page or "", loose=True))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column("__html").to_pylist()]
        kept = [c for c in batch.schema.names if c != "__html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())],
                                         [*kept, "text"])


def extract_main_text(pages: DataFrame, keep: list[str], column: str = "html") -> DataFrame:
    """The columns ``keep`` with text and n_chars (code points) of every page; a page is judged alone.

    Null and empty pages have an empty text; repeated rows stay, each with its text; an empty table gives an empty
    one; the time for a page follows its length.  Kept columns named ``text`` or ``n_chars`` give way to the results.
    """
    kept = [c for c in keep if c.lower() not in ("text", "n_chars")]
    rows = pages.select(*kept, F.col(column).alias("__html"))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "__html"), T.StructField("text", T.StringType())])
    return rows.mapInArrow(_extract, schema).withColumn("n_chars", F.length("text").cast("long"))
