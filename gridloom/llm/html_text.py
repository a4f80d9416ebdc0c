"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Lines summed in one sliding window, and the window mass from which text surges.
BLOCK_LINES = 3
SURGE_CHARS = 80
#: What standing in an article or main element adds to a line's mass, as far as the line is not a link.
ARTICLE_BONUS = 80
#: Share of the heaviest text's mass that another text on the page needs to be kept beside it.
LEAST_SHARE = 0.2

# HTML element names.
TO_THE_END = {"script", "style"}
DROPPED = TO_THE_END | {"noscript", "template", "iframe", "object", "svg", "canvas", "textarea", "select", "title", "video", "audio"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ROLES = {"alert", "banner", "complementary", "contentinfo", "dialog", "menu", "menubar", "navigation", "search"}

# A heuristic: words by which pages name what is not the article, and words that such names add to them. A name counts
# only if all its words are of these ("cookie-banner", "comment-list"), so "social-science" or "header-image" does not.
NAMED = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "footer", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination", "popup", "promo", "recommended", "related", "replies", "share", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "widget"}
GENERIC = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "form", "global", "group", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "posts", "primary", "right", "section", "site", "slot", "thread", "top", "unit", "wrap", "wrapper"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in DROPPED}
_NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})\b", re.I)


@dataclass
class Line:
    """A block's text, its characters outside links, the number of its article (0: none; -1: main only), and how it is
    an aside: by its element, or only by a class, id or role."""

    text: str
    own: int
    article: int
    by_tag: bool
    by_name: bool


def named_aside(attributes: str, in_article: bool) -> bool:
    """Whether a class, an id or a role says that the element is no part of the article."""
    if "=" not in attributes:
        return False
    for key, value in _NAMES.findall(attributes):
        value = value.strip("\"'")
        if key.lower() == "role":
            if value.lower() in ROLES:
                return True
            continue
        for name in value.split():
            parts = [p.lower() for p in _PART.findall(name) if not p.isdigit()]
            clutter = [p for p in parts if p in NAMED]
            if clutter and all(p in NAMED or p in GENERIC for p in parts) and not (in_article and clutter == ["header"]):
                return True
    return False


def page_lines(page: str) -> list[Line]:
    """The page's blocks in order, with what is known of each; scripts, styles and the like are gone."""
    lines: list[Line] = []
    text: list[str] = []
    linked, link_depth, articles = 0, 0, 0
    inside: list[int] = []  # open article (number) and main (-1) elements
    skipping: list[list] = []  # [element, open elements of that name, whether only its name says so]
    place, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                lines.append(Line(line, max(0, len(line) - linked), inside[-1] if inside else 0, any(not s[2] for s in skipping), any(s[2] for s in skipping)))
            text.clear()
        linked = 0

    while place < end:
        found = _TOKEN.search(page, place)
        stop = found.start() if found else end
        if stop > place:
            piece = page[place:stop]
            text.append(piece)
            if link_depth:
                linked += len(piece)
        if not found:
            break
        place = found.end()
        closing, tag, attributes = found[1], (found[2] or "").lower(), found[3] or ""
        if not tag:
            continue
        empty = attributes.rstrip(">").endswith("/")
        if tag in DROPPED:
            if not closing and not empty:
                over = _ENDS[tag].search(page, place)
                if tag not in TO_THE_END:  # an element that is never closed ends where the next block begins or ends
                    block = _NEXT_BLOCK.search(page, place)
                    if over is None:
                        place = block.start() if block else end
                        continue
                place = over.end() if over else end
            continue
        if tag == "a":
            link_depth = 0 if closing else 1
        elif tag == "br":
            text.append(" ")
        if tag in BLOCK:
            flush()
        if tag in ("article", "main") and not (not closing and named_aside(attributes, bool(inside))):
            if closing:
                if skipping and skipping[-1][0] == tag:
                    skipping[-1][1] -= 1
                    if skipping[-1][1] == 0:
                        skipping.pop()
                elif inside:
                    inside.pop()
            else:
                articles += tag == "article"
                inside.append(articles if tag == "article" else -1)
                skipping = [s for s in skipping if s[0] in ("article", "main")]  # what was never closed does not hold an article
            continue
        if tag in VOID or empty:
            continue
        if skipping and skipping[-1][0] == tag:
            skipping[-1][1] += -1 if closing else 1
            if skipping[-1][1] == 0:
                flush()
                skipping.pop()
        elif not closing and tag not in ("html", "body"):
            by_tag = tag in ASIDE and not (tag == "header" and inside)
            if by_tag or named_aside(attributes, bool(inside)):
                flush()
                skipping.append([tag, 1, not by_tag])
    flush()
    return lines


def masses(lines: list[Line], names: bool = True, tags: bool = True) -> list[float]:
    """A line's mass: its characters outside links, more of them in an article; asides by tag (or by name) have none."""
    out = []
    for x in lines:
        aside = tags and x.by_tag or names and x.by_name
        bonus = ARTICLE_BONUS * x.own / len(x.text) if x.article else 0
        out.append(0 if aside else x.own + bonus)
    return out


def regions(mass: list[float]) -> list[tuple[int, int]]:
    """Spans [start, end) of lines between surge and dive points.

    Text surges at a line with mass whose window (it and the lines after it, BLOCK_LINES in all) reaches SURGE_CHARS,
    and dives after the last line with mass before a window without any.
    """
    n, out, start, last = len(mass), [], None, 0
    window = sum(mass[:BLOCK_LINES])
    for i in range(n):
        if start is None:
            if mass[i] > 0 and window >= SURGE_CHARS:
                start = i
        elif not any(mass[i : i + BLOCK_LINES]):
            out.append((start, last + 1))
            start = None
        if mass[i] > 0:
            last = i
        window += (mass[i + BLOCK_LINES] if i + BLOCK_LINES < n else 0) - mass[i]
    if start is not None:
        out.append((start, last + 1))
    return out


def kept_regions(lines: list[Line], mass: list[float]) -> list[tuple[int, int]]:
    """Of the regions, the heaviest text and all others with LEAST_SHARE of its mass; regions of one article are one text."""
    found = regions(mass)
    text_of, by_article = list(range(len(found))), {}
    for k, (a, b) in enumerate(found):
        for article in {lines[i].article for i in range(a, b) if lines[i].article > 0 and mass[i] > 0}:
            first = by_article.setdefault(article, text_of[k])
            text_of = [first if t == text_of[k] else t for t in text_of]
    total: dict[int, float] = {}
    for t, (a, b) in zip(text_of, found, strict=True):
        total[t] = total.get(t, 0) + sum(mass[a:b])
    return [r for t, r in zip(text_of, found, strict=True) if total[t] >= LEAST_SHARE * max(total.values())]


def main_text(page: str | None, between: str = "\n\n") -> str:
    """Text between the points where the mass of sliding line windows surges and dives.

    On every page the masses decide. Lines of menus, adverts and the like weigh nothing and are left out; a line in an
    article or main element weighs more, so that a short paragraph surges too, but link lists there dive as they do
    elsewhere. All other lines between surge and dive stay, links too. Where nothing surges, names by class, id or role
    are not believed, then elements neither; a page that is still without a surge gives its heaviest line and those
    next to it with mass.
    ``between`` joins the blocks.
    """
    lines = page_lines(page or "")
    for names, tags in ((True, True), (False, True), (False, False)):
        mass = masses(lines, names, tags)
        if kept := kept_regions(lines, mass):
            return between.join(x.text for a, b in kept for x in lines[a:b] if not (tags and x.by_tag or names and x.by_name))
    mass = masses(lines)
    top = max(range(len(lines)), key=lambda i: mass[i], default=None)
    if top is None or not mass[top]:
        return ""
    a = b = top
    while a and mass[a - 1]:
        a -= 1
    while b < len(lines) and mass[b]:
        b += 1
    return between.join(x.text for x in lines[a:b])


def extract(pages: DataFrame, html_col: str = "html", between: str = "\n\n") -> DataFrame:
    """All columns of ``pages`` but the html (a ``text`` and ``n_chars`` are replaced) plus the main ``text`` and its
    ``n_chars`` in code points. Null and empty pages, and pages without article text, give an empty text; every row is
    returned once, repeated rows too, and equal pages give equal texts. There is no shuffle; a page is handled whole by
    itself, in time linear in its length.
    """
    base = pages.drop("text", "n_chars")
    names = [c for c in base.columns if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                texts = [main_text(x.as_py(), between) for x in batch.column(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    kept = base.select(*names)
    schema = kept.withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema
    return base.select(*names, html_col).mapInArrow(run, schema)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page of ``pages``: page_id, url, text (blocks joined by two line ends), n_chars; null html gives an empty text."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op9_html_text": op9_html_text}
