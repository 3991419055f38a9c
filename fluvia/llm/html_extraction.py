"""HTML extraction: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's streaming parser gives events; a block is the text between two block-level tags and is one line
of the page. Each line has a ratio of text to tags, its score; names of elements that tell menus, notices, comments and
the like are a feature of the score, and make it 0. The scores are smoothed with a Gaussian and compared with a threshold
taken from their spread, which clusters the lines into content and the rest. The content region is the
innermost container that holds most of the content lines' text, or the article or main round it. Its lines are the
article's, but for elements whose names hint at something else and whose lines are not content, and, where no article
or main says what belongs to it, for lists and boxes of links without a content line. Outside the region content lines,
containers that are mostly content, headings of any of these and, where no article or main says what belongs to it, text
directly beside the region are the article's too. A line without a score is content nowhere.

Every event costs the same whatever the nesting: open elements carry what they inherit, and sums over elements are
passed from inner to outer ones once, at the end.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from ._text import chunks

SIGMA, MAJORITY, SMALL, LARGE, LINKED = 1.0, 0.6, 0.25, 0.5, 0.7
# Tags by what they do. Text inside DROPPED tags is never content.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
DROPPED = set("aside button datalist dialog embed fieldset footer form frame frameset head header iframe input label legend map menu nav noscript object optgroup option script select style svg template textarea title video audio canvas math".split())
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
CONTAINERS = set("article body div html main section td".split())
BARRIERS = CONTAINERS | set("table ul ol dl blockquote".split())
#: Names in class, id or role that mark what is not the article, whole or all parts of a name; as one part among others they are a hint.
MARKS = set("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer disqus donate footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted promotion recommended related replies respond search share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription tags toolbar widget".split())
#: Of these, names that mark also as a part of a longer name, whatever the element's size.
TALK = set("comment comments disqus replies respond".split())
#: After these parts a name tells what there is elsewhere, not what the element is.
ABOUT = set("has no not with without".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Tags that close an open element of the same kind, and those that a block tag closes.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    """text; tags since the line before; is dropped; innermost node and marked element round it or -1; is a heading; share of text in links."""

    text: str
    tags: int
    dropped: bool
    node: int
    mark: int
    heading: bool
    linked: float


class Open(NamedTuple):
    """An open element with what it inherits; block and barrier are the places of the innermost such element."""

    tag: str
    dropped: bool
    node: int
    mark: int
    heading: bool
    link: bool
    block: int
    barrier: int


_ROOT = Open("", False, -1, -1, False, False, -1, -1)


class _Page(HTMLParser):
    """Collects the lines of a page; its nodes (containers and lists) and its marked elements, each with its parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # where each tag is open
        self.lines: list[Line] = []
        self.nodes: list[tuple[str, int]] = []
        self.marks: list[tuple[int, int]] = []  # 1 a part of a name, 2 a whole name, 3 of comments
        self.holds: list[set[str]] = []  # which of main and h1 a marked element holds itself
        self.articles: list[int] = []  # the marked element round each article
        self.text: list[str] = []
        self.tags = self.linked = 0

    def top(self) -> Open:
        return self.open[-1] if self.open else _ROOT

    def cut(self, depth: int) -> None:
        while len(self.open) > depth:
            self.places[self.open.pop().tag].pop()

    def flush(self) -> None:
        line = SPACE.sub(" ", "".join(self.text)).strip()
        if line:
            top = self.top()
            self.lines.append(Line(line, self.tags, top.dropped, top.node, top.mark, top.heading, self.linked / len(line)))
            self.tags = 0
        self.text.clear()
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            closed = CLOSES.get(tag, {"p"} if tag != "br" else set())
            depth = max((self.places[t][-1] for t in closed if self.places[t]), default=None)
            if depth is not None and self.top().barrier <= depth:
                self.cut(depth)
        self.tags += 1
        if tag in VOID:
            return
        top, own, here = self.top(), tag in {"html", "body", "article", "main"}, len(self.open)
        if tag == "article":
            self.articles.append(top.mark)
        elif tag in ("main", "h1") and top.mark >= 0:
            self.holds[top.mark].add(tag)
        mark, node = top.mark, top.node
        if not own and (kind := _marked(attrs)):
            mark = len(self.marks)
            self.marks.append((kind, top.mark))
            self.holds.append(set())
        if tag in BARRIERS:
            node = len(self.nodes)
            self.nodes.append((tag, top.node))
        self.places[tag].append(here)
        dropped = top.dropped or tag in DROPPED or not own and _hidden(attrs)
        self.open.append(Open(tag, dropped, node, mark, top.heading or tag in HEADINGS, top.link or tag == "a", here if tag in BLOCKS else top.block, here if tag in BARRIERS else top.barrier))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style", "textarea", "title"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if self.places[tag] and (tag in BLOCKS or self.top().block < self.places[tag][-1]):
            self.cut(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        top = self.top()
        if top.tag not in ("script", "style"):
            self.text.append(data)
            if top.link:
                self.linked += len(SPACE.sub(" ", data).strip())

    def away(self) -> list[bool]:
        """Which marked elements are not the article's whatever their lines: whole names, but for an element round most of
        the page's text, if the article is plainly inside; and what lies in such elements."""
        n = len(self.marks)
        size, articles, holds = [0] * n, [0] * n, [set(x) for x in self.holds]
        total = 0
        for x in self.lines:
            if not x.dropped:
                total += len(x.text)
                if x.mark >= 0:
                    size[x.mark] += len(x.text)
        for m in self.articles:
            if m >= 0:
                articles[m] += 1
        for m in range(n - 1, -1, -1):
            if (up := self.marks[m][1]) >= 0:
                size[up] += size[m]
                articles[up] += articles[m]
                holds[up] |= holds[m]
        out = []
        for m, (kind, up) in enumerate(self.marks):
            round_all = bool(self.articles) and articles[m] == len(self.articles) and kind != 3
            wraps = size[m] >= LARGE * total and (round_all or holds[m] or size[m] == total)
            out.append(up >= 0 and out[up] or kind > 1 and not wraps)
        return out


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower() for name, value in attrs)


def _marked(attrs: list[tuple[str, str | None]]) -> int:
    found = 0
    for name, value in attrs:
        for token in (value or "").split() if name in ("class", "id", "role") else ():
            if token.lower() in MARKS:
                found = max(found, 3 if token.lower() in TALK else 2)
            parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if x]
            parts = parts[: next((i for i, x in enumerate(parts) if x in ABOUT), len(parts))]
            found = max(found, 3 if TALK & set(parts) else 0 if not MARKS & set(parts) else 2 if MARKS >= set(parts) else 1)
    return found


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = np.arange(-int(3 * sigma), int(3 * sigma) + 1)
    kernel = np.exp(-0.5 * (reach / sigma) ** 2)
    padded = np.pad(ratios, len(reach) // 2, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def content_lines(own: np.ndarray) -> tuple[np.ndarray, float]:
    """(which lines the clustering of their smoothed ratios puts with the content, the threshold)."""
    ratio = smoothed(own)
    least = float(min(ratio.max(), ratio.std()))
    return ratio >= least, least


def _upward(parents: list[int], own: np.ndarray) -> np.ndarray:
    """The sums of ``own`` over each element and what lies in it; parents come before their children."""
    total = own.copy()
    for i in range(len(parents) - 1, -1, -1):
        if parents[i] >= 0:
            total[parents[i]] += total[i]
    return total


def main_text(html: str | None) -> str:
    """The article of one page, its blocks in page order joined by one space; empty for null, empty or contentless pages."""
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    away = page.away()
    kept = [x for x in page.lines if not x.dropped]
    if not kept:
        return ""
    told_away = np.array([x.mark >= 0 and away[x.mark] for x in kept])
    size = np.array([0 if out else len(x.text) for x, out in zip(kept, told_away, strict=True)], dtype=float)
    # a name is a feature of the score: a line in an element that its name tells apart has the ratio of no text at all
    own = size / np.maximum(1, [x.tags for x in kept])
    content, least = content_lines(own)
    sure = content & (own >= least)
    at, mark = np.array([x.node for x in kept]), np.array([x.mark for x in kept])
    tags, parents = [t for t, _ in page.nodes], [p for _, p in page.nodes]
    hints, outer = [k == 1 for k, _ in page.marks], [p for _, p in page.marks]

    def sums(where: np.ndarray, up: list[int], value: np.ndarray) -> np.ndarray:
        inside = where >= 0
        return _upward(up, np.bincount(where[inside], weights=value[inside], minlength=len(up)))

    text, weight, certain, links = (sums(at, parents, v) for v in (size, size * content, size * sure, size * [x.linked for x in kept]))
    most = MAJORITY * size[content].sum()
    region = max((c for c in range(len(tags)) if tags[c] in CONTAINERS and weight[c] >= most), default=None)  # inner ones come later
    if region is None:
        return " ".join(x.text for x, yes in zip(kept, sure, strict=True) if yes or size[content].sum() and x.mark < 0)
    chain = [region]
    while parents[chain[-1]] >= 0:
        chain.append(parents[chain[-1]])
    region = next((c for tag in ("article", "main") for c in reversed(chain) if tags[c] == tag), region)
    told = any(tags[c] in ("article", "main") for c in chain)
    round_it = set(chain[chain.index(region) :])
    inside, rich, linked = np.zeros(len(tags), dtype=bool), np.zeros(len(tags), dtype=bool), np.zeros(len(tags), dtype=bool)
    for c, up in enumerate(parents):
        inside[c] = c == region or up >= 0 and inside[up]
        rich[c] = c not in round_it and (certain[c] >= MAJORITY * text[c] > 0 or up >= 0 and rich[up])
        linked[c] = c not in round_it and not told and (certain[c] == 0 and links[c] >= LINKED * text[c] > 0 or up >= 0 and linked[up])
    # a hint counts where the element's lines are not content, and outside the region for all but large elements
    hinted = np.zeros((len(hints), 2), dtype=bool)
    big, good = sums(mark, outer, size), sums(mark, outer, size * sure)
    for m, up in enumerate(outer):
        poor = hints[m] and good[m] < MAJORITY * big[m], hints[m] and big[m] < SMALL * size.sum()
        hinted[m] = [x or up >= 0 and y for x, y in zip(poor, hinted[up], strict=True)]
    take = []
    for x, yes, score in zip(kept, sure, own, strict=True):
        c = x.node
        here = c >= 0 and inside[c]
        hint = x.mark >= 0 and hinted[x.mark][0 if here else 1]
        # where nothing tells the article, text beside its container, in no box of its own, goes with it
        beside = not told and (c < 0 or c in round_it) and x.linked < LINKED
        near = here and not linked[c] or not here and (beside or c >= 0 and rich[c])
        take.append(bool(yes) or not hint and bool(near) and score > 0)
    for i in range(len(kept) - 2, -1, -1):
        take[i] = take[i] or kept[i].heading and take[i + 1]
    return " ".join(x.text for x, t in zip(kept, take, strict=True) if t)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in chunks(batches, "html"):
        text = [main_text(h) if isinstance(h, str) else "" for h in pdf["html"]]
        yield pdf.drop(columns="html").assign(text=text, n_chars=[len(t) for t in text])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every row of ``pages`` with text and n_chars (code points) in place of the html; columns of these names are replaced.

    Null, empty and contentless pages have the empty text. Repeated rows stay, an empty table gives none, and all other
    columns are passed on as they are. A page is read in time by its length, however deep its elements are nested.
    """
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars", "html")]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest)
    return pages.select(*rest, F.col(html).alias("html")).mapInPandas(_extract, schema + ", text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op5_html_extraction": op5_html_extraction}
ORACLES: dict[str, str] = {}
