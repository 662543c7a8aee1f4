"""Main text of web pages from text-to-tag ratios.

A page streams through the standard library's parser. Its events make lines: a block element
starts a new line, inline elements do not. Each line has its text, its tags and the elements
it stands in. The text-to-tag ratios of all lines are smoothed with a Gaussian, and the lines
above a threshold (a share of their standard deviation, between the two clusters of menu-like
and text-like lines) are content. Class words that name what is not content silence an element
only if it holds no main element and less than two thirds of the page's unlinked text, so
that a wrapper leaves its lines to the ratios. Structure refines this: text inside scripts, menus, headers,
footers, sidebars, forms and the like counts as none, and an article or main element that
holds a content line is one region, so that its short lines stay. Lines outside such regions
stay only on pages without one. Memory: one page and its lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.common import text_of

# Elements by their role in a page
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav noscript ol p pre section summary table tbody td template tfoot th thead "
    "title tr ul".split()
)
_SILENT = frozenset(
    "aside audio button canvas dialog embed fieldset footer form head header iframe input label "
    "menu nav noscript object optgroup option script select style svg template textarea title "
    "video".split()
)
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_CONTENT = frozenset(["article", "main"])
_P_CLOSERS = _BLOCKS - frozenset(["body", "html", "head", "title", "template"])
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: words of class, id or role that name what is not content
_OTHER = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|cookies?|consent|"
    r"disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notice|popup|promo\w*|related|"
    r"replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget|"
    r"contentinfo|complementary|search|alert|dialog)(?:$|[\s_-])",
    re.IGNORECASE,
)
_REPLY = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?:$|[\s_-])", re.IGNORECASE)
_SPACES = re.compile(r"\s+")
_SIGMA = 1.0
_SHARE = 0.5
#: share of a page's unlinked text from which a named element is a wrapper
_WRAPPER = 2 / 3


@dataclass
class Line:
    """Text between two block boundaries, and what surrounds it."""

    parts: list[str] = field(default_factory=list)
    tags: int = 0
    links: int = 0
    region: int = 0
    #: of each part the elements around it whose class words name no content, and link characters
    around: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    def add(self, text: str, named: tuple[int, ...] = (), links: int = 0) -> None:
        self.parts.append(text)
        self.around.append((named, links))

    def silence(self, quiet: set[int]) -> None:
        """Leave out the parts inside elements of `quiet`."""
        kept = [i for i, (named, _) in enumerate(self.around) if quiet.isdisjoint(named)]
        self.parts = [self.parts[i] for i in kept]
        self.around = [self.around[i] for i in kept]
        self.links = sum(links for _, links in self.around)

    @property
    def text(self) -> str:
        return _SPACES.sub(" ", "".join(self.parts)).strip()


class _Lines(HTMLParser):
    """Collects the lines of a page from parser events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = [Line()]
        # name, silent, region, named
        self.open: list[tuple[str, bool, int, tuple[int, ...]]] = []
        self.regions = self.named = 0
        self.wrappers: set[int] = set()  # named elements that hold a main element

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # the parser gives up on unknown marked sections
            return self.parse_bogus_comment(i)

    def _state(self) -> tuple[bool, int, tuple[int, ...]]:
        return self.open[-1][1:] if self.open else (False, 0, ())

    def _new_line(self) -> None:
        if self.lines[-1].parts or self.lines[-1].tags:
            self.lines.append(Line())

    def _close(self, names: set[str], stops: set[str] | frozenset[str]) -> None:
        """Close the innermost open element of `names`, but none beyond `stops`."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                del self.open[i:]
                return
            if self.open[i][0] in stops:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _P_CLOSERS:
            self._close({"p"}, _BLOCKS - {"p"})
        if tag in _IMPLIED:
            self._close(*_IMPLIED[tag])
        if tag in _BLOCKS:
            self._new_line()
        elif tag == "br":
            self.lines[-1].add(" ")
        self.lines[-1].tags += 1
        if tag in _VOID:
            return
        silent, region, around = self._state()
        given = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "style")}
        words = " ".join(given.get(k, "") for k in ("class", "id", "role"))
        hidden = "hidden" in given or "display:none" in given.get("style", "").replace(" ", "")
        if tag in ("html", "body", "main"):
            other = False
        else:
            other = bool((_REPLY if tag == "article" else _OTHER).search(words))
        silent = silent or tag in _SILENT or hidden
        if tag in _CONTENT and not silent and not other:
            if tag == "main":
                self.wrappers.update(around)
            self.regions += 1
            region = region or self.regions  # of nested ones the outermost
        if other and not silent:
            self.named += 1
            around = (*around, self.named)
        self.open.append((tag, silent, region, around))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "iframe", "script", "template"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self._new_line()
        self.lines[-1].tags += 1
        # an inline end tag does not reach beyond its block
        self._close({tag}, frozenset() if tag in _BLOCKS or tag in _SILENT else _BLOCKS)

    def handle_data(self, data: str) -> None:
        silent, region, around = self._state()
        if silent:
            return
        line = self.lines[-1]
        line.region = region
        linked = any(name == "a" for name, *_ in self.open[-3:])
        line.add(data, around, len(data.strip()) if linked else 0)

    def settle(self) -> None:
        """Silence the named elements that are no wrappers of the page."""
        held, total = Counter(), 0
        for line in self.lines:
            for part, (named, links) in zip(line.parts, line.around, strict=True):
                own = len(part.strip()) - links
                total += own
                held.update(dict.fromkeys(named, own))
        wide = {n for n in held if total and held[n] >= _WRAPPER * total}
        quiet = set(range(1, self.named + 1)) - wide - self.wrappers
        for line in self.lines:
            line.silence(quiet)


def smoothed(values: np.ndarray, sigma: float = _SIGMA) -> np.ndarray:
    """Gaussian smoothing along the lines; the ends are repeated."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def main_text(html: str) -> str:
    """Blocks of the article in page order, joined by two line feeds; empty if none."""
    page = _Lines()
    page.feed(html)
    page.close()
    page.settle()
    lines = [(line, line.text) for line in page.lines]
    ratio = np.array([
        (len(text) - line.links) / (line.tags + 1) for line, text in lines
    ], dtype=float)
    smooth = smoothed(ratio)
    least = min(_SHARE * float(smooth.std()), float(smooth.mean()))
    above = [
        bool(text) and r >= least and line.links * 2 <= len(text)
        for (line, text), r in zip(lines, smooth, strict=True)
    ]
    regions = {line.region for (line, _), ok in zip(lines, above, strict=True) if ok} - {0}
    return "\n\n".join(
        text for (line, text), ok in zip(lines, above, strict=True)
        if text and (line.region in regions if regions else ok)
    )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "page_id": batch.column("page_id"), "url": batch.column("url"),
            "text": pa.array(texts, pa.string()),
            "n_chars": pa.array(list(map(len, texts)), pa.int64()),
        })


def extract_text(
    pages: DataFrame, html: str = "html", id_col: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of the text).

    A null or empty html, or one without content, gives the empty text. Repeated rows, null
    ids and null urls are rows like any other. No pages: no rows.
    """
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        text_of(html).alias("html"),
    ).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
