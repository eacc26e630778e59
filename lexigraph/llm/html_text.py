"""Main text of web pages: text-to-tag ratios, smoothed and clustered.

A streaming parser turns a page into lines, one per block, each with its text
and the number of tags seen in it.  Lines inside menus, headers, footers,
asides, forms, adverts, notices and comments are set aside by their element,
class, id or role.  The ratio of text to tags of the other lines is smoothed by
a Gaussian and cut at a share of its spread; lines above are the cluster of
content.  Where that cluster lies mostly in an article or main element, all of
that element is the content region, otherwise the region runs from the first to
the last line of the cluster.

Defined results: null or empty html, or a page without content, gives an empty
text; broken markup is read as far as the parser can; equal pages give equal
texts; an input column named like an output is dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexigraph.llm.common import free_name, pieces

RADIUS = 3
SIGMA = 1.5
SPREAD_SHARE = 0.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_SILENT = frozenset("head title script style noscript template iframe object svg math canvas audio video select button textarea datalist nav aside footer form menu dialog".split())
#: Elements that a later block start of the same level closes by itself.
_LOOSE = frozenset("p li dt dd option tr td th thead tbody tfoot".split())
_CONTENT = frozenset(("article", "main"))
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle adbox sponsor sponsored sponsors promo promotion banner banners nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars widget widgets footer comment comments commentlist replies disqus respond cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations search login pagination pager toolbar skip".split()
)
#: Words that only say what kind of box a noise word names: ``comment-list`` is noise, ``related-work`` is not.
_BOX = frozenset(
    "area bar block body bottom box boxes button buttons card column container content feed form global grid group holder icon inline inner item items left link links list main message "
    "module outer page panel post posts primary region right rail row secondary section site slot small sticky strip text title thread top unit view wide wrap wrapper js id".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form".split())
_NOISE_OR_BOX = _NOISE | _BOX
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_noise(tag: str, attrs: list[tuple[str, str | None]], in_content: bool) -> bool:
    if tag in _SILENT:
        return True
    if tag == "header":
        return not in_content
    if tag in ("html", "body") or not attrs:
        return False
    for name, value in attrs:
        if name == "hidden":
            return True
        if not value:
            continue
        if name in ("class", "id"):
            if tag in _CONTENT:
                continue
            for token in value.split():
                named = {w.lower() for w in _WORDS.findall(token) if not w.isdigit()}
                if not _NOISE.isdisjoint(named) and named <= _NOISE_OR_BOX:
                    return True
            if "header" in value.lower().split() and not in_content:
                return True
        elif name == "role" and value.lower() in _ROLES:
            return True
        elif name == "style" and _HIDDEN.search(value):
            return True
    return False


class _Lines(HTMLParser):
    """Lines of a page: (text, tags, number of the content element or 0)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self._open: list[tuple[str, bool, int]] = []  # tag, begins noise, content element
        self._count: Counter[str] = Counter()  # of the open tags
        self._noise = 0
        self._content = 0
        self._contents = 0
        self._text: list[str] = []
        self._tags = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.lines.append((text, self._tags, self._content))
            self._tags = 0
        self._text.clear()

    def _pop(self) -> None:
        tag, noise, before = self._open.pop()
        self._count[tag] -= 1
        if tag in _BLOCK:
            self._flush()
        self._noise -= noise
        self._content = before

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in _BLOCK:
            if not self._noise:
                self._flush()
            while self._open and self._open[-1][0] in _LOOSE and self._closes(self._open[-1][0], tag):
                self._pop()
        if tag in _VOID:
            return
        if tag in ("body", "article", "main") and self._count["head"]:
            while self._open and self._open[-1][0] != "head":
                self._pop()
            self._pop()
        noise = _is_noise(tag, attrs, self._content > 0)
        self._open.append((tag, noise, self._content))
        self._count[tag] += 1
        self._noise += noise
        if tag in _CONTENT and not self._content and not self._noise:
            self._contents += 1
            self._content = self._contents

    @staticmethod
    def _closes(old: str, new: str) -> bool:
        if old == "p":
            return new != "br" and new != "option"
        groups = (("li",), ("dt", "dd"), ("option",), ("tr", "thead", "tbody", "tfoot"), ("td", "th", "tr", "thead", "tbody", "tfoot"))
        return any(old in g and new in g for g in groups) and not (old == "tr" and new in ("td", "th"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in _BLOCK and not self._noise:
            self._flush()
        if not self._count[tag]:
            return
        for i in range(len(self._open) - 1, -1, -1):
            name = self._open[i][0]
            if name == tag:
                while len(self._open) > i:
                    self._pop()
                return
            # an inline element or a paragraph cannot close what encloses it
            if tag not in _BLOCK and name in _BLOCK:
                return
            if tag == "p" and name not in _LOOSE and name in _BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if not self._noise:
            self._text.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section of an unknown kind is a bogus comment: it ends at its next ``>``."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def end(self) -> None:
        self.close()
        self._flush()


def _smoothed(ratios: np.ndarray) -> np.ndarray:
    kernel = np.array([math.exp(-(i**2) / (2 * SIGMA**2)) for i in range(-RADIUS, RADIUS + 1)])
    weight = np.convolve(np.ones(len(ratios)), kernel)[RADIUS : RADIUS + len(ratios)]
    return np.convolve(ratios, kernel)[RADIUS : RADIUS + len(ratios)] / weight


def main_text(html: str | None) -> str:
    """The content of one page as one string."""
    if not html:
        return ""
    parser = _Lines()
    try:
        parser.feed(html)
        parser.end()
    except (AssertionError, ValueError):  # the parser gave up on broken markup: what it read so far counts
        parser._flush()
    lines = parser.lines
    if not lines:
        return ""
    ratios = np.array([len(t) / max(1, n) for t, n, _ in lines])
    smooth = _smoothed(ratios)
    content = smooth >= min(SPREAD_SHARE * float(smooth.std()), float(smooth.max()))
    sizes = np.array([len(t) for t, _, _ in lines])
    regions = np.array([c for _, _, c in lines])
    chosen = sizes * content
    if chosen[regions > 0].sum() * 2 >= chosen.sum():
        weights = np.bincount(regions, weights=chosen)
        weights[0] = 0
        keep = np.isin(regions, np.flatnonzero(weights > 0))
    else:
        at = np.flatnonzero(content)
        keep = np.zeros(len(lines), dtype=bool)
        keep[at[0] : at[-1] + 1] = True
    return " ".join(t for (t, _, _), k in zip(lines, keep) if k)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """All columns but the html, with the text and its length in code points (``n_chars``)."""
    carried = [c for c in pages.columns if c.lower() not in (html_col.lower(), text_col.lower(), "n_chars")]
    source = pages.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{html_col}`").cast("string").alias(free_name(pages, "html_")))
    fields = [*source.schema.fields[:-1], StructField(text_col, StringType()), StructField("n_chars", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [main_text(h) for h in batch.column(len(carried)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(carried))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[f.name for f in fields],
            )

    return source.mapInArrow(run, StructType(fields))
