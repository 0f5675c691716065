"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams events; block elements end lines.  Every line has a
text-to-tag ratio; the ratios are smoothed by a Gaussian and cut at their standard
deviation, which clusters the lines into content and the rest.  Content lines select
regions: the outermost article or main element around them, or else the smallest container
that holds all of them.  All lines of a selected region are kept, short ones too.  Elements
that are page furniture by their tag, role, class or id never make lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stayline.llm.common import batches

#: Element names by kind, and the words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "script style noscript template head title nav footer aside form button select textarea iframe object svg math "
    "canvas audio video map dialog menu datalist frameset".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img".split()
)
ARTICLES = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs captcha comment "
    "comments commentlist consent cookie cookies disclaimer disqus dropdown footer gdpr header hidden login masthead "
    "menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup "
    "promo promotion promoted related replies reply respond share sharing sidebar sidebars signup skyscraper social "
    "sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: Words that say nothing about the content of what they name beside a furniture word.
NEUTRAL = frozenset(
    "area article articles bar block blog body bottom box btn button buttons col column container entry fixed global group "
    "header holder icon icons inner item items js left link links list main outer page panel post posts primary right row "
    "secondary section site slot sticky text top unit wrap wrapper".split()
)
#: Ids that name furniture inside an article too, where most ids are slugs of headings.
FURNITURE_IDS = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs commentlist disqus masthead navbar pager respond "
    "sidebar sidebars skyscraper toolbar topbar".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_SMOOTHING = np.exp(-0.5 * np.arange(-2, 3) ** 2)


@dataclass
class Line:
    """One line of a page: its text, the tags in it, and the containers around it."""

    text: str
    tags: int
    article: int | None
    block: int


@dataclass
class _Open:
    tag: str
    number: int
    skipped: bool
    article: int | None
    block: int = 0
    code: bool = False


@dataclass
class Lines(HTMLParser):
    """Collects the lines of one page."""

    lines: list[Line] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self._open = [_Open("", 0, False, None)]
        # places in the open stack, by tag and of all blocks: no end tag scans the stack
        self._places: dict[str, list[int]] = {}
        self._blocks: list[int] = []
        self.parents = [0]
        self._texts: list[str] = []
        self._tags = self._made = 0

    def handle_starttag(self, tag, attrs):
        top = self._open[-1]
        self._tags += 1
        if tag in INLINE and not (tag not in VOID and _furniture(tag, attrs, top)):
            if tag not in VOID:
                self._push(tag, top.skipped, top)
            return
        if tag in ("br", "wbr"):
            self._texts.append(" ")
            return
        self._flush()
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):
            self._close_open(tag)
            top = self._open[-1]
        self._push(tag, top.skipped or _furniture(tag, attrs, top), top)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._tags += 1
        if tag not in INLINE:
            self._flush()
        places = self._places.get(tag)
        if not places or tag in INLINE and self._blocks and self._blocks[-1] > places[-1]:
            return  # not open, or an inline end tag beyond its block
        if any(o.skipped for o in self._open[places[-1] :]) or tag not in INLINE:
            self._flush()
        self._cut(places[-1])

    def handle_data(self, data):
        if not self._open[-1].skipped:
            self._texts.append(data)

    def finished(self, html: str) -> list[Line]:
        self.feed(html)
        self.close()
        self._flush()
        return self.lines

    def _push(self, tag, skipped, top):
        if skipped and not top.skipped:
            self._flush()
        self._made += 1
        article = top.article if top.article is not None else self._made if tag in ARTICLES else None
        self.parents.append(top.block)
        block = top.block if tag in INLINE or tag in _LEAVES else self._made
        self._places.setdefault(tag, []).append(len(self._open))
        if tag not in INLINE:
            self._blocks.append(len(self._open))
        self._open.append(_Open(tag, self._made, skipped, article, block, top.code or tag in ("pre", "code")))

    def _cut(self, at):
        for gone in self._open[at:]:
            self._places[gone.tag].pop()
            if gone.tag not in INLINE:
                self._blocks.pop()
        del self._open[at:]

    def _close_open(self, tag):
        """A paragraph, item or cell ends the one before it in the same container."""
        if self._blocks and self._open[self._blocks[-1]].tag == tag:
            self._cut(self._blocks[-1])

    def _flush(self):
        if text := " ".join("".join(self._texts).split()):
            self.lines.append(Line(text, self._tags, self._open[-1].article, self._open[-1].block))
        self._texts.clear()
        self._tags = 0


#: Blocks that hold text but are no regions of their own.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption td th tr ul ol dl caption".split())


def _furniture(tag: str, attrs, top: _Open) -> bool:
    if tag in SKIPPED or tag == "header" and top.article is None:
        return True
    if tag in ("html", "body", "main") or tag == "article" and top.article is None:
        return False
    given = dict(attrs)
    if "hidden" in given or (given.get("aria-hidden") or "").lower() == "true" or (given.get("role") or "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style") or "", re.I):
        return True
    if top.code or tag in HEADINGS and top.article is not None:
        return False
    inside = top.article is not None
    if any(_names_furniture(name, inside) for name in (given.get("class") or "").split()):
        return True
    name = (given.get("id") or "").strip()
    if inside:
        return name.lower() in FURNITURE_IDS
    return tag not in HEADINGS and _names_furniture(name, False)


@lru_cache(maxsize=50_000)
def _names_furniture(name: str, inside: bool) -> bool:
    """Whether a whole class name or id names furniture: each of its words is a furniture
    word or a neutral one ("cookie-notice", "sidebar-left"; not "related-work", "has-sidebar")."""
    words = {w.lower() for w in _WORD.findall(name)}
    # an article's own header is part of it
    named = words & FURNITURE - ({"header"} if inside else set())
    return bool(named) and words <= FURNITURE | NEUTRAL


def content_lines(lines: list[Line]) -> list[bool]:
    """Which lines are content: smoothed text-to-tag ratio at or above the deviation."""
    if not lines:
        return []
    ratios = np.array([len(x.text) / max(1, x.tags) for x in lines])
    around = np.pad(ratios, 2, mode="edge")
    smooth = np.convolve(around, _SMOOTHING / _SMOOTHING.sum(), mode="valid")
    return (smooth >= min(smooth.std(), smooth.max())).tolist()


def main_text(html: str | None) -> str:
    """The text of the selected regions, blocks in page order joined by one space."""
    if not html:
        return ""
    parser = Lines()
    lines = parser.finished(html)
    content = content_lines(lines)
    articles = {x.article for x in lines if x.article is not None}
    if articles:
        chosen = {x.article for x, c in zip(lines, content) if c and x.article is not None} or articles
        return " ".join(x.text for x in lines if x.article in chosen)
    within = _container(parser.parents, [x.block for x, c in zip(lines, content) if c])
    return " ".join(x.text for x in lines if within[x.block])


def _container(parents: list[int], blocks: list[int]) -> list[bool]:
    """For each element: is it in the smallest container that holds all ``blocks``?

    Elements are numbered as they open, so what holds the first and the last holds all.
    """
    first, last = min(blocks, default=0), max(blocks, default=0)
    while first != last:
        first, last = min(first, last), parents[max(first, last)]
    within = [False] * len(parents)
    for i, parent in enumerate(parents):
        within[i] = i == first or i > 0 and within[parent]
    return within


def extracted(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: ``id_col``, ``url_col``, text (empty if there is none), n_chars (code points).

    A null or empty page has an empty text.  Null ids and addresses stay null, repeated rows
    give repeated results, an empty table none.  Only the three columns are read.
    """

    def work(it: Iterator[pa.RecordBatch]):
        for batch in it:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield {id_col: batch.column(0), url_col: batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    kinds = dict(pages.dtypes)
    schema = f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars long"
    return batches(pages.select(id_col, url_col, html_col), schema, work)
