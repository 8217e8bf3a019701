"""Main text of web pages by two passes over blocks.

A page is cut into blocks at block-level tags.  First pass: blocks in navigation, page headers, footers, sidebars, forms,
adverts, notices and comments (by tag, role, class or id) are out; the others are decided by length, link density and
stop-word density.  Second pass: short or middling blocks take the label of the nearest decided block before or after
them; headings look ahead first.  The stop words are those of four languages: a page whose longer blocks have few of them
altogether is in another language, and its blocks are decided by length and link density alone.  On other pages a block of
few stop words (a table, names, code) is in where the nearest decided blocks on both sides are.  Where a page marks its
article (``article``, ``main`` or role main), only blocks inside it can be kept, longer ones need no stop words there, and
neighbours are those inside it; for their links alone only runs of list items that are links are out there, other blocks of
links (headings, quotations) take the label of their neighbours.

A class or id names such a zone as a whole: alone (``sidebar``), with words of place or form (``sidebar-left``, ``footer_links``)
or, for names that mean nothing else, after any word (``post-comments``).  Words of state (``has-sidebar``, ``no-comments``) name
none.  A zone by class, id or form that holds the page's only article does not hide it.

End tags that HTML lets one leave out are implied: a paragraph ends where a block starts; list items, terms, rows, cells and
options end where the next one starts.  An attribute whose quote is not closed ends with its tag.

Character references are decoded, white space becomes one space, blocks are joined by one space.  Nothing kept is cut.

Defined cases: null, empty and text-less pages give an empty text; plain text without tags is one block; unclosed tags end
with their parent, an unclosed script or style with the page; equal pages give equal texts; input columns named as an
output column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Length in characters below which a block is short, and the densities that decide the others.
SHORT = 40
LINKS, ALL_LINKS = 0.5, 0.9
STOP_HIGH, STOP_LOW = 0.30, 0.12
#: Share of letters (without combining marks) below which a block in another language is not text.
LETTERS = 0.25

#: Frequent function words of four languages.
STOP_WORDS = frozenset("""
the of and to a in is it that was for on are as with his they be at one have this from or had by not but what all were when we there can
an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see
le la les de des du un une et est en que qui dans pour sur par au aux ce ces cette il elle ils elles on ne pas plus avec se son sa ses
mais ou où nous vous leur être avoir fait comme tout
der die das den dem des ein eine einer eines einem einen und ist in zu von mit für auf im nicht sich auch als an es er sie wir ihr am aus
bei nach wie um aber oder dass war sind wird noch nur über vor zum zur
el los las un una unos unas y es en que por para con del al lo se su sus no más como pero sin sobre este esta entre cuando muy también hasta
desde todo nos ya fue ha son
""".split())

_SKIPPED_TAGS = frozenset("nav aside footer form noscript template select button textarea iframe svg dialog menu object canvas fieldset datalist".split())
#: Zones that may hold the whole page, and those that never do.
SOFT, HARD = 1, 2
_SOFT_TAGS = frozenset(("form", "dialog", "fieldset"))
_HEADER_NAMES = frozenset("header site-header page-header top-header main-header global-header header-wrapper header-container".split())
_RAW_TAGS = frozenset("script style title".split())
_VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE_TAGS = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span
strike strong sub sup time tt u var wbr""".split())
_CLEAR_NAMES = frozenset("""advert adverts advertisement advertisements advertising cookie cookies consent gdpr newsletter sidebar menu navbar
nav navigation breadcrumb breadcrumbs masthead footer comment comments disqus replies pagination pager toolbar topbar popup modal""".split())
_SKIPPED_NAMES = _CLEAR_NAMES | frozenset("""ad ads sponsor sponsored sponsors promo promos promotion promotions banner banners notice notices
overlay subscribe subscription reply respond related recommended recommendations share sharing social login signup search widget
widgets""".split())
#: Words of place and form that leave a name what it is, and words of state that make it no name.
_FORM_NAMES = frozenset("""left right top bottom upper lower first last main primary secondary site page global header head title label body
content inner outer box wrap wrapper container holder list item items link links icon icons button buttons bar block area section
panel slot unit group row column col form field text message thread count posts articles stories card cards image thumbnail policy
side mobile desktop""".split())
_STATE_NAMES = frozenset("has have no non not without with hide hidden show is are js un enable enabled disable disabled".split())
_COMMENT_NAMES = frozenset("comment comments reply replies disqus respond".split())
_SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*+(?=>)|[^<>]*+)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")


#: Elements that end an open one of the given names, unless one of the bounds lies between.
_ENDS_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5
h6 header hgroup hr main menu nav ol p pre search section summary table ul""".split())
_IMPLIED = {"li": (("li",), frozenset(("ul", "ol", "menu"))), "dt": (("dt", "dd"), frozenset(("dl",))), "dd": (("dt", "dd"), frozenset(("dl",))),
            "td": (("td", "th"), frozenset(("table", "tr"))), "th": (("td", "th"), frozenset(("table", "tr"))),
            "tr": (("tr",), frozenset(("table",))), "option": (("option",), frozenset(("select", "datalist")))}
_BOUNDS_P = frozenset("td th table caption object button template li dd dt".split())


def names_zone(value: str) -> bool:
    """Does one class or id name a zone that is left out?"""
    parts = [p.lower() for p in _NAME.findall(value) if len(p) > 1]
    if not parts or parts[0] in _STATE_NAMES:
        return False
    if all(p in _SKIPPED_NAMES or p in _FORM_NAMES for p in parts) and any(p in _SKIPPED_NAMES and p not in _FORM_NAMES for p in parts):
        return True
    if len(parts) == 1:
        return parts[0] in _SKIPPED_NAMES
    while len(parts) > 1 and parts[-1] in _FORM_NAMES and parts[-1] not in _CLEAR_NAMES:
        parts.pop()
    return parts[-1] in _CLEAR_NAMES


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    skipped: bool
    inside: bool
    item: bool = False
    wrapped: bool = False
    label: str = ""

    @property
    def link_density(self) -> float:
        return self.linked / max(len(self.text), 1)

    @property
    def stop_density(self) -> float:
        words = _WORD.findall(self.text.lower())
        return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


@dataclass
class _Parser:
    """Open elements and the block being gathered."""

    blocks: list[Block] = field(default_factory=list)
    open: list[tuple[str, int, bool]] = field(default_factory=list)  # name, skipped zone it starts (SOFT, HARD), starts the article
    names: Counter = field(default_factory=Counter)
    hard: int = 0
    soft: int = 0
    wrapped: int = 0
    inside: int = 0
    links: int = 0
    heading: int = 0
    pieces: list[tuple[str, bool]] = field(default_factory=list)
    here: tuple[bool, ...] = ()

    def text(self, raw: str) -> None:
        if raw and not self.pieces:
            skipped = self.hard > 0 or self.soft > self.wrapped
            self.here = (self.heading > 0, skipped, self.inside > 0, self.names["li"] > 0, self.inside > 0 and self.wrapped > 0)
        if raw:
            self.pieces.append((raw, self.links > 0))

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(unescape(p) for p, _ in self.pieces).split())
            if text:
                linked = sum(len(" ".join(unescape(p).split())) for p, link in self.pieces if link)
                self.blocks.append(Block(text, linked, *self.here))
            self.pieces = []

    def start(self, name: str, attrs: str) -> None:
        self.imply(name)
        skip, article = self.zone(name, attrs)
        if name not in _INLINE_TAGS or skip:
            self.end_block()
        if name in _VOID_TAGS:
            return
        self.open.append((name, skip, article))
        self.names[name] += 1
        self.count(name, skip, article, 1)

    def imply(self, name: str) -> None:
        """End the elements whose end tag may be left out before a start tag of that name."""
        if name in _ENDS_P and self.names["p"]:
            self.end_inside(("p",), _BOUNDS_P)
        if name in _IMPLIED:
            names, bounds = _IMPLIED[name]
            if any(self.names[n] for n in names):
                self.end_inside(names, bounds)

    def end_inside(self, names: tuple[str, ...], bounds: frozenset[str]) -> None:
        for top, _, _ in reversed(self.open):
            if top in bounds:
                return
            if top in names:
                self.end(top)
                return

    def count(self, name: str, skip: int, article: bool, by: int) -> None:
        if article:
            if by > 0 and not self.inside:
                self.wrapped = self.soft  # zones around the article, by class, id or form
            self.inside += by
            if not self.inside:
                self.wrapped = 0
        self.hard += by * (skip == HARD)
        self.soft += by * (skip == SOFT)
        self.links += by * (name == "a")
        self.heading += by * (len(name) == 2 and name[0] == "h" and name[1] in "123456")

    def end(self, name: str) -> None:
        if name not in _INLINE_TAGS:
            self.end_block()
        if not self.names[name]:
            return
        while True:
            top, skip, article = self.open.pop()
            if skip:
                self.end_block()
            self.names[top] -= 1
            self.count(top, skip, article, -1)
            if top == name:
                return

    def zone(self, name: str, attrs: str) -> tuple[int, bool]:
        """(zone that is left out and starts here: 0, SOFT or HARD, is it the article)."""
        if name in _SKIPPED_TAGS or (name == "header" and not self.inside):
            return SOFT if name in _SOFT_TAGS else HARD, False
        found = {k.lower(): unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(attrs)} if attrs.strip(" /") else {}
        values = f"{found.get('class', '')} {found.get('id', '')}".split() if found else []
        role = found.get("role", "").lower()
        if name in ("html", "body"):
            return 0, False
        if name in ("article", "main") or role == "main":
            comment = any(p.lower() in _COMMENT_NAMES for v in values for p in _NAME.findall(v) if names_zone(v))
            return (HARD, False) if comment else (0, True)
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
            return HARD, False
        named = any(map(names_zone, values)) or (not self.inside and any(v.lower() in _HEADER_NAMES for v in values))
        return SOFT if named or role in _SKIPPED_ROLES else 0, False


def parse(html: str) -> list[Block]:
    """Blocks of a page in order."""
    page, at, size = _Parser(), 0, len(html)
    while at < size:
        found = _TOKEN.search(html, at)
        if not found:
            page.text(html[at:])
            break
        page.text(html[at:found.start()])
        at = found.end()
        name = (found["tag"] or "").lower()
        if not name:
            continue
        if found["end"]:
            page.end(name)
        elif name in _RAW_TAGS:
            page.end_block()
            close = re.compile(rf"</{name}[^>]*>", re.I).search(html, at)
            at = close.end() if close else size
        else:
            page.start(name, found["attrs"])
    page.end_block()
    return page.blocks


def _first_label(block: Block, marked: bool, listed: bool) -> str:
    if block.link_density > LINKS:
        return "out" if not marked else "short" if len(block.text) < SHORT else "middling"
    if len(block.text) < SHORT:
        return "short"
    if marked:
        return "in"
    if not listed:
        return "in" if sum(map(len, _WORD.findall(block.text))) >= LETTERS * len(block.text) else "out"
    density = block.stop_density
    return "in" if density >= STOP_HIGH else "middling" if density >= STOP_LOW else "low"


def _listed(blocks: list[Block]) -> bool:
    """Are the longer blocks that are not links in a language of the stop words?"""
    words = [w for b in blocks if len(b.text) >= SHORT and b.link_density <= LINKS for w in _WORD.findall(b.text.lower())]
    return sum(w in STOP_WORDS for w in words) >= STOP_LOW * len(words)


def _low_label(blocks: list[Block]) -> None:
    """Blocks of few stop words are in between two blocks that are; where no block is in, they are middling."""
    decided = [i for i, b in enumerate(blocks) if b.label in ("in", "out")]
    some, k = any(blocks[i].label == "in" for i in decided), 0
    labels = [b.label for b in blocks]
    for i, b in enumerate(blocks):
        while k < len(decided) and decided[k] < i:
            k += 1
        if b.label == "low":
            between = 0 < k < len(decided) and blocks[decided[k - 1]].label == blocks[decided[k]].label == "in"
            labels[i] = "middling" if not some else "in" if between else "out"
    for b, label in zip(blocks, labels, strict=True):
        b.label = label


def _second_label(blocks: list[Block]) -> None:
    """Give short and middling blocks the label of their nearest decided neighbour."""
    decided = [i for i, b in enumerate(blocks) if b.label in ("in", "out")]
    if not any(blocks[i].label == "in" for i in decided):  # no block speaks for another: what is not out is in
        for b in blocks:
            b.label = "out" if b.label == "out" else "in"
        return
    ends = [0]
    for b in blocks:
        ends.append(ends[-1] + len(b.text))
    labels, k = [b.label for b in blocks], 0
    for i, b in enumerate(blocks):
        while k < len(decided) and decided[k] < i:
            k += 1
        if b.label in ("in", "out"):
            continue
        before = decided[k - 1] if k else None
        after = decided[k] if k < len(decided) else None
        if before is None or after is None:
            labels[i] = blocks[after if before is None else before].label
        elif blocks[before].label == blocks[after].label or b.heading:
            labels[i] = blocks[after].label
        else:
            back, ahead = ends[i] - ends[before + 1], ends[after] - ends[i + 1]
            labels[i] = ("in" if b.label == "middling" else "out") if back == ahead else blocks[before if back < ahead else after].label
    for b, label in zip(blocks, labels, strict=True):
        b.label = label


def label(blocks: list[Block]) -> list[Block]:
    apart = any(b.inside and not b.skipped and not b.wrapped for b in blocks)  # an article outside all zones
    marked = any(b.inside and not b.skipped for b in blocks)
    open_ = [b for b in blocks if not b.skipped and (b.inside or not marked) and not (apart and b.wrapped)]
    for b in blocks:
        b.label = "out"
    listed = marked or _listed(open_)
    items = [b.item and not b.heading and b.link_density > ALL_LINKS for b in open_]
    for i, b in enumerate(open_):
        run = items[i] and any(items[max(i - 1, 0):i] + items[i + 1:i + 2])
        b.label = "out" if run else _first_label(b, marked, listed)
    _low_label(open_)
    _second_label(open_)
    return blocks


def main_text(html: str | None) -> tuple[str, int, int]:
    """(text, blocks, blocks kept) of a page."""
    blocks = label(parse(html)) if html else []
    kept = [b.text for b in blocks if b.label == "in"]
    return " ".join(kept), len(blocks), len(kept)


def _extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pages in batches:
        yield pd.DataFrame([main_text(p) for p in pages], columns=["text", "n_blocks", "n_kept"])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text, n_chars (code points), n_blocks and n_kept in place of ``html``."""
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars", "n_blocks", "n_kept")]
    read = F.pandas_udf(_extract, "text string, n_blocks int, n_kept int")
    out = pages.select(*kept, read(F.col(html)).alias("_pw_page"))
    return out.select(*kept, "_pw_page.text", F.char_length("_pw_page.text").cast("long").alias("n_chars"), "_pw_page.n_blocks", "_pw_page.n_kept")
