"""Main text of web pages by block rules in two passes (operator 8).

A page is read tag by tag into blocks: the text between two tags of block level. Each block knows its
length, how much of it is link text, its share of stop words, and its containers. The first pass
decides a block on its own: content, boilerplate, or open. The second pass gives an open block the
label of its nearest decided neighbours; if the two sides differ, that of the nearer one, counted in
characters, and content on a tie.

First pass, in this order:

* boilerplate, if a container is no part of an article by its tag (menus, headers and footers of the
  page, sidebars, forms, dialogs, embedded objects), or by a word of its class, id or role (adverts,
  notices, comments and the like); of an ``article``, only words for comments say so, and of classes that name a
  subject (``category-``, ``tag-``) none do; text of scripts, styles, templates and the head is no block at all;
* boilerplate, if over a third of its characters are link text;
* content, if it is a heading, paragraph or cell inside ``article`` or ``main`` of at least
  ``SHORT`` characters or a heading there;
* open, if it is shorter than ``SHORT``;
* content, if under ``KNOWN`` of the words of the page are stop words: it is in another language, and there
  length and link density decide;
* content, if at least ``DENSE`` of its words are stop words; open, if at least ``SPARSE`` are or it
  lies inside an article; boilerplate otherwise.

Blocks that are boilerplate by their container are no neighbours: a menu says nothing about what follows
it. Open blocks without any decided neighbour are content when they lie inside an article, or when the page
has no article.

Defined results: a NULL or empty page gives an empty text. Unclosed and unknown tags, quoted ``>``,
comments and broken references are read as a browser reads them. Repeated rows are read one by one,
other columns are kept as they are, and a long page is read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelake.llm.common import free_name, map_batches, prepare, text_or_empty

SHORT = 70
DENSE = 0.30
SPARSE = 0.15
MAX_LINK_SHARE = 1 / 3
# A page with a smaller share of stop words is in a language whose stop words are not known here.
KNOWN = 0.05

# Frequent function words of the languages read here, as plain lists.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his if in is it its not of on or she so that the "
    "their there they this to was we were which will with you "
    "aber als am an auch auf aus bei bis das dem den der des die ein eine einem einen einer es für hat ich im in ist "
    "mit nach nicht oder sich sie sind so und vom von war wie wir zu zum zur über "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas pour que qui sa "
    "se ses son sont sur un une vous "
    "al como con de del el ella en es esta este ha la las le lo los más no o para pero por que se si sin sobre su sus "
    "un una y".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_NAME = re.compile(r"[a-z]+|[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")

# Tags whose content is no text of the page.
_SILENT = frozenset(
    "script style noscript template head title svg math canvas object iframe textarea select option audio video map "
    "noembed noframes xmp".split()
)
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OUTSIDE = frozenset("nav footer aside form dialog menu button fieldset search label legend".split())
_ARTICLE = frozenset("article main".split())
_OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments "
    "commentlist consent cookie cookies copyright disclaimer disqus donate footer gdpr legal login menu menus modal nav "
    "navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion "
    "promotions recommended related replies reply respond sharing share sidebar signup skyscraper social sponsor "
    "sponsored subscribe subscription toolbar".split()
)
# What still says so of an article: it is a reader's comment.
_COMMENT_NAMES = frozenset("comment comments commentlist disqus replies reply respond".split())
# Classes that begin like this name the subject of a text.
_SUBJECTS = ("category-", "tag-", "topic-")
_MODIFIERS = frozenset("with has no without".split())
_OUTSIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
# A start tag closes an open element of the same group, up to the nearest boundary.
_CLOSES = {
    "li": ("li", ("ul", "ol", "menu", "dir")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}


@dataclass
class Block:
    text: str
    link_chars: int
    outside: bool
    article: bool
    heading: bool
    prose: bool


class _Reader:
    def __init__(self) -> None:
        self.open: list[tuple[str, bool, bool]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.outside = self.articles = self.links = self.silent = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            tags = [t for t, _, _ in self.open]
            linked = len(" ".join("".join(self.linked).split()))
            heading = any(t in _HEADINGS for t in tags)
            prose = any(t in ("p", "blockquote", "pre", "dd", "td", "li", "figcaption") for t in tags)
            self.blocks.append(Block(text, linked, self.outside > 0, self.articles > 0, heading, prose))
        self.parts, self.linked = [], []

    def text(self, raw: str) -> None:
        if self.silent or not raw:
            return
        found = html.unescape(raw) if "&" in raw else raw
        self.parts.append(found)
        if self.links:
            self.linked.append(found)

    def count(self, tag: str, outside: bool, step: int) -> None:
        self.outside += step * outside
        self.articles += step * (tag in _ARTICLE)
        self.links += step * (tag == "a")
        self.silent += step * (tag in _SILENT)

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            if self.open[-1][0] in _BLOCK:
                self.flush()
            tag, outside, _ = self.open.pop()
            self.count(tag, outside, -1)

    def start(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK:
            self.flush()
            # A block ends an open paragraph.
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == "p":
                    self.close_to(at)
                    break
                if self.open[at][0] in _BLOCK:
                    break
            if tag in _HEADINGS and self.open and self.open[-1][0] in _HEADINGS:
                self.close_to(len(self.open) - 1)
        if tag in _CLOSES:
            group, borders = _CLOSES[tag]
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in borders:
                    break
                if self.open[at][0] in group.split():
                    self.close_to(at)
                    break
        if tag == "a" and self.links:
            self.end("a")
        if tag in ("br", "img", "wbr", "hr"):
            self.parts.append("" if tag == "wbr" else " ")
        if tag in _VOID:
            return
        outside = tag in _OUTSIDE or (tag == "header" and not self.articles) or self.named_outside(tag, attributes)
        self.open.append((tag, outside, tag in _BLOCK))
        self.count(tag, outside, 1)

    def named_outside(self, tag: str, attributes: str) -> bool:
        """Whether the attributes of an element say that it is no part of an article."""
        if not attributes or attributes.isspace():
            return False
        named = {}
        for m in _ATTRIBUTE.finditer(attributes):
            named.setdefault(m[1].lower(), html.unescape(next((g for g in m.groups()[1:] if g is not None), "")).lower())
        # "with-sidebar" and the like say what the page has, not what the element is.
        given = f"{named.get('class', '')} {named.get('id', '')}".split()
        words = [_NAME.findall(w) for w in given if not w.startswith(_SUBJECTS)]
        outside = _COMMENT_NAMES if tag == "article" else _OUTSIDE_NAMES
        names = {w for found in words if not _MODIFIERS.intersection(found) for w in found}
        return (
            named.get("role", "") in _OUTSIDE_ROLES
            or named.get("aria-hidden") == "true"
            or bool(re.search(r"(?:^|;)\s*display\s*:\s*none", named.get("style", "")))
            or bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes.lower()) and "hidden" not in named.get("class", ""))
            or (tag not in ("body", "html", "main") and bool(names & outside))
        )

    def end(self, tag: str) -> None:
        if tag == "p" and not any(t == "p" for t, _, _ in self.open):
            self.flush()
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.close_to(at)
                return
            # An inline end tag does not reach past the block it stands in.
            if tag not in _BLOCK and tag not in _SILENT and self.open[at][2]:
                return

    def read(self, page: str) -> list[Block]:
        at = 0
        while at < len(page):
            m = _TOKEN.search(page, at)
            if not m:
                self.text(page[at:])
                break
            self.text(page[at : m.start()])
            at = m.end()
            if m[0].startswith("<![CDATA["):
                self.text(html.escape(m[0][9:].removesuffix("]]>")))
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, m[3])
            if tag in _RAW and not m[3].endswith("/"):
                found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = found.end() if found else len(page)
                self.end(tag)
            elif m[3].endswith("/") and tag in ("svg", "math"):
                self.end(tag)
        self.close_to(0)
        self.flush()
        return self.blocks


def stop_words(text: str) -> tuple[int, int]:
    """How many stop words a text has, and how many words."""
    words = _LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def reads(blocks: list[Block]) -> bool:
    """Whether the page is in one of the languages whose stop words are known: some of its words are."""
    counts = [stop_words(b.text) for b in blocks if not b.outside]
    return sum(n for n, _ in counts) >= KNOWN * sum(n for _, n in counts)


def first_pass(block: Block, known: bool = True) -> bool | None:
    """Content, boilerplate, or None where the block alone does not tell. ``known`` is False on pages in other
    languages, where the length has to do for stop words."""
    if block.outside or block.link_chars > MAX_LINK_SHARE * len(block.text):
        return False
    if block.article and (block.heading or (block.prose and len(block.text) >= SHORT)):
        return True
    if len(block.text) < SHORT:
        return None
    if not known:
        return True
    stops, words = stop_words(block.text)
    share = stops / max(1, words)
    if share >= DENSE:
        return True
    return None if share >= SPARSE or block.article else False


def second_pass(blocks: list[Block], decided: list[bool | None]) -> list[bool]:
    """Labels of all blocks; open ones inherit from the nearest decided neighbours.

    Inside an article only neighbours in an article count: what surrounds it says nothing about it.
    """
    bare = not any(b.article for b in blocks)

    def nearest(order: range) -> dict[int, tuple[bool, int]]:
        found: dict[int, tuple[bool, int]] = {}
        last: dict[bool, tuple[bool, int] | None] = {True: None, False: None}
        for i in order:
            side = blocks[i].article
            if blocks[i].outside:
                continue
            if decided[i] is not None:
                last[side] = (decided[i], 0)
            elif last[side]:
                found[i] = last[side]
                last[side] = (last[side][0], last[side][1] + len(blocks[i].text))
        return found

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    out = []
    for i, label in enumerate(decided):
        if label is None:
            sides = [s[i] for s in (before, after) if i in s]
            if not sides:
                label = blocks[i].article or bare
            else:
                least = min(distance for _, distance in sides)
                label = any(value for value, distance in sides if distance == least)
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    blocks = _Reader().read(page or "")
    known = reads(blocks)
    labels = second_pass(blocks, [first_pass(b, known) for b in blocks])
    return "\n".join(b.text for b, kept in zip(blocks, labels, strict=True) if kept)


def extract(pages: DataFrame, *, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """All columns of ``pages`` but ``html_col``, with the main text in ``text_col``."""
    prepare(pages.sparkSession)
    kept = [c for c in pages.columns if c.lower() not in (html_col.lower(), text_col.lower())]
    page = free_name("_html", [*kept, text_col])
    rows = pages.select(*(F.col(f"`{c}`") for c in kept), text_or_empty(html_col).alias(page))

    def run(batches) -> Iterator[dict[str, list]]:
        for batch in batches:
            yield {
                **{c: batch.column(i) for i, c in enumerate(kept)},
                text_col: [main_text(p) for p in batch.column(len(kept)).to_pylist()],
            }

    return map_batches(rows, run, rows.drop(page).schema.add(text_col, "string"))
