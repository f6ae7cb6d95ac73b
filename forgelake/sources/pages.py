"""Scraped web pages to repository links, cards and logins.

Comments, scripts and styles are removed first. The tags of a page are then read once in order with a stack of
open elements, in built-in functions, so nested, unclosed and quoted markup is placed as in a browser. That
gives the anchors, with how far each selector has matched around them, and the spans of the elements whose text is
wanted: texts of cards and articles are found by which span contains which.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelake.functions.identity import repo_id
from forgelake.functions.text import path_parts, trimmed, unescape, without_leading_slash
from forgelake.operators.ordering import rows_between

NOISE = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
ANCHOR = r"(?is)^<a\b"
HREF = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
TAG = r"""(?s)</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*+>"""
CLASS = r"""(?is)\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# A paragraph that was not closed ends where one of these begins.
_NO_PARAGRAPH = (
    *_HEADINGS, "p", "article", "section", "div", "ul", "ol", "li", "table", "form", "blockquote", "pre", "main", "nav", "header", "footer",
)
_OPEN = "array<struct<name:string,at:int,label:string,met:array<int>>>"
_FOUND = "array<struct<at:int,tag:string,met:array<int>>>"
_SPANS = "array<struct<at:int,label:string,end:int>>"
# The end of an element that was never closed.
_NEVER = 1 << 30


@dataclass(frozen=True)
class Element:
    """An element by tag name and, if given, a class of its class list."""

    tag: str
    css_class: str | None = None

    def matches(self, opened: Column) -> Column:
        same = opened["name"] == self.tag
        if self.css_class is None:
            return same
        listed = F.concat(F.lit(" "), F.regexp_replace(opened["classes"], r"\s+", " "), F.lit(" "))
        return same & F.contains(listed, F.lit(f" {self.css_class} "))


@dataclass(frozen=True)
class Selector:
    """Anchors inside nested elements (outermost first) whose tag matches ``anchor``.

    ``mention`` demands that the link contains ``/organisation/``.
    """

    blocks: tuple[Element, ...] = ()
    anchor: str = ANCHOR
    mention: bool = False

    def advanced(self, met: Column, opened: Column) -> Column:
        """How many of the blocks are met inside an element, from how many were around it."""
        out = met
        for k, element in enumerate(self.blocks):
            out = F.when((met == k) & element.matches(opened), F.lit(k + 1)).otherwise(out)
        return out

    def holds(self, anchor: Column, number: int = 0) -> Column:
        """Whether an anchor of a page read with this selector as the given one is meant."""
        return anchor["tag"].rlike(self.anchor) & (anchor["met"][number] == len(self.blocks))


def elements(html: Column, selectors: Sequence[Selector] = (), labels: Sequence[tuple[str, str]] = ()) -> Column:
    """What one pass over the tags of a page finds: ``found``, its anchors in order, and ``spans``.

    An anchor has the number of its tag, ``at``, its text, and how many blocks of each selector are met around it.
    ``labels`` names the elements whose spans are wanted, by patterns of their start tags; a span has the numbers of its
    start tag and of the tag that ends it. An end tag closes the innermost open element of its name and all inside
    it, and is ignored if there is none. A list item, heading or paragraph that was not closed ends where the next one
    of its list, the next heading, or the next block begins.
    """

    def from_end(opened: Column, *names: str | Column) -> Column:
        """How far from the end the innermost element of a name is; 0 if none is open."""
        listed = F.reverse(F.transform(opened, lambda o: o["name"]))
        if len(names) == 1:
            return F.array_position(listed, names[0]).cast("int")
        return F.array_position(F.transform(listed, lambda n: n.isin(*names)), F.lit(True)).cast("int")

    none = F.array(*[F.lit(0) for _ in selectors]).cast("array<int>")

    def step(state: Column, tag: Column) -> Column:
        opened, name, ends = state["open"], tag["name"], tag["ends"]
        item, its_list = from_end(opened, F.lit("li")), from_end(opened, "ul", "ol", "menu")
        stale = (name == "li") & (item > 0) & ((its_list == 0) | (item < its_list))
        heading = name.isin(*_HEADINGS) & F.coalesce(F.try_element_at(opened, F.lit(-1))["name"].isin(*_HEADINGS), F.lit(False))
        closed = (
            F.when(ends, from_end(opened, name))
            .when(stale, item)
            .when(heading, F.lit(1))
            .when(name.isin(*_NO_PARAGRAPH), from_end(opened, F.lit("p")))
            .otherwise(F.lit(0))
        )
        return bound(closed, lambda n: after(state, tag, n))

    def after(state: Column, tag: Column, closed: Column) -> Column:
        """The state when a tag has ended so many of the open elements."""
        opened = state["open"]
        under = F.slice(opened, F.lit(1), F.size(opened) - closed)
        around = F.coalesce(F.try_element_at(under, F.lit(-1))["met"], none)
        return bound(F.struct(under.alias("open"), around.alias("met")), lambda u: entered(state, tag, closed, u))

    def entered(state: Column, tag: Column, closed: Column, under: Column) -> Column:
        opened, spans = state["open"], state["spans"]
        if labels:
            over = F.slice(opened, F.size(opened) - closed + 1, F.greatest(closed, F.lit(0)))
            new = F.transform(
                F.filter(over, lambda o: o["label"].isNotNull()),
                lambda o: F.struct(o["at"].alias("at"), o["label"].alias("label"), tag["at"].alias("end")),
            )
            spans = F.when(closed > 0, F.concat(spans, new)).otherwise(spans)
        met = F.array(*[s.advanced(under["met"][k], tag) for k, s in enumerate(selectors)]).cast("array<int>")
        own = F.struct(tag["name"].alias("name"), tag["at"].alias("at"), tag["label"].alias("label"), met.alias("met"))
        here = F.array(F.struct(tag["at"].alias("at"), tag["tag"].alias("tag"), under["met"].alias("met")))
        return F.struct(
            F.when(tag["ends"] | tag["name"].isin(*_VOID), under["open"])
            .otherwise(F.concat(under["open"], F.array(own)))
            .cast(_OPEN)
            .alias("open"),
            F.when((tag["name"] == "a") & ~tag["ends"], F.concat(state["found"], here))
            .otherwise(state["found"])
            .cast(_FOUND)
            .alias("found"),
            spans.cast(_SPANS).alias("spans"),
        )

    # Classes are only read where a selector asks for some.
    classes = any(e.css_class is not None for s in selectors for e in s.blocks)

    def labelled(tag: Column) -> Column:
        out = F.lit(None).cast("string")
        for label, pattern in labels:
            out = F.when(tag.rlike(pattern), label).otherwise(out)
        return out

    tags = F.transform(
        F.regexp_extract_all(html, F.lit(TAG), F.lit(0)),
        lambda t, i: F.struct(
            t.alias("tag"),
            i.alias("at"),
            F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1)).alias("name"),
            F.startswith(t, F.lit("</")).alias("ends"),
            (F.concat(*[F.regexp_extract(t, CLASS, g) for g in (1, 2, 3)]) if classes else F.lit("")).alias("classes"),
            labelled(t).alias("label"),
        ),
    )
    start = F.struct(
        F.array().cast(_OPEN).alias("open"), F.array().cast(_FOUND).alias("found"), F.array().cast(_SPANS).alias("spans")
    )

    def finished(state: Column) -> Column:
        unclosed = F.transform(
            F.filter(state["open"], lambda o: o["label"].isNotNull()),
            lambda o: F.struct(o["at"].alias("at"), o["label"].alias("label"), F.lit(_NEVER).alias("end")),
        )
        return F.struct(state["found"].alias("found"), F.concat(state["spans"], unclosed).alias("spans"))

    return F.aggregate(tags, start, step, finished)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, wherever it stands in there."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def start_tag(name: str) -> str:
    """Pattern of a start tag."""
    return rf"(?is)^<{name}(?=[\s/>])"


def first_span(spans: Column, label: str, outer: Column | None = None) -> Column:
    """The first element with the label, within another one if that is given."""
    inside = lambda s: F.lit(True) if outer is None else (s["at"] > outer["at"]) & (s["at"] < outer["end"])
    return F.array_min(F.filter(spans, lambda s: (s["label"] == label) & inside(s)))


def span_text(texts: Column, span: Column) -> Column:
    """Text of an element; ``texts`` are the stretches between the tags of the page."""
    text = bound(span, lambda s: F.array_join(F.slice(texts, s["at"] + 2, s["end"] - s["at"]), ""))
    return F.coalesce(bound(text, lambda t: trimmed(unescape(t))), F.lit(""))


# The three ways a listing page links a repository, in order of preference.
ORGANISATION_SELECTORS = (
    Selector(anchor=r"""(?is)<a\b[^>]*\sdata-hovercard-type\s*=\s*["']?repository["'\s>][^>]*>?"""),
    Selector(blocks=(Element("h3"),)),
    Selector(blocks=(Element("li", "Box-row"),), mention=True),
)
# Where a trending page links its users.
TRENDING_SELECTORS = (Selector(blocks=(Element("article"), Element("h1"))),)
CARD_HEADING = "h3"
# Fixed value: the mark of a card's language.
LANGUAGE = r"""(?is)^<[a-z][^>]*\sitemprop\s*=\s*["']?programmingLanguage(?=["'\s/>])"""


def without_noise(html: str | Column) -> Column:
    return F.regexp_replace(html, NOISE, " ")


def href_of(tag: Column) -> Column:
    """Link target of an anchor tag, NULL when it has none."""
    groups = [F.regexp_extract(tag, HREF, g) for g in (1, 2, 3)]
    return F.when(tag.rlike(HREF), unescape(F.concat(*groups)))


def links(pages: DataFrame, selectors: Sequence[Selector], keep: Sequence[str], html: str = "html") -> DataFrame:
    """Links of every selector in one pass: ``keep`` + selector_rank, pos, href."""
    # Materialized by the generator, so that a page is read once for all selectors.
    clean = pages.select(*keep, F.explode(F.array(elements(without_noise(html), selectors))).alias("_page"))

    def matches_of(rank: int, selector: Selector) -> Column:
        return F.transform(
            F.filter("_page.found", lambda anchor: selector.holds(anchor, rank - 1)),
            lambda anchor, pos: F.struct(
                F.lit(rank).alias("selector_rank"),
                pos.alias("pos"),
                href_of(anchor["tag"]).alias("href"),
                F.lit(selector.mention).alias("mention"),
            ),
        )

    matches = [matches_of(rank, s) for rank, s in enumerate(selectors, start=1)]
    found = F.concat(*matches) if len(matches) > 1 else matches[0]
    return clean.select(*keep, F.explode(found).alias("_l")).select(*keep, "_l.*").filter(F.col("href").isNotNull())


def organisation_repos(
    pages: DataFrame,
    *,
    base_url: str,
    selectors: Sequence[Selector] = ORGANISATION_SELECTORS,
    id_parts: Sequence[int] = (1, 2),
    max_pages: int | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Listing pages ``(org, page, html)`` to repositories, the first sighting per organisation.

    Sightings are ordered by page, selector and place on the page. ``id_parts`` names the path
    parts that identify a repository; the first is its owner, the last its name.
    """
    rows = pages if max_pages is None else pages.filter(F.col("page") <= max_pages)
    parts = path_parts("href")
    found = links(rows, selectors, ["org", "page"]).filter(
        F.col("href").startswith("/")
        & (F.size(parts) > max(id_parts))
        & (~F.col("mention") | F.contains("href", F.concat(F.lit("/"), "org", F.lit("/"))))
    )
    sightings = found.select(
        "org",
        F.concat_ws("/", *[F.get(parts, F.lit(i)) for i in id_parts]).alias("id"),
        F.struct("page", "selector_rank", "pos", "href").alias("_first"),
    )
    # A minimum per repository instead of a ranking window: combined before the shuffle.
    firsts = sightings.groupBy("org", "id").agg(F.min("_first").alias("f"))
    parts = path_parts("f.href")
    moment = F.current_timestamp() if now is None else now
    return firsts.select(
        "org",
        "id",
        F.get(parts, F.lit(id_parts[0])).alias("owner"),
        F.get(parts, F.lit(id_parts[-1])).alias("name"),
        F.concat(F.lit(base_url), "f.href").alias("url"),
        "f.page",
        "f.selector_rank",
        "f.pos",
        moment.alias("createdAt"),
        moment.alias("updated_at"),
    )


def first_seen(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct keys with the position of their first occurrence."""
    return (
        rows.groupBy(*keys)
        .agg(F.min(F.struct(*order)).alias("_first"))
        .select(*keys, *[F.col("_first")[o].alias(o) for o in order])
    )


def trending_logins(
    pages: DataFrame, *, selectors: Sequence[Selector] = TRENDING_SELECTORS, page: str = "page"
) -> DataFrame:
    """Logins linked from trending pages, once each, with their first position."""
    found = links(pages, selectors, [page]).filter(F.col("href").startswith("/"))
    logins = found.select(page, "selector_rank", "pos", without_leading_slash("href").alias("login"))
    return first_seen(logins.filter(F.col("login") != ""), ["login"], [page, "selector_rank", "pos"])


def profile_cards(
    pages: DataFrame,
    keep: Sequence[str],
    *,
    base_url: str,
    heading: str = CARD_HEADING,
    html: str = "html",
) -> DataFrame:
    """Profile pages to repositories, in page order, one row per card heading link.

    Description and language are the first paragraph and language mark in the closest article around the link; a
    link outside of an article has neither.
    """
    heads = Selector(blocks=(Element(heading),))
    labels = [("article", start_tag("article")), ("p", start_tag("p")), ("language", LANGUAGE)]
    page = F.struct(elements(F.col("_html"), [heads], labels).alias("read"), F.split("_html", TAG).alias("texts"))
    clean = pages.select(*keep, without_noise(html).alias("_html")).select(*keep, F.explode(F.array(page)).alias("_p"))
    spans, texts = F.col("_p.read.spans"), F.col("_p.texts")

    def card(anchor: Column) -> Column:
        around = F.filter(
            spans, lambda s: (s["label"] == "article") & (s["at"] < anchor["at"]) & (s["end"] > anchor["at"])
        )
        return F.struct(anchor["at"].alias("pos"), href_of(anchor["tag"]).alias("href"), F.array_max(around).alias("article"))

    def described(found: Column) -> Column:
        return F.struct(
            found["pos"].alias("pos"),
            found["href"].alias("href"),
            span_text(texts, first_span(spans, "p", found["article"])).alias("description"),
            span_text(texts, first_span(spans, "language", found["article"])).alias("language"),
        )

    cards = F.transform(F.transform(F.filter("_p.read.found", lambda a: heads.holds(a)), card), described)
    found = clean.select(*keep, F.explode(cards).alias("_c")).select(
        *keep, "_c.*", path_parts(without_leading_slash("_c.href")).alias("_parts")
    )
    owner, name = F.get("_parts", F.lit(0)), F.get("_parts", F.lit(1))
    return found.filter(F.startswith("href", F.lit("/")) & (F.size("_parts") >= 2)).select(
        *keep,
        "pos",
        repo_id(owner, name).alias("id"),
        owner.alias("owner"),
        name.alias("name"),
        F.concat(F.lit(base_url), F.concat_ws("/", F.lit(""), owner, name)).alias("url"),
        "description",
        "language",
        F.lit(0).cast("bigint").alias("stars"),
    )


def first_elements(pages: DataFrame, keep: Sequence[str], *, scope: str, names: dict[str, str], html: str = "html") -> DataFrame:
    """Text of the first element of each name ``column -> element`` inside the first ``scope`` element of a page."""
    labels = [(tag, start_tag(tag)) for tag in dict.fromkeys([scope, *names.values()])]
    page = F.struct(elements(F.col("_html"), (), labels).alias("read"), F.split("_html", TAG).alias("texts"))
    clean = pages.select(*keep, without_noise(html).alias("_html")).select(*keep, F.explode(F.array(page)).alias("_p"))
    scoped = clean.select("*", first_span(F.col("_p.read.spans"), scope).alias("_scope"))
    text = lambda tag: span_text(F.col("_p.texts"), first_span(F.col("_p.read.spans"), tag, F.col("_scope")))
    return scoped.select(*keep, *[text(tag).alias(column) for column, tag in names.items()])


def organisation_sweep(repos: DataFrame, organisations: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` repositories over the organisations ``(org, org_pos)`` in list order."""
    listed = repos.join(organisations.select("org", "org_pos"), "org")
    return rows_between(listed, ["org_pos", "page", "selector_rank", "pos"], 0, budget)
