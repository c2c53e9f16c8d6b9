"""Who wrote the page: four kinds of evidence, strongest first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.text import SPACE, WORD_START, strip
from sitegauge.operators.elements import attr, spaced_text

# --- fixed values: the name grammar ------------------------------------------
_CAPITAL = r"[\p{L}\p{Nl}\p{No}&&[^a-z]]"
_WORD = _CAPITAL + r"(?:[\p{L}\p{N}_.'’\-]*[\p{L}\p{N}])?"
_INITIAL = _CAPITAL + r"\."
_PARTICLES = "de|del|della|der|di|da|dos|van|von|la|le|bin|al"
FULL_NAME = rf"(?:{_WORD}|{_INITIAL})(?:{SPACE}+(?:{_WORD}|{_INITIAL}|(?:{_PARTICLES}))){{1,3}}"
_BY = rf"(?:[Ww]ritten{SPACE}+)?[Bb]y(?::|{SPACE}){SPACE}*"
_NOT_PROSE = rf"(?![’'a-z]|{SPACE}+[a-z])"
BYLINE_START = rf"\A{_BY}({FULL_NAME}){_NOT_PROSE}"
BYLINE_ANYWHERE = rf"{WORD_START}{_BY}({FULL_NAME}){_NOT_PROSE}"
AUTHOR_MARK = r"(?i)byline|author(?!ity)"
BYLINE_CHARS = 120
BYLINE_TAGS = ("p", "div", "span", "address", "header", "li", "small", "cite", "figcaption", "td")
# --- fixed values: words of a page's interface, never a name ---
INTERFACE_WORDS = (
    "read", "more", "learn", "home", "page", "pages", "next", "previous", "prev", "back", "all", "view",
    "views", "share", "shares", "related", "post", "posts", "comment", "comments", "reply", "sign", "log",
    "login", "menu", "search", "subscribe", "newsletter", "follow", "contact", "about", "privacy", "terms",
    "cookie", "cookies", "skip", "toggle", "close", "open", "show", "hide", "the", "and", "our", "team",
    "staff", "editor", "editors", "admin",
)


def plausible_name(name: Column) -> Column:
    """At least one token that is not an interface word."""
    tokens = F.transform(F.split(name, SPACE + "+"), lambda t: F.btrim(t, F.lit(".'’-")))
    return F.exists(tokens, lambda t: (t != "") & ~F.lower(t).isin(*INTERFACE_WORDS))


def _author_meta(e: Column) -> Column:
    key = F.coalesce(F.nullif(attr(e, "name"), F.lit("")), attr(e, "property"))
    names = (
        (e["tag"] == "meta")
        & F.lower(strip(key)).isin("author", "article:author")
        & (strip(attr(e, "content")) != "")
    )
    return F.coalesce(names, F.lit(False))


def meta_author(elements: Column) -> Column:
    return F.exists(elements, _author_meta)


def meta_values(elements: Column) -> Column:
    """Whole value of each author meta element."""
    return F.transform(F.filter(elements, _author_meta), lambda e: attr(e, "content"))


def _author_scoped(e: Column) -> Column:
    marks = F.concat_ws(" ", attr(e, "class"), attr(e, "id"))
    return (
        F.coalesce(F.lower(attr(e, "rel")).contains("author"), F.lit(False))
        | F.coalesce(F.lower(attr(e, "itemprop")).contains("author"), F.lit(False))
        | marks.rlike(AUTHOR_MARK)
    )


def author_marked_texts(elements: Column, texts: Column) -> Column:
    """Text of each element marked as author context."""
    marked = F.filter(
        elements,
        lambda e: (e["text_chars"] > 0) & (F.cardinality(F.map_keys(e["attrs"])) > 0) & _author_scoped(e),
    )
    return F.transform(marked, lambda e: spaced_text(texts, e))


def short_block_texts(elements: Column, texts: Column) -> Column:
    """Text of each short block that could be a byline. Headings never are."""
    blocks = F.filter(
        elements,
        lambda e: e["text_chars"].between(1, BYLINE_CHARS) & e["tag"].isin(*BYLINE_TAGS),
    )
    return F.transform(blocks, lambda e: spaced_text(texts, e))


def markup_author(marked_texts: Column) -> Column:
    def names(t: Column) -> Column:
        inline = plausible_name(F.regexp_extract(t, BYLINE_ANYWHERE, 1))
        bare = (F.length(t) <= BYLINE_CHARS) & plausible_name(F.regexp_extract(t, FULL_NAME, 0))
        return inline | bare

    return F.exists(marked_texts, names)


def visible_byline(block_texts: Column) -> Column:
    return F.exists(
        block_texts,
        lambda t: t.rlike(r"\A(?:[Ww]ritten|[Bb]y)") & plausible_name(F.regexp_extract(t, BYLINE_START, 1)),
    )


def byline_names(block_texts: Column) -> Column:
    """Whole name of each block that is a byline."""
    names = F.transform(block_texts, lambda t: F.regexp_extract(t, BYLINE_START, 1))
    return F.filter(names, lambda n: n != "")


def author_source(jsonld: Column, meta: Column, markup: Column, byline: Column) -> Column:
    """Strongest evidence: jsonld, meta, markup, byline, else NULL."""
    return (
        F.when(jsonld, "jsonld").when(meta, "meta").when(markup, "markup").when(byline, "byline")
    )
