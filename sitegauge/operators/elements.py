"""Column helpers over a page's element and text arrays (see `schema.DOM`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def live(elements: Column) -> Column:
    """Elements left after boilerplate subtrees are removed."""
    return F.filter(elements, lambda e: ~e["boilerplate"])


def tagged(elements: Column, *tags: str) -> Column:
    return F.filter(elements, lambda e: e["tag"].isin(*tags))


def count_tagged(elements: Column, *tags: str) -> Column:
    return F.size(tagged(elements, *tags))


def first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def attr(element: Column, name: str) -> Column:
    return element["attrs"][name]


def has_token(value: Column, token: str) -> Column:
    """Space-separated attribute value holds `token`."""
    return F.coalesce(F.array_contains(F.split(value, r"\s+"), token), F.lit(False))


def within(inner: Column, outer: Column) -> Column:
    """Strict descendant test on the shared numbering."""
    return (inner["eid"] > outer["eid"]) & (inner["eid"] <= outer["end_eid"])


def _text_slice(texts: Column, element: Column, flag: str) -> Column:
    span = F.slice(
        texts, element["text_from"] + 1, F.coalesce(element["text_to"] - element["text_from"], F.lit(0))
    )
    return F.transform(F.filter(span, lambda t: ~t[flag]), lambda t: t["text"])


def spaced_text(texts: Column, element: Column) -> Column:
    """Visible text of a subtree, nodes joined by one space."""
    return F.array_join(_text_slice(texts, element, "hidden"), " ")


def glued_text(texts: Column, element: Column, flag: str = "hidden") -> Column:
    """Text of a subtree with nodes joined by nothing: inline markup glues words."""
    return F.array_join(_text_slice(texts, element, flag), "")


def visible_text(texts: Column) -> Column:
    return F.array_join(
        F.transform(F.filter(texts, lambda t: ~t["hidden"]), lambda t: t["text"]), " "
    )


def visible_words(texts: Column) -> Column:
    """Words of the visible text. Nodes are joined by a space, so their counts add up."""
    return F.aggregate(
        texts, F.lit(0), lambda n, t: n + F.when(t["hidden"], F.lit(0)).otherwise(t["words"])
    )


def main_region(elements: Column) -> Column:
    """First article, else first main, else body."""
    return F.coalesce(*[first(tagged(elements, tag)) for tag in ("article", "main", "body")])


def jsonld_scripts(elements: Column, texts: Column) -> Column:
    """Bodies of `script[type="application/ld+json"]`, taken before any pruning."""
    scripts = F.filter(
        elements, lambda e: (e["tag"] == "script") & (attr(e, "type") == "application/ld+json")
    )
    return F.transform(
        scripts,
        lambda e: F.array_join(
            F.transform(
                F.slice(texts, e["text_from"] + 1, e["text_to"] - e["text_from"]), lambda t: t["text"]
            ),
            "",
        ),
    )
