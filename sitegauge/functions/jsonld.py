"""JSON-LD as VARIANT columns. Every function is total: bad input contributes nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


# A whole string, or a bare word that lenient readers take for a number.
_STRING_OR_WORD = r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+")|-?Infinity|NaN'
_MARK = "\x01"


def lenient(text: Column) -> Column:
    """JSON text in which a bare NaN, Infinity or -Infinity is a number beyond all others: there, and not zero.

    Strings are stepped over whole, so such a word inside one stays. The mark put behind each
    match occurs in no valid JSON; a text that holds it is left alone.
    """
    marked = F.regexp_replace(text, _STRING_OR_WORD, "$1" + _MARK)
    plain = F.replace(F.replace(marked, F.lit('"' + _MARK), F.lit('"')), F.lit(_MARK), F.lit("1e999"))
    return F.when(text.rlike("NaN|Infinity") & ~text.contains(_MARK), plain).otherwise(text)


def documents(script_texts: Column) -> Column:
    """Top-level objects of each script: an object itself, or an array's object members."""
    parsed = F.transform(script_texts, lambda s: F.try_parse_json(lenient(s)))
    lists = F.transform(
        parsed,
        lambda v: F.coalesce(
            F.try_variant_get(v, "$", "array<variant>"), F.when(_is_object(v), F.array(v))
        ),
    )
    members = F.flatten(F.filter(lists, lambda docs: docs.isNotNull()))
    return F.filter(members, _is_object)


def nodes(docs: Column) -> Column:
    """Object nodes: the members of a document's `@graph`, else the document itself."""

    def expand(doc: Column) -> Column:
        graph = F.try_variant_get(doc, "$['@graph']", "variant")
        members = F.coalesce(
            F.try_variant_get(doc, "$['@graph']", "array<variant>"),
            F.array().cast("array<variant>"),
        )
        return F.when(graph.isNull(), F.array(doc)).otherwise(members)

    return F.filter(F.flatten(F.transform(docs, expand)), _is_object)


def types(graph_nodes: Column) -> Column:
    """Distinct `@type` names. A list is asked for first: asked for a string, it returns its JSON text."""

    def of(node: Column) -> Column:
        listed = F.try_variant_get(node, "$['@type']", "array<string>")
        raw = F.try_variant_get(node, "$['@type']", "variant")
        single = F.when(F.schema_of_variant(raw) == "STRING", F.variant_get(raw, "$", "string"))
        return F.coalesce(listed, F.array(single))

    return F.array_distinct(
        F.filter(F.flatten(F.transform(graph_nodes, of)), lambda t: t.isNotNull())
    )


def _truthy(value: Column) -> Column:
    """Present and not null, false, zero, '' or an empty list or object."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    empty = (
        (kind == "VOID")
        | (kind == "OBJECT<>")
        | (text.isin("", "[]", "{}") & ((kind == "STRING") & (text == "") | ~(kind == "STRING")))
        | ((kind == "BOOLEAN") & (text == "false"))
        | (
            (kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT"))
            & (F.try_variant_get(value, "$", "double") == 0)
        )
    )
    return value.isNotNull() & ~F.coalesce(empty, F.lit(False))


def _field(node: Column, name: str) -> Column:
    return F.try_variant_get(node, f"$['{name}']", "variant")


def names_author(graph_nodes: Column) -> Column:
    return F.exists(graph_nodes, lambda n: _truthy(_field(n, "author")))


def first_date_modified(graph_nodes: Column) -> Column:
    """First non-empty `dateModified` in document order, as text."""
    dated = F.filter(graph_nodes, lambda n: _truthy(_field(n, "dateModified")))
    return F.try_variant_get(F.try_element_at(dated, F.lit(1)), "$['dateModified']", "string")
