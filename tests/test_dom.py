"""The parse stage: nesting, text nodes and their numbering."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitegauge.functions import dom
from sitegauge.functions.dom import parse_html
from sitegauge.operators import elements as el
from sitegauge.schema import ATTRIBUTES_READ, BOILERPLATE_TAGS


def parse(html: str):
    """Elements and texts of one page as plain tuples."""
    batch = dom._Batch(frozenset(ATTRIBUTES_READ), frozenset(BOILERPLATE_TAGS))
    batch.add(html)
    parent_tag = dict(zip(batch.eid, batch.tag))
    elements = [
        (tag, parent_tag.get(parent)) for tag, parent in zip(batch.tag, batch.parent)
    ]
    return elements, list(zip(batch.text, batch.hidden))


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p>one<p>two", [("html", None), ("body", "html"), ("p", "body"), ("p", "body")]),
        ("<p><b>bold<br><p>next", [("html", None), ("body", "html"), ("p", "body"), ("b", "p"), ("br", "b"), ("p", "body")]),
        ("<ul><li>a<li>b</ul>", [("html", None), ("body", "html"), ("ul", "body"), ("li", "ul"), ("li", "ul")]),
        ("<p>x<div>y</div>", [("html", None), ("body", "html"), ("p", "body"), ("div", "body")]),
        ("<dl><dt>a<dd>b<dt>c</dl>", [("html", None), ("body", "html"), ("dl", "body"), ("dt", "dl"), ("dd", "dl"), ("dt", "dl")]),
        ("<table><tr><td>a<td>b<tr><td>c</table>",
         [("html", None), ("body", "html"), ("table", "body"), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr")]),
        ("<title>t</title><meta name=x><p>a", [("html", None), ("head", "html"), ("title", "head"), ("meta", "head"), ("body", "html"), ("p", "body")]),
        ("plain words", [("html", None), ("body", "html"), ("p", "body")]),
        ("<div>a</span>b</div>", [("html", None), ("body", "html"), ("div", "body")]),
        ("<DIV><Br/></DIV>", [("html", None), ("body", "html"), ("div", "body"), ("br", "div")]),
        ("<div><b><td></b></div>", [("html", None), ("body", "html"), ("div", "body"), ("b", "div"), ("td", "b")]),
        ("", []),
    ],
)
def test_tag_soup_nesting(html, expected):
    assert parse(html)[0] == expected


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p>a<b>b</b> c</p>", ["a", "b", "c"]),
        ("<p>left<!-- note -->right</p>", ["left", "right"]),
        ("<p>1 &lt; 2 &amp;&nbsp;</p>", ["1 < 2 &"]),
        ("<p>a < b and c > d</p>", ["a < b and c > d"]),
        ("<script>var x = '</p>';</script><p>text</p>", ["text"]),
        ("<textarea><p>raw</textarea>", ["<p>raw"]),
        ("<p title='a > b'>quoted</p>", ["quoted"]),
        ('<p title="open>still text</p>', ["still text"]),
        ("<p>unclosed <!-- comment", ["unclosed"]),
        ("<![CDATA[x]]><p>y</p>", ["y"]),
    ],
)
def test_text_nodes(html, expected):
    assert [text for text, hidden in parse(html)[1] if not hidden] == expected


def test_boilerplate_and_inert_text_is_hidden():
    html = "<nav>menu</nav><header><p>top</p></header><p>body<template>later</template><ruby>漢<rt>kan</rt></ruby></p><footer>end</footer>"
    assert [t for t, hidden in parse(html)[1] if not hidden] == ["body", "漢"]


def test_long_and_broken_pages_parse_in_linear_time():
    deep = "<div>" * 20_000 + "x" + "</span>" * 20_000 + "<a b=\"" * 20_000 + "<" * 20_000
    elements, texts = parse(deep)
    assert len(elements) >= 20_002 and texts[0] == ("x", False)


def test_first_of_repeated_attributes_wins():
    batch = dom._Batch(frozenset(("href", "class")), frozenset())
    batch.add("<a href=/one HREF='/two' data-x=3 class=\"c &amp; d\">x</a>")
    assert dict(zip(batch.attr_keys, batch.attr_values)) == {"href": "/one", "class": "c & d"}


class _Reference(HTMLParser):
    """Nesting and text of well-formed markup, by the standard library."""

    def __init__(self):
        super().__init__()
        self.stack, self.elements, self.texts = [], [], []

    def handle_starttag(self, tag, attrs):
        self.elements.append((tag, self.stack[-1] if self.stack else None))
        self.stack.append(tag)

    def handle_endtag(self, tag):
        assert self.stack.pop() == tag

    def handle_data(self, data):
        if data.strip():
            self.texts.append(data.strip())


_TREE = st.recursive(
    st.sampled_from(["word", "two words", "a &amp; b", ""]),
    lambda kids: st.tuples(st.sampled_from(["div", "section", "span", "em", "article", "strong"]), st.lists(kids, max_size=4)),
    max_leaves=25,
)


def _markup(node) -> str:
    if isinstance(node, str):
        return node + " "
    return f"<{node[0]}>{''.join(map(_markup, node[1]))}</{node[0]}>"


@settings(max_examples=150, deadline=None)
@given(st.lists(_TREE, max_size=5))
def test_well_formed_pages_match_the_standard_parser(forest):
    html = "<html><body><div>" + "".join(map(_markup, forest)) + "</div></body></html>"
    reference = _Reference()
    reference.feed(html)
    elements, texts = parse(html)
    assert elements == reference.elements
    # The standard parser may cut one run of text in two; compare the words.
    assert " ".join(t for t, _ in texts).split() == " ".join(reference.texts).split()


def test_numbering_and_text_spans(spark):
    html = "<article><p>one <b>two</b></p><div><p>three</p>tail</div></article>"
    frame = spark.createDataFrame([(html,), (None,)], "html string").select(parse_html("html").alias("dom"))
    assert frame.where("dom IS NULL").count() == 1
    rows = (
        frame.where("dom IS NOT NULL")
        .select(F.col("dom.texts").alias("texts"), F.explode("dom.elements").alias("e"))
        .select(
            "e.tag", "e.eid", "e.end_eid", "e.text_chars",
            el.spaced_text(F.col("texts"), F.col("e")).alias("spaced"),
            el.glued_text(F.col("texts"), F.col("e")).alias("glued"),
        )
        .collect()
    )
    by_tag = {r.tag: r for r in rows}
    assert by_tag["article"].spaced == "one two three tail"
    assert [r.glued for r in rows if r.tag == "p"] == ["onetwo", "three"]
    for row in rows:
        assert row.text_chars == len(row.spaced)
        assert row.eid <= row.end_eid
    assert by_tag["article"].eid < by_tag["b"].eid <= by_tag["article"].end_eid


SHAPES = {
    "stray end tags behind a table": lambda n: "<x><table>" + "<span>" * n + "</x>" * n,
    "stray end tags behind cells": lambda n: "<b>" + "<table><tr><td>" * n + "</b>" * n,
    "mis-nested tables": lambda n: "<table><tr><td><div></table>" * n,
    "unclosed quotes": lambda n: "<a href='" * n,
    "attribute flood": lambda n: "<p " + "a=1 " * n + ">",
    "open inline elements": lambda n: "<i>" * n + "</b>" * n,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_time_grows_with_the_page(shape):
    """Eight times the page takes about eight times as long, not sixty-four."""
    def seconds(n: int) -> float:
        page, start = SHAPES[shape](n), time.perf_counter()
        dom._Batch(frozenset(("href",)), frozenset(("nav",))).add(page)
        return time.perf_counter() - start

    seconds(2_500)
    assert seconds(20_000) < 20 * max(min(seconds(2_500) for _ in range(3)), 0.01)


def test_a_large_arrow_batch_is_parsed_in_slices(spark):
    """Whatever an Arrow batch holds, a task works on a bounded run of pages; no row is lost, doubled or moved."""
    pages = [None, "", "<p>short</p>", "<p>" + "x" * (dom.SLICE_BYTES + 1), None, *[f"<p>page {i} " + "word " * 40_000 for i in range(30)], None]
    array = pa.array(["cut off", *pages])[1:]
    parts = list(dom._slices(array))
    assert [p for part in parts for p in part.to_pylist()] == pages
    assert all(len(part) == 1 or sum(len(p or "") for p in part.to_pylist()) <= dom.SLICE_BYTES for part in parts)
    assert len(parts) >= 8 and not list(dom._slices(pa.array([], pa.string())))
    frame = spark.createDataFrame(list(enumerate(pages)), "i int, html string").coalesce(1)
    got = {r.i: (r.n, r.t) for r in frame.withColumn("dom", parse_html("html")).select("i", F.size("dom.elements").alias("n"), F.substring(F.get("dom.texts", F.lit(0))["text"], 1, 7).alias("t")).collect()}
    assert {i for i, (n, _) in got.items() if n is None or n < 0} == {i for i, p in enumerate(pages) if p is None}
    assert [got[5 + i][1].strip() for i in range(30)] == [f"page {i}" for i in range(30)]
