"""HTML text -> element and text arrays, the one Python stage of an audit.

Everything downstream is JVM expressions over these arrays. The helper stays a
tokenizer plus a stack: it records what the markup says and judges nothing.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.schema import ATTRIBUTES_READ, BOILERPLATE_TAGS, DOM

# Executors need not have this package installed: the helper travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ATTR = r"""[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
_TOKEN = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/=]++|" + _ATTR + r")*+)(?:>|\Z)"
)
_WORDS = re.compile(r"\w+")
_ATTRS = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+""")

# Bytes of markup parsed before their arrays are handed over: bounds a task's memory, whatever Arrow batches hold.
SLICE_BYTES = 1_000_000

# --- fixed values: how tag soup nests -----------------------------------------
_VOID = frozenset(
    "area base basefont br col embed frame hr img input isindex link meta param source track wbr".split()
)
_RAW = {
    tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE)
    for tag in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
}
_ENTITY_FREE = frozenset(("script", "style", "xmp", "iframe", "noembed", "noframes"))
_INERT = frozenset(("script", "style", "template", "rt", "rp"))
_HEAD_ONLY = frozenset(("script", "style", "meta", "link", "title", "base"))
_BLOCKS = frozenset(
    "address blockquote center dd dir div dl dt fieldset form h1 h2 h3 h4 h5 h6 hr li listing menu ol p pre table "
    "tbody td tfoot th thead tr ul xmp".split()
)
_HEADING_ENDERS = frozenset(("fieldset", "form", "li", "p", "table"))
# open tag -> start tags that end it
_ENDED_BY = {
    "p": _BLOCKS,
    "li": frozenset(("li",)),
    "dt": frozenset(("dd", "dt")),
    "dd": frozenset(("dd", "dt")),
    "a": frozenset(("a",)),
    "option": frozenset(("optgroup", "option")),
    "tr": frozenset(("tbody", "tfoot", "thead", "tr")),
    "td": frozenset(("tbody", "td", "tfoot", "th", "thead", "tr")),
    "th": frozenset(("tbody", "td", "tfoot", "th", "thead", "tr")),
    "thead": frozenset(("tbody", "tfoot")),
    "tbody": frozenset(("tbody", "tfoot")),
    "tfoot": frozenset(("tbody",)),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), _HEADING_ENDERS),
    **dict.fromkeys(("b", "big", "i", "s", "small", "strike", "tt", "u"), frozenset(("p",))),
}
# An end tag cannot reach past an open element of higher rank.
_RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "tbody": 180, "tfoot": 180, "thead": 180, "table": 190}
_RANKS = tuple(sorted(set(_RANK.values())))


class _Batch:
    """Column buffers of one slice of pages."""

    def __init__(self, keep: frozenset[str], boilerplate: frozenset[str]):
        self.keep, self.boilerplate = keep, boilerplate
        self.page_offsets, self.text_offsets, self.attr_offsets = [0], [0], [0]
        self.eid, self.end, self.parent, self.tag, self.boiler = [], [], [], [], []
        self.t_from, self.t_to, self.t_chars = [], [], []
        self.attr_keys, self.attr_values = [], []
        self.pos, self.text, self.words, self.inert, self.hidden = [], [], [], [], []

    def add(self, html: str) -> None:
        text_base = len(self.text)
        number = 0  # running number shared by elements and text nodes
        shown = shown_chars = 0  # visible text nodes so far and their total length
        stack: list[tuple] = []  # (row, tag, boilerplate, inert, shown, shown_chars)
        opened: dict[str, list[int]] = {}  # stack depths of the open elements of a tag
        ranked: dict[int, list[int]] = {r: [] for r in _RANKS}  # and of a rank
        head_seen = body_seen = False

        def push(tag: str, attrs: str = "", void: bool = False) -> None:
            nonlocal number
            _, _, boiler, inert, _, _ = stack[-1] if stack else (0, "", False, False, 0, 0)
            boiler = boiler or tag in self.boilerplate
            row = len(self.eid)
            self.parent.append(self.eid[stack[-1][0]] if stack else -1)
            self.eid.append(number)
            self.end.append(number)
            self.tag.append(tag)
            self.boiler.append(boiler)
            here = len(self.text) - text_base
            self.t_from.append(here)
            self.t_to.append(here)
            self.t_chars.append(0)
            if attrs:
                seen = set()
                for name, value in _ATTRS.findall(attrs):
                    name = name.lower()
                    if name in self.keep and name not in seen:
                        seen.add(name)
                        if value[:1] in ("'", '"'):
                            value = value[1:-1]
                        self.attr_keys.append(name)
                        self.attr_values.append(unescape(value) if "&" in value else value)
            self.attr_offsets.append(len(self.attr_keys))
            number += 1
            if not void:
                opened.setdefault(tag, []).append(len(stack))
                if tag in _RANK:
                    ranked[_RANK[tag]].append(len(stack))
                stack.append((row, tag, boiler, inert or tag in _INERT, shown, shown_chars))

        def pop() -> None:
            row, tag, _, _, n0, c0 = stack.pop()
            opened[tag].pop()
            if tag in _RANK:
                ranked[_RANK[tag]].pop()
            self.end[row] = number - 1
            self.t_to[row] = len(self.text) - text_base
            self.t_chars[row] = shown_chars - c0 + max(shown - n0 - 1, 0)

        def open_body() -> None:
            nonlocal head_seen, body_seen
            while stack and stack[-1][1] != "html":
                pop()
            if not stack:
                push("html")
            head_seen = body_seen = True
            push("body")

        def add_text(raw: str, decode: bool = True) -> None:
            nonlocal number, shown, shown_chars
            text = (unescape(raw) if decode and "&" in raw else raw).strip()
            if not text:
                return
            if not body_seen and (not stack or stack[-1][1] in ("html", "head")):
                open_body()
                push("p")
            _, _, boiler, inert, _, _ = stack[-1]
            self.pos.append(number)
            self.text.append(text)
            self.words.append(0 if inert else len(_WORDS.findall(text)))
            self.inert.append(inert)
            self.hidden.append(boiler or inert)
            number += 1
            if not (boiler or inert):
                shown += 1
                shown_chars += len(text)

        at, size = 0, len(html)
        while at < size:
            token = _TOKEN.search(html, at)
            if token is None:
                add_text(html[at:])
                break
            if token.start() > at:
                add_text(html[at : token.start()])
            at = token.end()
            closing, tag, attrs = token.group(1, 2, 3)
            if tag is None:  # comment, doctype or processing instruction
                continue
            tag = tag.lower()
            if closing:
                if tag in ("html", "body") or not opened.get(tag):
                    continue
                # Close the nearest one, unless an element of higher rank was opened after it.
                rank, depth = _RANK.get(tag, 100), opened[tag][-1]
                if not any(ranked[r] and ranked[r][-1] > depth for r in _RANKS if r > rank):
                    while len(stack) > depth:
                        pop()
                continue
            if tag == "html":
                if not stack:
                    push("html", attrs)
                continue
            if not stack:
                push("html")
            if tag == "head":
                if not head_seen and not body_seen:
                    head_seen = True
                    push("head", attrs)
                continue
            if tag == "body":
                if not body_seen:
                    while stack[-1][1] != "html":
                        pop()
                    head_seen = body_seen = True
                    push("body", attrs)
                continue
            if not body_seen and stack[-1][1] in ("html", "head"):
                if tag in _HEAD_ONLY or (tag == "noscript" and stack[-1][1] == "head"):
                    if not head_seen:
                        head_seen = True
                        push("head")
                elif tag not in ("frameset", "frame", "noframes"):
                    open_body()
            while stack[-1][1] in _ENDED_BY and tag in _ENDED_BY[stack[-1][1]]:
                pop()
            if tag in _VOID:
                push(tag, attrs, void=True)
                continue
            push(tag, attrs)
            if tag in _RAW:
                end = _RAW[tag].search(html, at)
                stop = end.start() if end else size
                # Script and style sheets are never read as text, bar JSON-LD.
                if tag not in ("script", "style") or "ld+json" in attrs:
                    add_text(html[at:stop], tag not in _ENTITY_FREE)
                pop()
                close = html.find(">", stop)
                at = size if close < 0 else close + 1
        while stack:
            pop()
        self.page_offsets.append(len(self.eid))
        self.text_offsets.append(len(self.text))

    def to_arrow(self, nulls: list[bool]) -> pa.StructArray:
        i32 = pa.int32()
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_offsets, i32),
            pa.array(self.attr_keys, pa.string()),
            pa.array(self.attr_values, pa.string()),
        )
        elements = pa.StructArray.from_arrays(
            [
                pa.array(self.eid, i32),
                pa.array(self.end, i32),
                pa.array(self.parent, i32),
                pa.array(self.tag, pa.string()),
                attrs,
                pa.array(self.boiler, pa.bool_()),
                pa.array(self.t_from, i32),
                pa.array(self.t_to, i32),
                pa.array(self.t_chars, i32),
            ],
            names=DOM["elements"].dataType.elementType.names,
        )
        texts = pa.StructArray.from_arrays(
            [
                pa.array(self.pos, i32),
                pa.array(self.text, pa.string()),
                pa.array(self.words, i32),
                pa.array(self.inert, pa.bool_()),
                pa.array(self.hidden, pa.bool_()),
            ],
            names=DOM["texts"].dataType.elementType.names,
        )
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(self.page_offsets, i32), elements),
                pa.ListArray.from_arrays(pa.array(self.text_offsets, i32), texts),
            ],
            names=DOM.names,
            mask=pa.array(nulls, pa.bool_()),
        )


def _slices(pages: pa.Array) -> Iterator[pa.Array]:
    """`pages` cut into runs of about `SLICE_BYTES`; a longer page is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(pages), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(pages):
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
        yield pages.slice(start, stop - start)
        start = stop


def parse_html(
    html: Column | str,
    keep_attributes: tuple[str, ...] = ATTRIBUTES_READ,
    boilerplate_tags: tuple[str, ...] = BOILERPLATE_TAGS,
) -> Column:
    """Parse an HTML column into `DOM` structs (NULL stays NULL).

    Marked non-deterministic so that Catalyst evaluates it exactly once: a
    filter on a score must not be pushed down as a second parse of every page.
    """
    keep, boilerplate = frozenset(keep_attributes), frozenset(boilerplate_tags)

    @F.arrow_udf(DOM)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            for some in _slices(pages):
                batch, nulls = _Batch(keep, boilerplate), []
                for page in some:
                    text = page.as_py()
                    nulls.append(text is None)
                    batch.add(text or "")
                yield batch.to_arrow(nulls)

    return parse.asNondeterministic()(html)
