"""Main text of web pages: flat text blocks, features of neighbours, a decision tree."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sitegauge.llm.common import sliced, table, with_columns

# Elements whose text nobody reads, up to their end tag.
HIDDEN = frozenset("script style noscript template svg math iframe object select textarea button title head".split())
# Of these, those that end at the next block where their end tag is missing.
SOFT = frozenset("svg math iframe object select button title".split())
# Elements that hold blocks, and those that start or end one. Others are part of a line.
HOLDERS = frozenset(
    "div section article main nav header footer aside form ul ol dl table tbody thead tfoot tr figure blockquote details "
    "dialog fieldset menu address hgroup search".split()
)
BREAKS = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre hr figcaption caption summary legend body html option center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What surrounds an article, by element and by the words of class, id and role.
SIDE_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
SIDE_WORDS = frozenset(
    "ad ads adv banner nav navbar menu menubar footer header masthead sidebar side aside rail toolbar topbar bottom "
    "cookie cookies consent gdpr notice alert popup modal overlay toast subscribe signup login search form related "
    "share sharing social follow pagination pager widget copyright legal disclaimer reply replies respond feedback "
    "reviews teaser outbrain taboola skip contentinfo complementary navigation dialog".split()
)
SIDE_STARTS = ("comment", "advert", "sponsor", "promo", "breadcrumb", "newsletter", "recommend", "sidebar", "cookie", "disqus", "subscri")
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article main content post entry story articlebody".split())
# Words of a class that name the head of an article rather than of the site, next to one of MAIN_WORDS.
MILD_WORDS = frozenset("header side bottom notice".split())

# Words that say nothing beside one of these: a name made of both only still is a side name.
PLAIN_WORDS = frozenset(
    "box container wrapper wrap block section list area inner outer item items bar left right top main post posts button buttons "
    "panel row slot unit group text title links link icons buttons policy form field".split()
)

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# A quotation mark opens a value only right after an equals sign.
TAG_END = re.compile(r"""(?:[^>"'=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+>""")
BOUNDARY = re.compile(rf"</?(?:{'|'.join(sorted(BREAKS))})(?=[\s/>])", re.I)
NAMING = re.compile(r"""(?:^|\s)(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    """A run of text between block boundaries: its words, those inside links, and where it stands."""

    text: str
    words: int
    linked: int
    zone: int  # 1 inside an article, -1 inside what surrounds one, 0 neither
    heading: bool
    item: bool
    para: bool
    hint: bool  # inside an article, under a name that has a side word among others
    label: str = ""


def _side(word: str) -> bool:
    return word in SIDE_WORDS or word.startswith(SIDE_STARTS)


def zone_of(tag: str, attributes: str, zone: int) -> tuple[int, bool, str]:
    """Zone inside an element, given the one around it, whether its name only hints at a side, and its `data-label` (of samples).

    Outside an article one side word is enough. Inside, a name must be made of such
    words: an id, or one name of a class, with other words in it (`search-algorithms`,
    as anchors are made of headings) is a hint, which the tree weighs.
    """
    names, label = [], ""
    if "=" in attributes:
        for key, *values in NAMING.findall(attributes):
            value = next((v for v in values if v), "")
            if key.lower() == "data-label":
                label = value
            else:
                names += [WORDS.findall(CAMEL.sub(" ", name).lower()) for name in value.split()]
    if tag in ("html", "body"):
        return zone, False, label
    words = {w for name in names for w in name}
    side = {w for w in words if _side(w)}
    main = words & MAIN_WORDS
    if main and side <= MILD_WORDS:
        side = set()
    if tag in SIDE_TAGS or (tag == "header" and zone < 1):
        return -1, False, label
    if side and (zone < 1 or any(any(map(_side, name)) and all(_side(w) or w in PLAIN_WORDS for w in name) for name in names)):
        return -1, False, label
    if tag in MAIN_TAGS or (main and zone == 0):
        return 1, False, label
    return zone, bool(side), label


@dataclass
class _Scan:
    blocks: list[Block] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    stack: list[tuple[str, int, bool, str]] = field(default_factory=list)
    open: dict[str, int] = field(default_factory=dict)
    zone: int = 0
    hint: bool = False
    own: tuple[int, bool] | None = None
    label: str = ""
    tag: str = ""
    linked: bool = False

    def flush(self) -> None:
        parts, self.parts = self.parts, []
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            linked = sum(len(t.split()) for t, in_link in parts if in_link)
            words = text.count(" ") + 1
            zone, hint = (self.zone, self.hint) if self.own is None else self.own
            self.blocks.append(Block(text, words, min(linked, words), zone, self.tag in HEADINGS, self.tag in ("li", "dt", "dd"), self.tag == "p", hint, self.label))
        self.own, self.tag, self.label = None, "", self.stack[-1][3] if self.stack else ""

    def start(self, tag: str, attributes: str) -> None:
        if tag in BREAKS:
            self.flush()
            zone, hint, label = zone_of(tag, attributes, self.zone)
            hint = zone == 1 and (hint or self.hint)
            if tag in HOLDERS:
                self.stack.append((tag, self.zone, self.hint, label or self.label))
                self.open[tag] = self.open.get(tag, 0) + 1
                self.zone, self.hint, self.label = zone, hint, label or self.label
            else:
                self.own, self.tag, self.label = (zone, hint), tag, label or self.label
        elif tag == "a":
            self.linked = True
        elif tag == "br":
            self.parts.append((" ", self.linked))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.linked = False
        elif tag in BREAKS:
            self.flush()
            # An end tag without its start closes nothing; the count keeps that cheap.
            if self.open.get(tag):
                while True:
                    name, self.zone, self.hint, _ = self.stack.pop()
                    self.open[name] -= 1
                    if name == tag:
                        break
                self.label = self.stack[-1][3] if self.stack else ""


def text_blocks(page: str) -> list[Block]:
    """The blocks of a page in order; one pass, linear in its length, whatever is left unclosed."""
    scan, at, n = _Scan(), 0, len(page)
    closers: dict[str, re.Pattern] = {}
    unclosed: set[str] = set()
    while at < n:
        tag_at = page.find("<", at)
        if tag_at < 0:
            tag_at = n
        if tag_at > at:
            chunk = page[at:tag_at]
            scan.parts.append((entities.unescape(chunk) if "&" in chunk else chunk, scan.linked))
        if tag_at >= n:
            break
        if page.startswith("<!--", tag_at):
            close = page.find("-->", tag_at + 4)
            at = n if close < 0 else close + 3
            continue
        closing = page.startswith("/", tag_at + 1)
        name = NAME.match(page, tag_at + 1 + closing)
        if not name:
            if page.startswith(("!", "?", "/"), tag_at + 1):
                close = page.find(">", tag_at)
                at = n if close < 0 else close + 1
            else:
                scan.parts.append(("<", scan.linked))
                at = tag_at + 1
            continue
        end = TAG_END.match(page, name.end())
        stop = end.end() if end else page.find(">", name.end()) + 1
        tag = name.group().lower()
        if not stop:
            # The page is cut inside a tag.
            break
        at = stop
        if closing:
            scan.end(tag)
        elif tag in HIDDEN:
            if page[stop - 2] != "/":
                if tag not in closers:
                    # A page without body tag after its head still goes on after the last thing in it.
                    # Another start of a soft element shows that the end tag of this one is missing.
                    again = rf"|<{tag}(?=[\s>])" if tag in SOFT and tag not in ("svg", "math", "object") else ""
                    closers[tag] = re.compile(r"</head\s*>|(?=<body[\s>])" if tag == "head" else rf"</{tag}\s*>{again}", re.I)
                close = None if tag in unclosed else closers[tag].search(page, stop)
                if close is None:
                    unclosed.add(tag)
                if tag in SOFT and (close is None or page[close.start() + 1] != "/"):
                    close = BOUNDARY.search(page, stop)
                    at = close.start() if close else n
                else:
                    at = close.end() if close else n
        else:
            scan.start(tag, page[name.end() : stop - 1])
    scan.flush()
    return scan.blocks


FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "zone", "heading", "item", "para", "hint")


def block_features(blocks: list[Block]) -> np.ndarray:
    """A row per block: word count and link density of it and its neighbours, zone, heading, list item, paragraph, hint."""
    words = np.array([0, *(b.words for b in blocks), 0], float)
    density = np.array([0, *(b.linked for b in blocks), 0]) / np.maximum(words, 1)
    own = np.array([(b.zone, b.heading, b.item, b.para, b.hint) for b in blocks], float).reshape(-1, 5)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], own])


@dataclass
class Tree:
    """A binary decision tree in arrays: feature and threshold of each node, children, share of main text."""

    feature: list[int]
    threshold: list[float]
    child: list[tuple[int, int]]
    share: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        child, node = np.array(self.child), np.zeros(len(x), np.int64)
        while (inner := feature[node] >= 0).any():
            at = np.flatnonzero(inner)
            right = x[at, feature[node[at]]] > threshold[node[at]]
            node[at] = child[node[at], right.astype(int)]
        return np.array(self.share)[node] >= 0.5


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> Tree:
    """CART with the Gini impurity; the first of equally good splits wins."""
    tree = Tree([], [], [], [])

    def grow(rows: np.ndarray, left: int) -> int:
        node = len(tree.feature)
        own = y[rows]
        tree.feature.append(-1)
        tree.threshold.append(0.0)
        tree.child.append((0, 0))
        tree.share.append(float(own.mean()))
        best = (own.sum() * (len(own) - own.sum()) / len(own) - 1e-9, None)
        for f in range(x.shape[1]) if left and 0 < own.sum() < len(own) else ():
            order = rows[np.argsort(x[rows, f], kind="stable")]
            value, hits = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order) + 1)
            at = np.flatnonzero((value[1:] > value[:-1]) & (n[:-1] >= least) & (n[::-1][1:] >= least))
            if not len(at):
                continue
            a, b = hits[at], hits[-1] - hits[at]
            impurity = a * (n[at] - a) / n[at] + b * (len(order) - n[at] - b) / (len(order) - n[at])
            k = int(impurity.argmin())
            if impurity[k] < best[0]:
                best = (impurity[k], (f, (value[at[k]] + value[at[k] + 1]) / 2))
        if best[1]:
            f, cut = best[1]
            low = x[rows, f] <= cut
            tree.feature[node], tree.threshold[node] = f, cut
            tree.child[node] = (grow(rows[low], left - 1), grow(rows[~low], left - 1))
        return node

    grow(np.arange(len(y)), depth)
    return tree


# The labelled table: outlines of pages, made up for this purpose. A line is a block: where it stands, its element, its
# words, how many of them are links, and whether it is main text. Outlines mix long and short blocks of both kinds.
OUTLINES = (
    """nav li 1 1 0;nav li 2 2 0;nav li 1 1 0;div.ad div 9 0 0;article h1 9 0 1;article p 80 0 1;article p 1 0 1;
    article p 35 3 1;article p 2 0 1;article li 4 0 1;article li 7 1 1;footer div 12 0 0""",
    """header div 3 3 0;nav li 1 1 0;nav li 1 1 0;nav li 3 3 0;main h1 4 0 1;main p 22 0 1;main h2 2 0 1;main p 51 6 1;
    main p 6 6 1;div.related li 6 6 0;div.related li 8 8 0;footer p 30 2 0;footer p 4 4 0""",
    """div.cookie p 24 2 0;div.topbar div 2 2 0;div#content h1 7 0 1;div#content p 60 2 1;div#content p 14 0 1;
    div#content p 3 0 1;section.comments h3 2 0 0;section.comments p 40 0 0;section.comments p 5 0 0;form p 6 0 0;footer p 9 0 0""",
    """body div 2 2 0;body div 3 3 0;body h1 6 0 1;body p 45 1 1;body p 90 4 1;body p 17 0 1;body p 11 0 1;body p 30 0 1;
    body div 3 3 0;body div 4 4 0;body div 2 2 0""",
    """nav li 2 2 0;body h2 5 0 1;body p 25 0 1;body p 38 2 1;body p 12 0 1;body p 55 0 1;body div 5 5 0;body div 2 2 0""",
    """nav li 1 1 0;article h1 12 0 1;article p 5 0 1;article p 150 0 1;aside p 70 0 0;aside li 5 5 0;article p 64 1 1;
    article p 2 0 1;div.ad p 33 0 0;article p 8 0 1;article li 1 0 1;article li 2 0 1;div.newsletter p 18 0 0;footer p 60 0 0""",
    """div.menu li 2 2 0;div.menu li 1 1 0;div.banner p 15 1 0;div.post h1 3 0 1;div.post p 1 0 1;div.post p 44 0 1;
    div.post p 28 28 1;div.post p 9 0 1;div.share li 1 1 0;div.comments p 100 0 0;div.sidebar p 25 0 0;div.sidebar li 4 4 0""",
    """form div 1 0 0;form p 16 0 0;nav li 1 1 0;main p 1 0 1;main p 130 0 1;main li 20 0 1;main li 3 3 1;footer li 2 2 0;footer p 11 0 0""",
    """body div 1 1 0;body div 1 1 0;body div 2 2 0;body p 33 0 1;body p 70 3 1;body h2 3 0 1;body p 18 0 1;body li 13 0 1;
    body li 16 1 1;body p 40 0 1;div.footer p 20 0 0;div.footer p 3 3 0""",
    """body div 2 2 0;body div 3 0 0;body div 2 2 0;body h1 6 0 1;body p 45 1 1;body p 3 0 1;body p 52 2 1;body p 21 0 1;
    body div 4 4 0;body div 6 0 0;body div 3 3 0;body div 5 0 0;body div 2 2 0""",
    """body div 1 1 0;body div 4 0 0;body div 1 1 0;body p 31 0 1;body p 4 0 1;body p 64 0 1;body div 2 2 0;body div 7 0 0;body div 1 1 0""",
    """article h1 4 0 1;article li 1 0 1;article li 3 3 1;article p 2 0 1;article p 1 1 1;article p 3 0 1;article li 5 5 1;
    div.post h2 1 0 1;div.post li 1 0 1;div.post li 2 2 1;footer p 3 0 0;footer div 2 2 0""",
    # Sections of an article whose names have a side word among others, and side matter inside one under such names.
    """nav li 2 2 0;article h1 6 0 1;article p 40 1 1;article/section#search-algorithms h2 3 0 1;article/section#search-algorithms p 55 2 1;
    article/section#search-algorithms p 4 0 1;article/div#form-and-function p 30 0 1;article/div#form-and-function li 3 0 1;
    article/div.acme-share-strip li 1 1 0;article/div.acme-share-strip li 2 2 0;article p 12 0 1;article/div.acme-related-cards li 6 6 0;
    article/div.acme-related-cards li 7 7 0;footer p 20 1 0""",
    """article h1 3 0 1;article h2#legal-basis 2 0 1;article p 2 0 1;article p 70 3 1;article/div.elementor-widget-holder p 25 0 1;
    article/div.elementor-widget-holder p 1 0 1;article/div.elementor-widget-holder p 44 4 1;article/div.acme-promo-line p 4 4 0;footer div 3 0 0""",
    # Pages without telling names and links: only long blocks, and what stands next to them, tell.
    """body div 3 0 0;body div 4 0 0;body div 2 0 0;body h1 6 0 1;body p 60 0 1;body p 41 0 1;body p 35 1 1;body div 2 0 0;body div 5 0 0;body div 3 0 0""",
    """body p 1 0 0;body p 2 0 0;body p 3 0 0;body h1 7 0 1;body div 48 0 1;body div 33 0 1;body h2 4 0 1;body div 75 2 1;body div 4 0 0;body p 1 0 0;body p 3 0 0""",
    """body div 2 0 0;body p 4 0 0;body div 5 0 0;body h1 5 0 1;body p 90 0 1;body li 24 0 1;body li 31 0 1;body div 52 0 1;body div 3 0 0;body p 2 0 0;body div 6 0 0""",
    """body div 2 2 0;body p 40 0 1;body p 5 0 1;body p 52 0 1;body p 6 0 1;body div 1 1 0;body div 1 1 0""",
    """body div 1 1 0;body p 55 2 1;body p 4 0 1;body div 3 3 0;body p 30 0 1;body p 7 0 1;body div 2 2 0""",
    """div.notice p 45 0 0;article h1 1 0 1;article p 3 0 1;article p 4 0 1;article p 1 0 1;aside p 12 0 0;footer p 2 0 0""",
)


def outline_page(outline: str) -> str:
    """A page of filler words from an outline; blocks carry their label as an attribute.

    Where a block stands is an element, or several inside one another (`article/div.x`); its own element may have an id.
    """
    def opened(element: str, more: str = "") -> str:
        tag, mark, name = re.match(r"(\w+)([.#]?)([\w-]*)", element).groups()
        key = {".": "class", "#": "id"}.get(mark)
        return f"<{tag} {key}='{name}'{more}>" if key else f"<{tag}{more}>"

    tag_of = lambda element: re.match(r"\w+", element).group()
    page, path = [], []
    for line in outline.split(";"):
        where, element, words, linked, label = line.split()
        wanted = [e for e in where.split("/") if e != "body"]
        same = next((i for i, (x, y) in enumerate(zip(path, wanted)) if x != y), min(len(path), len(wanted)))
        page += [f"</{tag_of(e)}>" for e in reversed(path[same:])] + [opened(e) for e in wanted[same:]]
        path = wanted
        links = f"<a href='/'>{' '.join(['there'] * int(linked))}</a> " if int(linked) else ""
        more = f" data-label='{label}'"
        page.append(f"{opened(element, more)}{links}{' '.join(['word'] * (int(words) - int(linked)))}</{tag_of(element)}>")
    return "<body>" + "".join(page)


def train_tree(outlines: tuple[str, ...] = OUTLINES) -> Tree:
    """The tree of the labelled table: about a hundred blocks."""
    pages = [text_blocks(outline_page(o)) for o in outlines]
    x = np.concatenate([block_features(blocks) for blocks in pages])
    return grow_tree(x, np.array([b.label == "1" for blocks in pages for b in blocks], float))


def main_text(page: str, tree: Tree) -> str:
    blocks = text_blocks(page)
    if not blocks:
        return ""
    keep = tree.predict(block_features(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_text(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Adds `text` (main text) and `n_chars` (its code points) to every page.

    A page is read once from left to right into flat blocks: text between block
    boundaries, character references decoded, white space folded to one blank. A
    block's features are the word count and link density of itself and its two
    neighbours, whether the innermost telling element around it belongs to an
    article or to what surrounds one, and whether a name inside an article hints at the latter. A decision tree, grown on a small labelled
    table of blocks, keeps or drops it; kept blocks are joined by line feeds.

    Scale: one narrow pass, linear in the page's length; a tree of some tens of
    nodes travels with the task.

    Null and empty pages have empty text; unclosed elements, comments and cut pages
    end where the page does; equal rows give equal results; an empty table gives no
    rows; other columns stay (those named like a result are replaced).
    """
    tree = train_tree() if tree is None else tree
    base = pages.drop("text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = pa.array([main_text(p or "", tree) for p in batch.column("html").to_pylist()], pa.string())
            count = pc.utf8_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts, count], [*batch.schema.names, "text", "n_chars"])

    return base.mapInArrow(run, with_columns(base, "text string, n_chars bigint"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages").select("page_id", "url", "html")).drop("html")
