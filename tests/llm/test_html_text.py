from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from sitegauge.llm import html_text as ht


@pytest.fixture(scope="module")
def tree():
    return ht.train_tree()


def test_the_tree_fits_its_table_and_held_out_outlines(tree):
    right = []
    for held_out in range(len(ht.OUTLINES)):
        others = tuple(o for i, o in enumerate(ht.OUTLINES) if i != held_out)
        blocks = ht.text_blocks(ht.outline_page(ht.OUTLINES[held_out]))
        got = ht.train_tree(others).predict(ht.block_features(blocks))
        right += (got == [b.label == "1" for b in blocks]).tolist()
    assert np.mean(right) >= 0.9
    every = [b for o in ht.OUTLINES for b in [ht.text_blocks(ht.outline_page(o))]]
    assert all((tree.predict(ht.block_features(b)) == [x.label == "1" for x in b]).all() for b in every)


def test_cart_finds_a_boundary():
    rng = np.random.default_rng(2)
    x = rng.random((300, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 2] < 0.7)).astype(float)
    assert (ht.grow_tree(x, y).predict(x) == (y == 1)).all()


def test_main_text_of_a_page(tree):
    page = """<!DOCTYPE html><html><head><title>Site title</title><style>p{}</style></head><body class="sidebar-left">
    <header><h1>The site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice"><p>We keep crumbs on this device to make things work.</p></div>
    <article><header><h1>Bread &amp; butter</h1></header><p>First <b>line</b>s&nbsp;of
    a   text.<br>Same block.<script>var t = "</p>";</script><!-- <p>no</p> --><p>Unclosed &lt;p&gt; one.
    <div class="ad">Buy this today</div><ul><li>short</li><li><a href="x">a link</a></li></ul>
    <aside><p>Also read the other things we wrote this week.</p></aside>
    <section id="comments"><h2>Replies</h2><p>I liked this very much and will write a long comment about it here.</p></section>
    <form><p>Your address please</p><button>Go</button></form></article>
    <div class="widget"><p>Popular posts of this month are listed here for you.</p></div><footer>&copy; nobody</footer></body></html>"""
    assert ht.main_text(page, tree).split("\n") == [
        "Bread & butter", "First lines of a text. Same block.", "Unclosed <p> one.", "short", "a link"
    ]


def test_pages_without_telling_elements(tree):
    page = "<body><div><a>One</a> <a>Two</a></div><p>" + "word " * 40 + "</p><p>Then a few more words.</p><div><a>Next</a></div><div><a>Last</a></div>"
    assert ht.main_text(page, tree).split("\n") == [("word " * 40).strip(), "Then a few more words."]


def test_random_articles_come_back_whole(tree):
    """Round trip: paragraphs of any length, in an article among boilerplate, are what is extracted."""
    rnd = random.Random(9)
    for _ in range(200):
        paragraphs = [" ".join(rnd.choice(["a", "B&B", "<tag>", "ünï", '"q"']) for _ in range(rnd.randrange(1, 60))) for _ in range(rnd.randrange(1, 12))]
        body = "".join(f"<{t}>{ht.entities.escape(p)}</{t}>" for p in paragraphs for t in [rnd.choice(["p", "h2", "li", "blockquote"])])
        page = f"<nav><a>x</a></nav><div class='ad'>{'buy ' * rnd.randrange(30)}</div><article>{body}</article><footer>end {'of ' * rnd.randrange(20)}</footer>"
        assert ht.main_text(page, tree) == "\n".join(paragraphs)


def test_broken_pages_take_linear_time(tree):
    start = time.time()
    for shape in ("<a x='", "<div><nav>", "</div>", "<!--", "<script>", "<a x=\"'>", "<", "&", "<b ", "<p class=ad", "</p>", "<li>x"):
        ht.main_text(shape * 40_000, tree)
        ht.main_text("<div><section>" * 20_000 + shape * 20_000, tree)
    assert time.time() - start < 60


def test_word_counts_decide(tree):
    """Without names and links, and with hints, it is the words of a block and its neighbours that tell."""
    used = {ht.FEATURES[f] for f in tree.feature if f >= 0}
    assert used & {"words", "words_before", "words_after"} and "zone" in used
    page = "<body><div>One</div><div>Two words</div><h1>The one heading here</h1><p>" + "word " * 50 + "</p><p>" + "more " * 40 + "</p><div>Here it ends</div><div>Last</div><div>So so</div>"
    assert ht.main_text(page, tree).split("\n") == ["The one heading here", ("word " * 50).strip(), ("more " * 40).strip()]


PROBES = {
    "an anchor made of a heading": ("<h2 id='legal-basis'>Legal basis</h2><p>Five words of some text.</p>", ["Legal basis", "Five words of some text."]),
    "a section named by its heading": ("<section id='search-algorithms'><h2>Search</h2><p>How it is done.</p><ul><li>one</li></ul></section>", ["Search", "How it is done.", "one"]),
    "a part named by its heading": ("<div id='form-and-function'><p>Form follows.</p></div>", ["Form follows."]),
    "a class of a page builder": ("<div class='elementor-widget-container'><p>All text is in here.</p></div>", ["All text is in here."]),
    "an apostrophe in a bare value": ("<p title=it's>First text.</p><p>It's the second.</p>", ["First text.", "It's the second."]),
    "a button left open": ("<p>Before.</p><button>Play<p>After the button.</p><p>And on.</p>", ["Before.", "After the button.", "And on."]),
    "two buttons left open": ("<button>Play<p>One text.</p><button>Stop</button><p>Two texts.</p>", ["One text.", "Two texts."]),
    "a button that holds blocks": ("<p>Text.</p><button><div>Play</div> now</button><p>More.</p>", ["Text.", "More."]),
    **{f"{tag} left open": (f"<p>Before.</p><{tag}>gone <b>too</b><p>After it.</p>", ["Before.", "After it."]) for tag in ("select", "svg", "object", "title", "iframe", "math")},
    "a script left open": ("<p>Before.</p><script>x<p>all of it", ["Before."]),
    "reader comments": ("<p>Text.</p><section id='comments'><p>I have read it all and liked it.</p></section>", ["Text."]),
    "side matter inside": ("<p>Text.</p><div class='related-posts'><p>Some other things to read here</p></div><div class='cookie-notice'><p>We keep crumbs.</p></div>", ["Text."]),
    "linked side matter under other names": ("<p>Text of the article.</p><div class='acme-share-row'><ul><li><a>Here</a></li><li><a>There</a></li></ul></div>", ["Text of the article."]),
}


@pytest.mark.parametrize("name", PROBES)
def test_inside_an_article(tree, name):
    body, wanted = PROBES[name]
    page = f"<nav><a href='/'>Home</a></nav><article><h1>A title</h1>{body}</article><footer>the end of it</footer>"
    if "script" in name:
        page = page.replace("</article><footer>the end of it</footer>", "")
    assert ht.main_text(page, tree).split("\n") == ["A title", *wanted]


def test_articles_with_side_words_in_their_names_come_back_whole(tree):
    rnd = random.Random(4)
    words = sorted(ht.SIDE_WORDS)
    for _ in range(300):
        parts, wanted = [], []
        for _ in range(rnd.randrange(1, 8)):
            name = "-".join(rnd.sample([rnd.choice(words), rnd.choice(["theory", "history", "of", "science", "results"]), "x"], 3))
            texts = [" ".join(rnd.choice(["w", "ünï", "B&B"]) for _ in range(rnd.randrange(1, 50))) for _ in range(rnd.randrange(1, 5))]
            tag = rnd.choice(["section", "div"])
            parts.append(f"<{tag} {rnd.choice(['id', 'class'])}='{name}'>" + "".join(f"<p>{ht.entities.escape(t)}</p>" for t in texts) + f"</{tag}>")
            wanted += texts
        assert ht.main_text(f"<article>{''.join(parts)}</article>", tree) == "\n".join(wanted)


def test_open_elements_take_linear_time(tree):
    start = time.time()
    for shape in ("<button>", "<select><p>", "<svg>", "<p title=it's>", "<button><p>x", "<object>x<div>", "<a b=\"", "<a b='c\">"):
        ht.main_text(shape * 40_000, tree)
    assert time.time() - start < 40


def test_given_pages_equal_a_rule(tree):
    """The generated pages hold one article each, without anything beside it inside: its blocks, by plain expressions."""
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        article = re.sub(r"(?is)<script.*?</script>|<!--.*?-->", "", re.search(r"(?s)<article>(.*)</article>", page).group(1))
        parts = re.split(r"</?(?:p|h1|h2|li|ul|div)[^>]*>", article.replace("<br>", " "))
        blocks = (" ".join(ht.entities.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in parts)
        assert ht.main_text(page, tree) == "\n".join(b for b in blocks if b)
