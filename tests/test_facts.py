"""Page facts from markup, one job for all cases."""

from __future__ import annotations

import pytest

WORDS20 = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"

# case: (html, fact, value)
CASES = {
    "canonical first link decides": ('<link rel=canonical><link rel=canonical href="/x">', "canonical_href", None),
    "canonical token list": ('<link rel="shortlink canonical" href="/x">', "canonical_href", "/x"),
    "canonical by exact token": ('<link rel="Canonical" href="/x">', "canonical_href", None),
    "viewport": ('<meta name="viewport" content="w">', "viewport_content", "w"),
    "open graph duplicates count": ('<meta property="og:a"><meta property="og:a"><meta property="xog:b">', "n_open_graph", 2),
    "aria heading counts twice on h1": ('<h1 role="heading" aria-level="1">x</h1>', "n_h1", 2),
    "aria level two": ('<h2>x</h2><div role="heading" aria-level="2">y</div>', "n_h2", 2),
    "title in pruned header is gone": ("<body><header><title>x</title></header>", "has_title", False),
    "question glued": ("<h2>Is it <b>so?</b></h2><h2>no</h2><h2>eh ?</h2>", "n_question_h2", 2),
    "words skip boilerplate": ("<title>my title</title><nav>a b c</nav><p>don't stop_now 3.5</p>", "words", 7),
    "words across inline markup": ("<p>ab<b>cd</b></p>", "words", 2),
    "unicode words": ("<p>naïve 王小明 straße x² </p>", "words", 4),
    "combining marks split words": ("<p>हिन्दी</p>", "words", 3),
    "region": ("<main><p>x</p></main>", "has_region", True),
    "no region": ("", "has_region", False),
    "article beats earlier main": (f"<main><p>{WORDS20}.</p></main><article><p>short</p></article>", "answer_words", None),
    "first answer skips short ones": (f"<article><p>too short</p><p>{WORDS20}.</p></article>", "answer_words", 20),
    "answer glues inline words": ("<article><p>a<b>b</b> c d e f g h i j</p></article>", "answer_words", 8),
    "answer closed": (f"<article><p>{WORDS20}!</p></article>", "answer_closed", True),
    "answer open": (f"<article><p>{WORDS20}</p></article>", "answer_closed", False),
    "tldr": ("<p>TL;DR yes</p>", "has_tldr", True),
    "summary as part of a word": ("<p>summaryless</p>", "has_tldr", False),
    "summary beyond the top": (f"<p>{'x' * 2000} in short</p>", "has_tldr", False),
    "summary at the edge": (f"<p>{'x' * 1991} in short</p>", "has_tldr", True),
    "bold": ("<article><p>a <strong>b</strong></p></article>", "bold_first_p", True),
    "bold in the second p": ("<article><p>a</p><p><b>b</b></p></article>", "bold_first_p", False),
    "no paragraph": ("<article>text</article>", "bold_first_p", None),
    "lists": ("<ul></ul><ol></ol><nav><ul></ul></nav>", "n_lists", 2),
    "authority suffixes": (
        '<a href="https://x.gov/a"></a><a href="http://notwikipedia.org"></a><a href="https://a.edu:443/"></a>'
        '<a href="HTTPS://b.gov"></a><a href="https://c.ac.uk"></a>', "n_authority_links", 3),
    "internal links": (
        '<a href="/a"></a><a href="//cdn/x"></a><a href="rel.html"></a><a href="#f"></a><a href="https://SITE.example/b"></a>',
        "n_internal_links", 2),
    "external links": (
        '<a href="https://other.example"></a><a href="http:nohost"></a><a href="https://[bad/"></a>'
        '<a href="https://site.example/x"></a><a href="https://[::1]/"></a>', "n_external_links", 3),
    "links in nav do not count": ('<nav><a href="/a"></a></nav>', "n_internal_links", 0),
    "article types": ('<script type="application/ld+json">{"@graph":[{"@type":["A","B"]},{"@type":"A"},7]}</script>', "schema_types", ["A", "B"]),
    "types of an array": ('<script type="application/ld+json">[{"@type":"HowTo"},3,[]]</script>', "schema_types", ["HowTo"]),
    "bad json": ('<script type="application/ld+json">{"@type":</script>', "schema_types", []),
    "graph that is no list": ('<script type="application/ld+json">{"@type":"X","@graph":{"@type":"Y"}}</script>', "schema_types", []),
    "other script type": ('<script type="text/json">{"@type":"X"}</script>', "schema_types", []),
    "script in the footer still counts": ('<footer><script type="application/ld+json">{"@type":"X"}</script></footer>', "schema_types", ["X"]),
    "duplicate keys keep the last": ('<script type="application/ld+json">{"@type":"X","@type":"Y"}</script>', "schema_types", ["Y"]),
    "bare NaN is a number": ('<script type="application/ld+json">{"@type":"X","v":NaN,"w":[-Infinity, Infinity]}</script>', "schema_types", ["X"]),
    "NaN inside strings stays": (r'<script type="application/ld+json">{"@type":["NaN","a \"Infinity\" b"],"v":NaN}</script>', "schema_types", ["NaN", 'a "Infinity" b']),
    "NaN is no type": ('<script type="application/ld+json">{"@type":NaN}</script>', "schema_types", []),
    "a NaN author is there": ('<script type="application/ld+json">{"@type":"X","author":NaN}</script>', "author_source", "jsonld"),
    "a broken document with NaN": ('<script type="application/ld+json">{"@type":"X","v":xNaN}</script>', "schema_types", []),
    "an open string with NaN": ('<script type="application/ld+json">{"@type":"X","v":"NaN}</script>', "schema_types", []),
    "a long string beside NaN": (f'<script type="application/ld+json">{{"@type":"X","v":NaN,"t":"{"word " * 20_000}"}}</script>', "schema_types", ["X"]),
    "date modified": ('<script type="application/ld+json">[{"dateModified":""},{"dateModified":"2025-01-02"},{"dateModified":"2026"}]</script>', "date_modified", "2025-01-02"),
    "dated": ("<p>As of  March it holds.</p>", "dated_claim", True),
    "dated by year across nodes": ("<p>since</p><p>2025</p>", "dated_claim", True),
    "dated too early": ("<p>in 2019</p>", "dated_claim", False),
    "dated inside a word": ("<p>begin 2025 and in 20255</p>", "dated_claim", False),
    "dated needs a separate lead": ("<p>updated in May</p>", "dated_claim", True),
    "year in h1 only when first": ("<title>x 2025</title><h1>none</h1>", "title_year", False),
    "year in title": ("<title>x 2025</title>", "title_year", True),
    "year glued to a word": ("<h1>x2025</h1>", "title_year", False),
    "cites": ("<cite>x</cite><blockquote>y</blockquote>", "n_cite", 1),
    "page title before pruning": ("<header><title> In <b>header</b> </title></header>", "page_title", "In <b>header</b>"),
    "no title": ("<p>x</p>", "page_title", None),
}


@pytest.fixture(scope="module")
def rows(facts_of):
    return facts_of({name: html for name, (html, _, _) in CASES.items()})


@pytest.mark.parametrize("name", CASES)
def test_fact(rows, name):
    _, fact, expected = CASES[name]
    assert rows[name][fact] == expected


def test_headers_are_case_insensitive(facts_of):
    row = facts_of({"x": "<p>a</p>"}, headers={"LAST-Modified": "Tue"})["x"]
    assert row.last_modified == "Tue"


def test_client_rendered_pages(spark, tmp_path):
    """Three scripts or more, under three paragraphs and under 200 words: only then is a page built in the browser."""
    def page(scripts, paragraphs, words):
        return "<script></script>" * scripts + "<p>x</p>" * paragraphs + f"<div>{'w ' * (words - paragraphs)}</div>"

    cases = {(s, p, w): s >= 3 and p < 3 and w < 200 for s in (2, 3, 9) for p in (0, 2, 3) for w in (5, 199, 200)}
    rows = [(i, f"https://a.test/{i}", page(*case)) for i, case in enumerate(cases)]
    from sitegauge.plans import queries

    plain = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    arrays = queries.plan.page_arrays(queries.plan.parsed_pages(plain))
    got = {r.page_id: r.js_rendered for r in queries.rendered_in_browser(arrays).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and True in got.values()
