"""Author evidence: which source, if any, names a person. Cases are built from the name grammar."""

from __future__ import annotations

import pytest

from sitegauge.operators.authors import BYLINE_CHARS, BYLINE_TAGS, INTERFACE_WORDS
from sitegauge.plans.queries import QUERIES

REST = "<p>The harbour was quiet all morning.</p>"


def script(json: str) -> str:
    return f'<script type="application/ld+json">{json}</script>{REST}'


# A name is two to four parts; the first is a capital word or an initial.
NAMES = {
    "two words": "Ilse Brandt", "two initials": "T. J. Varga", "inner hyphen": "Lou-Ann Kipkemboi", "inner apostrophe": "Sean D'Arcy",
    "particle inside": "Pia von Arnim", "four parts": "Noor Van Der Berg", "letters beyond ASCII": "Óscar Ĺubica", "no case at all": "李 小龙",
    "inner capital": "Fay McNeil",
}
NO_NAMES = {"one word": "Brandt", "small letters": "ilse brandt", "an initial alone": "I.", "digits": "10 11"}
# What may stand between the words that announce a name and the name.
LEADS = {"by": "By ", "small by": "by ", "written": "Written by ", "small written": "written by ", "colon": "By: ", "tight colon": "By:"}
# What follows a name in a line that is no byline.
PROSE = {"possessive": "'s ledger shows a gap", "curly possessive": "\u2019s ledger shows a gap", "a verb": " sold the boat", "letters": "ish charm"}
NOT_PROSE = {"end": "", "a date": ", 3 May 2031", "a dot": ".", "a bar": " | Harbour desk", "a capital": " Harbour Desk"}

CASES: dict[str, tuple[str, str | None]] = {}
for kind, name in NAMES.items():
    CASES[f"line, {kind}"] = (f"<p>By {name}</p>{REST}", "byline")
    CASES[f"marked, {kind}"] = (f'<i class="author">{name}</i>{REST}', "markup")
for kind, name in NO_NAMES.items():
    CASES[f"line, {kind}"] = (f"<p>By {name}</p>{REST}", None)
    CASES[f"marked, {kind}"] = (f'<i class="author">{name}</i>{REST}', None)
for kind, lead in LEADS.items():
    CASES[f"lead: {kind}"] = (f"<p>{lead}Ilse Brandt</p>{REST}", "byline")
for kind, tail in PROSE.items():
    CASES[f"prose: {kind}"] = (f"<p>By Ilse Brandt{tail}</p>{REST}", None)
for kind, tail in NOT_PROSE.items():
    CASES[f"tail: {kind}"] = (f"<p>By Ilse Brandt{tail}</p>{REST}", "byline")
for tag in BYLINE_TAGS:
    CASES[f"block: {tag}"] = (f"<{tag}>By Ilse Brandt</{tag}>{REST}", None if tag == "header" else "byline")
for tag in ("h1", "h2", "h6", "b", "section", "nav", "footer"):
    CASES[f"no byline block: {tag}"] = (f"<{tag}>By Ilse Brandt</{tag}>{REST}", None)
for mark in ('class="byline"', 'class="x entry-byline y"', 'id="AuthorBox"', 'rel="author"', 'itemprop="author"', 'class="co-author"'):
    CASES[f"mark: {mark}"] = (f"<em {mark}>Ilse Brandt</em>{REST}", "markup")
for mark in ('class="authority"', 'id="authority-list"', 'data-author="x"', 'class="auth or"'):
    CASES[f"no mark: {mark}"] = (f"<em {mark}>Ilse Brandt</em>{REST}", None)
for word in INTERFACE_WORDS[:: len(INTERFACE_WORDS) // 6]:
    CASES[f"interface word: {word}"] = (f'<a rel="author">{word.title()} {INTERFACE_WORDS[0].title()}</a>{REST}', None)
for key in ("name", "property"):
    for value in ("author", "article:author", " AUTHOR "):
        CASES[f"meta {key}={value}"] = (f'<meta {key}="{value}" content="x">{REST}', "meta")
    CASES[f"meta {key}, empty"] = (f'<meta {key}="author" content="\t ">{REST}', None)
    CASES[f"meta {key}, other"] = (f'<meta {key}="authors" content="x">{REST}', None)
for json, names in {
    '{"author":"x"}': True, '{"author":{"@type":"Organization"}}': True, '[{"a":1},{"author":["x"]}]': True, '{"@graph":[{},{"author":"x"}]}': True,
    '{"author":""}': False, '{"author":null}': False, '{"author":{}}': False, '{"author":0}': False, '{"creator":"x"}': False, '{"author"': False,
}.items():
    CASES[f"json {json}"] = (script(json), "jsonld" if names else None)
CASES |= {
    "strongest wins": ('<meta name="author" content="x"><p class="byline">By Ilse Brandt</p><script type="application/ld+json">{"author":"x"}</script>', "jsonld"),
    "meta before markup": ('<p class="byline">By Ilse Brandt</p><meta name="author" content="x">', "meta"),
    "name inside a marked line": (f'<div class="author">on 4 June by Ilse Brandt for the desk</div>{REST}', "markup"),
    "name over several elements": ("<p>By <b>Ilse</b> <u>Brandt</u></p>", "byline"),
    "as long as a byline may be": (f"<p>By Ilse Brandt{' .' * ((BYLINE_CHARS - 14) // 2)}</p>", "byline"),
    "longer than that": (f"<p>By Ilse Brandt{' .' * BYLINE_CHARS}</p>", None),
    "in the middle of a line": ("<p>Told by Ilse Brandt</p>", None),
    "nothing": (REST, None),
}


@pytest.fixture(scope="module")
def rows(facts_of):
    return facts_of({name: html for name, (html, _) in CASES.items()})


@pytest.mark.parametrize("name", CASES)
def test_author_source(rows, name):
    assert rows[name].author_source == CASES[name][1]


def test_candidates_are_judged_whole(spark, tmp_path):
    """What stands past the 24th character decides."""
    name, words = "Read more about our team and Ilse Brandt", "Read more about our team and privacy"
    html = f'<html><body><article><i class="author">{name}</i><i class="byline">{words}</i></article></body></html>'
    rows = [(1, "https://site.example/a", html)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.candidate: r.plausible for r in QUERIES["author_candidate_names"](spark, str(tmp_path)).collect()}
    assert found[name] is True and found[words] is False
