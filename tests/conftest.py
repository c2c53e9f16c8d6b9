from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sitegauge.plans.audit import audit_facts, page_facts  # noqa: E402
from sitegauge.session import build_session  # noqa: E402

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def facts_of(spark):
    """Facts of many pages in one job: {case: row}."""

    def run(cases: dict[str, str], url: str = "https://site.example/page", headers: dict | None = None):
        names = list(cases)
        rows = [(i, url, cases[n], headers or {}) for i, n in enumerate(names)]
        pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, headers map<string,string>")
        return {names[r.page_id]: r for r in page_facts(pages).collect()}

    return run


@pytest.fixture(scope="session")
def signals_from(spark):
    """Signals of pages given by their facts: {case: {signal number: struct}}."""
    defaults = {
        "url": "https://a.example/", "final_url": "https://a.example/", "fetch_note": None, "page_title": "t",
        "origin": "https://a.example", "page_scheme": "https", "canonical_href": None, "viewport_content": None,
        "n_open_graph": 0, "schema_types": [], "n_h1": 0, "n_h2": 0, "has_title": False, "n_dl": 0, "n_table": 0,
        "n_question_h2": 0, "words": 0, "has_region": True, "answer_words": None, "answer_closed": None,
        "has_tldr": False, "bold_first_p": None, "n_lists": 0, "n_authority_links": 0, "n_internal_links": 0,
        "n_external_links": 0, "author_source": None, "n_blockquote": 0, "n_cite": 0, "date_modified": None,
        "last_modified": None, "dated_claim": False, "title_year": False, "llms_verdict": None,
        "probe_status": None, "robots_found": None, "blocked_bots": [],
    }
    schema = (
        "page_id bigint, url string, final_url string, fetch_note string, page_title string, origin string, "
        "page_scheme string, canonical_href string, viewport_content string, n_open_graph int, "
        "schema_types array<string>, n_h1 int, n_h2 int, has_title boolean, n_dl int, n_table int, "
        "n_question_h2 int, words int, has_region boolean, answer_words int, answer_closed boolean, "
        "has_tldr boolean, bold_first_p boolean, n_lists int, n_authority_links int, n_internal_links int, "
        "n_external_links int, author_source string, n_blockquote int, n_cite int, date_modified string, "
        "last_modified string, dated_claim boolean, title_year boolean, llms_verdict string, probe_status int, "
        "robots_found boolean, blocked_bots array<string>"
    )

    def run(cases: dict[str, dict]):
        names = list(cases)
        rows = [tuple([i] + [({**defaults, **cases[n]})[k] for k in defaults]) for i, n in enumerate(names)]
        audit = audit_facts(spark.createDataFrame(rows, schema))
        return {names[r.page_id]: r for r in audit.collect()}

    return run
