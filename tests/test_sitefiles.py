"""llms.txt verdicts, the markup sniff and robots.txt groups."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitegauge.functions.urls import origin
from sitegauge.operators.sitefiles import blocked_bots, looks_like_html, pivot_site_files, site_verdicts, site_versions
from sitegauge.plans.audit import attach_site_evidence
from sitegauge.schema import AI_CRAWLERS, SITE_FILE

NOTES = "# Ferry times\n\n- winter: hourly until dusk\n- summer: every half hour\n"
MARKUP = "<html><body><main>Ferries leave from the old pier, tickets on board</main></body></html>"
PLAIN, HTML = "text/plain", "text/html; charset=latin1"
OK_PROBE = (404, PLAIN, "")


def site(llms, probe, hops=0):
    """(status, type, body) of llms.txt and of the probe."""
    return llms, probe, hops


# A good file meets every probe status of a class; then every way evidence can lack.
LLMS = [
    *((site((200, PLAIN, NOTES), (s, PLAIN, "")), "pass_absence") for s in (404, 410)),
    *((site((200, PLAIN, NOTES), (s, HTML, "")), "waf") for s in (400, 402, 405, 409, 411, 451, 500, 504, 599, 600)),
    *((site((200, PLAIN, NOTES), (s, HTML, ""), h), v) for s in (300, 308, 399) for h, v in ((0, "pass_direct"), (None, "unverified"), (3, "redirect_ambiguous"))),
    *((site((200, PLAIN, NOTES), (s, PLAIN, "")), "unexpected") for s in (100, 199)),
    *((site((200, PLAIN, NOTES), (s, t, b)), v) for s in (200, 204, 299) for t, b, v in (
        (HTML, "", "pass_html_shell"), ("TEXT/HTML", "plain", "pass_html_shell"), (PLAIN, "\n\t<p>", "pass_html_shell"), (PLAIN, "fine", "catch_all"), ("", "", "catch_all"),
        (None, MARKUP, "unverified"), (HTML, None, "unverified"), (None, None, "unverified"))),
    *((site((200, PLAIN, NOTES), (s, t, b)), v) for s, good in ((404, "pass_absence"), (301, "pass_direct"), (503, "waf")) for t, b, v in (
        (PLAIN, None, good), (HTML, None, good), (PLAIN, "<p>x", good), (None, None, "unverified"), (None, "<p>x", "unverified"), (None, "x", "unverified"))),
    (site((200, PLAIN, NOTES), (None, PLAIN, "")), "unverified"),
    *((site((s, PLAIN, NOTES), OK_PROBE), "absent") for s in (None, 201, 204, 301, 404, 500)),
    *((site((200, PLAIN, "y" * n), OK_PROBE), v) for n, v in ((0, "absent"), (50, "absent"), (51, "pass_absence"))),
    (site((200, PLAIN, None), OK_PROBE), "absent"),
    *((site((200, t, NOTES), OK_PROBE), v) for t, v in (
        (None, "pass_absence"), ("", "pass_absence"), ("TEXT/x-notes", "pass_absence"), ("image/png", "bad_type"), ("application/json", "bad_type"), (HTML, "html_fallback"))),
    *((site((200, PLAIN, lead + MARKUP), OK_PROBE), "html_fallback") for lead in ("", "\ufeff", " \t\r\n\f\x0b")),
    (site((200, PLAIN, NOTES + MARKUP), OK_PROBE), "pass_absence"),
]


def test_llms_verdicts(spark):
    rows = []
    for i, ((llms, probe, hops), _) in enumerate(LLMS):
        rows += [(f"https://s{i}.test", "llms", *llms, hops), (f"https://s{i}.test", "probe", *probe, 0)]
    verdicts = site_verdicts(spark.createDataFrame(rows, SITE_FILE)).collect()
    got = {r.origin: r.llms_verdict for r in verdicts}
    wrong = [(i, case, got[f"https://s{i}.test"]) for i, case in enumerate(LLMS) if got[f"https://s{i}.test"] != case[1]]
    assert wrong == []


def test_origins_meet_in_canonical_form(spark):
    shut = "User-agent: GPTBot\nDisallow: /\n"
    names = {"https://Pier.TEST:443": "https://pier.test", "http://pier.test:80": "http://pier.test", "https://pier.test:80": "https://pier.test:80", "HTTPS://b.test:": "https://b.test"}
    rows = [(name, "robots", 200, PLAIN, shut, 0) for name in names]
    got = {r.origin: r.blocked_bots for r in site_verdicts(spark.createDataFrame(rows, SITE_FILE)).collect()}
    assert got == {want: ["GPTBot"] for want in names.values()}
    urls = [("https://PIER.test/a", "https://pier.test"), ("https://u@pier.test:443/", "https://u@pier.test"), ("http://[2001:DB8::1]:80/", "http://[2001:db8::1]"), ("https://x.test:8443", "https://x.test:8443")]
    frame = spark.createDataFrame(urls, "url string, want string")
    assert frame.where(origin(F.col("url")) != F.col("want")).collect() == []


@pytest.mark.parametrize(
    "text, expected",
    [
        ("﻿<!doctype html>", True), ("\n" * 5000 + "<!doctype html>", True), ("\f" * 5000 + "<html>", True),
        ("\x0b\t\r\n <x", True), ("# Title\n<html>", False), ("", False), ("\xa0<html>", False),
    ],
)
def test_sniff(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(looks_like_html(F.col("t")).alias("x")).first()
    assert row.x is expected


FENCE = "Disallow: /\n"


def group(bot: str, *lines: str) -> str:
    return "".join([f"User-agent: {bot}\n", *lines])


OTHER = group("*", FENCE)
ROBOTS = [
    # Every crawler by itself, typed in capitals, with a rule before the ban, and among others.
    *((group(b, FENCE), [b]) for b in AI_CRAWLERS),
    *((group(b.upper(), "Allow: /open\n", "Crawl-delay: 9\n", FENCE), [b]) for b in AI_CRAWLERS),
    ("\n".join(group(b, FENCE) for b in reversed(AI_CRAWLERS)), list(AI_CRAWLERS)),
    # What is no ban of the whole site.
    *((group(AI_CRAWLERS[0], rule), []) for rule in ("Disallow:\n", "Disallow: /in\n", "Disallow: /*\n", "Allow: /\n", "# Disallow: /\n", "Sitemap: /\n")),
    # What still is one.
    *((group(AI_CRAWLERS[0], rule), [AI_CRAWLERS[0]]) for rule in ("disallow:/", "DISALLOW:   /   \n", "Disallow: / # for now\n", "Disallow: /\r\n")),
    (OTHER, []), ("", []), (f"{OTHER}\n{group('CCBot', FENCE)}", ["CCBot"]),
    (group("GPTBot # ours", FENCE), []), ("User-agent: GPTBot\n\n" + FENCE, ["GPTBot"]),
    # A blank line after a rule ends the group; without one, the next group's rules count here too.
    (group("GPTBot", "Allow: /\n", "\n", FENCE), []), (group("GPTBot", "Allow: /\n", group("CCBot", FENCE)), ["GPTBot", "CCBot"]),
    (group("GPTBot", "Allow: /\n") + "\n" + group("GPTBot", FENCE), ["GPTBot"]),
    # A very long group must not exhaust the stack.
    (group("FacebookBot", "Disallow: /in\n" * 50_000, FENCE), ["FacebookBot"]),
]


def test_robots(spark):
    frame = spark.createDataFrame([(i, body) for i, (body, _) in enumerate(ROBOTS)], "i int, body string")
    got = {r.i: r.x for r in frame.select("i", blocked_bots(F.col("body")).alias("x")).collect()}
    assert [got[i] for i in range(len(ROBOTS))] == [e for _, e in ROBOTS]


def test_one_row_per_site(spark):
    rows = [
        ("https://a", "robots", 404, None, "User-agent: GPTBot\nDisallow: /", 0),
        ("https://a", "llms", 200, "text/plain", NOTES, 0),
        ("https://a", "probe", 404, "text/plain", "", 0),
        ("https://b", "robots", 200, None, "User-agent: GPTBot\nDisallow: /", 0),
    ]
    got = {r.origin: r for r in site_verdicts(spark.createDataFrame(rows, SITE_FILE)).collect()}
    # A robots.txt that was not served shuts nobody out.
    assert (got["https://a"].blocked_bots, got["https://a"].llms_verdict) == ([], "pass_absence")
    assert (got["https://b"].blocked_bots, got["https://b"].llms_verdict) == (["GPTBot"], "absent")


def test_of_several_files_one_rule_picks(spark):
    """Listed under the canonical origin, else the least spelling: whatever the files say, and in whatever order they come."""
    shut, open_ = group("GPTBot", FENCE), group("GPTBot", "Allow: /\n")
    rows = [
        ("https://A.test", "robots", 200, PLAIN, shut, 0), ("https://a.test", "robots", 200, PLAIN, open_, 0), ("https://a.test:443", "robots", 200, PLAIN, shut, 0),
        ("https://B.test", "robots", 200, PLAIN, shut, 0), ("https://b.test:443", "robots", 200, PLAIN, open_, 0),
        ("https://a.test", "llms", 200, PLAIN, NOTES, 0), ("HTTPS://a.test", "llms", 404, PLAIN, "", 0), ("https://a.test", "probe", 404, PLAIN, "", 0),
    ]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, SITE_FILE)
        got = {r.origin: (r.blocked_bots, r.llms_verdict) for r in site_verdicts(frame).collect()}
        assert got == {"https://a.test": ([], "pass_absence"), "https://b.test": (["GPTBot"], "absent")}
        assert {r.origin: r.llms_status for r in pivot_site_files(frame).collect()} == {"https://a.test": 200, "https://b.test": None}


def test_pages_meet_the_files_of_their_time(spark):
    shut, open_ = group("GPTBot", FENCE), group("GPTBot", "Allow: /\n")
    files = [
        ("https://a.test", "robots", 200, PLAIN, shut, 0, "2025-01-10"), ("https://a.test", "robots", 200, PLAIN, open_, 0, "2025-02-10"),
        ("https://a.test", "robots", None, None, None, 0, "2025-03-10"),  # no answer: what held goes on
        ("https://a.test", "robots", 404, PLAIN, shut, 0, "2025-04-10"),  # gone: nobody is shut out
        ("https://a.test", "llms", 200, PLAIN, NOTES, 0, "2025-01-10"), ("https://a.test", "probe", 404, PLAIN, "", 0, "2025-02-10"),
        ("https://b.test", "robots", 200, PLAIN, shut, 0, None),
    ]
    schema = "origin string, kind string, status int, content_type string, body string, redirect_hops int, crawled_at string"
    frame = spark.createDataFrame(files, schema).withColumn("crawled_at", F.to_timestamp("crawled_at"))
    pages = {
        ("https://a.test", "2025-01-09"): (None, None, None), ("https://a.test", "2025-01-10"): (["GPTBot"], True, "unverified"),
        ("https://a.test", "2025-02-09"): (["GPTBot"], True, "unverified"), ("https://a.test", "2025-02-10"): ([], True, "pass_absence"),
        ("https://a.test", "2025-03-11"): ([], True, "pass_absence"), ("https://a.test", "2025-05-01"): ([], None, "pass_absence"),
        ("https://a.test", None): ([], None, "pass_absence"), ("https://b.test", "2000-01-01"): (["GPTBot"], True, "absent"),
        ("https://c.test", "2025-02-10"): (None, None, None),
    }
    keyed = spark.createDataFrame([(i, o, t) for i, (o, t) in enumerate(pages)], "page_id bigint, origin string, crawled_at string")
    rows = attach_site_evidence(keyed.withColumn("crawled_at", F.to_timestamp("crawled_at")), frame).collect()
    got = {r.page_id: (r.blocked_bots, r.robots_found, r.llms_verdict) for r in rows}
    assert [got[i] for i in range(len(pages))] == list(pages.values())
    # Versions are changes: the fetch without an answer is none.
    assert {r.origin: len(r.versions) for r in site_versions(frame).collect()} == {"https://a.test": 3, "https://b.test": 1}
    assert {r.origin: r.blocked_bots for r in site_verdicts(frame).collect()} == {"https://a.test": [], "https://b.test": ["GPTBot"]}
