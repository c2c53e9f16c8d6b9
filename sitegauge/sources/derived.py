"""Audit inputs derived from the given tables.

The raw pages show few signals, so blocks that depend on `page_id` alone are
added to each of them; site files, request logs, crawl frontiers and DNS answers
are derived from pages and events the same way. Every derivation is a plain SQL
expression over its row (or one aggregation), in text that reads the same in
Spark SQL and in other SQL engines, so checks can rebuild the very same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.ip import BLOCKED_NETWORKS
from sitegauge.sources.pages import as_instant

# --- pages ------------------------------------------------------------------------

_TWENTY = "This short opening says what the page is about and gives the reader one plain answer in twenty words"

HEAD = """
    CASE WHEN page_id % 2 = 0 THEN '<link rel="canonical" href="' || url || '">'
         WHEN page_id % 10 = 1 THEN '<link rel="canonical"><link rel="canonical" href="' || url || '">' ELSE '' END
 || CASE WHEN page_id % 9 = 3 THEN '<meta name="viewport" content="">'
         WHEN page_id % 3 <> 0 THEN '<meta name="viewport" content="width=device-width">' ELSE '' END
 || repeat('<meta property="og:title" content="t">', CAST(page_id % 5 AS INT))
 || CASE page_id % 7
      WHEN 1 THEN '<script type="application/ld+json">{"@type":"Article","author":{"@type":"Person","name":"Tove Halvorsen"},"dateModified":"2025-03-0' || CAST(page_id % 9 + 1 AS VARCHAR(1)) || '"}</script>'
      WHEN 2 THEN '<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":["FAQPage","BlogPosting"]}]}</script>'
      WHEN 3 THEN '<script type="application/ld+json">[{"@type":"HowTo"},3]</script>'
      WHEN 4 THEN '<script type="application/ld+json">{"@type":"Article",</script>'
      WHEN 5 THEN '<script type="application/ld+json">{"@type":"BreadcrumbList","author":""}</script>'
      WHEN 6 THEN '<script type="application/ld+json">{"@type":"NewsArticle"}</script><script type="application/ld+json">{"@type":"FAQPage"}</script>'
      ELSE '' END
 || CASE page_id % 11
      WHEN 3 THEN '<meta name="author" content="Tove Halvorsen">'
      WHEN 4 THEN '<meta property="article:author" content="https://people.example/tove-h">'
      WHEN 5 THEN '<meta name="author" content=" ">' ELSE '' END
"""

INTRO = f"""
    CASE page_id % 4
      WHEN 1 THEN CASE WHEN page_id % 8 = 1 THEN '<p>' || replace('{_TWENTY}', 'plain', '<b>plain</b>') || '.</p>'
                       ELSE '<p>{_TWENTY}.</p>' END
      WHEN 2 THEN '<p>{_TWENTY}</p>'
      WHEN 3 THEN '<p>Only five words stand here.</p>' ELSE '' END
 || CASE page_id % 6 WHEN 2 THEN '<p>TL;DR: it depends.</p>' WHEN 3 THEN '<p>It is, in short, a matter of taste.</p>' ELSE '' END
"""

BODY = """
    repeat('<h2>What does it cost?</h2>', CAST(least(page_id % 4, page_id % 6) AS INT))
 || repeat('<h2>Further remarks</h2>', CAST(page_id % 6 - least(page_id % 4, page_id % 6) AS INT))
 || CASE WHEN page_id % 12 = 7 THEN '<div role="heading" aria-level="2">More</div>' ELSE '' END
 || CASE WHEN page_id % 16 = 9 THEN '<h1>Second headline</h1>' ELSE '' END
 || repeat('<ul><li>entry</li><li>other entry</li></ul>', CAST(page_id % 7 AS INT))
 || CASE WHEN page_id % 3 = 0 THEN '<table><tr><td>cell</td></tr></table>' ELSE '' END
 || CASE WHEN page_id % 4 = 0 THEN '<dl><dt>term</dt><dd>meaning</dd></dl>' ELSE '' END
 || CASE page_id % 5 WHEN 1 THEN '<blockquote>quoted words</blockquote>' WHEN 2 THEN '<cite>Some source</cite>' ELSE '' END
 || repeat('<a href="/i/n">inner</a> ', CAST(page_id % 9 AS INT))
 || repeat('<a href="https://other.example/n">outer</a> ', CAST(page_id % 6 AS INT))
 || CASE WHEN page_id % 4 >= 1 THEN '<a href="https://www.nasa.gov/x">agency</a> ' ELSE '' END
 || CASE WHEN page_id % 4 >= 2 THEN '<a href="http://cs.example.edu">school</a> ' ELSE '' END
 || CASE WHEN page_id % 4 >= 3 THEN '<a href="https://en.wikipedia.org/wiki/A">entry</a> ' ELSE '' END
 || CASE WHEN page_id % 8 = 0 THEN '<a href="//cdn.example/x">cdn</a> <a href="#frag">jump</a> ' ELSE '' END
 || CASE page_id % 9
      WHEN 1 THEN '<p class="byline">By Tove Halvorsen</p>'
      WHEN 2 THEN '<a rel="author" href="/authors/1">Read More</a>'
      WHEN 3 THEN '<p>By E. M. Okonkwo</p>'
      WHEN 4 THEN '<p>By Tove Halvorsen' || chr(39) || 's count, nine boats came in.</p>'
      WHEN 5 THEN '<div class="authority-box">Checked By Harbour Office Records</div>'
      WHEN 6 THEN '<header><p>By Tove Halvorsen</p></header>'
      WHEN 7 THEN '<span class="author-line">Ilse Brandt</span>' ELSE '' END
 || CASE page_id % 5 WHEN 3 THEN '<p>Updated March of that year.</p>' WHEN 4 THEN '<p>It was so in 2019 already.</p>' ELSE '' END
 || '<p>Filler' || repeat(' word', CAST(800 * (page_id % 5) AS INT)) || '</p>'
"""

TITLE_YEAR = "CASE page_id % 10 WHEN 4 THEN ' 2025' WHEN 5 THEN ' 2019' ELSE '' END"

DECORATED_HTML = (
    f"replace(replace(replace(html, '</head>', {HEAD} || '</head>'),"
    f" '</h1>', {TITLE_YEAR} || '</h1>' || {INTRO}), '</article>', {BODY} || '</article>')"
)
# Where the fetch ended: as typed, in capitals, with the scheme's own port, or on another site.
_SCHEME_PART, _HOST_PART = "regexp_extract(url, '^([a-z]+://)', 1)", "regexp_extract(url, '^[a-z]+://([^/]*)', 1)"
_PATH_PART = "regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1)"
FINAL_URL = f"""CASE page_id % 13 WHEN 5 THEN {_SCHEME_PART} || upper({_HOST_PART}) || {_PATH_PART}
    WHEN 7 THEN {_SCHEME_PART} || {_HOST_PART} || CASE WHEN url LIKE 'https:%' THEN ':443' ELSE ':80' END || {_PATH_PART}
    WHEN 9 THEN 'https://elsewhere.example/moved' ELSE url END"""
# Typed addresses of a crawl that needs a guard, and the answers of the sites' name servers.
GUARDED_URL = f"""CASE page_id % 17 WHEN 3 THEN 'http://10.1.2.' || CAST(page_id % 250 AS INT) || '/' WHEN 6 THEN 'ftp://files.example/x'
    WHEN 11 THEN {_SCHEME_PART} || 'printer.lan/' ELSE url END"""
# The same, each typed in its own way, and where they redirect: over a private address, over the site itself, or in a circle.
HOP_URL = f"({GUARDED_URL}) || '?p=' || CAST(page_id AS VARCHAR(20))"
MIDDLE_URL = f"""CASE page_id % 6 WHEN 1 THEN 'http://10.0.0.7/in/' ELSE {_SCHEME_PART} || {_HOST_PART} || '/login/' END || CAST(page_id AS VARCHAR(20))"""
HOST_IP = "CASE WHEN host_no % 4 = 1 THEN '192.168.7.' || CAST(host_no % 250 AS INT) ELSE '198.41.0.' || CAST(host_no % 250 AS INT) END"
LAST_MODIFIED = "CASE WHEN page_id % 3 = 1 THEN 'Tue, 04 Mar 2025 10:00:00 GMT' END"
# Fetch status of the crawl: one page in three failed in one way or another.
STATUS = (
    "CASE page_id % 21 WHEN 1 THEN 404 WHEN 4 THEN 401 WHEN 7 THEN 403 WHEN 10 THEN 429 WHEN 13 THEN 500"
    " WHEN 16 THEN 503 WHEN 19 THEN 418 ELSE 200 END"
)


def decorated_pages(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id",
        "url",
        F.expr(FINAL_URL).alias("final_url"),
        F.expr(DECORATED_HTML).alias("html"),
        F.expr(f"map('Last-Modified', {LAST_MODIFIED})").alias("headers"),
    )


def crawled_pages(pages: DataFrame) -> DataFrame:
    """Decorated pages of a crawl in which some fetches failed."""
    return decorated_pages(pages).withColumns(
        {"status": F.expr(STATUS), "reason": F.expr("CASE WHEN page_id % 21 = 19 THEN 'Teapot' END")}
    )


# --- site files ----------------------------------------------------------------------

# Origin of a page and the number that decides what its site serves.
ORIGIN = "regexp_extract(url, '^([a-z]+://[^/]*)', 1)"
SITE_NO = "min(page_id)"
# Some site files are listed under an origin in capitals and with its port.
SERVED_ORIGIN = "CASE WHEN site_no % 5 = 2 THEN upper(origin) || CASE WHEN origin LIKE 'https:%' THEN ':443' ELSE ':80' END ELSE origin END"

_NL = "chr(10)"
ROBOTS_BODY = f"""CASE site_no % 6
    WHEN 1 THEN 'User-agent: GPTBot' || {_NL} || 'Disallow: /' || {_NL}
    WHEN 2 THEN 'User-agent: GPTBot' || {_NL} || 'Disallow: /' || {_NL} || {_NL} || 'User-agent: CCBot' || {_NL} || 'Crawl-delay: 5' || {_NL}
             || 'Disallow: / # all' || {_NL} || {_NL} || 'user-agent:ClaudeBot ' || {_NL} || 'disallow:/'
    WHEN 3 THEN 'User-agent: PerplexityBot' || chr(13) || {_NL} || 'Allow: /a' || chr(13) || {_NL} || 'Disallow: /' || chr(13) || {_NL}
    WHEN 4 THEN 'User-agent: *' || {_NL} || 'Disallow: /' || {_NL}
    WHEN 5 THEN 'User-agent: Google-Extended' || {_NL} || 'Disallow: /' || {_NL} || 'User-agent: Applebot-Extended' || {_NL} || 'Disallow: /' || {_NL}
             || 'User-agent: FacebookBot' || {_NL} || 'Disallow: /' || {_NL} || {_NL} || 'User-agent: anthropic-ai' || {_NL} || 'Disallow: /' || {_NL}
             || {_NL} || 'User-agent: Bytespider' || {_NL} || 'Disallow: /' || {_NL}
    ELSE 'User-agent: Bytespider' || {_NL} || 'Disallow: /private' || {_NL} END"""
ROBOTS_STATUS = "CASE site_no % 6 WHEN 0 THEN CASE WHEN site_no % 12 = 0 THEN 404 END ELSE 200 END"
_GUIDE = "'# Guide' || chr(10) || 'This site describes itself here, in plain words, for machine readers.'"
LLMS_BODY = f"""CASE site_no % 12
    WHEN 2 THEN '# Twenty characters.' WHEN 3 THEN '<!doctype html><html><body>The home page of the site again</body></html>'
    WHEN 4 THEN '﻿ <html><body>The home page of the site again, padded</body></html>' ELSE {_GUIDE} END"""
LLMS_STATUS = "CASE site_no % 12 WHEN 0 THEN NULL WHEN 1 THEN 404 ELSE 200 END"
LLMS_TYPE = "CASE site_no % 12 WHEN 5 THEN 'application/octet-stream' WHEN 6 THEN NULL ELSE 'Text/Plain; charset=utf-8' END"
LLMS_HOPS = "CASE WHEN site_no % 5 < 2 THEN 1 ELSE 0 END"
PROBE_STATUS = (
    "CASE site_no % 8 WHEN 0 THEN NULL WHEN 1 THEN 404 WHEN 2 THEN 410 WHEN 3 THEN 302 WHEN 4 THEN 503"
    " WHEN 7 THEN CASE WHEN site_no % 16 = 7 THEN 101 ELSE 301 END ELSE 200 END"
)
# Incomplete evidence, too: a type or a body the crawl did not keep.
PROBE_TYPE = "CASE WHEN site_no % 24 IN (2, 5) THEN NULL WHEN site_no % 8 = 5 THEN 'text/html' ELSE 'text/plain' END"
PROBE_BODY = """CASE WHEN site_no % 16 IN (1, 13, 14) THEN NULL WHEN site_no % 8 = 5 THEN '<html></html>'
    WHEN site_no % 8 = 6 THEN 'any path is fine here' ELSE '' END"""

SITE_FILE_KINDS = {
    # kind: status, content type, body, redirect hops
    "robots": (ROBOTS_STATUS, "'text/plain'", ROBOTS_BODY, "0"),
    "llms": (LLMS_STATUS, LLMS_TYPE, LLMS_BODY, LLMS_HOPS),
    "probe": (PROBE_STATUS, PROBE_TYPE, PROBE_BODY, "0"),
}


def sites(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.expr(ORIGIN).alias("origin")).agg(F.expr(SITE_NO).alias("site_no"))


def _files_of(sites: DataFrame) -> DataFrame:
    files = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.expr(status).cast("int").alias("status"),
            F.expr(ctype).alias("content_type"),
            F.expr(body).alias("body"),
            F.expr(hops).cast("int").alias("redirect_hops"),
        )
        for kind, (status, ctype, body, hops) in SITE_FILE_KINDS.items()
    ]
    rows = sites.select(F.expr(SERVED_ORIGIN).alias("origin"), F.explode(F.array(*files)).alias("f")).select("origin", "f.*")
    return rows.where(F.col("status").isNotNull())


def site_files(pages: DataFrame) -> DataFrame:
    """One row per origin and file kind the crawl got an answer for."""
    return _files_of(sites(pages))


# Two crawls of the site files, the second of sites that have moved on by one; pages come before, between and after.
CRAWLS = (("2025-01-10 00:00:00", 0), ("2025-02-10 00:00:00", 1))
CRAWLED_AT = "CASE page_id % 4 WHEN 0 THEN '2025-01-01 00:00:00' WHEN 1 THEN '2025-01-10 00:00:00' WHEN 2 THEN '2025-02-09 23:59:59' ELSE '2025-03-01 00:00:00' END"


def crawled_site_files(pages: DataFrame) -> DataFrame:
    """Every file with the time it was crawled at."""
    known = sites(pages)
    crawls = [
        _files_of(known.withColumn("site_no", F.col("site_no") + step)).withColumn("crawled_at", F.to_timestamp(F.concat(F.lit(at), F.lit("+00:00"))))
        for at, step in CRAWLS
    ]
    return crawls[0].unionByName(crawls[1])


# --- request log ------------------------------------------------------------------------

_CLIENT = "'10.0.' || CAST((user_id - user_id % 256) / 256 % 256 AS INT) || '.' || CAST(user_id % 256 AS INT)"
FORWARDED_FOR = f"""CASE WHEN event_id % 19 = 0 THEN NULL
    WHEN event_id % 17 = 0 THEN 'garbage,1.2.3.4'
    WHEN event_id % 23 = 0 THEN {_CLIENT} || ':5678'
    WHEN event_id % 29 = 0 THEN ' 2001:db8::' || CAST(user_id % 9 AS INT) || ' , 10.9.9.9'
    WHEN event_id % 31 = 0 THEN '10.0.01.7'
    ELSE {_CLIENT} || ', 172.16.0.1' END"""
REAL_IP = f"CASE WHEN event_id % 17 = 0 THEN {_CLIENT} WHEN event_id % 31 = 0 THEN 'not-an-ip' END"
PATH = """CASE event_id % 7 WHEN 0 THEN '/api/score' WHEN 1 THEN '/api/score?url=' WHEN 2 THEN '/api/score?lang=en'
    WHEN 3 THEN '/api/score?lang=en&url=https%3A%2F%2Fexample.com%2Fa%20b&url=second'
    ELSE '/api/score?url=example.com/' || event_type || '+' || CAST(event_id % 100 AS INT) || '#top' END"""
# What the counter store answered, for logs of a limiter that asked one.
STORE_STATUS = (
    "CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN 401 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 403"
    " WHEN 5 THEN 500 WHEN 6 THEN 503 ELSE 200 END"
)
STORE_PARSED = "event_id % 5 <> 0"
STORE_CONFIGURED = "event_id % 11 <> 0"

# In which of three deliveries an event arrives: stragglers come last, and the earliest ten days in the second.
DELIVERY = "CASE WHEN event_id % 5 = 0 THEN 2 WHEN dayofmonth(ts) <= 10 THEN 1 WHEN dayofmonth(ts) <= 20 THEN 0 ELSE 2 END"


def request_log(events: DataFrame) -> DataFrame:
    headers = F.map_filter(
        F.create_map(
            F.lit("X-Forwarded-For"), F.expr(FORWARDED_FOR), F.lit("x-real-ip"), F.expr(REAL_IP)
        ),
        lambda _, v: v.isNotNull(),
    )
    return as_instant(events, "ts").select(
        F.col("event_id").alias("request_id"),
        "ts",
        headers.alias("headers"),
        F.expr(PATH).alias("path"),
        F.expr(STORE_CONFIGURED).alias("configured"),
        F.expr(STORE_STATUS).alias("store_status"),
        F.expr(STORE_PARSED).alias("parsed"),
    )


# --- crawl frontier ---------------------------------------------------------------------

# A spread-out 32-bit number per event, and address texts made of it.
ADDRESS = "event_id % 1000003 * 2654435761 % 4294967296"


def quad(number: str) -> str:
    """Dotted quad of a 32-bit number."""
    octets = [f"CAST((({number}) - ({number}) % {1 << s}) / {1 << s} % 256 AS INT)" for s in (24, 16, 8)]
    return " || '.' || ".join(octets + [f"CAST(({number}) % 256 AS INT)"])


_HOST = "'h' || CAST(user_id AS INT) || '.example.net'"
FRONTIER_URL = f"""CASE event_id % 16
    WHEN 0 THEN 'http://' || {quad(ADDRESS)} || '/x'
    WHEN 1 THEN 'https://[::ffff:' || {quad(ADDRESS)} || ']:8443/'
    WHEN 2 THEN 'http://[fd00::' || CAST(event_id % 10 AS INT) || ']/'
    WHEN 3 THEN 'http://[2606:4700::' || CAST(event_id % 10 AS INT) || ':1]/'
    WHEN 4 THEN CASE event_id % 3 WHEN 0 THEN 'ftp://example.com/' WHEN 1 THEN 'javascript:alert(1)' ELSE '//example.com/x' END
    WHEN 5 THEN CASE event_id % 4 WHEN 0 THEN 'http://LocalHost./a' WHEN 1 THEN 'http://metadata/' WHEN 2 THEN 'http://printer.local/' ELSE 'http://user@nas.home:80/' END
    WHEN 6 THEN 'http://10.' || CAST(event_id % 256 AS INT) || '.0.1:8080/'
    WHEN 7 THEN CASE event_id % 3 WHEN 0 THEN 'http://[fe80::1/' WHEN 1 THEN 'https:///no-host' ELSE 'http://unresolved.example/' END
    ELSE 'https://' || {_HOST} || '/' || event_type END"""
# Answers of a host's k-th DNS record; every fourth client's host has none.
DNS_ANSWERS = "user_id % 4"
DNS_ADDRESS = "(user_id * 4 + k) % 1000003 * 2654435761 % 4294967296"
DNS_IP = f"CASE WHEN user_id % 37 = 5 AND k = 0 THEN 'bad-answer' ELSE {quad(DNS_ADDRESS)} END"


def frontier(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("frontier_id"), F.expr(FRONTIER_URL).alias("url"))


def page_redirects(pages: DataFrame) -> DataFrame:
    """One page in two redirects twice on its way from the typed address."""
    rows = pages.where("page_id % 2 = 1").select(
        F.expr(HOP_URL).alias("typed"), F.expr(MIDDLE_URL).alias("middle"),
        F.expr(f"CASE page_id % 6 WHEN 5 THEN {HOP_URL} ELSE {FINAL_URL} END").alias("last"),
    )
    return rows.select("typed", "middle", F.explode(F.array(F.struct(F.col("typed").alias("from_url"), F.col("middle").alias("to_url")),
        F.struct(F.col("middle").alias("from_url"), F.col("last").alias("to_url")))).alias("e")).select("e.*")


def site_dns(pages: DataFrame) -> DataFrame:
    """One answer per host of the pages."""
    hosts = pages.groupBy(F.expr(_HOST_PART).alias("host")).agg(F.min("page_id").alias("host_no"))
    return hosts.select("host", F.expr(HOST_IP).alias("ip"))


def dns(events: DataFrame) -> DataFrame:
    hosts = events.select("user_id").distinct()
    answers = hosts.select(
        "user_id", F.explode(F.expr(f"filter(array(0, 1, 2), i -> i < {DNS_ANSWERS})")).alias("k")
    )
    return answers.select(F.expr(_HOST).alias("host"), F.expr(DNS_IP).alias("ip"))


# Single redirects: chains of up to seven, some that end at any address of the frontier, and circles of two.
def _stop(number: str) -> str:
    return f"'https://h' || CAST(({number}) % 97 AS INT) || '.example.net/r/' || CAST({number} AS VARCHAR(20))"


REDIRECT_FROM = _stop("event_id")
REDIRECT_TO = f"""CASE WHEN event_id % 10 = 6 THEN 'https://h' || CAST(event_id % 97 AS INT) || '.example.net/end'
    WHEN event_id % 10 = 7 THEN {FRONTIER_URL} WHEN event_id % 10 = 9 THEN {_stop("event_id - 1")} ELSE {_stop("event_id + 1")} END"""


def redirects(events: DataFrame) -> DataFrame:
    return events.select(F.expr(REDIRECT_FROM).alias("from_url"), F.expr(REDIRECT_TO).alias("to_url"))


# Networks beside the constant ones: one in ten events names one, many inside others.
NETWORK_ADDRESS = "event_id % 1000003 * 40503 * 65537 % 4294967296"
NETWORK_BITS = "CAST(9 + event_id % 24 AS INT)"


def networks(events: DataFrame) -> DataFrame:
    """Networks that are not public, as a table: the constant ones and those the events name."""
    named = events.where("event_id % 10 = 0").select(
        F.expr(f"{quad(NETWORK_ADDRESS)} || '/' || CAST({NETWORK_BITS} AS VARCHAR(2))").alias("cidr")
    )
    constant = events.sparkSession.createDataFrame([(n,) for n in BLOCKED_NETWORKS], "cidr string")
    return named.unionByName(constant)


# Redirect chains: five events in a row form one fetch.
FETCH_ID = "CAST((event_id - event_id % 5) / 5 AS BIGINT)"
HOP_NO = "CAST(event_id % 5 AS INT)"


def hops(events: DataFrame) -> DataFrame:
    return events.select(
        F.expr(FETCH_ID).alias("fetch_id"), F.expr(HOP_NO).alias("hop_no"), F.expr(FRONTIER_URL).alias("url")
    )
