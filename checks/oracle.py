"""SQL twins of the queries, for an engine with RE2 regular expressions.

They work on the same derived inputs but reach the results in another way: the
pages are well-formed here, so a page is cut up with regular expressions and
list functions instead of being parsed.
"""

from __future__ import annotations

from sitegauge.plans.queries import FETCHED_AT, PER_DAY, PER_MINUTE, SIGNAL_KEYS
from sitegauge.sources import derived as d

# --- fixed values, written out here: a wrong one in the library must show ----------------
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
AI_CRAWLERS = (
    "GPTBot", "ClaudeBot", "PerplexityBot", "CCBot", "Google-Extended", "Applebot-Extended", "Bytespider", "anthropic-ai", "FacebookBot",
)
BUCKET_CAPS = {"schema_structure": 30, "content_format": 25, "authority": 20, "crawlability": 15, "freshness": 10}
GRADE_FLOORS = ((90, "A+"), (80, "A"), (70, "B"), (60, "C"), (45, "D"))
INTERFACE_WORDS = (
    "read", "more", "learn", "home", "page", "pages", "next", "previous", "prev", "back", "all", "view", "views", "share",
    "shares", "related", "post", "posts", "comment", "comments", "reply", "sign", "log", "login", "menu", "search", "subscribe",
    "newsletter", "follow", "contact", "about", "privacy", "terms", "cookie", "cookies", "skip", "toggle", "close", "open",
    "show", "hide", "the", "and", "our", "team", "staff", "editor", "editors", "admin",
)

ORACLES: dict[str, str] = {}

W = r"[\p{L}\p{N}_]"
BEFORE, AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def words_in(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{W}+'))"


def clean(text: str) -> str:
    """Strip one text node and decode the entities the pages use."""
    plain = text
    # A title cut off inside an entity ends without its semicolon.
    for entity, char in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        plain = f"regexp_replace({plain}, '{entity}', '{char}', 'g')"
    return rf"regexp_replace({plain}, '^\s+|\s+$', '', 'g')"


def nodes(html: str) -> str:
    """Non-blank text nodes of a piece of markup."""
    return f"list_filter(list_transform(string_split_regex({html}, '<[^>]*>'), lambda t: {clean('t')}), lambda t: t <> '')"


def pruned(html: str) -> str:
    for tag in ("script", "style", "noscript", "header", "footer", "nav"):
        html = rf"regexp_replace({html}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', '<!---->', 'g')"
    return html


def has(pattern: str, text: str = "p") -> str:
    return f"regexp_matches({text}, '{pattern}')"


def count(pattern: str, text: str = "p") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


PAGES = f"SELECT page_id, url, {d.FINAL_URL} AS final_url, {d.DECORATED_HTML} AS html, {d.LAST_MODIFIED} AS last_modified FROM pages"
PARAGRAPH_END = "(?s)(</p>|<(ul|table|dl|blockquote|div|h1|h2|article)[ >]).*$"
# The name grammar without look-ahead and class intersection.
_CAP = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{Nl}\p{No}ß-öø-ÿ]"
_WORD = _CAP + r"(?:[\p{L}\p{N}_.''’\-]*[\p{L}\p{N}])?"
_NAME = rf"(?:{_WORD}|{_CAP}\.)(?:\s+(?:{_WORD}|{_CAP}\.|(?:de|del|della|der|di|da|dos|van|von|la|le|bin|al))){{1,3}}"
_BY = r"(?:[Ww]ritten\s+)?[Bb]y[:\s]\s*"
_TAIL = r"(?:$|[^’''a-z\s]|\s+(?:$|[^a-z\s]))"


def plausible(name: str) -> str:
    return (
        f"len(list_filter(string_split_regex({name}, '\\s+'), lambda w: trim(w, '.''’-') <> ''"
        f" AND lower(trim(w, '.''’-')) NOT IN ({quoted(INTERFACE_WORDS)}))) > 0"
    )


MARKED = (
    r"<[a-z]+ (?:class=\"[^\"]*(?:byline|author(?:[^i\"]|i[^t]|it[^y]))[^\"]*\"|rel=\"[^\"]*author[^\"]*\")[^>]*>([^<]*)<"
).replace('\\"', '"')

# b: page with pruned markup `p`; c: its pieces.
BASE = f"""
raw_pages AS ({PAGES}),
b AS MATERIALIZED (SELECT *, {pruned('html')} AS p FROM raw_pages),
c AS MATERIALIZED (
  SELECT *,
    array_to_string({nodes('p')}, ' ') AS visible,
    list_transform(
      string_split_regex(regexp_extract(p, '(?s)<article>(.*)</article>', 1), '<p(?: [^>]*)?>')[2:],
      -- A paragraph left open inside a bold run is ended by the next one only.
      lambda x: CASE WHEN contains(x, '<b>') AND NOT contains(x, '</b>') THEN x ELSE regexp_replace(x, '{PARAGRAPH_END}', '') END) AS paras,
    array_to_string({nodes("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '') AS title,
    array_to_string({nodes("regexp_extract(p, '(?s)<h1>(.*?)</h1>', 1)")}, '') AS headline,
    regexp_extract_all(p, '<a [^>]*href="([^"]*)"', 1) AS hrefs,
    regexp_replace(lower(regexp_extract(final_url, '^[a-z]+://([^/?#]*)', 1)), ':(443|80)$', '') AS page_host,
    regexp_extract_all(html, '<script type="application/ld\\+json">(.*?)</script>', 1) AS scripts
  FROM b)
"""

JSONLD = f"""{BASE},
j_scripts AS (SELECT page_id, unnest(scripts) AS s, generate_subscripts(scripts, 1) AS script_no FROM c),
j_docs AS (
  SELECT page_id, script_no, unnest(CASE json_type(s) WHEN 'ARRAY' THEN json_extract(s, '$[*]') ELSE [s::JSON] END) AS doc,
    generate_subscripts(CASE json_type(s) WHEN 'ARRAY' THEN json_extract(s, '$[*]') ELSE [s::JSON] END, 1) AS doc_no
  FROM j_scripts WHERE json_valid(s)),
j_objects AS (SELECT * FROM j_docs WHERE json_type(doc) = 'OBJECT'),
j_nodes AS (
  SELECT page_id, script_no, doc_no, unnest(CASE WHEN json_exists(doc, '$."@graph"') THEN json_extract(doc, '$."@graph"[*]') ELSE [doc] END) AS node,
    generate_subscripts(CASE WHEN json_exists(doc, '$."@graph"') THEN json_extract(doc, '$."@graph"[*]') ELSE [doc] END, 1) AS graph_no
  FROM j_objects),
j AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY script_no, doc_no, graph_no) - 1 AS node_no, node
  FROM j_nodes WHERE json_type(node) = 'OBJECT'),
j_types AS (
  SELECT DISTINCT page_id, unnest(CASE json_type(node, '$."@type"') WHEN 'ARRAY' THEN json_extract_string(node, '$."@type"[*]')
    WHEN 'VARCHAR' THEN [json_extract_string(node, '$."@type"')] ELSE [] END) AS type FROM j),
j_page AS (
  SELECT page_id,
    bool_or(coalesce(json_extract_string(node, '$.author'), '') NOT IN ('', '[]', '{{}}', '0', 'false')) AS names_author,
    min_by(json_extract_string(node, '$.dateModified'), node_no) FILTER (json_extract_string(node, '$.dateModified') <> '') AS date_modified
  FROM j GROUP BY page_id),
j_type_sets AS (SELECT page_id, list(type) AS types FROM j_types GROUP BY page_id)
"""


def site_file(kind: str) -> str:
    status, ctype, body, hops = d.SITE_FILE_KINDS[kind]
    return f"({status}) AS {kind}_status, {ctype} AS {kind}_type, {body} AS {kind}_body, {hops} AS {kind}_hops"


def sniff(text: str) -> str:
    return f"coalesce(starts_with(ltrim({text}, '﻿ ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '<'), false)"


def bot_blocked(bot: str) -> str:
    # `[\s]` of the text is plain white space here; files have no other.
    group = rf"user-agent:\s*{bot.lower()}\s*\n((?:[a-z-]+:.*\n?)+)"
    return (
        f"len(list_filter(regexp_extract_all(lower(robots_body), '{group}', 1),"
        rf" lambda g: regexp_matches(g, 'disallow:\s*/(\s|$)'))) > 0"
    )


# Canonical origin: lower case, no port (the derived ones are the schemes' own).
ORIGIN_OF = "regexp_replace(lower(regexp_extract({}, '^([a-z]+://[^/]*)', 1)), ':(443|80)$', '')"
SITES = f"""
ended AS (SELECT {ORIGIN_OF.format('(' + d.FINAL_URL + ')')} AS ended, count(*) AS n_pages FROM pages GROUP BY 1),
sites AS (SELECT * FROM (SELECT {d.ORIGIN} AS origin, {d.SITE_NO} AS site_no FROM pages GROUP BY 1) LEFT JOIN ended ON origin = ended),
site_rows AS (SELECT *, {', '.join(site_file(k) for k in d.SITE_FILE_KINDS)} FROM sites),
present AS (SELECT * FROM site_rows WHERE coalesce(robots_status, llms_status, probe_status) IS NOT NULL),
verdicts AS (
  SELECT origin, n_pages, robots_status, llms_status, probe_status,
    CASE WHEN llms_status IS NULL OR llms_status <> 200 OR length(llms_body) <= 50 THEN 'absent'
      WHEN coalesce(lower(llms_type), '') LIKE '%text/html%' OR {sniff('llms_body')} THEN 'html_fallback'
      WHEN llms_type IS NOT NULL AND lower(llms_type) NOT LIKE 'text/%' THEN 'bad_type'
      WHEN probe_status IS NULL OR probe_type IS NULL OR (probe_status // 100 = 2 AND probe_body IS NULL) THEN 'unverified'
      WHEN probe_status IN (404, 410) THEN 'pass_absence'
      WHEN probe_status // 100 = 3 THEN CASE WHEN llms_hops IS NULL THEN 'unverified' WHEN llms_hops > 0 THEN 'redirect_ambiguous' ELSE 'pass_direct' END
      WHEN probe_status >= 400 THEN 'waf'
      WHEN probe_status // 100 = 2 THEN CASE WHEN probe_type LIKE '%text/html%' OR {sniff('probe_body')} THEN 'pass_html_shell' ELSE 'catch_all' END
      ELSE 'unexpected' END AS verdict,
    CASE WHEN robots_status = 200 THEN
      list_filter([{', '.join(f"CASE WHEN {bot_blocked(b)} THEN '{b}' END" for b in AI_CRAWLERS)}], lambda x: x IS NOT NULL)
      ELSE [] END AS blocked
  FROM present)
"""

# The same after a second crawl: a file it got no answer for stays the first one's.
_KEPT = ", ".join(
    f"CASE WHEN b.{k}_status IS NULL THEN a.{k}_{c} ELSE b.{k}_{c} END AS {k}_{c}" for k in d.SITE_FILE_KINDS for c in ("status", "type", "body", "hops")
)
_LATER = SITES.replace(
    "site_rows AS (SELECT *,", "first_rows AS (SELECT *,"
).replace(
    "present AS (SELECT * FROM site_rows", f"""next_sites AS (SELECT origin, site_no + 1 AS site_no FROM sites),
next_rows AS (SELECT *, {', '.join(site_file(k) for k in d.SITE_FILE_KINDS)} FROM next_sites),
site_rows AS (SELECT a.origin, a.n_pages, {_KEPT} FROM first_rows a JOIN next_rows b USING (origin)),
present AS (SELECT * FROM site_rows"""
)

HTTP_LINKS = (
    "list_transform(list_filter(hrefs, lambda h: starts_with(h, 'http')),"
    " lambda h: lower(regexp_extract(h, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)))"
)
AUTHOR_META = (
    "len(list_filter(regexp_extract_all(p, '<meta (?:name=\"author\"|property=\"article:author\") content=\"([^\"]*)\"', 1),"
    " lambda m: trim(m) <> '')) > 0"
)
AUTHOR_MARKUP = f"""len(list_filter(list_filter(list_transform(regexp_extract_all(p, '{MARKED}', 1), lambda t: {clean('t')}), lambda t: t <> ''),
    lambda t: {plausible(f"regexp_extract(t, '{BEFORE}{_BY}({_NAME}){_TAIL}', 1)")}
           OR (length(t) <= 120 AND {plausible(f"regexp_extract(t, '{_NAME}')")}))) > 0"""
BLOCK_TEXTS = f"""list_concat(
    list_transform(paras, lambda x: array_to_string({nodes('x')}, ' ')),
    list_transform(regexp_extract_all(p, '<(?:div|li|span|cite|td)(?: [^>]*)?>([^<]*)</', 1), lambda t: {clean('t')}))"""
AUTHOR_BYLINE = f"""len(list_filter({BLOCK_TEXTS}, lambda t: t <> '' AND length(t) <= 120
    AND {plausible(f"regexp_extract(t, '^{_BY}({_NAME}){_TAIL}', 1)")})) > 0"""

FACTS = f"""{JSONLD}, {SITES},
f0 AS (
  SELECT c.page_id, url, final_url, title, headline, last_modified, page_host,
    coalesce(t.types, []) AS types, coalesce(jp.names_author, false) AS jsonld_author, jp.date_modified,
    coalesce(v.verdict, 'absent') AS verdict, coalesce(v.blocked, []) AS blocked,
    coalesce(regexp_extract(regexp_extract(p, '<link rel="canonical"[^>]*>'), 'href="([^"]*)"', 1), '') AS canonical,
    regexp_extract(regexp_extract(p, '<meta name="viewport"[^>]*>'), 'content="([^"]*)"', 1) AS viewport,
    {count('<meta property="og:')} AS n_og,
    {count('<h1[ >]')} + {count('role="heading" aria-level="1"')} AS h1,
    {count('<h2[ >]')} + {count('role="heading" aria-level="2"')} AS h2,
    {count('<dl>')} AS dl, {count('<table>')} AS tables, {count('<[uo]l>')} AS lists,
    {count('<blockquote>')} AS quotes, {count('<cite>')} AS cites,
    len(list_filter(regexp_extract_all(p, '<h2>([^<]*)</h2>', 1), lambda h: h LIKE '%?')) AS questions,
    {words_in('visible')} AS words,
    list_filter(list_transform(paras, lambda x: array_to_string({nodes('x')}, '')), lambda t: {words_in('t')} >= 8)[1] AS answer,
    {has('<(b|strong)>', 'paras[1]')} AS bold, len(paras) AS n_paras,
    {has(BEFORE + '(tl;dr|tldr|in short|summary)' + AFTER, 'left(lower(visible), 2000)')} AS tldr,
    {HTTP_LINKS} AS hosts, hrefs,
    {AUTHOR_META} AS meta_author, {AUTHOR_MARKUP} AS markup_author, {AUTHOR_BYLINE} AS visible_byline,
    {has('(?i)' + BEFORE + '(in|as of|updated|since)' + r'\s+(2023|2024|2025|2026|' + '|'.join(MONTHS) + ')' + AFTER, 'visible')} AS dated
  FROM c LEFT JOIN j_page jp USING (page_id) LEFT JOIN j_type_sets t USING (page_id)
    LEFT JOIN verdicts v ON v.origin = {ORIGIN_OF.format('final_url')}),
f AS MATERIALIZED (
  SELECT *, coalesce({words_in('answer')}, 0) AS answer_words, {has('[.!?]$', "coalesce(answer, '')")} AS answer_closed,
    len(list_filter(hosts, lambda h: h <> page_host AND regexp_matches(h, '(\\.gov|\\.edu|\\.ac\\.uk|wikipedia\\.org)$'))) AS n_auth,
    len(list_filter(hosts, lambda h: h <> page_host)) AS n_out,
    len(list_filter(hosts, lambda h: h = page_host)) + len(list_filter(hrefs, lambda h: regexp_matches(h, '^/([^/]|$)'))) AS n_in,
    CASE WHEN jsonld_author THEN 'jsonld' WHEN meta_author THEN 'meta' WHEN markup_author THEN 'markup' WHEN visible_byline THEN 'byline' END AS author
  FROM f0)
"""

# signal: name, bucket, weight, passed, points
_BIN = "CASE WHEN {0} THEN {1} ELSE 0 END"


def binary(name, bucket, weight, passed):
    return name, bucket, weight, passed, _BIN.format(passed, weight)


SIGNALS = (
    binary("HTTPS", "crawlability", 2, "final_url LIKE 'https://%'"),
    binary("Canonical URL", "crawlability", 2, "canonical <> ''"),
    binary("Mobile viewport", "crawlability", 2, "viewport <> ''"),
    binary("Open Graph tags", "crawlability", 2, "n_og >= 3"),
    binary("llms.txt file", "crawlability", 3, "verdict LIKE 'pass%'"),
    ("Robots allows AI crawlers", "crawlability", 4, "len(blocked) = 0", "greatest(0, 4 - len(blocked))"),
    binary("Article schema", "schema_structure", 5, "list_has_any(types, ['Article', 'NewsArticle', 'BlogPosting', 'TechArticle'])"),
    binary("FAQ schema", "schema_structure", 6, "list_contains(types, 'FAQPage')"),
    binary("HowTo schema", "schema_structure", 3, "list_contains(types, 'HowTo')"),
    binary("Breadcrumb schema", "schema_structure", 3, "list_contains(types, 'BreadcrumbList')"),
    ("Heading structure", "schema_structure", 4, "h1 = 1 AND h2 >= 3", "CASE WHEN h1 = 1 AND h2 >= 3 THEN 4 WHEN h1 >= 1 AND h2 >= 2 THEN 2 ELSE 1 END"),
    binary("Definition lists", "schema_structure", 3, "dl > 0"),
    binary("Table markup", "schema_structure", 3, "tables > 0"),
    ("Question-style H2s", "schema_structure", 3, "questions >= 2", "least(3, questions)"),
    ("Word count (lift-worthy range)", "content_format", 5, "words BETWEEN 1200 AND 3500",
     "CASE WHEN words BETWEEN 1200 AND 3500 THEN 5 WHEN words BETWEEN 800 AND 5000 THEN 2 ELSE 0 END"),
    ("Answer in first 60 words", "content_format", 5, "answer_words BETWEEN 15 AND 60 AND answer_closed",
     "CASE WHEN answer_words BETWEEN 15 AND 60 AND answer_closed THEN 5 WHEN answer_words >= 15 THEN 2 WHEN answer_words > 0 THEN 1 ELSE 0 END"),
    binary("TL;DR / summary block near top", "content_format", 5, "tldr"),
    binary("Bold answer in first section", "content_format", 5, "coalesce(bold, false)"),
    ("Structured lists", "content_format", 5, "lists >= 3", "least(5, lists)"),
    ("Authority outbound links", "authority", 5, "n_auth >= 2", "least(5, n_auth)"),
    ("Internal linking", "authority", 4, "n_in BETWEEN 5 AND 50", "CASE WHEN n_in BETWEEN 5 AND 50 THEN 4 WHEN n_in > 0 THEN 2 ELSE 0 END"),
    binary("Named author / byline", "authority", 5, "author IS NOT NULL"),
    ("Outbound link density", "authority", 3, "n_out BETWEEN 3 AND 30", "CASE WHEN n_out BETWEEN 3 AND 30 THEN 3 ELSE 1 END"),
    binary("Quotes & citations markup", "authority", 3, "quotes + cites > 0"),
    binary("Last modified date", "freshness", 4, "date_modified IS NOT NULL OR last_modified IS NOT NULL"),
    binary("Dated claims in body", "freshness", 3, "dated"),
    binary("Year in title", "freshness", 3, f"regexp_matches(headline, '{BEFORE}202[4-6]{AFTER}')"),
)

for _no, (_key, _signal) in enumerate(zip(SIGNAL_KEYS, SIGNALS), start=1):
    _passed, _points = _signal[3], _signal[4]
    ORACLES[f"sig_{_key}"] = f"WITH {FACTS} SELECT page_id, {_passed} AS passed, CAST({_points} AS INT) AS points FROM f"

LONG = f"""{FACTS},
s_wide AS (SELECT page_id, [{', '.join(f"{{'no': {i}, 'name': {quoted([s[0]])}, 'bucket': '{s[1]}', 'weight': {s[2]}, 'passed': {s[3]}, 'points': CAST({s[4]} AS INT)}}" for i, s in enumerate(SIGNALS, 1))}] AS signals FROM f),
s AS MATERIALIZED (SELECT page_id, unnest(signals, max_depth := 2) FROM s_wide),
scores AS (SELECT page_id, CAST(sum(points) AS INT) AS score FROM s GROUP BY page_id),
crawl AS (SELECT page_id, {d.STATUS} AS status FROM pages)
"""
# Advice is dropped only by a pass, or by the bold signal on a page without a paragraph.
ADVISED = "NOT passed AND NOT (no = 18 AND n_paras = 0)"
GRADE = "CASE " + " ".join(f"WHEN score >= {n} THEN '{g}'" for n, g in GRADE_FLOORS) + " ELSE 'F' END"
CRAWLED = "SELECT page_id, status, CASE WHEN status = 200 THEN score ELSE 0 END AS score FROM crawl JOIN scores USING (page_id)"

ORACLES |= {
    # sources and labels
    "page_source": f"SELECT page_id, url, final_url, 200 AS status, CAST(length(html) AS INT) AS html_chars, 0 AS redirect_hops FROM ({PAGES})",
    "url_normalize": """SELECT page_id, CASE WHEN starts_with(u, 'http://') OR starts_with(u, 'https://') THEN u ELSE concat('https://', u) END AS url
        FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 1 THEN upper(url) ELSE url END AS u FROM pages)""",
    "site_file_join": f"""WITH {SITES}, placed AS (SELECT page_id, {d.FINAL_URL} AS u FROM pages) SELECT {ORIGIN_OF.format('u')} AS origin, page_id, CAST(robots_status AS INT) AS robots_status,
        CAST(llms_status AS INT) AS llms_status, CAST(probe_status AS INT) AS probe_status
        FROM placed LEFT JOIN verdicts v ON v.origin = {ORIGIN_OF.format('u')}""",
    "fetch_status_note": f"""SELECT page_id, status, CASE status WHEN 404 THEN 'HTTP 404: no page at this address; check the path.'
        WHEN 401 THEN 'HTTP 401: the site refused the request (login, paywall or bot wall).'
        WHEN 403 THEN 'HTTP 403: the site refused the request (login, paywall or bot wall).'
        WHEN 429 THEN 'HTTP 429: too many requests; try again in a minute.'
        WHEN 500 THEN 'HTTP 500: the site reported an error of its own; try again later.'
        WHEN 503 THEN 'HTTP 503: the site reported an error of its own; try again later.'
        WHEN 418 THEN 'HTTP 418 Teapot' END AS note FROM (SELECT page_id, {d.STATUS} AS status FROM pages)""",
    "report_json": f"""WITH {LONG} SELECT page_id, url, x.score, CASE WHEN status = 200 THEN {GRADE.replace('score', 'x.score')} ELSE '—' END AS grade,
        CASE WHEN status = 200 THEN title END AS page_title, CASE WHEN status = 200 THEN 27 ELSE 0 END AS n_signals,
        CASE WHEN status = 200 THEN 0 ELSE 1 END AS n_notes FROM ({CRAWLED}) x JOIN f USING (page_id)""",
    "report_written": f"""WITH {LONG} SELECT url, x.score, CASE WHEN status = 200 THEN {GRADE.replace('score', 'x.score')} ELSE '—' END AS grade,
        '{FETCHED_AT}' AS fetched_at, count(*) AS n, CAST(count_if(status <> 200) AS BIGINT) AS n_without_buckets,
        CAST(count_if(status <> 200) AS BIGINT) AS n_without_signals FROM ({CRAWLED}) x JOIN f USING (page_id) GROUP BY ALL""",
    # HTML extraction
    "attribute_match": f"""WITH {BASE} SELECT page_id, {count('<link rel="canonical"')} AS n_canonical, {count('<meta name="viewport"')} AS n_viewport,
        {count('<meta property="og:')} AS n_open_graph, {count('role="heading" aria-level="2"')} AS n_role_h2 FROM c""",
    "plausible_name": f"SELECT doc_id, {plausible('text')} AS plausible FROM documents",
    "page_elements": r"""SELECT page_id, CAST(i - 1 AS INT) AS element_no, regexp_extract(t, '^<([a-z0-9]+)', 1) AS tag,
        CASE WHEN t LIKE '% href=%' THEN replace(regexp_extract(t, ' href="([^"]*)"', 1), '&amp;', '&') END AS href,
        CASE WHEN t LIKE '% class=%' THEN regexp_extract(t, ' class="([^"]*)"', 1) END AS class
        FROM (SELECT page_id, unnest(tags) AS t, generate_subscripts(tags, 1) AS i FROM (
          SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)(<script[^>]*>).*?</script>', '\1</script>', 'g'), '<[a-z][^>]*>') AS tags
          FROM (""" + PAGES + ")))",
    "tag_counts": f"WITH {BASE} SELECT page_id, tag, CAST(count(*) AS INT) AS n FROM (SELECT page_id, unnest(regexp_extract_all(p, '<([a-z][a-z0-9]*)', 1)) AS tag FROM b) GROUP BY ALL",
    "page_title": f"WITH {BASE} SELECT page_id, title AS page_title FROM c",
    "prune_boilerplate": f"""WITH {BASE} SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(html, '(?s)(<script[^>]*>).*?</script>', '\\1', 'g'), '<[a-z][^>]*>')) AS INT) AS n_before,
        CAST(len(regexp_extract_all(p, '<[a-z][^>]*>')) AS INT) AS n_after, html LIKE '%<nav>%' AS nav_before, p LIKE '%<nav>%' AS nav_after FROM b""",
    "visible_text": f"WITH {BASE} SELECT page_id, visible AS text FROM c",
    "word_count": f"WITH {BASE} SELECT page_id, CAST({words_in('visible')} AS INT) AS words FROM c",
    "document_word_count": f"SELECT doc_id, CAST({words_in('text')} AS INT) AS words FROM documents",
    "main_region": f"""WITH {BASE} SELECT page_id, 'article' AS tag, CAST(len(paras) AS INT) AS n_paragraphs,
        CAST(length(array_to_string({nodes("regexp_extract(p, '(?s)<article>(.*)</article>', 1)")}, ' ')) AS INT) AS n_chars FROM c""",
    "page_links": f"""WITH {BASE} SELECT page_id, CAST(i - 1 AS INT) AS link_no, href,
        CASE WHEN starts_with(href, 'http') THEN lower(regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) END AS host
        FROM (SELECT page_id, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS i FROM c)""",
    "js_rendered_flag": f"""WITH {BASE} SELECT *, n_scripts >= 3 AND n_paragraphs < 3 AND words < 200 AS js_rendered FROM (
        SELECT page_id, CAST({count('<script[ >]', 'html')} AS INT) AS n_scripts, CAST({count('<p[ >]')} AS INT) AS n_paragraphs,
        CAST({words_in('visible')} AS INT) AS words FROM c)""",
    # JSON-LD
    "jsonld_docs": f"""WITH {JSONLD} SELECT page_id, CAST(len(scripts) AS INT) AS n_scripts,
        CAST((SELECT count(*) FROM j_objects o WHERE o.page_id = c.page_id) AS INT) AS n_docs FROM c""",
    "jsonld_nodes": f"""WITH {JSONLD} SELECT page_id, CAST(node_no AS INT) AS node_no,
        CASE json_type(node, '$."@type"') WHEN 'ARRAY' THEN array_to_string(json_extract_string(node, '$."@type"[*]'), '+') ELSE json_extract_string(node, '$."@type"') END AS type FROM j""",
    "schema_types": f"WITH {JSONLD} SELECT page_id, type FROM j_types",
    "jsonld_author": f"WITH {JSONLD} SELECT page_id, coalesce(names_author, false) AS names_author FROM c LEFT JOIN j_page USING (page_id)",
    "jsonld_date_modified": f"WITH {JSONLD} SELECT page_id, date_modified FROM c LEFT JOIN j_page USING (page_id)",
    # authors
    "author_meta": f"WITH {BASE} SELECT page_id, {AUTHOR_META} AS found FROM c",
    "author_markup": f"WITH {BASE} SELECT page_id, {AUTHOR_MARKUP} AS found FROM c",
    "author_visible_byline": f"WITH {BASE} SELECT page_id, {AUTHOR_BYLINE} AS found FROM c",
    "author_candidate_names": f"""WITH {BASE}, found AS (
        SELECT page_id, 'meta' AS source, unnest(regexp_extract_all(p, '<meta (?:name="author"|property="article:author") content="([^"]*)"', 1)) AS candidate FROM c
        UNION SELECT page_id, 'markup', unnest(list_transform(regexp_extract_all(p, '{MARKED}', 1), lambda t: {clean('t')})) FROM c
        UNION SELECT page_id, 'byline', unnest(list_transform(list_filter({BLOCK_TEXTS}, lambda t: length(t) <= 120),
          lambda t: regexp_extract(t, '^{_BY}({_NAME}){_TAIL}', 1))) FROM c)
        SELECT *, {plausible('candidate')} AS plausible FROM found WHERE trim(candidate) <> ''""",
    "author_source": f"WITH {FACTS} SELECT page_id, author AS source FROM f",
    # site files
    "llms_verdict": f"WITH {SITES} SELECT origin, verdict FROM verdicts",
    "site_file_asof": f"""WITH page_rows AS (SELECT page_id, {d.CRAWLED_AT} AS crawled, {ORIGIN_OF.format('(' + d.FINAL_URL + ')')} AS origin FROM pages),
        one AS (WITH {SITES} SELECT origin, verdict, robots_status = 200 AS found, array_to_string(blocked, ', ') AS blocked FROM verdicts),
        two AS (WITH {_LATER} SELECT origin, verdict, robots_status = 200 AS found, array_to_string(blocked, ', ') AS blocked FROM verdicts),
        held AS (SELECT page_id, verdict, found, blocked FROM page_rows JOIN one USING (origin) WHERE crawled >= '2025-01-10' AND crawled < '2025-02-10'
          UNION ALL SELECT page_id, verdict, found, blocked FROM page_rows JOIN two USING (origin) WHERE crawled >= '2025-02-10')
        SELECT page_id, verdict AS llms_verdict, CASE WHEN found THEN true END AS robots_found, blocked FROM page_rows LEFT JOIN held USING (page_id)""",
    "looks_like_html": f"""WITH {SITES} SELECT * FROM (
        {' UNION ALL '.join(f"SELECT concat('{k} ', {d.SERVED_ORIGIN}) AS item, CASE WHEN {k}_body IS NOT NULL THEN {sniff(f'{k}_body')} END AS is_html FROM site_rows WHERE {k}_status IS NOT NULL" for k in d.SITE_FILE_KINDS)}
        UNION ALL SELECT concat('doc ', doc_id), {sniff('text')} FROM documents)""",
    "robots_blocked_bots": f"WITH {SITES} SELECT origin, array_to_string(blocked, ', ') AS blocked FROM verdicts",
    "audit_guarded": f"""WITH {LONG},
        typed AS (SELECT page_id, {d.GUARDED_URL} AS typed, {d.FINAL_URL} AS final_url,
          regexp_replace(lower(regexp_extract({d.FINAL_URL}, '^[a-z]+://([^/]*)', 1)), ':[0-9]+$', '') AS host FROM pages),
        hosts AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, min(page_id) AS host_no FROM pages GROUP BY 1),
        safe AS (SELECT t.page_id, page_id % 17 NOT IN (3, 6, 11) AND coalesce(h.host_no % 4 <> 1, false) AND coalesce(o.host_no % 4 <> 1, false) AS safe
          FROM typed t LEFT JOIN hosts h ON h.host = t.host LEFT JOIN hosts o ON o.host = regexp_extract(t.typed, '^[a-z]+://([^/]*)', 1)),
        g AS (SELECT page_id, CASE WHEN safe THEN score ELSE 0 END AS score, safe FROM scores JOIN safe USING (page_id))
        SELECT page_id, score, CASE WHEN safe THEN {GRADE} ELSE '—' END AS grade,
          CASE WHEN safe THEN '' ELSE 'Only public web pages can be scored; give a public URL.' END AS notes FROM g""",
    "audit_guarded_hops": f"""WITH {LONG},
        typed AS (SELECT page_id, {d.GUARDED_URL} AS typed, {d.FINAL_URL} AS final_url,
          regexp_replace(lower(regexp_extract({d.FINAL_URL}, '^[a-z]+://([^/]*)', 1)), ':[0-9]+$', '') AS host FROM pages),
        hosts AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, min(page_id) AS host_no FROM pages GROUP BY 1),
        safe AS (SELECT t.page_id, page_id % 17 NOT IN (3, 6, 11) AND page_id % 6 NOT IN (1, 5) AND coalesce(h.host_no % 4 <> 1, false) AND coalesce(o.host_no % 4 <> 1, false) AS safe
          FROM typed t LEFT JOIN hosts h ON h.host = t.host LEFT JOIN hosts o ON o.host = regexp_extract(t.typed, '^[a-z]+://([^/]*)', 1)),
        g AS (SELECT page_id, CASE WHEN safe THEN score ELSE 0 END AS score, safe FROM scores JOIN safe USING (page_id))
        SELECT page_id, score, CASE WHEN safe THEN {GRADE} ELSE '—' END AS grade,
          CASE WHEN safe THEN '' ELSE 'Only public web pages can be scored; give a public URL.' END AS notes FROM g""",
    "robots_block_counts": f"""WITH {SITES} SELECT bot, count(*) AS n_sites, CAST(sum(n_pages) AS BIGINT) AS n_pages
        FROM (SELECT unnest(blocked) AS bot, n_pages FROM verdicts WHERE n_pages IS NOT NULL) GROUP BY bot""",
    # scores and reports
    "signals_long": f"WITH {LONG} SELECT page_id, no AS signal_no, name, bucket, passed, weight, points FROM s",
    "signal_status": f"WITH {LONG} SELECT page_id, no AS signal_no, CASE WHEN passed THEN 'pass' WHEN points > 0 THEN 'partial' ELSE 'fail' END AS status FROM s",
    "bucket_scores": f"""WITH {LONG} SELECT page_id, bucket, CAST(sum(points) AS DOUBLE) AS earned, CAST(sum(weight) AS DOUBLE) AS max,
        round(100.0::DOUBLE * sum(points) / sum(weight), 1) AS percent FROM s GROUP BY page_id, bucket""",
    "bucket_labels": f"""WITH {LONG} SELECT bucket, CASE bucket WHEN 'schema_structure' THEN 'Schema Structure' WHEN 'content_format' THEN 'Content Format'
        ELSE concat(upper(bucket[1]), bucket[2:]) END AS label, count(DISTINCT page_id) AS n_pages, CAST(sum(points) AS BIGINT) AS earned FROM s GROUP BY bucket""",
    "page_scores": f"WITH {LONG} SELECT page_id, score FROM scores",
    "page_grades": f"WITH {LONG} SELECT page_id, score, CASE WHEN status = 200 THEN {GRADE} ELSE '—' END AS grade FROM ({CRAWLED})",
    "fixes_first10": f"""WITH {LONG} SELECT page_id, CAST(r AS INT) AS rank, name FROM (
        SELECT page_id, name, row_number() OVER (PARTITION BY page_id ORDER BY no) AS r FROM s JOIN f USING (page_id) WHERE {ADVISED}) WHERE r <= 10""",
    "top_fixes": f"""WITH {LONG} SELECT page_id, CAST(r AS INT) AS rank, name, weight FROM (
        SELECT page_id, name, weight, row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, no) AS r FROM s WHERE NOT passed) WHERE r <= 8""",
    "whats_working": f"""WITH {LONG} SELECT page_id, CAST(r AS INT) AS rank, name FROM (
        SELECT page_id, name, row_number() OVER (PARTITION BY page_id ORDER BY no) AS r FROM s WHERE passed) WHERE r <= 6""",
    "site_rollup": f"""WITH {LONG}, placed AS (SELECT page_id, score AS s, CASE WHEN status = 200 THEN score END AS score, CASE WHEN status = 200 THEN {GRADE} ELSE '—' END AS grade FROM ({CRAWLED})),
        sited AS (SELECT placed.*, regexp_replace(lower(regexp_extract({d.FINAL_URL.replace('page_id', 'pages.page_id')}, '^[a-z]+://([^/]*)', 1)), ':[0-9]+$', '') AS site
          FROM placed JOIN pages USING (page_id))
        SELECT site, grade, count(*) AS n_pages, count(score) AS n_fetched, sum(score)::BIGINT AS score_sum, min(score)::BIGINT AS lowest, max(score)::BIGINT AS highest,
          quantile_disc(score, 0.1)::BIGINT AS q10, quantile_disc(score, 0.5)::BIGINT AS q50, quantile_disc(score, 0.9)::BIGINT AS q90
        FROM sited GROUP BY GROUPING SETS ((site, grade), (site), ())""",
    "audit_stream": f"WITH {LONG} SELECT page_id, score FROM scores",
    "audit_incremental": f"WITH {LONG} SELECT page_id, score, CASE WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 THEN 1 ELSE 2 END AS parsed_in FROM scores",
    "score_gate": f"WITH {LONG} SELECT page_id, CASE WHEN score >= 50 THEN 0 ELSE 1 END AS gate FROM ({CRAWLED})",
    "score_band": f"WITH {LONG} SELECT page_id, CASE WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'warn' ELSE 'danger' END AS tone FROM scores",
    "score_report": f"""WITH {LONG},
        wide AS (SELECT page_id, {', '.join(f"CAST(sum(points) FILTER (bucket = '{b}') AS INT) AS {b}" for b in BUCKET_CAPS)},
          CAST(least(10, count(*) FILTER ({ADVISED})) AS INT) AS n_fixes FROM s JOIN f USING (page_id) GROUP BY page_id)
        SELECT page_id, url, x.score, CASE WHEN status = 200 THEN {GRADE.replace('score', 'x.score')} ELSE '—' END AS grade, '{FETCHED_AT}' AS fetched_at,
        CASE WHEN status = 200 THEN title END AS page_title, {', '.join(f"CASE WHEN status = 200 THEN {b} END AS {b}" for b in BUCKET_CAPS)},
        CASE WHEN status = 200 THEN 27 ELSE 0 END AS n_signals, CASE WHEN status = 200 THEN n_fixes ELSE 0 END AS n_fixes,
        CASE WHEN status = 200 THEN 0 ELSE 1 END AS n_notes FROM ({CRAWLED}) x JOIN f USING (page_id) JOIN wide USING (page_id)""",
}

# --- rate limits ---------------------------------------------------------------------

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def address(text: str) -> str:
    """Valid address or NULL: dotted quads, and the short IPv6 form the log uses."""
    return rf"CASE WHEN regexp_matches({text}, '^{_OCTET}(\.{_OCTET}){{3}}$|^2001:db8::[0-9a-f]$') THEN {text} END"


LOG = f"""
log0 AS (SELECT event_id AS request_id, ts, trim(split_part({d.FORWARDED_FOR}, ',', 1)) AS xff, {d.REAL_IP} AS xri, {d.PATH} AS path,
  CAST(floor(epoch(ts)) AS BIGINT) AS second FROM events),
log AS MATERIALIZED (SELECT *, coalesce({address('xff')}, {address('xri')}) AS client_ip, second // 60 AS minute_bucket, second // 86400 AS day_bucket FROM log0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY client_ip, minute_bucket ORDER BY ts, request_id) AS minute_count,
  row_number() OVER (PARTITION BY client_ip, day_bucket ORDER BY ts, request_id) AS day_count FROM log WHERE client_ip IS NOT NULL),
decided AS (
  SELECT request_id, path, minute_count <= {PER_MINUTE} AND day_count <= {PER_DAY} AS allowed, true AS enforced,
    CAST(greatest(CASE WHEN minute_count > {PER_MINUTE} THEN 60 - second % 60 ELSE 0 END,
                  CASE WHEN day_count > {PER_DAY} THEN 86400 - second % 86400 ELSE 0 END) AS INT) AS retry_after FROM numbered
  UNION ALL SELECT request_id, path, true, false, 0 FROM log WHERE client_ip IS NULL)
"""
URL_PARAM = (
    r"nullif(url_decode(replace(regexp_extract(path, '[?&]url=([^&#]+)', 1), '+', ' ')), '')"
)

ORACLES |= {
    "request_outcome": f"""WITH {LOG} SELECT request_id, status, CASE WHEN status = 429 THEN retry_after END AS retry_after, CASE WHEN status = 200 THEN 600 END AS max_age
        FROM (SELECT *, CASE WHEN NOT allowed THEN 429 WHEN {URL_PARAM} IS NULL THEN 400 ELSE 200 END AS status FROM decided)""",
    "request_url_param": f"WITH {LOG} SELECT request_id, {URL_PARAM} AS url FROM log",
    "client_ip": f"WITH {LOG} SELECT request_id, client_ip FROM log",
    "minute_counts": f"WITH {LOG} SELECT client_ip, minute_bucket, count(*) AS n FROM log WHERE client_ip IS NOT NULL GROUP BY ALL",
    "day_counts": f"WITH {LOG} SELECT client_ip, day_bucket, count(*) AS n FROM log WHERE client_ip IS NOT NULL GROUP BY ALL",
    "request_ordinals": f"WITH {LOG} SELECT request_id, client_ip, minute_count, day_count FROM numbered",
    "rate_limit_decisions": f"WITH {LOG} SELECT request_id, allowed, enforced FROM decided",
    "limit_caps": f"""WITH {LOG}, c AS (SELECT * FROM (VALUES ('1/3', 1, 3), ('2/many', 20, 200), ('0/-5', 1, 1), (' 4 /2', 4, 2), ('/', 20, 200)) v(config, m, d))
        SELECT config, count_if(minute_count > m OR day_count > d)::BIGINT AS blocked FROM c, numbered GROUP BY config""",
    "retry_after": f"WITH {LOG} SELECT request_id, retry_after FROM decided",
    "rate_limit_unidentified": f"WITH {LOG} SELECT request_id, true AS allowed, false AS enforced FROM log WHERE client_ip IS NULL",
    "retry_label": f"""WITH {LOG} SELECT request_id, CASE WHEN retry_after < 60 THEN concat(retry_after, 's')
        WHEN retry_after < 3600 THEN concat((retry_after + 59) // 60, ' min') ELSE concat((retry_after + 3599) // 3600, ' h') END AS wait
        FROM decided WHERE NOT allowed""",
    "limiter_outcome": f"""WITH {LOG}, store AS (SELECT event_id AS request_id, {d.STORE_CONFIGURED} AS configured, {d.STORE_STATUS} AS status, {d.STORE_PARSED} AS parsed FROM events),
        labelled AS (SELECT request_id, CASE WHEN NOT configured THEN 'unconfigured' WHEN client_ip IS NULL THEN 'unidentified' WHEN status IS NULL THEN 'unreachable'
          WHEN status IN (403, 429) THEN 'drained' WHEN status >= 400 THEN 'store_error' WHEN NOT parsed THEN 'unreadable' ELSE 'counted' END AS label
          FROM store JOIN log USING (request_id))
        SELECT request_id, label, CASE label WHEN 'counted' THEN NULL WHEN 'drained' THEN false ELSE true END AS allowed,
        CASE label WHEN 'drained' THEN 60 ELSE 0 END AS retry_after_seconds, label IN ('counted', 'drained') AS enforced FROM labelled""",
    "rate_limit_stream": f"WITH {LOG} SELECT request_id, allowed, retry_after AS retry_after_seconds, enforced, false AS late FROM decided",
    "rate_limit_stream_shuffled": f"WITH {LOG} SELECT request_id, allowed, retry_after AS retry_after_seconds, enforced, false AS late FROM decided",
    "late_split_stream": f"""WITH {LOG}, delivered AS (
        SELECT client_ip, minute_bucket * 60 AS window_start, epoch_ms(log.ts) AS ms, {d.DELIVERY.replace("ts", "events.ts")} AS delivery
        FROM log JOIN events ON event_id = request_id WHERE client_ip IS NOT NULL),
        newest AS (SELECT delivery, max(ms) AS ms FROM delivered GROUP BY delivery),
        watermark AS (SELECT a.delivery, max(b.ms) - 2 * 86400000 AS ms FROM newest a JOIN newest b ON b.delivery < a.delivery GROUP BY a.delivery),
        judged AS (SELECT client_ip, window_start, (window_start + 60) * 1000 <= coalesce(w.ms, 0) AS late FROM delivered LEFT JOIN watermark w USING (delivery))
        SELECT client_ip, window_start, count_if(NOT late)::BIGINT AS n, count_if(late)::BIGINT AS n_late FROM judged GROUP BY ALL""",
    "minute_counts_stream": f"WITH {LOG} SELECT client_ip, minute_bucket * 60 AS window_start, count(*) AS n FROM log WHERE client_ip IS NOT NULL GROUP BY ALL",
}

# --- URL safety -------------------------------------------------------------------------

_BLOCKS = [(0, 8), (10, 8), (0x64400000, 10), (127, 8), (0xA9FE0000, 16), (0xAC100000, 12), (0xC0000000, 24), (0xC0A80000, 16), (0xC6120000, 15), (224, 4), (240, 4)]


def blocked_number(n: str) -> str:
    """32-bit address in one of the IPv4 networks, by integer comparison."""
    tests = []
    for start, bits in _BLOCKS:
        low = start << 24 if start < 256 else start
        tests.append(f"{n} BETWEEN {low} AND {low + (1 << (32 - bits)) - 1}")
    return "(" + " OR ".join(tests) + ")"


def quad_number(text: str) -> str:
    return " + ".join(f"CAST(split_part({text}, '.', {i}) AS BIGINT) * {1 << (32 - 8 * i)}" for i in range(1, 5))


HOSTS = f"""
urls AS (SELECT event_id AS frontier_id, {d.FETCH_ID} AS fetch_id, {d.HOP_NO} AS hop_no, {d.FRONTIER_URL} AS url FROM events),
parts AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS authority FROM urls),
hosts AS (SELECT *, CASE WHEN contains(authority, '[') <> contains(authority, ']') THEN NULL
    ELSE nullif(rtrim(lower(regexp_replace(CASE WHEN contains(authority, '[') THEN regexp_extract(authority, '\\[([^\\]]*)\\]', 1)
      ELSE regexp_replace(authority, '^.*@', '') END, CASE WHEN contains(authority, '[') THEN 'x^' ELSE ':.*$' END, '')), '.'), '') END AS host FROM parts),
dns_rows AS (SELECT {d._HOST} AS host, {d.DNS_IP} AS ip FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([0, 1, 2]) AS k) WHERE k < {d.DNS_ANSWERS}),
dns_hosts AS (SELECT host, count(*) AS answers, min(ip) AS lowest,
    bool_and(CASE WHEN ip = 'bad-answer' THEN false ELSE NOT {blocked_number(f"({quad_number('ip')})")} END) AS host_safe FROM dns_rows GROUP BY host),
judged AS MATERIALIZED (SELECT h.*, CASE WHEN scheme NOT IN ('http', 'https') OR h.host IS NULL THEN false
    WHEN h.host IN ('localhost', 'metadata') OR regexp_matches(h.host, '\\.(internal|local|localhost|intranet|corp|home|lan)$') THEN false
    WHEN regexp_matches(h.host, '^[0-9.]+$') THEN NOT {blocked_number(f"({quad_number('h.host')})")}
    WHEN starts_with(h.host, '::ffff:') THEN NOT {blocked_number(f"({quad_number('h.host[8:]')})")}
    WHEN contains(h.host, ':') THEN NOT regexp_matches(h.host, '^(f[cd]|fe[89ab]|ff)|^::1?$')
    ELSE coalesce(host_safe, false) END AS safe, answers, lowest FROM hosts h LEFT JOIN dns_hosts USING (host))
"""

ORACLES |= {
    "url_parts": f"WITH {HOSTS} SELECT frontier_id, scheme, authority, host FROM hosts",
    "url_scheme_allowed": f"WITH {HOSTS} SELECT frontier_id, scheme IN ('http', 'https') AS allowed FROM hosts",
    "host_denied": f"""WITH {HOSTS} SELECT frontier_id, coalesce(host IN ('localhost', 'metadata')
        OR regexp_matches(host, '\\.(internal|local|localhost|intranet|corp|home|lan)$'), false) AS denied FROM hosts""",
    "ip_blocked": f"SELECT event_id, {d.quad(d.ADDRESS)} AS ip, {blocked_number(f'({d.ADDRESS})')} AS blocked FROM events",
    "ip_blocked_by_table": f"""WITH named AS (SELECT {d.NETWORK_ADDRESS} AS n, {d.NETWORK_BITS} AS bits FROM events WHERE event_id % 10 = 0),
        nets AS (SELECT DISTINCT n - n % (1::BIGINT << (32 - bits)) AS low, n - n % (1::BIGINT << (32 - bits)) + (1::BIGINT << (32 - bits)) - 1 AS high FROM named),
        a AS (SELECT event_id, {d.quad(d.ADDRESS)} AS ip, {d.ADDRESS} AS n FROM events)
        SELECT event_id, ip, {blocked_number("n")} OR EXISTS (SELECT 1 FROM nets WHERE n BETWEEN low AND high) AS blocked FROM a""",
    "redirect_chains": f"""WITH RECURSIVE {HOSTS}, edges AS (SELECT e.event_id, {d.REDIRECT_FROM.replace("event_id", "e.event_id")} AS f, {d.REDIRECT_TO.replace("event_id", "e.event_id").replace("user_id", "e.user_id")} AS t,
          coalesce(x.host_safe, false) AS f_safe, CASE e.event_id % 10 WHEN 7 THEN j.safe WHEN 6 THEN coalesce(x.host_safe, false)
            WHEN 9 THEN coalesce(w.host_safe, false) ELSE coalesce(y.host_safe, false) END AS t_safe
          FROM events e JOIN judged j ON j.frontier_id = e.event_id LEFT JOIN dns_hosts x ON x.host = concat('h', e.event_id % 97, '.example.net')
          LEFT JOIN dns_hosts y ON y.host = concat('h', (e.event_id + 1) % 97, '.example.net') LEFT JOIN dns_hosts w ON w.host = concat('h', (e.event_id - 1) % 97, '.example.net')),
        walk AS (SELECT f AS start, t AS place, 1 AS n, CASE WHEN NOT f_safe THEN 0 WHEN NOT t_safe THEN 1 END AS unsafe_at FROM edges
          UNION ALL SELECT start, t, n + 1, coalesce(unsafe_at, CASE WHEN NOT t_safe THEN n + 1 END) FROM walk JOIN edges ON f = place WHERE n < 14),
        far AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY start ORDER BY n DESC) = 1)
        SELECT start AS url, CASE WHEN n < 14 THEN place END AS final_url, CASE WHEN n < 14 THEN n END AS n_hops, n = 14 AS loops,
          n < 14 AND unsafe_at IS NULL AS safe, unsafe_at AS first_unsafe_hop FROM far""",
    "host_ips": f"""WITH {HOSTS} SELECT frontier_id, host, literal, CASE WHEN literal THEN 1 ELSE coalesce(answers, 0) END AS n_ips,
        CASE WHEN literal THEN host ELSE lowest END AS lowest_ip
        FROM (SELECT *, regexp_matches(host, '^[0-9.]+$') OR contains(host, ':') AS literal FROM judged) WHERE scheme IN ('http', 'https') AND host IS NOT NULL""",
    "host_dns_verdict": f"WITH {HOSTS} SELECT host, answers, host_safe FROM dns_hosts",
    "url_safety": f"WITH {HOSTS} SELECT frontier_id, url, safe, NOT safe AS refused FROM judged",
    "redirect_chain_safety": f"""WITH {HOSTS} SELECT fetch_id, bool_and(safe) AS safe, CAST(min(hop_no) FILTER (NOT safe) AS INT) AS first_unsafe_hop, count(*) AS n_hops
        FROM judged GROUP BY fetch_id""",
    "frontier_safe_only": f"WITH {HOSTS} SELECT frontier_id, url FROM judged WHERE safe",
}
