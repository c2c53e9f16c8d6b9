"""Every query by key: `(spark, folder of tables) -> DataFrame`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.functions import jsonld
from sitegauge.functions.ip import in_networks, ip_bytes
from sitegauge.functions.text import word_count
from sitegauge.functions.urls import hostname, netloc, normalize_url, origin
from sitegauge.operators import authors, elements as el, ratelimit as rl, redirects, safety, sitefiles
from sitegauge.operators.joins import left_join_lookup
from sitegauge.operators.networks import flag_networks
from sitegauge.plans import audit as plan, incremental, reports, rollup
from sitegauge.schema import BUCKET_CAPS
from sitegauge.sources import derived
from sitegauge.sources.pages import fetch_note, page_source, read_table, spread
from sitegauge.sources.sinks import write_reports
from sitegauge.streaming import audit as live_audit, limits
from sitegauge.streaming.folders import run_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Caps low enough to bite on the given log; the defaults never trigger there.
PER_MINUTE, PER_DAY = 1, 3
FETCHED_AT = "2025-01-01T00:00:00Z"


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# --- inputs -----------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str, key: str | None = None) -> DataFrame:
    """A given table; with a key, spread over all cores where it is stored in one piece."""
    scan = read_table(spark, f"{folder}/{name}.parquet")
    return spread(scan, key) if key else scan


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return derived.decorated_pages(table(spark, folder, "pages", "page_id"))


def site_files(spark: SparkSession, folder: str) -> DataFrame:
    return derived.site_files(table(spark, folder, "pages"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events", "event_id")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return derived.request_log(events(spark, folder))


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    return plan.parsed_pages(pages(spark, folder))


def arrays(spark: SparkSession, folder: str) -> DataFrame:
    return plan.page_arrays(parsed(spark, folder))


def facts(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "pages", "page_id")
    return plan.page_facts(derived.decorated_pages(raw), derived.site_files(raw))


def audit(spark: SparkSession, folder: str) -> DataFrame:
    return plan.audit_facts(facts(spark, folder), FETCHED_AT)


def crawl_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Audit of a crawl in which some fetches failed."""
    raw = table(spark, folder, "pages", "page_id")
    return plan.audit_pages(derived.crawled_pages(raw), derived.site_files(raw), fetched_at=FETCHED_AT)


@query
def audit_guarded(spark, folder):
    """Audit of a crawl in which some addresses are not public."""
    raw = table(spark, folder, "pages", "page_id")
    pages = derived.decorated_pages(raw).withColumn("url", F.expr(derived.GUARDED_URL))
    audited = plan.audit_pages(pages, derived.site_files(raw), dns=derived.site_dns(raw), fetched_at=FETCHED_AT)
    return audited.select("page_id", "score", "grade", F.array_join("notes", " ").alias("notes"))


@query
def audit_guarded_hops(spark, folder):
    """Audit of a crawl in which some pages were reached over redirects that are not public, or that never end."""
    raw = table(spark, folder, "pages", "page_id")
    pages = derived.decorated_pages(raw).withColumn("url", F.expr(derived.HOP_URL))
    audited = plan.audit_pages(
        pages, derived.site_files(raw), dns=derived.site_dns(raw), redirects=derived.page_redirects(raw), fetched_at=FETCHED_AT
    )
    return audited.select("page_id", "score", "grade", F.array_join("notes", " ").alias("notes"))


# --- sources and labels -----------------------------------------------------------


@query
def page_source_rows(spark, folder):
    return page_source(pages(spark, folder)).select(
        "page_id", "url", "final_url", "status", F.length("html").alias("html_chars"), "redirect_hops"
    )


QUERIES["page_source"] = QUERIES.pop("page_source_rows")


@query
def url_normalize(spark, folder):
    raw = table(spark, folder, "pages")
    typed = F.expr("CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 1 THEN upper(url) ELSE url END")
    return raw.select("page_id", normalize_url(typed).alias("url"))


@query
def site_file_join(spark, folder):
    raw = table(spark, folder, "pages")
    keyed = raw.select("page_id", origin(F.expr(derived.FINAL_URL)).alias("origin"))
    statuses = sitefiles.pivot_site_files(derived.site_files(raw))
    return left_join_lookup(keyed, statuses, "origin", "page_id")


@query
def site_file_asof(spark, folder):
    """Evidence as it held when each page was crawled, from two crawls of the site files."""
    raw = table(spark, folder, "pages")
    at = F.to_timestamp(F.concat(F.expr(derived.CRAWLED_AT), F.lit("+00:00")))
    keyed = raw.select("page_id", origin(F.expr(derived.FINAL_URL)).alias("origin"), at.alias("crawled_at"))
    judged = plan.attach_site_evidence(keyed, derived.crawled_site_files(raw))
    return judged.select("page_id", "llms_verdict", "robots_found", F.array_join("blocked_bots", ", ").alias("blocked"))


@query
def fetch_status_note(spark, folder):
    crawled = page_source(derived.crawled_pages(table(spark, folder, "pages")))
    note = fetch_note(F.col("status"), F.col("reason"), F.col("fetch_error"))
    return crawled.select("page_id", "status", note.alias("note"))


@query
def report_json(spark, folder):
    docs = reports.json_reports(crawl_audit(spark, folder))

    def read(path):
        return F.get_json_object("report", path)

    return docs.select(
        "page_id",
        read("$.url").alias("url"),
        read("$.score").cast("int").alias("score"),
        read("$.grade").alias("grade"),
        read("$.page_title").alias("page_title"),
        F.json_array_length(read("$.signals")).alias("n_signals"),
        F.json_array_length(read("$.notes")).alias("n_notes"),
    )


@query
def report_written(spark, folder):
    """Reports through the JSON sink and back."""
    out = run_folder(spark, "reports")
    write_reports(crawl_audit(spark, folder), out)
    # All that is missing from a report must show: the fields are typed here, not guessed.
    written = spark.read.schema("url STRING, score INT, grade STRING, fetched_at STRING, bucket_scores STRING, signals STRING").json(out)
    return written.groupBy("url", "score", "grade", "fetched_at").agg(
        F.count("*").alias("n"), F.sum((F.col("bucket_scores") == "{}").cast("int")).alias("n_without_buckets"),
        F.sum((F.col("signals") == "[]").cast("int")).alias("n_without_signals"),
    )


@query
def request_outcome(spark, folder):
    limited = rl.rate_limit(requests(spark, folder), PER_MINUTE, PER_DAY)
    status = rl.request_outcome(F.col("allowed"), rl.query_parameter(F.col("path"), "url"))
    return limited.select(
        "request_id",
        status.alias("status"),
        F.when(status == 429, F.col("retry_after_seconds")).alias("retry_after"),
        F.when(status == 200, rl.CACHE_SECONDS).alias("max_age"),
    )


@query
def request_url_param(spark, folder):
    return requests(spark, folder).select(
        "request_id", rl.query_parameter(F.col("path"), "url").alias("url")
    )


# --- HTML extraction ----------------------------------------------------------------


@query
def page_elements(spark, folder):
    rows = parsed(spark, folder).select("page_id", F.posexplode("dom.elements").alias("element_no", "e"))
    return rows.select(
        "page_id",
        "element_no",
        "e.tag",
        el.attr(F.col("e"), "href").alias("href"),
        el.attr(F.col("e"), "class").alias("class"),
    )


@query
def tag_counts(spark, folder):
    """Row-local census: a page's elements never leave its row."""
    tags = arrays(spark, folder).select("page_id", F.transform("live", lambda e: e["tag"]).alias("tags"))
    counts = F.transform(
        F.array_distinct("tags"),
        lambda t: F.struct(t.alias("tag"), F.size(F.filter("tags", lambda x: x == t)).alias("n")),
    )
    return tags.select("page_id", F.explode(counts).alias("c")).select("page_id", "c.*")


@query
def page_title(spark, folder):
    return arrays(spark, folder).select("page_id", "page_title")


@query
def prune_boilerplate(spark, folder):
    return arrays(spark, folder).select(
        "page_id",
        F.size("elements").alias("n_before"),
        F.size("live").alias("n_after"),
        F.exists("elements", lambda e: e["tag"] == "nav").alias("nav_before"),
        F.exists("live", lambda e: e["tag"] == "nav").alias("nav_after"),
    )


@query
def visible_text(spark, folder):
    return arrays(spark, folder).select("page_id", F.col("visible").alias("text"))


QUERIES["word_count"] = lambda spark, folder: arrays(spark, folder).select(
    "page_id", el.visible_words(F.col("texts")).alias("words")
)


@query
def document_word_count(spark, folder):
    """The word rule over plain documents."""
    return table(spark, folder, "documents").select("doc_id", word_count(F.col("text")).alias("words"))


@query
def attribute_match(spark, folder):
    """How many elements match by attribute: a token of `rel`, a name, a prefix of a property, a role with its level."""
    live = F.col("live")

    def matching(rule):
        return F.size(F.filter(live, lambda e: F.coalesce(rule(e), F.lit(False))))

    return arrays(spark, folder).select(
        "page_id",
        matching(lambda e: (e["tag"] == "link") & el.has_token(el.attr(e, "rel"), "canonical")).alias("n_canonical"),
        matching(lambda e: (e["tag"] == "meta") & (el.attr(e, "name") == "viewport")).alias("n_viewport"),
        matching(lambda e: (e["tag"] == "meta") & el.attr(e, "property").startswith("og:")).alias("n_open_graph"),
        matching(lambda e: (el.attr(e, "role") == "heading") & (el.attr(e, "aria-level") == "2")).alias("n_role_h2"),
    )


@query
def plausible_name(spark, folder):
    """The name test over plain documents, whole."""
    return table(spark, folder, "documents").select("doc_id", authors.plausible_name(F.col("text")).alias("plausible"))


@query
def main_region(spark, folder):
    texts = F.col("texts")
    return arrays(spark, folder).select(
        "page_id", F.col("region.tag").alias("tag"), F.size("paragraphs").alias("n_paragraphs"),
        F.length(el.spaced_text(texts, F.col("region"))).alias("n_chars"),
    )


@query
def page_links(spark, folder):
    rows = arrays(spark, folder).select("page_id", F.posexplode("links").alias("link_no", "k"))
    return rows.select("page_id", "link_no", "k.href", "k.host")


@query
def js_rendered_flag(spark, folder):
    return rendered_in_browser(arrays(spark, folder))


def rendered_in_browser(arrays: DataFrame) -> DataFrame:
    """Page that seems to be built in the browser: many scripts, little text."""
    return arrays.select(
        "page_id",
        el.count_tagged(F.col("elements"), "script").alias("n_scripts"),
        el.count_tagged(F.col("live"), "p").alias("n_paragraphs"),
        el.visible_words(F.col("texts")).alias("words"),
    ).withColumn(
        "js_rendered", (F.col("n_scripts") >= 3) & (F.col("n_paragraphs") < 3) & (F.col("words") < 200)
    )


# --- JSON-LD --------------------------------------------------------------------------


@query
def jsonld_docs(spark, folder):
    scripts = el.jsonld_scripts(F.col("dom.elements"), F.col("dom.texts"))
    return parsed(spark, folder).select(
        "page_id", F.size(scripts).alias("n_scripts"), F.size(jsonld.documents(scripts)).alias("n_docs")
    )


@query
def jsonld_nodes(spark, folder):
    rows = arrays(spark, folder).select("page_id", F.posexplode("nodes").alias("node_no", "node"))
    return rows.select(
        "page_id",
        "node_no",
        F.coalesce(
            F.array_join(F.try_variant_get("node", "$['@type']", "array<string>"), "+"),
            F.try_variant_get("node", "$['@type']", "string"),
        ).alias("type"),
    )


@query
def schema_types(spark, folder):
    rows = arrays(spark, folder).select("page_id", F.explode(jsonld.types(F.col("nodes"))).alias("type"))
    return rows


@query
def jsonld_author(spark, folder):
    return arrays(spark, folder).select("page_id", jsonld.names_author(F.col("nodes")).alias("names_author"))


@query
def jsonld_date_modified(spark, folder):
    return arrays(spark, folder).select(
        "page_id", jsonld.first_date_modified(F.col("nodes")).alias("date_modified")
    )


# --- signals ----------------------------------------------------------------------------

SIGNAL_KEYS = (
    "https canonical viewport open_graph llms_txt robots_ai article_schema faq_schema howto_schema "
    "breadcrumb_schema heading_structure definition_lists tables question_h2s word_count first_answer tldr "
    "bold_answer lists authority_links internal_links author_byline outbound_density quotes last_modified "
    "dated_claims year_in_title"
).split()


def _signal_query(no: int) -> Query:
    needs_sites = no in (5, 6)

    def build(spark: SparkSession, folder: str) -> DataFrame:
        rows = facts(spark, folder) if needs_sites else plan.page_facts(pages(spark, folder))
        return plan.single_signal(rows, no).select("page_id", "s.passed", "s.points")

    return build


for _no, _key in enumerate(SIGNAL_KEYS, start=1):
    QUERIES[f"sig_{_key}"] = _signal_query(_no)


# --- authors ------------------------------------------------------------------------------


@query
def author_meta(spark, folder):
    return arrays(spark, folder).select("page_id", authors.meta_author(F.col("live")).alias("found"))


@query
def author_markup(spark, folder):
    return arrays(spark, folder).select("page_id", authors.markup_author(F.col("author_texts")).alias("found"))


@query
def author_visible_byline(spark, folder):
    return arrays(spark, folder).select("page_id", authors.visible_byline(F.col("block_texts")).alias("found"))


@query
def author_candidate_names(spark, folder):
    """The name test over every author candidate of a page, whole: meta values, marked texts, names in bylines."""
    found = {
        "meta": authors.meta_values(F.col("live")),
        "markup": F.col("author_texts"),
        "byline": authors.byline_names(F.col("block_texts")),
    }
    listed = [
        F.transform(texts, lambda t: F.struct(F.lit(source).alias("source"), t.alias("candidate")))
        for source, texts in found.items()
    ]
    rows = arrays(spark, folder).select("page_id", F.inline(F.array_distinct(F.concat(*listed))))
    return rows.withColumn("plausible", authors.plausible_name(F.col("candidate")))


@query
def author_source(spark, folder):
    return plan.page_facts(pages(spark, folder)).select("page_id", F.col("author_source").alias("source"))


# --- site files ------------------------------------------------------------------------------


@query
def llms_verdict(spark, folder):
    return sitefiles.site_verdicts(site_files(spark, folder)).select("origin", F.col("llms_verdict").alias("verdict"))


@query
def looks_like_html(spark, folder):
    """The markup sniff over site files and plain documents."""
    files = site_files(spark, folder).select(
        F.concat_ws(" ", "kind", "origin").alias("item"), F.col("body").alias("text")
    )
    docs = table(spark, folder, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("item"), "text"
    )
    bodies = files.unionByName(docs)
    return bodies.select("item", sitefiles.looks_like_html(F.col("text")).alias("is_html"))


@query
def robots_blocked_bots(spark, folder):
    return sitefiles.site_verdicts(site_files(spark, folder)).select(
        "origin", F.array_join("blocked_bots", ", ").alias("blocked")
    )


@query
def robots_block_counts(spark, folder):
    """Pages each crawler is shut out of. Pages are counted per site first, then joined."""
    raw = table(spark, folder, "pages")
    per_site = raw.groupBy(origin(F.expr(derived.FINAL_URL)).alias("origin")).agg(F.count("*").alias("n"))
    verdicts = sitefiles.site_verdicts(derived.site_files(raw)).select("origin", "blocked_bots")
    rows = per_site.join(verdicts, "origin").select(F.explode("blocked_bots").alias("bot"), "n")
    return rows.groupBy("bot").agg(F.count("*").alias("n_sites"), F.sum("n").alias("n_pages"))


# --- URL safety -------------------------------------------------------------------------------


def frontier(spark: SparkSession, folder: str) -> DataFrame:
    return derived.frontier(events(spark, folder))


def dns(spark: SparkSession, folder: str) -> DataFrame:
    return derived.dns(events(spark, folder))


@query
def url_parts(spark, folder):
    return safety.url_parts(frontier(spark, folder)).select("frontier_id", "scheme", "authority", "host")


@query
def url_scheme_allowed(spark, folder):
    return frontier(spark, folder).select("frontier_id", safety.scheme_allowed(F.col("url")).alias("allowed"))


@query
def host_denied(spark, folder):
    host = safety.normal_host(hostname(netloc(F.col("url"))))
    return frontier(spark, folder).select(
        "frontier_id", F.coalesce(safety.host_denied(host), F.lit(False)).alias("denied")
    )


@query
def ip_blocked(spark, folder):
    quad = F.expr(derived.quad(derived.ADDRESS))
    return events(spark, folder).select(
        "event_id", quad.alias("ip"), in_networks(ip_bytes(quad)).alias("blocked")
    )


@query
def ip_blocked_by_table(spark, folder):
    """Addresses against networks that come as a table: the constant ones and some thousand others that overlap."""
    rows = events(spark, folder).select("event_id", F.expr(derived.quad(derived.ADDRESS)).alias("ip"))
    judged = flag_networks(rows.withColumn("address", ip_bytes(F.col("ip"))), "address", derived.networks(events(spark, folder)), "blocked")
    return judged.drop("address")


@query
def redirect_chains(spark, folder):
    """Chains followed from single redirects, and whether they stay public."""
    return redirects.redirect_chains(derived.redirects(events(spark, folder)), dns(spark, folder))


@query
def host_ips(spark, folder):
    """Addresses to judge per URL: a literal host is its own only address, else its DNS answers.

    Answers are counted per host before the join: a URL never fans out to its host's answers.
    """
    local = safety.local_verdicts(frontier(spark, folder)).where(
        F.col("scheme").isin("http", "https") & F.col("host").isNotNull()
    )
    answers = dns(spark, folder).groupBy(F.col("host").alias("dns_host")).agg(
        F.count("*").alias("answers"), F.min("ip").alias("lowest")
    )
    literal = F.col("address").isNotNull()
    joined = left_join_lookup(
        local.withColumn("dns_host", F.when(~literal, F.col("host"))), answers, "dns_host", "frontier_id"
    )
    return joined.select(
        "frontier_id",
        "host",
        literal.alias("literal"),
        F.when(literal, F.lit(1)).otherwise(F.coalesce("answers", F.lit(0))).cast("bigint").alias("n_ips"),
        F.when(literal, F.col("host")).otherwise(F.col("lowest")).alias("lowest_ip"),
    )


@query
def host_dns_verdict(spark, folder):
    return safety.host_verdicts(dns(spark, folder))


@query
def url_safety(spark, folder):
    return safety.url_verdicts(frontier(spark, folder), dns(spark, folder), "frontier_id").select(
        "frontier_id", "url", "safe", F.col("reason").isNotNull().alias("refused")
    )


@query
def redirect_chain_safety(spark, folder):
    return safety.chain_verdicts(derived.hops(events(spark, folder)), dns(spark, folder))


@query
def frontier_safe_only(spark, folder):
    return safety.safe_only(frontier(spark, folder), dns(spark, folder), "frontier_id")


# --- scores and reports -----------------------------------------------------------------------


@query
def signals_long(spark, folder):
    return reports.signal_rows(audit(spark, folder)).select(
        "page_id", "signal_no", "name", "bucket", "passed", "weight", "points"
    )


@query
def signal_status(spark, folder):
    return reports.signal_rows(audit(spark, folder)).select("page_id", "signal_no", "status")


@query
def bucket_scores(spark, folder):
    return reports.bucket_table(audit(spark, folder)).drop("label")


@query
def bucket_labels(spark, folder):
    return (
        reports.bucket_table(audit(spark, folder))
        .groupBy("bucket", "label")
        .agg(F.count("*").alias("n_pages"), F.sum("earned").cast("bigint").alias("earned"))
    )


@query
def page_scores(spark, folder):
    return audit(spark, folder).select("page_id", "score")


@query
def page_grades(spark, folder):
    return crawl_audit(spark, folder).select("page_id", "score", "grade")


@query
def fixes_first10(spark, folder):
    named = F.filter("signals", lambda s: s["fix"].isNotNull())
    rows = audit(spark, folder).select("page_id", F.posexplode(F.slice(named, 1, 10)).alias("i", "s"))
    return rows.select("page_id", (F.col("i") + 1).alias("rank"), "s.name")


@query
def top_fixes(spark, folder):
    return reports.top_fixes(audit(spark, folder)).select("page_id", "rank", "name", "weight")


@query
def whats_working(spark, folder):
    return reports.whats_working(audit(spark, folder)).select("page_id", "rank", "name")


@query
def score_gate(spark, folder):
    return reports.gate_table(crawl_audit(spark, folder)).select("page_id", "gate")


@query
def score_band(spark, folder):
    return reports.gate_table(audit(spark, folder)).select("page_id", "tone")


@query
def score_report(spark, folder):
    return crawl_audit(spark, folder).select(
        "page_id",
        "url",
        "score",
        "grade",
        "fetched_at",
        "page_title",
        *[F.col("bucket_scores")[b]["earned"].cast("int").alias(b) for b in BUCKET_CAPS],
        F.size("signals").alias("n_signals"),
        F.size("fixes").alias("n_fixes"),
        F.size("notes").alias("n_notes"),
    )


@query
def site_rollup(spark, folder):
    """Pages and scores per site, per site and grade, and over all, with quantiles from sketches."""
    rows = rollup.site_rollup(crawl_audit(spark, folder))
    quantiles = [rollup.quantile(F.col("sketch"), F.col("n_fetched"), q).alias(f"q{round(100 * q)}") for q in rollup.QUANTILES]
    return rows.select("site", "grade", "n_pages", "n_fetched", "score_sum", "lowest", "highest", *quantiles)


@query
def audit_incremental(spark, folder):
    """A second audit after a first one that saw two pages in three, some of them with other text: only the rest is parsed."""
    raw, store = table(spark, folder, "pages", "page_id"), run_folder(spark, "incremental")
    full, files = derived.decorated_pages(raw), derived.site_files(raw)
    earlier = full.where("page_id % 3 <> 0").withColumn("html", F.expr("CASE WHEN page_id % 5 = 0 THEN concat(html, ' and more') ELSE html END"))
    incremental.incremental_audit(earlier, files, store, fetched_at=FETCHED_AT)
    return incremental.incremental_audit(full, files, store, fetched_at=FETCHED_AT).select("page_id", "score", "parsed_in")


# --- rate limits --------------------------------------------------------------------------------


@query
def client_ip(spark, folder):
    return requests(spark, folder).select("request_id", rl.client_ip("headers").alias("client_ip"))


@query
def minute_counts(spark, folder):
    return rl.bucket_counts(requests(spark, folder), "minute")


@query
def day_counts(spark, folder):
    return rl.bucket_counts(requests(spark, folder), "day")


@query
def request_ordinals(spark, folder):
    return rl.request_ordinals(requests(spark, folder)).select(
        "request_id", "client_ip", "minute_count", "day_count"
    )


def limited(spark: SparkSession, folder: str) -> DataFrame:
    return rl.rate_limit(requests(spark, folder), PER_MINUTE, PER_DAY)


@query
def rate_limit_decisions(spark, folder):
    return limited(spark, folder).select("request_id", "allowed", "enforced")


# Caps as a configuration may spell them.
CAPS = (("1", "3"), ("2", "many"), ("0", "-5"), (" 4 ", "2"), ("", ""))


@query
def limit_caps(spark, folder):
    """Blocked requests under several configurations of the caps."""
    numbered = rl.request_ordinals(requests(spark, folder))
    blocked = [
        F.struct(
            F.lit(f"{minute}/{day}").alias("config"),
            F.count_if((F.col("minute_count") > rl.caps(minute, day)[0]) | (F.col("day_count") > rl.caps(minute, day)[1])).alias("blocked"),
        )
        for minute, day in CAPS
    ]
    return numbered.agg(F.array(*blocked).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query
def retry_after(spark, folder):
    return limited(spark, folder).select("request_id", F.col("retry_after_seconds").alias("retry_after"))


@query
def rate_limit_unidentified(spark, folder):
    return limited(spark, folder).where(~F.col("enforced")).select("request_id", "allowed", "enforced")


@query
def limiter_outcome(spark, folder):
    outcome = rl.limiter_outcome(
        F.col("configured"), rl.client_ip("headers").isNotNull(), F.col("store_status"), F.col("parsed")
    )
    return requests(spark, folder).select("request_id", outcome.alias("o")).select("request_id", "o.*")


@query
def retry_label(spark, folder):
    return limited(spark, folder).where(~F.col("allowed")).select(
        "request_id", rl.retry_label(F.col("retry_after_seconds")).alias("wait")
    )


def _request_stream(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "events")
    # A pattern, as a plain path must be a folder: the table may be one file or a folder of many.
    stream = spark.readStream.schema(stored.schema).parquet(f"{folder}/events.parque[t]")
    return derived.request_log(stream)


@query
def rate_limit_stream(spark, folder):
    out = run_folder(spark, "rate-limit")
    limits.start_rate_limit(_request_stream(spark, folder), out, PER_MINUTE, PER_DAY).awaitTermination()
    return limits.read_decisions(spark, out).select(
        "request_id", "allowed", "retry_after_seconds", "enforced", "late"
    )


def _arriving(spark: SparkSession, folder: str, part: str, parts: int, start) -> None:
    """The request log in `parts` deliveries; after each, the stream `start` builds is started anew and runs to its end."""
    log, source = events(spark, folder), run_folder(spark, "arriving")
    for no in range(parts):
        log.where(f"{part} = {no}").write.mode("append").parquet(source)
        stream = spark.readStream.schema(log.schema).parquet(source)
        start(derived.request_log(stream)).awaitTermination()


@query
def rate_limit_stream_shuffled(spark, folder):
    """The limiter on a log that arrives out of order, restarted between deliveries."""
    out = run_folder(spark, "rate-limit")
    _arriving(spark, folder, derived.DELIVERY, 3, lambda rows: limits.start_rate_limit(rows, out, PER_MINUTE, PER_DAY))
    return limits.read_decisions(spark, out).select("request_id", "allowed", "retry_after_seconds", "enforced", "late")


# How long a window waits for stragglers.
LATENESS = 2 * rl.DAY


@query
def late_split_stream(spark, folder):
    """Counts of a stream with a horizon, and how many requests came after their window had closed."""
    out = run_folder(spark, "bounded-counts")
    _arriving(spark, folder, derived.DELIVERY, 3, lambda rows: limits.start_bounded_counts(rows, out, lateness_seconds=LATENESS))
    counted = limits.read_counts(spark, out).withColumn("n_late", F.lit(0).cast("bigint"))
    start = (F.col("second") - F.col("second") % rl.MINUTE).alias("window_start")
    late = limits.late_rows(spark, out).select("client_ip", start, F.lit(0).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("n_late"))
    return counted.unionByName(late).groupBy("client_ip", "window_start").agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late"))


@query
def audit_stream(spark, folder):
    """Pages and site crawls as two streams, in three deliveries: odd pages, even pages, and the rows that close a replay."""
    raw, source, out = table(spark, folder, "pages"), run_folder(spark, "crawl"), run_folder(spark, "audit-stream")
    at = F.to_timestamp(F.concat(F.expr(derived.CRAWLED_AT), F.lit("+00:00")))
    typed = derived.decorated_pages(raw).withColumn("crawled_at", at)
    pages = typed.select("page_id", "url", "final_url", "html", "headers", "crawled_at")
    file = F.struct("kind", "status", "content_type", "body", "redirect_hops")
    early = F.to_timestamp(F.lit("2024-12-01 00:00:00+00:00")).alias("crawled_at")
    crawls = derived.site_files(raw).groupBy("origin").agg(F.collect_list(file).alias("files")).select("origin", early, "files")
    last_page, last_crawl = live_audit.closing_rows(spark, "2030-01-01 00:00:00+00:00")
    last_page = last_page.select("page_id", "url", F.col("url").alias("final_url"), "html", F.lit(None).cast(pages.schema["headers"].dataType).alias("headers"), "crawled_at")
    deliveries = ((pages.where("page_id % 2 = 1"), crawls), (pages.where("page_id % 2 = 0"), crawls.limit(0)), (last_page, last_crawl))
    for page_rows, crawl_rows in deliveries:
        page_rows.write.mode("append").parquet(f"{source}/pages")
        crawl_rows.write.mode("append").parquet(f"{source}/crawls")
        streams = (spark.readStream.schema(rows.schema).parquet(f"{source}/{name}") for name, rows in (("pages", pages), ("crawls", crawls)))
        live_audit.start_audit(*streams, out, window="400 days", lateness="400 days").awaitTermination()
    return live_audit.read_audit(spark, out, FETCHED_AT).select("page_id", "score")


@query
def minute_counts_stream(spark, folder):
    out = run_folder(spark, "minute-counts")
    counts = limits.windowed_counts(_request_stream(spark, folder))
    limits.start_counts(counts, out).awaitTermination()
    return limits.read_counts(spark, out)
