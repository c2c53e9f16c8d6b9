"""The audit plan: scan -> parse -> facts -> (site verdicts) -> signals -> score.

One narrow pass over the pages. The only join brings in per-site verdicts, after
the page text is gone: nothing wider than a page's scalar facts is ever shuffled,
and with a small site table nothing is.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions import jsonld
from sitegauge.functions.dom import parse_html
from sitegauge.functions.ip import BLOCKED_NETWORKS
from sitegauge.functions.text import SPACE, WORD_END, any_word_of, built_once, let, word_count, words_from
from sitegauge.functions.urls import authority, authority_malformed, netloc, origin, scheme
from sitegauge.operators import authors, elements as el, scoring
from sitegauge.operators.joins import is_small, left_join_lookup, stored_lookup
from sitegauge.operators.redirects import redirect_chains
from sitegauge.operators.signals import REGISTRY, all_signals
from sitegauge.operators.safety import REFUSAL, Networks, host_verdicts, local_verdicts
from sitegauge.operators.sitefiles import NO_EVIDENCE, evidence_at, site_verdicts, site_versions
from sitegauge.schema import BUCKET_CAPS, SIGNAL
from sitegauge.sources.pages import fetch_note, header, page_source

AUTHORITY_SUFFIXES = (".gov", ".edu", ".ac.uk", "wikipedia.org")
# --- fixed values: words, years and lengths the rules look for ---------------------
SUMMARY_WORDS = ["tl;dr", "tldr", "in short", "summary"]
SUMMARY_CHARS = 2000
CLAIM_LEADS = ["in", "as of", "updated", "since"]
MONTHS = (
    "january february march april may june july august september october november december"
).split()
CLAIM_YEARS = (2023, 2026)
TITLE_YEARS = (2024, 2026)


def _years(span: tuple[int, int]) -> list[str]:
    return [str(y) for y in range(span[0], span[1] + 1)]


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Pages with a `dom` column in place of `html`; failed fetches are not parsed."""
    failure = fetch_note(F.col("status"), F.col("reason"), F.col("fetch_error"))
    missing = F.when(F.col("html").isNull(), "The fetch returned nothing.")
    source = page_source(pages).withColumn("fetch_note", F.coalesce(failure, missing))
    html = F.when(F.col("fetch_note").isNull(), F.col("html"))
    return source.withColumn("dom", parse_html(html)).drop("html")


@built_once
def _view_columns() -> list[Column]:
    """Full and pruned elements, texts and the visible text."""
    elements, texts = F.col("dom.elements"), F.col("dom.texts")
    return [
        elements.alias("elements"),
        el.live(elements).alias("live"),
        texts.alias("texts"),
        el.visible_text(texts).alias("visible"),
        F.lower(authority(F.col("final_url"))).alias("page_host"),
    ]


@built_once
def _derived_columns() -> list[Column]:
    """Title, region, links, JSON-LD nodes and the texts that may name an author."""
    elements, live, texts = F.col("elements"), F.col("live"), F.col("texts")
    title = el.first(el.tagged(elements, "title"))

    def link(e: Column) -> Column:
        href = el.attr(e, "href")
        return F.struct(
            href.alias("href"),
            href.startswith("http").alias("absolute"),
            F.when(href.startswith("http"), F.lower(netloc(href))).alias("host"),
        )

    anchors = F.filter(live, lambda e: (e["tag"] == "a") & el.attr(e, "href").isNotNull())
    return [
        let(title, lambda t: F.when(t.isNotNull(), el.glued_text(texts, t, "inert"))).alias("page_title"),
        el.main_region(live).alias("region"),
        F.transform(anchors, link).alias("links"),
        jsonld.nodes(jsonld.documents(el.jsonld_scripts(elements, texts))).alias("nodes"),
        authors.author_marked_texts(live, texts).alias("author_texts"),
        authors.short_block_texts(live, texts).alias("block_texts"),
    ]


@built_once
def _narrowed_columns() -> list[Column]:
    """Paragraphs of the main region and links with a host."""
    region = F.col("region")
    return [
        F.filter(F.col("live"), lambda e: (e["tag"] == "p") & el.within(e, region)).alias("paragraphs"),
        F.filter(F.col("links"), lambda k: k["absolute"] & ~authority_malformed(k["host"])).alias("absolute_links"),
    ]


def page_arrays(parsed: DataFrame) -> DataFrame:
    """The page's working arrays: full and pruned elements, texts, scripts, regions, links."""
    views = parsed.select("page_id", "url", "final_url", "headers", "fetch_note", "crawled_at", *_view_columns())
    return views.select("*", *_derived_columns()).select("*", *_narrowed_columns())


def _first_answer(paragraphs: Column, texts: Column) -> Column:
    """Text of the first paragraph of eight words or more; later ones are not read."""

    def step(found: Column, p: Column) -> Column:
        text = el.glued_text(texts, p)
        return F.coalesce(found, F.when((p["text_chars"] > 0) & (word_count(text) >= 8), text))

    return F.aggregate(paragraphs, F.lit(None).cast("string"), step)


def _heading_role(live: Column, level: str) -> Column:
    return F.size(
        F.filter(live, lambda e: (el.attr(e, "role") == "heading") & (el.attr(e, "aria-level") == level))
    )


def _first_meta(live: Column, name: str) -> Column:
    return el.first(F.filter(live, lambda e: (e["tag"] == "meta") & (el.attr(e, "name") == name)))


def _claim_pattern(years: tuple[int, int]) -> str:
    """`in 2025`, `as of March`, … in lower-cased text."""
    when = "|".join(_years(years) + MONTHS)
    return f"{words_from(CLAIM_LEADS)}{SPACE}+(?:{when}){WORD_END}"


def scalar_facts(
    arrays: DataFrame, claim_years: tuple[int, int] = CLAIM_YEARS, title_years: tuple[int, int] = TITLE_YEARS
) -> DataFrame:
    """Reduce each page to the scalars the signal rules read; no text or array of elements survives."""
    worked = arrays.select("*", *_text_columns())
    return worked.select(
        "page_id", "url", "final_url", "fetch_note", "crawled_at", "page_title", *_fact_columns(claim_years, title_years)
    )


@built_once
def _text_columns() -> list[Column]:
    return [
        _first_answer(F.col("paragraphs"), F.col("texts")).alias("answer"),
        F.lower("visible").alias("lowered"),
    ]


@built_once
def _fact_columns(claim_years: tuple[int, int], title_years: tuple[int, int]) -> list[Column]:
    live, texts, nodes, links = F.col("live"), F.col("texts"), F.col("nodes"), F.col("absolute_links")
    host = F.col("page_host")
    canonical = el.first(
        F.filter(live, lambda e: (e["tag"] == "link") & el.has_token(el.attr(e, "rel"), "canonical"))
    )
    heading = F.coalesce(el.first(el.tagged(live, "h1")), el.first(el.tagged(live, "title")))
    first_p = el.first(F.col("paragraphs"))
    answer, lowered = F.col("answer"), F.col("lowered")

    def count_links(test) -> Column:
        return F.size(F.filter(links, test))

    def authority(k: Column) -> Column:
        hit = F.lit(False)
        for suffix in AUTHORITY_SUFFIXES:
            hit = hit | k["host"].endswith(suffix)
        return (k["host"] != host) & hit

    return [
        origin(F.col("final_url")).alias("origin"),
        scheme(F.col("final_url")).alias("page_scheme"),
        el.attr(canonical, "href").alias("canonical_href"),
        el.attr(_first_meta(live, "viewport"), "content").alias("viewport_content"),
        F.size(
            F.filter(live, lambda e: (e["tag"] == "meta") & el.attr(e, "property").startswith("og:"))
        ).alias("n_open_graph"),
        jsonld.types(nodes).alias("schema_types"),
        (el.count_tagged(live, "h1") + _heading_role(live, "1")).alias("n_h1"),
        (el.count_tagged(live, "h2") + _heading_role(live, "2")).alias("n_h2"),
        F.exists(live, lambda e: e["tag"] == "title").alias("has_title"),
        el.count_tagged(live, "dl").alias("n_dl"),
        el.count_tagged(live, "table").alias("n_table"),
        F.size(
            F.filter(live, lambda e: (e["tag"] == "h2") & el.glued_text(texts, e).endswith("?"))
        ).alias("n_question_h2"),
        el.visible_words(texts).alias("words"),
        F.col("region").isNotNull().alias("has_region"),
        word_count(answer).alias("answer_words"),
        answer.rlike(r"[.!?]\z").alias("answer_closed"),
        F.substring(lowered, 1, SUMMARY_CHARS).rlike(any_word_of(SUMMARY_WORDS)).alias("has_tldr"),
        F.when(
            first_p.isNotNull(),
            F.exists(live, lambda e: e["tag"].isin("strong", "b") & el.within(e, first_p)),
        ).alias("bold_first_p"),
        el.count_tagged(live, "ol", "ul").alias("n_lists"),
        count_links(authority).alias("n_authority_links"),
        (
            F.size(
                F.filter(F.col("links"), lambda k: k["href"].startswith("/") & ~k["href"].startswith("//"))
            )
            + count_links(lambda k: k["host"] == host)
        ).alias("n_internal_links"),
        count_links(lambda k: k["host"] != host).alias("n_external_links"),
        authors.author_source(
            jsonld.names_author(nodes),
            authors.meta_author(live),
            authors.markup_author(F.col("author_texts")),
            authors.visible_byline(F.col("block_texts")),
        ).alias("author_source"),
        el.count_tagged(live, "blockquote").alias("n_blockquote"),
        el.count_tagged(live, "cite").alias("n_cite"),
        jsonld.first_date_modified(nodes).alias("date_modified"),
        header(F.col("headers"), "last-modified").alias("last_modified"),
        lowered.rlike(_claim_pattern(claim_years)).alias("dated_claim"),
        F.coalesce(
            el.glued_text(texts, heading).rlike(any_word_of(_years(title_years))), F.lit(False)
        ).alias("title_year"),
    ]


def attach_site_evidence(facts: DataFrame, site_files: DataFrame | None, pages: DataFrame | None = None) -> DataFrame:
    """Add per-site verdicts by origin; without site files every page lacks evidence.

    If the files say when they were crawled, a page is judged by those that held when it was.
    """
    if site_files is None:
        return facts.select("*", *[F.lit(None).cast(t).alias(c) for c, t in NO_EVIDENCE.items()])
    counts = None
    if pages is not None:
        # Pages per site from the URL column alone: no page is parsed for it.
        source = page_source(pages)
        counts = source.groupBy(origin(F.col("final_url")).alias("origin")).agg(F.count("*").alias("n"))
    if "crawled_at" not in site_files.columns:
        return left_join_lookup(facts, site_verdicts(site_files), "origin", "page_id", key_counts=counts)
    joined = left_join_lookup(facts, site_versions(site_files), "origin", "page_id", key_counts=counts)
    return joined.select(*facts.columns, *evidence_at(F.col("versions"), F.col("crawled_at")))


def page_facts(
    pages: DataFrame,
    site_files: DataFrame | None = None,
    claim_years: tuple[int, int] = CLAIM_YEARS,
    title_years: tuple[int, int] = TITLE_YEARS,
) -> DataFrame:
    """One row of scalar facts per page."""
    facts = scalar_facts(page_arrays(parsed_pages(pages)), claim_years, title_years)
    return attach_site_evidence(facts, site_files, pages)


@built_once
def _signal_columns(registered: tuple) -> list[Column]:
    return [s.struct().alias(f"s{s.no}") for s in registered]


def single_signal(facts: DataFrame, no: int) -> DataFrame:
    """One signal's outcome per page; Catalyst drops every fact the rule does not read."""
    return facts.where(F.col("fetch_note").isNull()).select(
        "page_id", _signal_columns((REGISTRY[no],))[0].alias("s")
    )


@built_once
def _score_columns(registered: tuple) -> list[Column]:
    points = {b: F.col(f"_{b}") for b in BUCKET_CAPS}
    buckets = F.map_from_arrays(
        F.array(*[F.lit(b) for b in BUCKET_CAPS]),
        F.array(*[scoring.bucket_struct(points[b], b) for b in BUCKET_CAPS]),
    )
    no_buckets = F.create_map().cast("map<string,struct<earned:double,max:double,percent:double>>")
    signals = F.array(*[F.col(f"s{s.no}") for s in registered])
    no_signals = F.array().cast(f"array<{SIGNAL.simpleString()}>")
    fetched = F.col("fetched")
    return [
        F.when(fetched, scoring.page_score(points)).otherwise(0).alias("score"),
        F.when(fetched, buckets).otherwise(no_buckets).alias("bucket_scores"),
        F.when(fetched, signals).otherwise(no_signals).alias("signals"),
    ]


def audit_facts(facts: DataFrame, fetched_at: str | None = None) -> DataFrame:
    """Signals, bucket points, score, grade, fixes and notes from page facts."""
    registered = tuple(all_signals())
    page = ["page_id", "url", "final_url", "page_title", "origin", "fetched"]
    rows = facts.select(
        *page[:-1], F.col("fetch_note").isNull().alias("fetched"), "fetch_note", *_signal_columns(registered)
    )
    rows = rows.select("*", *[scoring.bucket_points(b).alias(f"_{b}") for b in BUCKET_CAPS])
    rows = rows.select(*page, "fetch_note", *_score_columns(registered))
    return rows.select(
        *page,
        F.lit(fetched_at).cast("string").alias("fetched_at"),
        "score",
        F.when(F.col("fetched"), scoring.grade(F.col("score"))).otherwise(scoring.failed_grade()).alias("grade"),
        "bucket_scores",
        "signals",
        scoring.fix_list(F.col("signals")).alias("fixes"),
        F.array_compact(F.array("fetch_note")).alias("notes"),
    )


class Guard:
    """Which pages may be scored: those whose typed and final address, and every hop between, are public.

    What an address itself tells is judged in the page's row. Hosts only DNS can judge,
    and redirect chains, are looked up in verdict tables that are computed once: in front of the
    parser while they are small enough to travel with the tasks, else on the
    facts, when all page text is gone. So a refused page is not parsed, and no page is shuffled.
    """

    def __init__(self, dns: DataFrame, networks: Networks = BLOCKED_NETWORKS, redirects: DataFrame | None = None):
        self.networks = networks
        self.hosts = stored_lookup(host_verdicts(dns, networks).select(F.col("host").alias("guard_host"), "host_safe"))
        self.chains = None
        if redirects is not None:
            chains = redirect_chains(redirects, dns, networks).select(F.col("url").alias("guard_url"), F.col("safe").alias("chain_safe"))
            self.chains = stored_lookup(chains)
        self.hosts_small = is_small(self.hosts, "guard_host")
        self.chains_small = self.chains is None or is_small(self.chains, "guard_url")

    def _judged(self, rows: DataFrame, hosts: bool, chains: bool) -> tuple[DataFrame, Column]:
        """`rows`, and whether each is refused by its addresses and by the tables asked."""
        columns, given = rows.columns, rows
        refused = F.lit(False)
        for name in ("url", "final_url"):
            verdict = f"guard_{name}_safe"
            own = local_verdicts(given.withColumn("guard_typed", F.col("url")).withColumn("url", F.col(name)), self.networks)
            own = own.withColumn("url", F.col("guard_typed"))
            undecided = F.when(F.col("decided").isNull(), F.col("host"))
            if hosts:
                keyed = own.withColumn("guard_host", undecided)
                own = left_join_lookup(keyed, self.hosts, "guard_host", "page_id", is_stored=True)
                safe = F.coalesce("decided", "host_safe", F.lit(False))
            else:
                safe = F.coalesce("decided", F.lit(True))
            given = own.select(*given.columns, safe.alias(verdict))
            refused = refused | ~F.col(verdict)
        if chains and self.chains is not None:
            given = left_join_lookup(given.withColumn("guard_url", F.col("url")), self.chains, "guard_url", "page_id", is_stored=True)
            refused = refused | ~F.coalesce("chain_safe", F.lit(True))
        return given.select(*columns, refused.alias("guard_refused")), F.col("guard_refused")

    def pages(self, pages: DataFrame) -> DataFrame:
        """Pages in which a refused one is a failed fetch without html."""
        judged, refused = self._judged(page_source(pages), self.hosts_small, self.chains_small)
        return judged.withColumns(
            {"html": F.when(~refused, F.col("html")), "fetch_error": F.when(refused, F.lit(REFUSAL)).otherwise(F.col("fetch_error"))}
        ).drop("guard_refused")

    def facts(self, facts: DataFrame) -> DataFrame:
        """Facts, judged by the tables that were too large to be asked before."""
        if self.hosts_small and self.chains_small:
            return facts
        judged, refused = self._judged(facts, not self.hosts_small, not self.chains_small)
        return judged.withColumns(
            {"fetch_note": F.when(refused, F.lit(REFUSAL)).otherwise(F.col("fetch_note")), "page_title": F.when(~refused, F.col("page_title"))}
        ).drop("guard_refused")


def audit_pages(
    pages: DataFrame,
    site_files: DataFrame | None = None,
    *,
    dns: DataFrame | None = None,
    networks: Networks = BLOCKED_NETWORKS,
    redirects: DataFrame | None = None,
    fetched_at: str | None = None,
    claim_years: tuple[int, int] = CLAIM_YEARS,
    title_years: tuple[int, int] = TITLE_YEARS,
) -> DataFrame:
    """Audit a crawl table: one report row per page.

    With `dns` (`host, ip`) a page whose typed or final address is not safely public
    is refused, not scored; with `redirects` (`from_url, to_url`) also one whose chain of
    redirects has an unsafe address anywhere or never ends. `networks` are those that
    are not public, constants or a table (`cidr`). `fetched_at` defaults to the time of
    this call, in UTC.
    """
    guard = Guard(dns, networks, redirects) if dns is not None else None
    facts = page_facts(guard.pages(pages) if guard else pages, site_files, claim_years, title_years)
    facts = guard.facts(facts) if guard else facts
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return audit_facts(facts, fetched_at or now)
