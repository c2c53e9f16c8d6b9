"""The 27 signals: one rule per signal over a page's scalar facts.

A rule is a function without arguments that returns an `Outcome` of columns over
the fact columns made by `plans.audit.page_facts`. Rules hold no state, touch no
arrays of elements and add no shuffle; `register_signal` adds or replaces one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.text import plain_count

ARTICLE_TYPES = ("Article", "NewsArticle", "BlogPosting", "TechArticle")


@dataclass(frozen=True)
class Outcome:
    passed: Column
    points: Column
    detail: Column
    fix: Column  # advice, dropped when the signal passed


@dataclass(frozen=True)
class Signal:
    no: int
    name: str
    bucket: str
    weight: int
    rule: Callable[[], Outcome]

    def struct(self) -> Column:
        out = self.rule()
        passed = F.coalesce(out.passed, F.lit(False))
        return F.struct(
            F.lit(self.no).alias("signal_no"),
            F.lit(self.name).alias("name"),
            F.lit(self.bucket).alias("bucket"),
            passed.alias("passed"),
            F.lit(self.weight).alias("weight"),
            F.coalesce(out.points, F.lit(0)).cast("int").alias("points"),
            out.detail.alias("detail"),
            F.when(~passed, out.fix).alias("fix"),
        )


REGISTRY: dict[int, Signal] = {}


def register_signal(no: int, name: str, bucket: str, weight: int, rule: Callable[[], Outcome]) -> Signal:
    REGISTRY[no] = Signal(no, name, bucket, weight, rule)
    return REGISTRY[no]


def signal(no: int, name: str, bucket: str, weight: int):
    def add(rule: Callable[[], Outcome]) -> Callable[[], Outcome]:
        register_signal(no, name, bucket, weight, rule)
        return rule

    return add


def all_signals() -> list[Signal]:
    return [REGISTRY[no] for no in sorted(REGISTRY)]


def _s(text: str) -> Column:
    return F.lit(text)


def _binary(passed: Column, weight: int, yes: Column | str, no: Column | str, fix: str) -> Outcome:
    passed = F.coalesce(passed, F.lit(False))
    yes, no = (_s(m) if isinstance(m, str) else m for m in (yes, no))
    return Outcome(
        passed, F.when(passed, weight).otherwise(0), F.when(passed, yes).otherwise(no), _s(fix)
    )


# --- crawlability -------------------------------------------------------------


@signal(1, "HTTPS", "crawlability", 2)
def https() -> Outcome:
    return _binary(
        F.col("page_scheme") == "https", 2, "The page is served over HTTPS.", "The page is served without HTTPS.",
        "Serve every page over HTTPS.",
    )


@signal(2, "Canonical URL", "crawlability", 2)
def canonical() -> Outcome:
    href = F.col("canonical_href")
    return _binary(
        href != "", 2, F.concat(_s("Canonical address: "), href), "The page names no canonical address.",
        'Put one <link rel="canonical" href="…"> with the preferred address in the head.',
    )


@signal(3, "Mobile viewport", "crawlability", 2)
def viewport() -> Outcome:
    return _binary(
        F.col("viewport_content") != "", 2, "A viewport is declared.", "No viewport is declared.",
        'Declare <meta name="viewport" content="width=device-width, initial-scale=1">.',
    )


@signal(4, "Open Graph tags", "crawlability", 2)
def open_graph() -> Outcome:
    n = F.col("n_open_graph")
    count = plain_count(n, "Open Graph tag")
    return _binary(n >= 3, 2, count, count, "Describe the page with og:title, og:description, og:image and og:url.")


@signal(5, "llms.txt file", "crawlability", 3)
def llms_txt() -> Outcome:
    verdict = F.coalesce(F.col("llms_verdict"), _s("absent"))
    status = F.coalesce(F.col("probe_status").cast("string"), _s("?"))
    detail = (
        F.when(verdict == "absent", "The site has no llms.txt.")
        .when(verdict == "html_fallback", "The llms.txt address answers with an HTML page.")
        .when(verdict == "bad_type", "The llms.txt address answers with a non-text content-type.")
        .when(verdict == "unverified", "An llms.txt answers, but the control request gave no result. Not scored.")
        .when(verdict == "redirect_ambiguous", "llms.txt and unknown paths both redirect. Not scored.")
        .when(verdict == "waf", F.concat(_s("Unknown paths answer HTTP "), status, _s(", so llms.txt proves nothing. Not scored.")))
        .when(verdict == "catch_all", "Unknown paths answer with text too: a catch-all. Not scored.")
        .when(verdict == "unexpected", F.concat(_s("The control request answered HTTP "), status, _s(". Not scored.")))
        .otherwise("A genuine llms.txt stands at the site root.")
    )
    passed = verdict.startswith("pass")
    return Outcome(
        passed, F.when(passed, 3).otherwise(0), detail,
        _s("Serve a plain-text llms.txt at the site root and let unknown paths answer 404."),
    )


@signal(6, "Robots allows AI crawlers", "crawlability", 4)
def robots_ai() -> Outcome:
    blocked = F.coalesce(F.col("blocked_bots"), F.array().cast("array<string>"))
    names = F.array_join(blocked, ", ")
    passed = F.size(blocked) == 0
    return Outcome(
        passed,
        F.when(passed, 4).otherwise(F.greatest(F.lit(0), 4 - F.size(blocked))),
        F.when(F.col("robots_found").isNull(), "No robots.txt: every crawler may fetch.")
        .when(passed, "robots.txt shuts out none of the known AI crawlers.")
        .otherwise(F.concat(_s("robots.txt shuts out "), names, _s("."))),
        F.concat(_s("Unless meant, drop the site-wide Disallow for "), names, _s(".")),
    )


# --- schema and structure -------------------------------------------------------


@signal(7, "Article schema", "schema_structure", 5)
def article_schema() -> Outcome:
    found = F.array_sort(F.array_intersect(F.col("schema_types"), F.array(*map(F.lit, ARTICLE_TYPES))))
    return _binary(
        F.size(found) > 0, 5, F.concat(_s("Article markup: "), F.array_join(found, ", ")), "No article markup.",
        "State type, author and dates in JSON-LD with @type Article or BlogPosting.",
    )


def _typed(name: str, weight: int, fix: str) -> Outcome:
    return _binary(
        F.array_contains(F.col("schema_types"), name), weight, f"{name} markup found.", f"No {name} markup.", fix
    )


@signal(8, "FAQ schema", "schema_structure", 6)
def faq_schema() -> Outcome:
    return _typed("FAQPage", 6, "Repeat a visible question section as FAQPage JSON-LD.")


@signal(9, "HowTo schema", "schema_structure", 3)
def howto_schema() -> Outcome:
    return _typed("HowTo", 3, "Repeat real step-by-step instructions as HowTo JSON-LD.")


@signal(10, "Breadcrumb schema", "schema_structure", 3)
def breadcrumb_schema() -> Outcome:
    return _typed("BreadcrumbList", 3, "Show the page's place in the site with BreadcrumbList JSON-LD.")


@signal(11, "Heading structure", "schema_structure", 4)
def heading_structure() -> Outcome:
    implied = (F.col("n_h1") == 0) & F.col("has_title")
    h1 = F.when(implied, 1).otherwise(F.col("n_h1"))
    h2 = F.col("n_h2")
    passed = (h1 == 1) & (h2 >= 3)
    detail = F.concat(
        h1.cast("string"), _s(" H1, "), h2.cast("string"), _s(" H2."),
        F.when(implied, " The title stands in for the missing H1.").otherwise(""),
    )
    fix = F.concat_ws(
        " ",
        F.when(h1 == 0, "Add exactly one H1 with the page's topic."),
        F.when(h1 > 1, F.concat(_s("Keep one of the "), h1.cast("string"), _s(" H1s."))),
        F.when(h2 < 3, F.concat(_s("Cut the text into at least 3 H2 sections; there are "), h2.cast("string"), _s("."))),
    )
    return Outcome(passed, F.when(passed, 4).when((h1 >= 1) & (h2 >= 2), 2).otherwise(1), detail, fix)


@signal(12, "Definition lists", "schema_structure", 3)
def definition_lists() -> Outcome:
    n = F.col("n_dl")
    count = plain_count(n, "definition list")
    return _binary(n >= 1, 3, count, count, "Mark up terms and their meanings as <dl>.")


@signal(13, "Table markup", "schema_structure", 3)
def table_markup() -> Outcome:
    n = F.col("n_table")
    count = plain_count(n, "table")
    return _binary(n >= 1, 3, count, count, "Put comparisons into a real <table>.")


@signal(14, "Question-style H2s", "schema_structure", 3)
def question_h2s() -> Outcome:
    n = F.col("n_question_h2")
    return Outcome(
        n >= 2, F.least(F.lit(3), n), plain_count(n, "H2 that asks a question", "H2s that ask a question"),
        _s("Phrase two or more H2s as the questions readers ask."),
    )


# --- content and format -----------------------------------------------------------


@signal(15, "Word count (lift-worthy range)", "content_format", 5)
def length_range() -> Outcome:
    n = F.col("words")
    passed = n.between(1200, 3500)
    near = n.between(800, 1199) | n.between(3501, 5000)
    verdict = (
        F.when(passed, " words: within 1200–3500.").when(near, " words: just outside 1200–3500.")
        .when(n < 800, " words: too thin.").otherwise(" words: too long.")
    )
    return Outcome(
        passed, F.when(passed, 5).when(near, 2).otherwise(0), F.concat(n.cast("string"), verdict),
        _s("Aim at 1500 to 2500 words, one clear answer per section."),
    )


@signal(16, "Answer in first 60 words", "content_format", 5)
def first_answer() -> Outcome:
    n = F.coalesce(F.col("answer_words"), F.lit(0))
    passed = n.between(15, 60) & F.col("answer_closed")
    return Outcome(
        passed,
        F.when(passed, 5).when(n >= 15, 2).when(n > 0, 1).otherwise(0),
        F.when(~F.col("has_region"), "No main content region.")
        .when(n == 0, "The main content has no real opening paragraph.")
        .otherwise(F.concat(_s("The opening paragraph has "), n.cast("string"), _s(" words."))),
        F.when(~F.col("has_region"), "Wrap the content in <article> or <main>.")
        .otherwise("Open with a paragraph of 15 to 60 words that answers the page's question."),
    )


@signal(17, "TL;DR / summary block near top", "content_format", 5)
def tldr() -> Outcome:
    return _binary(
        F.col("has_tldr"), 5, "A summary stands near the top.", "No summary near the top.",
        "Sum the page up in about 50 words below the H1.",
    )


@signal(18, "Bold answer in first section", "content_format", 5)
def bold_answer() -> Outcome:
    bold = F.coalesce(F.col("bold_first_p"), F.lit(False))
    return Outcome(
        bold, F.when(bold, 5).otherwise(0),
        F.when(~F.col("has_region"), "No main content region.")
        .when(F.col("bold_first_p").isNull(), "No paragraph.")
        .when(bold, "The first paragraph has bold words.")
        .otherwise("The first paragraph has no bold words."),
        # Without a paragraph there is nothing to embolden: no advice.
        F.when(F.col("bold_first_p").isNotNull(), "Set the answer in the first paragraph in bold."),
    )


@signal(19, "Structured lists", "content_format", 5)
def structured_lists() -> Outcome:
    n = F.col("n_lists")
    return Outcome(n >= 3, F.least(F.lit(5), n), plain_count(n, "list"), _s("Use three or more real lists."))


# --- authority -----------------------------------------------------------------------


@signal(20, "Authority outbound links", "authority", 5)
def authority_links() -> Outcome:
    n = F.col("n_authority_links")
    return Outcome(
        n >= 2, F.least(F.lit(5), n), plain_count(n, "link to an authority site", "links to authority sites"),
        _s("Cite two or more government, university or encyclopedia pages."),
    )


@signal(21, "Internal linking", "authority", 4)
def internal_links() -> Outcome:
    n = F.col("n_internal_links")
    passed = n.between(5, 50)
    return Outcome(
        passed, F.when(passed, 4).when(n > 0, 2).otherwise(0), plain_count(n, "internal link"),
        _s("Link 5 to 50 other pages of the site."),
    )


@signal(22, "Named author / byline", "authority", 5)
def author_byline() -> Outcome:
    source = F.col("author_source")
    return Outcome(
        source.isNotNull(), F.when(source.isNotNull(), 5).otherwise(0),
        F.when(source == "jsonld", "Author named in JSON-LD.")
        .when(source == "meta", "Author named in a meta tag.")
        .when(source == "markup", "Author named in author markup.")
        .when(source == "byline", "A visible byline names the author.")
        .otherwise("No named author found."),
        _s("Name the person who wrote the page."),
    )


@signal(23, "Outbound link density", "authority", 3)
def outbound_density() -> Outcome:
    n = F.col("n_external_links")
    passed = n.between(3, 30)
    return Outcome(
        passed, F.when(passed, 3).otherwise(1), plain_count(n, "outbound link"),
        _s("Cite 3 to 30 outside sources."),
    )


@signal(24, "Quotes & citations markup", "authority", 3)
def quotes() -> Outcome:
    q, c = F.col("n_blockquote"), F.col("n_cite")
    count = F.concat_ws(", ", plain_count(q, "blockquote"), plain_count(c, "cite"))
    return _binary(q + c >= 1, 3, count, count, "Mark quotations up as <blockquote> and sources as <cite>.")


# --- freshness -------------------------------------------------------------------------


@signal(25, "Last modified date", "freshness", 4)
def last_modified() -> Outcome:
    in_data = F.col("date_modified")
    in_header = F.nullif(F.col("last_modified"), F.lit(""))
    return _binary(
        in_data.isNotNull() | in_header.isNotNull(), 4,
        F.coalesce(F.concat(_s("dateModified: "), in_data), F.concat(_s("Last-Modified: "), in_header)),
        "No date of change found.",
        "Publish dateModified in JSON-LD or a Last-Modified header.",
    )


@signal(26, "Dated claims in body", "freshness", 3)
def dated_claims() -> Outcome:
    return _binary(
        F.col("dated_claim"), 3, "The text dates its claims.", "The text dates none of its claims.",
        "Say as of when each claim holds.",
    )


@signal(27, "Year in title", "freshness", 3)
def year_in_title() -> Outcome:
    return _binary(
        F.col("title_year"), 3, "The title names a recent year.", "The title names no recent year.",
        "Name the year in the title where the subject changes with time.",
    )
