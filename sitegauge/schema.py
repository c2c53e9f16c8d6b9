"""Row shapes and fixed values shared by the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

# One parsed element. Elements and text nodes share one running number, so
# `eid < x <= end_eid` means "x lies inside the element". `text_from`/`text_to`
# index the page's text array; `text_chars` is the length of the element's
# visible text with its nodes joined by one space.
ELEMENT = T.StructType(
    [
        T.StructField("eid", T.IntegerType(), False),
        T.StructField("end_eid", T.IntegerType(), False),
        T.StructField("parent", T.IntegerType(), False),
        T.StructField("tag", T.StringType(), False),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType(), False), False),
        T.StructField("boilerplate", T.BooleanType(), False),
        T.StructField("text_from", T.IntegerType(), False),
        T.StructField("text_to", T.IntegerType(), False),
        T.StructField("text_chars", T.IntegerType(), False),
    ]
)

# One non-blank text node, stripped, with its word count (0 when inert). `inert` marks script/style/template/ruby
# text; `hidden` marks text that is inert or lies in a boilerplate element.
TEXT = T.StructType(
    [
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("words", T.IntegerType(), False),
        T.StructField("inert", T.BooleanType(), False),
        T.StructField("hidden", T.BooleanType(), False),
    ]
)

DOM = T.StructType(
    [
        T.StructField("elements", T.ArrayType(ELEMENT, False), False),
        T.StructField("texts", T.ArrayType(TEXT, False), False),
    ]
)

SIGNAL = T.StructType(
    [
        T.StructField("signal_no", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("weight", T.IntegerType()),
        T.StructField("points", T.IntegerType()),
        T.StructField("detail", T.StringType()),
        T.StructField("fix", T.StringType()),
    ]
)

# A crawl table; all but the first three columns are optional.
PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("fetch_error", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("redirect_hops", T.IntegerType()),
        T.StructField("crawled_at", T.TimestampType()),
    ]
)

# A table of site files may have `crawled_at`, too.
SITE_FILE = T.StructType(
    [
        T.StructField("origin", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("redirect_hops", T.IntegerType()),
    ]
)

# --- fixed values -----------------------------------------------------------

# Points each bucket contributes to the 0-100 score, in report order.
BUCKET_CAPS = {
    "schema_structure": 30,
    "content_format": 25,
    "authority": 20,
    "crawlability": 15,
    "freshness": 10,
}

# Lowest score of each grade, best first; anything below the last is F.
GRADE_FLOORS = ((90, "A+"), (80, "A"), (70, "B"), (60, "C"), (45, "D"))
FAILED_GRADE = "—"

# Crawlers looked up in robots.txt, in report order.
AI_CRAWLERS = (
    "GPTBot",
    "ClaudeBot",
    "PerplexityBot",
    "CCBot",
    "Google-Extended",
    "Applebot-Extended",
    "Bytespider",
    "anthropic-ai",
    "FacebookBot",
)

# Subtrees that carry no page content.
BOILERPLATE_TAGS = ("script", "style", "noscript", "header", "footer", "nav")

# Attributes any operator reads; all others are dropped while parsing.
ATTRIBUTES_READ = (
    "aria-level",
    "class",
    "content",
    "href",
    "id",
    "itemprop",
    "name",
    "property",
    "rel",
    "role",
    "type",
)
