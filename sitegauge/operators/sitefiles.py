"""robots.txt and llms.txt evidence, judged once per site and then joined to pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegauge.functions.text import built_once
from sitegauge.functions.urls import origin as site_origin
from sitegauge.schema import AI_CRAWLERS

_LEADING_JUNK = r"\A[\x{FEFF} \t\r\n\f\x0B]+"


def looks_like_html(text: Column) -> Column:
    """First character after byte-order mark and padding is `<`."""
    return F.regexp_replace(text, _LEADING_JUNK, "").startswith("<")


def is_markup(content_type: Column, text: Column) -> Column:
    """Declared as HTML or opening like it; NULL when either is missing, whatever the other says."""
    known = content_type.isNotNull() & text.isNotNull()
    return F.when(known, F.lower(content_type).contains("text/html") | looks_like_html(text))


def probe_markup(status: Column, content_type: Column, body: Column) -> Column:
    """Whether a probe was answered with markup; NULL for incomplete evidence.

    Only the body of a successful answer is ever read, so without one it counts as empty elsewhere.
    """
    return is_markup(content_type, F.when(status.between(200, 299), body).otherwise(F.coalesce(body, F.lit(""))))


def llms_gate(status: Column, content_type: Column, body: Column) -> Column:
    """Why a crawled llms.txt cannot count, NULL for a candidate the probe must confirm."""
    kind = F.coalesce(F.lower(content_type), F.lit(""))
    present = F.coalesce((status == 200) & (F.length(body) > 50), F.lit(False))
    return (
        F.when(~present, "absent")
        .when(is_markup(kind, body), "html_fallback")
        .when((kind != "") & ~kind.startswith("text/"), "bad_type")
    )


def probe_verdict(hops: Column, probe_status: Column, markup: Column) -> Column:
    """What the answer to a path that cannot exist says about a candidate.

    A file counts only when the site demonstrably answers unknown paths in
    another way. `markup` is NULL for an incomplete probe.
    """
    return (
        F.when(probe_status.isNull() | markup.isNull(), "unverified")
        .when(probe_status.isin(404, 410), "pass_absence")
        .when(
            probe_status.between(300, 399),
            # Unless it is known that the file itself came without a redirect, this proves nothing.
            F.when(hops.isNull(), "unverified").when(hops > 0, "redirect_ambiguous").otherwise("pass_direct"),
        )
        .when(probe_status >= 400, "waf")
        .when(
            probe_status.between(200, 299), F.when(markup, "pass_html_shell").otherwise("catch_all")
        )
        .otherwise("unexpected")
    )


def blocked_bots(body: Column, bots: tuple[str, ...] = AI_CRAWLERS) -> Column:
    """Crawlers a robots.txt shuts out of the whole site, in the order of `bots`.

    A group is the run of `field: value` lines right below the agent's line; the
    wildcard agent is not consulted. Line mode `(?d)` keeps CRLF lines whole, and
    possessive loops keep a long file from exhausting the stack.
    """
    text = F.lower(body)

    def shut_out(bot: str) -> Column:
        groups = F.regexp_extract_all(
            text,
            F.lit(rf"(?dU)user-agent:\s*{re.escape(bot.lower())}\s*\n((?:[a-z-]++:.*+\n?+)++)"),
            F.lit(1),
        )
        return F.exists(groups, lambda g: g.rlike(r"(?dU)disallow:\s*/(?:\s|\z)"))

    # Fixed: the shape of a group and of a full ban are those a live scorer looks for.
    # Cheap test first: most files name none of the crawlers.
    return F.array_compact(
        F.array(*[F.when(text.contains(bot.lower()) & shut_out(bot), bot) for bot in bots])
    )


@built_once
def _evidence_columns() -> list[Column]:
    """What each crawled file proves, judged in place: a few small values per file."""
    return _proof(*[F.col(c) for c in ("kind", "status", "content_type", "body", "redirect_hops")])


def _proof(kind: Column, status: Column, ctype: Column, body: Column, hops: Column) -> list[Column]:
    """What a file proves, as one of three kinds. A file no answer came for proves nothing."""
    return [
        F.when(
            kind == "llms",
            F.struct(
                F.coalesce(llms_gate(status, ctype, body), F.lit("candidate")).alias("gate"),
                hops.alias("hops"),
            ),
        ).alias("l"),
        F.when(
            (kind == "probe") & status.isNotNull(),
            F.struct(status.alias("status"), probe_markup(status, ctype, body).alias("markup")),
        ).alias("p"),
        F.when(
            (kind == "robots") & status.isNotNull(),
            F.struct(
                F.when(status == 200, True).alias("found"),
                F.when(status == 200, blocked_bots(body)).otherwise(F.array().cast("array<string>")).alias("blocked"),
            ),
        ).alias("r"),
    ]


def _file_rank() -> Column:
    """Which of several files of one site, kind and time counts: that listed under the canonical origin, then the least
    other spelling of it, then one without a redirect, then by content. Larger counts."""
    canonical = site_origin(F.col("origin"))
    spelled = F.translate(F.hex("origin"), "0123456789ABCDEF", "FEDCBA9876543210")  # the least text is the largest
    content = F.xxhash64("status", "content_type", "body")
    return F.struct(
        (F.col("origin") == canonical).alias("canonical"), spelled.alias("spelled"),
        (-F.coalesce("redirect_hops", F.lit(1 << 30))).alias("direct"), content.alias("content"),
    )


def _judged(llms: Column | None = None, probe: Column | None = None, robots: Column | None = None) -> list[Column]:
    """The columns of `NO_EVIDENCE` from what the three files prove."""
    llms, probe, robots = (F.col(name) if c is None else c for c, name in ((llms, "l"), (probe, "p"), (robots, "r")))
    gate = F.nullif(F.coalesce(llms["gate"], F.lit("absent")), F.lit("candidate"))
    return [
        F.coalesce(gate, probe_verdict(llms["hops"], probe["status"], probe["markup"])).alias("llms_verdict"),
        probe["status"].alias("probe_status"),
        robots["found"].alias("robots_found"),
        F.coalesce(robots["blocked"], F.array().cast("array<string>")).alias("blocked_bots"),
    ]


def crawl_evidence(files: Column) -> list[Column]:
    """The columns of `NO_EVIDENCE` from the files of one crawl of a site, in its row; of files of one kind the first counts."""
    fields = ("kind", "status", "content_type", "body", "redirect_hops")

    def proof(kind: str, which: int) -> Column:
        file = F.try_element_at(F.filter(files, lambda f: f["kind"] == kind), F.lit(1))
        return _proof(*[file[c] for c in fields])[which]

    return _judged(proof("llms", 0), proof("probe", 1), proof("robots", 2))


def _evidence(site_files: DataFrame, at: Column) -> DataFrame:
    """One row per origin and time: of each kind the file that counts. Files are judged where they are read; no body is shuffled."""
    rows = site_files.select(site_origin(F.col("origin")).alias("origin"), at.alias("at"), _file_rank().alias("rank"), *_evidence_columns())
    first = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(c) for c in ("l", "p", "r")]
    return rows.groupBy("origin", "at").agg(*first)


def site_versions(site_files: DataFrame) -> DataFrame:
    """`origin, versions`: what held of each origin from when on, oldest first (`since` and the columns of `NO_EVIDENCE`).

    Files of different times follow one another: at any time the newest file of each
    kind holds, and a fetch that got no answer changes nothing. `crawled_at` NULL, or
    no such column, is before all times. Only versions that differ from the one before are kept,
    so a site's row grows with its changes, not with its crawls.
    """
    known = F.col("crawled_at").cast("timestamp") if "crawled_at" in site_files.columns else F.lit(None).cast("timestamp")
    evidence = _evidence(site_files, F.coalesce(F.unix_micros(known), F.lit(-(1 << 62))))
    past = W.partitionBy("origin").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    held = evidence.select("origin", "at", *[F.last(c, ignorenulls=True).over(past).alias(c) for c in ("l", "p", "r")])
    judged = held.select("origin", "at", F.struct(*_judged()).alias("v"))
    before = F.lag("v").over(W.partitionBy("origin").orderBy("at"))
    changed = judged.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("v")))
    version = F.struct(F.col("at").alias("since"), "v")
    return changed.groupBy("origin").agg(F.sort_array(F.collect_list(version)).alias("versions"))


def evidence_at(versions: Column, crawled_at: Column) -> list[Column]:
    """The columns of `NO_EVIDENCE` as they held at a time; the newest where the time is NULL, none before the first."""
    micros = F.unix_micros(crawled_at)
    held = F.filter(versions, lambda v: micros.isNull() | (v["since"] <= micros))
    newest = F.try_element_at(held, F.lit(-1))["v"]
    return [newest[c].cast(t).alias(c) for c, t in NO_EVIDENCE.items()]


def site_verdicts(site_files: DataFrame) -> DataFrame:
    """One small row per origin, of its newest files: llms verdict, probe status and shut-out crawlers."""
    if "crawled_at" in site_files.columns:
        sites = site_versions(site_files)
        return sites.select("origin", *evidence_at(F.col("versions"), F.lit(None).cast("timestamp")))
    return _evidence(site_files, F.lit(0)).select("origin", *_judged())


NO_EVIDENCE = {
    "llms_verdict": "string",
    "probe_status": "int",
    "robots_found": "boolean",
    "blocked_bots": "array<string>",
}


def pivot_site_files(site_files: DataFrame) -> DataFrame:
    """Status of each file kind per origin, of the file that counts."""
    kinds = ("robots", "llms", "probe")
    rows = site_files.select(site_origin(F.col("origin")).alias("origin"), "kind", "status", _file_rank().alias("rank"))
    return rows.groupBy("origin").agg(
        *[F.max_by("status", F.when((F.col("kind") == k) & F.col("status").isNotNull(), F.col("rank"))).alias(f"{k}_status") for k in kinds]
    )
