"""Audits of pages as they arrive, joined with the site crawls that arrive beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitegauge.functions.urls import origin as site_origin
from sitegauge.operators.sitefiles import NO_EVIDENCE, crawl_evidence
from sitegauge.plans.audit import audit_facts, page_arrays, parsed_pages, scalar_facts

# Parts the pages of a site are dealt over; a site crawl, a few hundred bytes by then, is copied to each.
PARTS = 8


def joined_facts(pages: DataFrame, crawls: DataFrame, window: str, lateness: str) -> DataFrame:
    """Facts of a stream of pages with the evidence of every crawl of their site in the `window` before them.

    Pages are parsed and reduced to their facts, site crawls to their verdicts, where they are
    read; only these meet, in a left outer join whose state is bounded by the watermarks of
    both sides (`lateness`). A page without any crawl in its window comes out, without
    evidence, once the watermark has passed. One site may have a third of all pages: they go to `PARTS` keys.
    """
    facts = scalar_facts(page_arrays(parsed_pages(pages))).withWatermark("crawled_at", lateness)
    facts = facts.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(PARTS)))
    sites = crawls.select(
        site_origin(F.col("origin")).alias("site"), F.col("crawled_at").alias("since"), F.struct(*crawl_evidence(F.col("files"))).alias("evidence")
    ).withWatermark("since", lateness)
    sites = sites.withColumn("site_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    near = (F.col("since") <= F.col("crawled_at")) & (F.col("since") >= F.col("crawled_at") - F.expr(f"INTERVAL {window}"))
    return facts.join(sites, (F.col("origin") == F.col("site")) & (F.col("part") == F.col("site_part")) & near, "left_outer").drop("site", "part", "site_part")


def start_audit(
    pages: DataFrame, crawls: DataFrame, folder: str, window: str = "7 days", lateness: str = "1 hour", **trigger
) -> StreamingQuery:
    """Audits a stream of pages; `read_audit` reads the reports of what has come out so far.

    `pages` are crawl rows with `crawled_at`; `crawls` hold `origin, crawled_at, files`, one row per crawl of
    a site with all its files (`kind, status, content_type, body, redirect_hops`). A page is judged by the
    newest crawl at or before it, `window` back at most. Rows later than `lateness` are dropped
    by the engine. A replay ends with pages still waiting: `closing_rows` let them out.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/facts/batch={batch_id}")

    return (
        joined_facts(pages, crawls, window, lateness)
        .writeStream.outputMode("append")
        .foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def closing_rows(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """A page and a site crawl of no site, at a time past all others: as the last rows of a replay they move the watermark on."""
    time = F.lit(at).cast("timestamp").alias("crawled_at")
    page = spark.range(1).select(F.lit(None).cast("bigint").alias("page_id"), F.lit("https://end.invalid/").alias("url"), F.lit("").alias("html"), time)
    files = F.array().cast("array<struct<kind:string,status:int,content_type:string,body:string,redirect_hops:int>>").alias("files")
    return page, spark.range(1).select(F.lit("https://nowhere.invalid").alias("origin"), time, files)


def read_audit(spark: SparkSession, folder: str, fetched_at: str) -> DataFrame:
    """Reports of the pages that have come out, each by the newest crawl it met."""
    rows = spark.read.parquet(f"{folder}/facts").drop("batch").where("page_id IS NOT NULL")
    facts = [c for c in rows.columns if c not in ("since", "evidence", "page_id")]
    newest = rows.groupBy("page_id").agg(
        F.max_by(F.struct("evidence", *facts), F.coalesce("since", F.lit("1900-01-01").cast("timestamp"))).alias("row")
    )
    evidence: list[Column] = [F.col(f"row.evidence.{c}").cast(t).alias(c) for c, t in NO_EVIDENCE.items()]
    return audit_facts(newest.select("page_id", *[F.col(f"row.{c}").alias(c) for c in facts], *evidence), fetched_at)
