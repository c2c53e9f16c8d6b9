"""Audits that parse only what changed since the last one."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.operators.joins import stored_lookup
from sitegauge.plans.audit import attach_site_evidence, audit_facts, page_arrays, parsed_pages, scalar_facts
from sitegauge.schema import PAGE
from sitegauge.sources.pages import page_source

_FACTS, _RUNS = "facts", "runs"


def content_digest() -> Column:
    """256 bits of all that a page's facts depend on, NULLs told from empty texts."""
    def told(name: str) -> Column:
        text = F.to_json(F.array_sort(F.map_entries("headers"))) if name == "headers" else F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[told(f.name) for f in PAGE if f.name != "page_id"]), 256)


def committed_facts(spark: SparkSession, folder: str) -> DataFrame | None:
    """Facts of all runs that were written to their end, with `run` and `digest`; None before the first."""
    runs = _runs(spark, folder)
    if not runs:
        return None
    return spark.read.parquet(*[f"{folder}/{_FACTS}/run-{run}" for run in runs])


def _runs(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the committed runs; the folder is made on the first call."""
    spark.createDataFrame([], "run int").write.mode("append").parquet(f"{folder}/{_RUNS}")
    return sorted({r.run for r in spark.read.schema("run int").parquet(f"{folder}/{_RUNS}").collect()})


def incremental_audit(
    pages: DataFrame, site_files: DataFrame | None, folder: str, *, fetched_at: str | None = None
) -> DataFrame:
    """The audit of `pages`, for which only pages unknown to `folder` are parsed; `parsed_in` tells in which run.

    Facts of parsed pages are kept by page and digest of its content. A run writes the
    facts it lacks to a table of its own and then records the run: until that row is
    there, nothing of it is seen, so a run that breaks off leaves the last state whole and is simply
    made again. Site evidence is looked up and the score computed anew every time, so the
    result equals that of a full audit; pages no longer crawled are not in it.

    Digests and ids are all that is shuffled to find what changed; texts are, at most, of
    changed pages. `page_id` is unique; of equal rows one is kept.
    """
    spark = pages.sparkSession
    source = page_source(pages).withColumn("digest", content_digest())
    keys = stored_lookup(source.select("page_id", "digest").distinct())
    known = committed_facts(spark, folder)
    fresh = keys if known is None else keys.join(known.select("page_id", "digest"), ["page_id", "digest"], "left_anti")
    run = (_runs(spark, folder) or [0])[-1] + 1
    changed = stored_lookup(fresh)
    digests = source.join(changed, ["page_id", "digest"], "left_semi")
    facts = scalar_facts(page_arrays(parsed_pages(digests.drop("digest"))))
    kept = facts.join(changed, "page_id").withColumn("parsed_in", F.lit(run)).dropDuplicates(["page_id", "digest"])
    # A run that broke off left files under this number: they were never recorded.
    kept.write.mode("overwrite").parquet(f"{folder}/{_FACTS}/run-{run}")
    spark.createDataFrame([(run,)], "run int").write.mode("append").parquet(f"{folder}/{_RUNS}")
    whole = committed_facts(spark, folder).join(keys, ["page_id", "digest"], "left_semi")
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    judged = attach_site_evidence(whole.drop("digest", "parsed_in"), site_files)
    audited = audit_facts(judged, fetched_at or now)
    return audited.join(whole.select("page_id", "parsed_in"), "page_id")
