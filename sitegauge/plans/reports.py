"""Report tables over audited pages. All are row-local: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.operators import scoring


def signal_rows(audit: DataFrame) -> DataFrame:
    """Long form: one row per page and signal."""
    return audit.select("page_id", F.explode("signals").alias("s")).select(
        "page_id", "s.*", scoring.status(F.col("s")).alias("status")
    )


def bucket_table(audit: DataFrame) -> DataFrame:
    """One row per scored page and bucket, in bucket order."""
    rows = audit.select("page_id", F.explode("bucket_scores").alias("bucket", "b"))
    return rows.select(
        "page_id", "bucket", scoring.bucket_label(F.col("bucket")).alias("label"), "b.earned", "b.max", "b.percent"
    )


def _ranked(audit: DataFrame, items) -> DataFrame:
    return audit.select("page_id", F.posexplode(items).alias("_i", "s")).select(
        "page_id", (F.col("_i") + 1).alias("rank"), "s.*"
    )


def top_fixes(audit: DataFrame, limit: int = 8) -> DataFrame:
    return _ranked(audit, scoring.heaviest_failures(F.col("signals"), limit))


def whats_working(audit: DataFrame, limit: int = 6) -> DataFrame:
    return _ranked(audit, scoring.first_passes(F.col("signals"), limit))


def first_fixes(audit: DataFrame) -> DataFrame:
    return audit.select("page_id", F.posexplode("fixes").alias("_i", "fix")).select(
        "page_id", (F.col("_i") + 1).alias("rank"), "fix"
    )


def gate_table(audit: DataFrame, bar: int = 50) -> DataFrame:
    return audit.select(
        "page_id", "score", scoring.gate(F.col("score"), F.col("fetched"), bar).alias("gate"),
        scoring.tone(F.col("score")).alias("tone"),
    )


def report_struct():
    """The full report of a page, buckets in report order; a failed page has none."""
    signal = lambda s: s.dropFields("signal_no")
    return F.struct(
        "url", "score", "grade", "fetched_at", "page_title",
        "bucket_scores",
        F.transform("signals", signal).alias("signals"),
        "fixes", "notes",
    )


def json_reports(audit: DataFrame) -> DataFrame:
    """One JSON document per page; NULL fields are written out."""
    return audit.select(
        "page_id", F.to_json(report_struct(), {"ignoreNullFields": "false"}).alias("report")
    )
