"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.plans.reports import json_reports, report_struct


def write_reports(audit: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """One report per page: JSON lines as text, or typed columns in parquet or orc."""
    if fmt == "json":
        json_reports(audit).select("report").write.mode(mode).text(path)
    else:
        audit.select("page_id", report_struct().alias("r")).select(F.col("page_id"), "r.*").write.mode(mode).format(
            fmt
        ).save(path)
