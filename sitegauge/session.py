"""Session settings the jobs are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages are wide rows: a few hundred of them already fill an Arrow batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    # Long column expressions are built node by node: skip recording a call site for each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # JSON-LD with a repeated key keeps the last value instead of being discarded.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "sitegauge", master: str | None = None, **extra: str) -> SparkSession:
    """A session with `SETTINGS`; `extra` uses double underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
