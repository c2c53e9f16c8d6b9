"""Page-readiness analytics on Spark: audit tables of crawled pages as DataFrame jobs."""

from sitegauge.plans.audit import audit_pages, page_facts
from sitegauge.plans.reports import (
    bucket_table,
    first_fixes,
    gate_table,
    json_reports,
    signal_rows,
    top_fixes,
    whats_working,
)
from sitegauge.operators.signals import register_signal
from sitegauge.session import build_session

__all__ = [
    "audit_pages",
    "build_session",
    "bucket_table",
    "first_fixes",
    "gate_table",
    "json_reports",
    "page_facts",
    "register_signal",
    "signal_rows",
    "top_fixes",
    "whats_working",
]
