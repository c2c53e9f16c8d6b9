"""Audit job for spark-submit: crawl table in, report table out.

    spark-submit --py-files sitegauge.zip sitegauge/jobs.py PAGES OUT [--site-files PATH] [--format json]

Exits with 0 when every page reaches the bar, 1 when one does not, 2 on an error, 3 for a crawl without pages.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from sitegauge.plans.audit import audit_pages
from sitegauge.schema import PAGE, SITE_FILE
from sitegauge.session import build_session
from sitegauge.sources.pages import read_table
from sitegauge.sources.sinks import write_reports


def run(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="sitegauge")
    parser.add_argument("pages")
    parser.add_argument("out")
    parser.add_argument("--site-files")
    parser.add_argument("--dns", help="table of host and ip; pages at unsafe addresses are refused")
    parser.add_argument("--redirects", help="table of from_url and to_url; pages reached over unsafe addresses are refused (needs --dns)")
    parser.add_argument("--networks", help="table of networks (cidr) that are not public, in place of the usual ones (needs --dns)")
    parser.add_argument("--format", default="parquet", choices=["json", "parquet", "orc"])
    parser.add_argument("--fetched-at")
    parser.add_argument("--bar", type=int, default=50)
    args = parser.parse_args(argv)
    if (args.redirects or args.networks) and not args.dns:
        parser.error("--redirects and --networks need --dns")
    spark = build_session()
    files = read_table(spark, args.site_files, schema=SITE_FILE) if args.site_files else None
    dns = read_table(spark, args.dns, schema="host STRING, ip STRING") if args.dns else None
    guard = {"dns": dns}
    if args.redirects:
        guard["redirects"] = read_table(spark, args.redirects, schema="from_url STRING, to_url STRING")
    if args.networks:
        guard["networks"] = read_table(spark, args.networks, schema="cidr STRING")
    audit = audit_pages(read_table(spark, args.pages, schema=PAGE), files, fetched_at=args.fetched_at, **guard)
    write_reports(audit, args.out, args.format)
    # The gate reads the written scores: pages are parsed once, and no report is read to guess its schema.
    lowest = spark.read.schema("score INT").format(args.format).load(args.out).agg(F.min("score")).first()[0]
    if lowest is None:
        return 3
    return 0 if lowest >= args.bar else 1


if __name__ == "__main__":
    try:
        code = run(sys.argv[1:])
    except Exception as error:  # the caller tells a bad score from a broken job
        print(f"error: {error}", file=sys.stderr)
        code = 2
    sys.exit(code)
