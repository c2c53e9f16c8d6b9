"""Pages and site crawls as streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sitegauge.plans.audit import audit_pages
from sitegauge.streaming import audit as live
from sitegauge.streaming.folders import run_folder

DAY = dt.datetime(2025, 3, 1, tzinfo=dt.timezone.utc)
PAGES = "page_id bigint, url string, html string, crawled_at timestamp"
CRAWLS = "origin string, crawled_at timestamp, files array<struct<kind:string,status:int,content_type:string,body:string,redirect_hops:int>>"
NOTES = "# Ferry times\n\n- winter: hourly until dusk\n- summer: every half hour\n"
SHUT, OPEN = "User-agent: GPTBot\nDisallow: /\n", "User-agent: GPTBot\nAllow: /\n"


def at(hours: float) -> dt.datetime:
    return DAY + dt.timedelta(hours=hours)


def files(robots: str, probe: int = 404) -> list[tuple]:
    return [("robots", 200, "text/plain", robots, 0), ("llms", 200, "text/plain", NOTES, 0), ("probe", probe, "text/plain", "", 0)]


def reports(frame):
    return sorted((r.page_id, r.url, r.score, r.grade, str(r.signals), str(r.notes)) for r in frame.collect())


def test_a_replay_equals_the_batch_audit(spark, tmp_path):
    """Files come in four deliveries, crawls before and after their pages, one site with most pages and one never crawled."""
    html = "<title>t</title><article><h1>x</h1><p>some words</p></article>"
    pages = [(i, f"https://{'big' if i % 3 else 'small'}.test/{i}", html, at(i)) for i in range(24)]
    pages += [(100, "https://never.test/", html, at(5)), (101, "https://late.test/", html, at(3)), (102, "https://BIG.test:443/x", None, at(30))]
    crawls = [
        ("https://big.test", at(0), files(SHUT)), ("https://big.test", at(10), files(OPEN)), ("https://Small.test:443", at(4), files(SHUT, 503)),
        ("https://late.test", at(6), files(OPEN)), ("https://big.test", at(20), files(SHUT, 200)),
    ]
    source, out = str(tmp_path), run_folder(spark, "stream-audit")
    for k in range(2):
        spark.createDataFrame(pages[k::2], PAGES).coalesce(1).write.mode("append").parquet(f"{source}/pages")
        spark.createDataFrame(crawls[k::2], CRAWLS).coalesce(1).write.mode("append").parquet(f"{source}/crawls")

    def run():
        streams = (spark.readStream.schema(s).option("maxFilesPerTrigger", 2).parquet(f"{source}/{n}") for n, s in (("pages", PAGES), ("crawls", CRAWLS)))
        live.start_audit(*streams, out, window="7 days", lateness="2 days").awaitTermination()

    run()
    # What met a crawl is there; what met none waits for the watermark.
    so_far = {r.page_id for r in live.read_audit(spark, out, "now").collect()}
    assert {5, 12, 102} <= so_far and not so_far & {100, 101}
    for name, rows in zip(("pages", "crawls"), live.closing_rows(spark, "2026-01-01")):
        rows.coalesce(1).write.mode("append").parquet(f"{source}/{name}")
    run()
    one_by_one = [(o, f[0], f[1], f[2], f[3], f[4], t) for o, t, fs in crawls for f in fs]
    schema = "origin string, kind string, status int, content_type string, body string, redirect_hops int, crawled_at timestamp"
    whole = audit_pages(spark.createDataFrame(pages, PAGES), spark.createDataFrame(one_by_one, schema), fetched_at="now")
    assert reports(live.read_audit(spark, out, "now")) == reports(whole)


def test_the_state_is_bounded_by_both_watermarks(spark):
    pages = spark.readStream.schema(PAGES).parquet("/root/testdata/sf0.001/pages.parque[t]")
    crawls = spark.readStream.schema(CRAWLS).parquet("/root/testdata/sf0.001/pages.parque[t]")
    plan = live.joined_facts(pages, crawls, "1 day", "1 hour")._jdf.queryExecution().analyzed().toString()
    assert plan.count("EventTimeWatermark") == 2 and "LeftOuter" in plan and "html" not in plan.splitlines()[0]
    assert live.closing_rows(spark, "2030-01-01")[0].select(F.year("crawled_at")).first()[0] == 2030
