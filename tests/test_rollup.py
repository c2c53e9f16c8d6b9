"""Scores per site from mergeable sketches, and audits that parse only what changed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sitegauge.plans import incremental, rollup
from sitegauge.plans.audit import audit_pages
from sitegauge.schema import SITE_FILE
from sitegauge.streaming.folders import run_folder

AUDIT = "final_url string, grade string, fetched boolean, score int"


def graded(score):
    return next((g for low, g in ((90, "A+"), (80, "A"), (70, "B"), (60, "C"), (45, "D")) if score >= low), "F")


def rows_of(n, seed):
    """One site holds a third of all pages; some fetches failed, and one address has no host."""
    rnd = random.Random(seed)
    out = [("https:///x", "F", True, 3), ("https://lost.test/", "—", False, 0)]
    for i in range(n):
        site = "big.test" if i % 3 == 0 else f"s{rnd.randrange(9)}.test"
        score, fetched = rnd.randrange(101), rnd.random() > 0.1
        out.append((f"https://{site.upper()}:8443/{i}", graded(score) if fetched else "—", fetched, score if fetched else 0))
    return out


def by_hand(rows):
    cells = {}
    for url, grade, fetched, score in rows:
        site = url.split("/")[2].lower().split(":")[0]
        for key in ((site, grade), (site, None), (None, None)):
            cell = cells.setdefault(key, [0, []])
            cell[0] += 1
            if fetched:
                cell[1].append(score)
    out = {}
    for key, (n, scores) in cells.items():
        scores.sort()
        at = lambda q: scores[max(0, -(-round(q * 1_000) * len(scores) // 1_000) - 1)] if scores else None
        out[key] = (n, len(scores), sum(scores) if scores else None, *((scores[0], scores[-1]) if scores else (None, None)), *(at(q) for q in rollup.QUANTILES))
    return out


def collected(frame):
    quantiles = [rollup.quantile(F.col("sketch"), F.col("n_fetched"), q).alias(f"q{i}") for i, q in enumerate(rollup.QUANTILES)]
    rows = frame.select("site", "grade", "n_pages", "n_fetched", "score_sum", "lowest", "highest", *quantiles).collect()
    assert len({(r.site, r.grade) for r in rows}) == len(rows)
    return {(r.site, r.grade): tuple(r)[2:] for r in rows}


def test_rollup(spark):
    rows = rows_of(700, 1)
    assert collected(rollup.site_rollup(spark.createDataFrame(rows, AUDIT))) == by_hand(rows)
    assert collected(rollup.site_rollup(spark.createDataFrame([], AUDIT))) == {}


def test_rollups_of_two_runs_merge(spark):
    rows = rows_of(500, 2)
    parts = [rollup.site_rollup(spark.createDataFrame(part, AUDIT)) for part in (rows[:100], rows[100:])]
    assert collected(rollup.merged_rollups(parts[0].unionByName(parts[1]))) == by_hand(rows)


def test_large_sketches_stay_within_the_stated_error(spark):
    frame = spark.range(200_000).select(
        F.lit("https://a.test/").alias("final_url"), F.lit("F").alias("grade"), F.lit(True).alias("fetched"), (F.xxhash64("id") % 1_000_000).cast("int").alias("score")
    )
    row = rollup.site_rollup(frame).where("site IS NULL").first()
    scores = sorted(r.score for r in frame.collect())
    found = frame.sparkSession.createDataFrame([(row.sketch,)], "sketch binary").select(
        *[rollup.quantile(F.col("sketch"), F.lit(1), q).alias(f"q{i}") for i, q in enumerate(rollup.QUANTILES)]
    ).first()
    import bisect

    for q, value in zip(rollup.QUANTILES, found):
        assert abs(bisect.bisect_right(scores, value) / len(scores) - q) < 0.006


PAGES = "page_id bigint, url string, html string, status int, headers map<string,string>"
SHUT = "User-agent: GPTBot\nDisallow: /\n"


def page(i, text="some words", status=200, headers=None):
    return (i, f"https://a.test/{i}", f"<title>t{i}</title><article><p>{text}</p></article>", status, headers)


def reports(frame):
    return sorted((r.page_id, r.url, r.score, r.grade, r.page_title, str(r.signals), str(r.notes)) for r in frame.collect())


def run(spark, rows, folder, files=None):
    """Audits incrementally, compares with the whole audit, and tells in which run each page was parsed."""
    pages = spark.createDataFrame(rows, PAGES)
    sites = spark.createDataFrame(files, SITE_FILE) if files else None
    found = incremental.incremental_audit(pages, sites, folder, fetched_at="now")
    assert reports(found) == reports(audit_pages(pages, sites, fetched_at="now"))
    return {r.page_id: r.parsed_in for r in found.collect()}


def test_only_changes_are_parsed(spark):
    folder = run_folder(spark, "incremental")
    assert run(spark, [page(1), page(2), page(3), page(4, status=404)], folder) == {1: 1, 2: 1, 3: 1, 4: 1}
    # Another text, another header, another status, one page gone, one new.
    now = [page(1), page(2, "other words"), page(4), page(5, headers={"last-modified": "Tue"})]
    assert run(spark, now, folder) == {1: 1, 2: 2, 4: 2, 5: 2}
    assert run(spark, now, folder) == {1: 1, 2: 2, 4: 2, 5: 2}
    # What is as it once was needs no parse; new site files change scores of all.
    assert run(spark, [page(1), page(2), page(3)], folder, [("https://a.test", "robots", 200, "text/plain", SHUT, 0)]) == {1: 1, 2: 1, 3: 1}
    parsed = incremental.committed_facts(spark, folder)
    assert parsed.count() == 7 and parsed.select("page_id", "digest").distinct().count() == 7


def test_a_run_that_broke_off_is_not_seen(spark, monkeypatch):
    folder = run_folder(spark, "incremental")
    run(spark, [page(1)], folder)
    # The facts of run 2 are written, but it ends before it is recorded.
    incremental.committed_facts(spark, folder).drop("page_id").selectExpr("99L AS page_id", "*").write.parquet(f"{folder}/facts/run-2")
    assert incremental.committed_facts(spark, folder).count() == 1
    assert run(spark, [page(1), page(2)], folder) == {1: 1, 2: 2}


def test_null_is_no_empty_text(spark):
    folder = run_folder(spark, "incremental")
    rows = [(1, "https://a.test/", None, 200, None), (2, "https://a.test/", "", 200, None)]
    assert run(spark, rows, folder) == {1: 1, 2: 1}
    assert run(spark, [(1, "https://a.test/", "", 200, None), (2, "https://a.test/", None, 200, None)], folder) == {1: 2, 2: 2}
    assert run(spark, [page(1, headers={"a": "1", "b": "2"})], folder) == {1: 3}
    assert run(spark, [page(1, headers={"b": "2", "a": "1"})], folder) == {1: 3}


def test_an_empty_crawl(spark):
    folder = run_folder(spark, "incremental")
    assert run(spark, [], folder) == {}
    assert run(spark, [page(1)], folder) == {1: 2}
