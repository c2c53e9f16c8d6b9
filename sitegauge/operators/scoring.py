"""Bucket points, score, grade and the row-local report lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.operators.signals import all_signals
from sitegauge.schema import BUCKET_CAPS, FAILED_GRADE, GRADE_FLOORS


def bucket_weight(bucket: str) -> int:
    return sum(s.weight for s in all_signals() if s.bucket == bucket)


def bucket_points(bucket: str) -> Column:
    """Points earned in one bucket, from the signal columns `s1`, `s2`, …"""
    return sum((F.col(f"s{s.no}.points") for s in all_signals() if s.bucket == bucket), F.lit(0))


def scaled(points: Column, bucket: str) -> Column:
    """Points on the scale of the bucket's cap."""
    return points / F.lit(float(bucket_weight(bucket) or 1)) * F.lit(float(BUCKET_CAPS[bucket]))


def bucket_struct(points: Column, bucket: str) -> Column:
    cap = float(BUCKET_CAPS[bucket])
    return F.struct(
        F.bround(scaled(points, bucket), 1).alias("earned"),
        F.lit(cap).alias("max"),
        F.bround(F.lit(100.0) * scaled(points, bucket) / F.lit(cap), 1).alias("percent"),
    )


def page_score(points: dict[str, Column]) -> Column:
    total = sum((scaled(p, b) for b, p in points.items()), F.lit(0.0))
    return F.least(F.lit(100), F.greatest(F.lit(0), F.bround(total, 0).cast("int")))


def grade(score: Column) -> Column:
    chain = F
    for floor, letter in GRADE_FLOORS:
        chain = chain.when(score >= floor, letter)
    return chain.otherwise("F")


def failed_grade() -> Column:
    return F.lit(FAILED_GRADE)


def fix_list(signals: Column, limit: int = 10) -> Column:
    """First fixes in signal order."""
    fixes = F.transform(F.filter(signals, lambda s: s["fix"].isNotNull()), lambda s: s["fix"])
    return F.slice(fixes, 1, limit)


def heaviest_failures(signals: Column, limit: int = 8) -> Column:
    """Failed signals by weight, heaviest first; equal weights keep signal order."""
    failed = F.filter(signals, lambda s: ~s["passed"])
    keyed = F.transform(failed, lambda s: F.struct((-s["weight"]).alias("k"), s["signal_no"].alias("n"), s.alias("s")))
    return F.slice(F.transform(F.array_sort(keyed), lambda k: k["s"]), 1, limit)


def first_passes(signals: Column, limit: int = 6) -> Column:
    return F.slice(F.filter(signals, lambda s: s["passed"]), 1, limit)


def gate(score: Column, fetched: Column, bar: int = 50) -> Column:
    """Process outcome: 0 good enough, 1 below the bar (also a page that could not be fetched)."""
    return F.when(fetched & (score >= bar), 0).otherwise(1)


def tone(score: Column) -> Column:
    return F.when(score >= 70, "good").when(score >= 50, "warn").otherwise("danger")


def bucket_label(bucket: Column) -> Column:
    return F.initcap(F.replace(bucket, F.lit("_"), F.lit(" ")))


def status(signal: Column) -> Column:
    """pass, partial (some points without passing) or fail."""
    return F.when(signal["passed"], "pass").when(signal["points"] > 0, "partial").otherwise("fail")
