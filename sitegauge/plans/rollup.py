"""Scores per site: exact counts and sums, quantiles from sketches that merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.urls import hostname, netloc

# Size of a sketch: exact up to about this many pages; beyond, a quantile's rank is within 0.3 % (99 of 100 times).
SKETCH_K = 1_024
QUANTILES = (0.1, 0.5, 0.9)


def site_rollup(audit: DataFrame) -> DataFrame:
    """Audited pages per site, per site and grade, and over all: `site, grade` are NULL where a row spans all of them.

    `n_pages`, `n_fetched`, `score_sum`, `lowest` and `highest` are exact, over fetched pages but
    for `n_pages`; `sketch` holds the fetched pages' scores (see `SKETCH_K`). All are folded
    map-side, so a site with a third of all pages is shuffled as one row per task, and nothing is sorted.
    A page whose address has no host counts under the site ''.
    """
    host = F.coalesce(hostname(netloc(F.col("final_url"))), F.lit(""))
    rows = audit.select(host.alias("site"), "grade", F.when(F.col("fetched"), F.col("score").cast("bigint")).alias("s"))
    # One aggregation; the two coarser levels are merged from it, not counted again.
    finest = rows.groupBy("site", "grade").agg(
        F.count("*").alias("n_pages"), F.count("s").alias("n_fetched"), F.sum("s").alias("score_sum"),
        F.min("s").alias("lowest"), F.max("s").alias("highest"), F.kll_sketch_agg_bigint("s", SKETCH_K).alias("sketch"),
    )
    return merged_rollups(finest)


def merged_rollups(finest: DataFrame) -> DataFrame:
    """Rollups of several runs (rows with a site and a grade) merged into one, with the levels above."""
    cells = finest.where("site IS NOT NULL AND grade IS NOT NULL")
    level = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level")
    spread = cells.select("*", level).select(
        "level", F.when(F.col("level") < 2, F.col("site")).alias("site"), F.when(F.col("level") < 1, F.col("grade")).alias("grade"),
        "n_pages", "n_fetched", "score_sum", "lowest", "highest", "sketch",
    )
    return spread.groupBy("level", "site", "grade").agg(
        F.sum("n_pages").alias("n_pages"), F.sum("n_fetched").alias("n_fetched"), F.sum("score_sum").alias("score_sum"),
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.kll_merge_agg_bigint("sketch", SKETCH_K).alias("sketch"),
    ).drop("level")


def quantile(sketch: Column, n: Column, q: float) -> Column:
    """The least score that this share of the pages does not exceed; NULL without a fetched page."""
    return F.when(n > 0, F.kll_sketch_get_quantile_bigint(sketch, F.lit(q)))
