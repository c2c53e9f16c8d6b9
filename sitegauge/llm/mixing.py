"""Mixing sources to target weights: Efraimidis-Spirakis sampling, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import WORD, stored, table
from sitegauge.operators.joins import left_join_lookup

# Rows of a source that one sort is planned for.
BUCKET_ROWS = 4_096
CYCLE = (1, 2, 3)
REPEATS = 3
# Classes of weights by which the spread of a source's keys is told.
WEIGHT_CLASSES = 40
# Rounds the SQL form fills budgets in; here they go on until nothing fits.
SQL_ROUNDS = 16


def sized(docs: DataFrame, text: str = "text", seed: int = 7) -> DataFrame:
    """Adds `size` (words), and `_key`: an exponential variate divided by the quality weight.

    The weight falls with the share of mark-up characters, from 1 to 1/20. The
    variate is drawn from a digest of id and text, so reruns agree; equal rows
    get equal keys.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    marks = F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))
    weight = F.greatest(F.lit(0.05), 1 - F.lit(4.0) * marks / F.greatest(F.length(body), F.lit(1)))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(body)))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(2**52))
    return docs.withColumn("size", F.regexp_count(body, F.lit(WORD)).cast("long")).withColumn(
        "_weight", weight
    ).withColumn("_key", -F.log(uniform) / F.col("_weight"))


def targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, repeats: int = REPEATS) -> DataFrame:
    """Target words per source: shares by weight, none above `repeats` times its size.

    `sizes` has one row per source (`source`, `source_size`). With caps c and
    weights w the targets are min(c, l * w) for the level l at which they add up to
    all words; sorted by c / w, a source is capped as long as its ratio is below
    the level the remaining sources would share.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int"))
    ranked = sizes.withColumn("share", share).withColumn("_cap", repeats * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("share"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum(
        "share"
    ).over(rest)
    levels = ranked.withColumn("_level", level)
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("share"), F.col("_level"))
    # The first level that fits is the least: up to there the levels fall no further than the ratios rise.
    common = F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn(
        "target", F.least(F.col("_cap").cast("double"), F.coalesce(common, F.lit(0.0)) * F.col("share"))
    ).drop("_cap", "_level")


def bucket_of(bucket_rows: int) -> Column:
    """Number of a row's bucket of keys: by the share of its source's keys below its own.

    Each class of weights (`_mix`: rows and mean weight) is an exponential of its own, so
    buckets are about equal however weights are mixed, and rise with the key.
    """
    above = F.aggregate("_mix", F.lit(0.0), lambda sum_, x: sum_ + x["n"] * F.exp(-x["w"] * F.col("_key")))
    n = F.ceil(F.col("_rows") / F.lit(bucket_rows))
    return F.least(n - 1, F.floor(n * (1 - above / F.col("_rows"))))


def key_classes(light: DataFrame) -> DataFrame:
    """Per source its words, rows, and rows by class of weight."""
    classes = light.groupBy("_source", F.floor(F.col("_weight") * WEIGHT_CLASSES).alias("_class")).agg(
        F.first("source").alias("source"), F.sum("size").alias("size"), F.count("*").alias("n"), F.avg("_weight").alias("w")
    )
    return classes.groupBy("_source").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.sum("n").alias("_rows"),
        F.collect_list(F.struct("n", "w")).alias("_mix"),
    )


def mix(docs: DataFrame, *, repeats: int = REPEATS, bucket_rows: int = BUCKET_ROWS, seed: int = 7) -> DataFrame:
    """One row per document: `doc_id, source, size, source_size, target, taken`.

    A source first gives as many whole epochs as its target holds. What is left is
    a weighted sample without replacement: documents in the order of their keys as
    long as their sizes add up to no more. A long document may end that early; then, of the
    documents not taken yet, those that still fit are added in the same order, round after round, until none
    fits: what a source lacks is less than its smallest document left. `taken` counts repeats.

    Scale: one narrow pass over the text. A source of any size is cut into about equal
    buckets of its keys; in a round, whole buckets up to the one in which the budget ends are in, and only
    that one is sorted. A round is remembered as two numbers per source, what was left and the
    key that no longer fitted, so documents carry no state and are judged in their row at the end.

    Null text has size 0; the null source is a source of its own, last in order;
    equal rows are documents of their own; an empty table gives no rows; a source
    without words has target 0. Other columns are not read.
    """
    light = stored(
        sized(docs, seed=seed).select(
            "doc_id", "source", "size", "_weight", "_key",
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_source"),
            # Tells rows of equal keys apart, once and for all as it is written.
            F.monotonically_increasing_id().alias("_row"),
        ),
        "mix-sizes",
    )
    per_source = key_classes(light)
    no_cuts = F.array().cast("array<struct<left:double,key:double,row:bigint>>")
    plan = targets(per_source, repeats=repeats).withColumn(
        "_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    )
    plan = plan.withColumn("_left", F.col("target") - F.col("_epochs") * F.col("source_size")).withColumn("_cuts", no_cuts)
    plan = stored(plan.drop("source", "share"), "mix-plan")
    bucket = bucket_of(bucket_rows)
    taken = F.exists(
        "_cuts",
        lambda c: (F.col("size") <= c["left"])
        & (c["key"].isNull() | (F.col("_key") < c["key"]) | ((F.col("_key") == c["key"]) & (F.col("_row") < c["row"]))),
    )
    rows = light.drop("source", "_weight")
    while True:
        placed = left_join_lookup(rows, plan, "_source", "_key", is_stored=True)
        free = placed.where((F.col("size") > 0) & (F.col("size") <= F.col("_left")) & ~taken).withColumn("_bucket", bucket)
        upto = Window.partitionBy("_source").orderBy("_bucket")
        filled = free.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words"), F.first("_left").alias("_left"))
        filled = stored(filled.withColumn("_upto", F.sum("_words").over(upto)), "mix-filled")
        if filled.isEmpty():
            break
        over = F.when(F.col("_upto") > F.col("_left"), F.struct("_bucket", (F.col("_upto") - F.col("_words")).alias("_before")))
        ends = filled.groupBy("_source").agg(F.min(over).alias("_edge"), F.max("_upto").alias("_all"))
        ends = stored(ends.select("_source", F.col("_edge._bucket").alias("_at"), F.col("_edge._before").alias("_before"), "_all"), "mix-ends")
        last = left_join_lookup(free, ends, "_source", "_key", is_stored=True).where(F.col("_bucket") == F.col("_at"))
        order = Window.partitionBy("_source").orderBy("_key", "_row").rowsBetween(Window.unboundedPreceding, 0)
        running = last.withColumn("_running", F.col("_before") + F.sum("size").over(order))
        cut = running.groupBy("_source").agg(
            F.min(F.when(F.col("_running") > F.col("_left"), F.struct("_key", "_row"))).alias("_cut"),
            F.max(F.when(F.col("_running") <= F.col("_left"), F.col("_running"))).alias("_got"),
        )
        step = ends.join(cut, "_source", "left")
        used = F.when(F.col("_at").isNull(), F.col("_all")).otherwise(F.coalesce("_got", "_before"))
        round_ = F.struct(F.col("_left").alias("left"), F.col("_cut._key").alias("key"), F.col("_cut._row").alias("row"))
        plan = plan.join(step, "_source", "left").select(
            *[c for c in plan.columns if c not in ("_left", "_cuts")],
            (F.col("_left") - F.coalesce(used, F.lit(0))).alias("_left"),
            F.when(F.col("_all").isNotNull(), F.array_append("_cuts", round_)).otherwise(F.col("_cuts")).alias("_cuts"),
        )
        plan = stored(plan, "mix-plan")
    judged = left_join_lookup(light, plan.drop("_mix"), "_source", "_key")
    return judged.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * (F.col("_epochs") + F.coalesce(taken, F.lit(False)).cast("int"))).cast("long").alias("taken"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).drop("source")


def mix_sql(docs: str) -> str:
    """The operator over `docs`, a query in DuckDB."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM ({docs})
), k AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    greatest(0.05::DOUBLE, 1 - 4.0::DOUBLE * (length(t) - length(translate(t, '#*$%&|<>', ''))) / greatest(length(t), 1)) AS weight,
    (('0x' || substr(md5(concat_ws(':', '7', doc_id::VARCHAR, md5(t))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1 AS share
  FROM k GROUP BY source
), r AS (
  SELECT *, 3 * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / share, source NULLS LAST
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(share) OVER (ORDER BY 3 * source_size / share, source NULLS LAST
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM s
), f AS (
  SELECT *, least(cap::DOUBLE, coalesce(arg_min(level, cap / share) FILTER (level <= cap / share) OVER (), 0) * share) AS target FROM r
), p AS (
  SELECT k.*, f.source_size, f.target,
    CASE WHEN f.source_size > 0 THEN floor(f.target / f.source_size) ELSE 0 END AS epochs,
    -ln(u) / weight AS key
  FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source
), w0 AS (
  SELECT *, target - epochs * source_size AS budget, FALSE AS taken, target - epochs * source_size AS rest FROM p
){"".join(_fill_sql(i) for i in range(SQL_ROUNDS))}
SELECT doc_id, size, source_size, target, (size * (epochs + taken::INT))::BIGINT AS taken FROM w{SQL_ROUNDS}"""


def _fill_sql(i: int) -> str:
    return f""", r{i} AS (
  SELECT *, NOT taken AND size <= rest AS fits, sum(CASE WHEN NOT taken AND size <= rest THEN size ELSE 0 END)
    OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM w{i}
), t{i} AS (
  SELECT * EXCLUDE (taken), taken OR (fits AND running <= rest) AS taken FROM r{i}
), w{i + 1} AS (
  SELECT * EXCLUDE (rest, fits, running), budget - sum(CASE WHEN taken THEN size ELSE 0 END) OVER (PARTITION BY source) AS rest FROM t{i}
)"""


SQL = mix_sql("SELECT * FROM documents")
