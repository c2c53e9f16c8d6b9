"""Left joins of a huge side to a one-row-per-key side that stay even when a key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.streaming.folders import run_folder

# Rows a lookup side may have to be broadcast: counted, never assumed.
BROADCAST_ROWS = 200_000
# Rows of one key a single task should have to take.
TASK_ROWS = 2_000_000
# Parts the rows without a key are spread over.
KEYLESS_PARTS = 4096


def stored_lookup(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back: computed once, however often it is counted and joined."""
    path = run_folder(df.sparkSession, "lookup")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, key: str, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `rows` rows; reads the key column only and stops early."""
    return df.select(key).limit(rows + 1).count() <= rows


def left_join_lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    salt_by: str,
    *,
    key_counts: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    task_rows: int = TASK_ROWS,
    is_stored: bool = False,
) -> DataFrame:
    """`left LEFT JOIN right USING (key)` for a `right` with one row per key.

    `right` is computed once and stored (unless it is already), so that counting it costs nothing more.
    If it is small it is broadcast and `left` is not shuffled at all. Beyond that, keys holding more than `task_rows` rows of `left` are cut into
    salted parts: the left rows by `salt_by`, the single right row copied to each
    part. Other keys keep one part, so `right` grows only by the hot keys. There
    are at most rows/`task_rows` hot keys; they are counted before the broadcast,
    and `task_rows` is doubled until they fit.

    `key_counts` may pass rows per key (`key`, `n`) from a cheaper table.
    """
    right = right if is_stored else stored_lookup(right)
    if is_small(right, key, broadcast_rows):
        return left.join(F.broadcast(right), key, "left")
    counts = key_counts if key_counts is not None else left.groupBy(key).agg(F.count("*").alias("n"))
    hot = counts.where((F.col("n") > task_rows) & F.col(key).isNotNull())
    while not is_small(hot, key, broadcast_rows):
        task_rows *= 2
        hot = counts.where((F.col("n") > task_rows) & F.col(key).isNotNull())
    hot = F.broadcast(hot.select(key, F.ceil(F.col("n") / task_rows).cast("int").alias("_parts")))
    spray = F.xxhash64(salt_by)
    cut_left = left.join(hot, key, "left").withColumn(
        "_part",
        # Rows without a key match nothing: spread them instead of piling them up.
        F.when(F.col(key).isNull(), F.pmod(spray, F.lit(KEYLESS_PARTS)).cast("int")).otherwise(
            F.coalesce(F.pmod(spray, F.col("_parts")).cast("int"), F.lit(0))
        ),
    )
    cut_right = right.join(hot, key, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    )
    return cut_left.drop("_parts").join(cut_right.drop("_parts"), [key, "_part"], "left").drop("_part")
