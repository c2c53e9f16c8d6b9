"""Preference formatting: common prompt, paired and masked completions; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import table

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
LEARNED = "assistant"


def _turns(turns: DataFrame, side: str) -> DataFrame:
    """One row per (pair, turn): of several, the one with the least role, then text (nulls first)."""
    placed = turns.where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull())
    return placed.groupBy("pair_id", "turn").agg(F.min(F.struct("role", "text")).alias(side))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Renders pairs of conversations turn by turn: `pair_id, side, turn, role, rendered, loss_from, loss_to`.

    Both inputs have `pair_id, turn, role, text`. Turns before the first one that
    differs (role or text, nulls equal; a turn only one side has differs) form the
    prompt and are rendered once, side `prompt`. The rest are the completions,
    sides `chosen` and `rejected`, which share `pair_id`. Code points from
    `loss_from` to `loss_to` (exclusive) of `rendered` are learned from: the text and
    the end mark of assistant turns in completions; elsewhere both are 0. Read in
    the order of `turn`, the rows of prompt and one side are that conversation.

    Scale: turns stay rows, so a conversation of any length is never gathered; both
    exchanges by (pair, turn) are even, the first difference is a map-side minimum,
    and the join back to it is one the planner can split.

    Rows without pair or turn have no place and are left out; of repeated rows one
    is kept; null text renders as empty, a null role as `none`; a pair that one
    side lacks has an empty prompt; equal sides have no completions.
    """
    both = _turns(chosen, "chosen").join(_turns(rejected, "rejected"), ["pair_id", "turn"], "full")
    same = F.col("chosen").isNotNull() & F.col("rejected").isNotNull() & F.col("chosen").eqNullSafe(F.col("rejected"))
    differs = both.where(~same).groupBy("pair_id").agg(F.min("turn").alias("_first"))
    split = both.join(differs, "pair_id", "left")
    prompt = F.col("_first").isNull() | (F.col("turn") < F.col("_first"))
    part = lambda side, turn: F.struct(F.lit(side).alias("side"), turn["role"].alias("role"), turn["text"].alias("text"))
    sides = F.when(prompt, F.array(part("prompt", F.col("chosen")))).otherwise(
        F.filter(
            F.array(
                F.when(F.col("chosen").isNotNull(), part("chosen", F.col("chosen"))),
                F.when(F.col("rejected").isNotNull(), part("rejected", F.col("rejected"))),
            ),
            lambda x: x.isNotNull(),
        )
    )
    rows = split.select("pair_id", "turn", F.explode(sides).alias("p")).select("pair_id", "p.side", "turn", "p.role", "p.text")
    role = F.coalesce(F.col("role"), F.lit("none"))
    head = F.concat(F.lit(OPEN.split("{}")[0]), role, F.lit(OPEN.split("{}")[1]))
    rendered = F.concat(head, F.coalesce(F.col("text"), F.lit("")), F.lit(CLOSE))
    learned = (F.col("side") != "prompt") & (role == LEARNED)
    return rows.select(
        "pair_id", "side", "turn", "role", rendered.alias("rendered"),
        F.when(learned, F.length(head)).otherwise(0).cast("long").alias("loss_from"),
        F.when(learned, F.length(rendered)).otherwise(0).cast("long").alias("loss_to"),
    )


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Rejected conversations: the last assistant reply is that of the next conversation, empty without one."""
    last = turns.where((F.col("role") == LEARNED) & F.col("turn").isNotNull()).groupBy("conv_id").agg(
        F.max(F.struct("turn", "text")).alias("last")
    )
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other"))
    reply = last.select("conv_id", F.col("last.turn").alias("turn"), F.lit(True).alias("swap")).join(other, "conv_id", "left")
    # Joined by conversation and turn: even, and already the partitioning that the rendering needs.
    joined = turns.join(reply, ["conv_id", "turn"], "left")
    text = F.when(F.col("swap") & (F.col("role") == LEARNED), F.coalesce(F.col("other"), F.lit(""))).otherwise(F.col("text"))
    return joined.select("conv_id", "turn", "role", text.alias("text"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation against itself with a reply that answers something else."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return format_preferences(
        turns.withColumnRenamed("conv_id", "pair_id"), swapped_replies(turns).withColumnRenamed("conv_id", "pair_id")
    )


SQL = r"""
WITH l AS (
  SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS reply
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), r AS (
  SELECT c.conv_id, c.turn, c.role,
    CASE WHEN c.role = 'assistant' AND c.turn = l.last_turn THEN coalesce(o.reply, '') ELSE c.text END AS text
  FROM conversations c LEFT JOIN l ON l.conv_id = c.conv_id LEFT JOIN l o ON o.conv_id = c.conv_id + 1
), b AS (
  SELECT c.conv_id, c.turn, c.role, c.text, r.text AS other FROM conversations c JOIN r USING (conv_id, turn)
), f AS (
  SELECT conv_id, min(turn) FILTER (text IS DISTINCT FROM other) AS first FROM b GROUP BY conv_id
), s AS (
  SELECT conv_id AS pair_id, CASE WHEN first IS NULL OR turn < first THEN 'prompt' ELSE 'chosen' END AS side, turn, role, text
  FROM b JOIN f USING (conv_id)
  UNION ALL
  SELECT conv_id, 'rejected', turn, role, other FROM b JOIN f USING (conv_id) WHERE turn >= first
), t AS (
  SELECT *, '<|' || coalesce(role, 'none') || '|>' || chr(10) AS head,
    side <> 'prompt' AND coalesce(role, 'none') = 'assistant' AS learned FROM s
)
SELECT pair_id, side, turn, role, head || coalesce(text, '') || '<|end|>' || chr(10) AS rendered,
  CASE WHEN learned THEN length(head) ELSE 0 END::BIGINT AS loss_from,
  CASE WHEN learned THEN length(head) + length(coalesce(text, '')) + 8 ELSE 0 END::BIGINT AS loss_to
FROM t"""
