"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import Words, bytes_in, grams, mixed, sliced, stored, table, words_of

WINDOW = 5
MIN_WORDS, MAX_REPEATED = 10, 0.2


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Per text, the words inside runs of `window` words that the text holds twice or more."""
    value, at = grams(mixed(words.ids.astype(np.uint64)), words.doc, window)
    with np.errstate(over="ignore"):
        value = mixed(value + mixed(words.doc[at].astype(np.uint64)))
    order = np.argsort(value, kind="stable")
    twin = value[order][1:] == value[order][:-1]
    same = np.zeros(len(value), bool)
    same[order[1:][twin]] = same[order[:-1][twin]] = True
    at = at[same]
    covered = np.zeros(len(words.ids) + 1, np.int64)
    if len(at):
        # Equal hashes are only candidates: compare the words themselves.
        rows = np.column_stack([words.doc[at], *(words.ids[at + i] for i in range(window))])
        _, which, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        at = at[count[which.ravel()] > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
    inside = np.cumsum(covered)[:-1] > 0
    return np.bincount(words.doc[inside], minlength=len(words.counts))


def text_measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts over whole texts (no nulls) that the rules and the base filter are made of."""
    n = len(texts)
    words = words_of(texts)
    chars = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)[words.ids]
    lists = pc.split_pattern(texts, "\n")
    lines, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    trimmed = pc.ascii_trim_whitespace(lines)
    full = pc.greater(pc.binary_length(trimmed), 0)
    row = row[full.to_numpy(zero_copy_only=False)].astype(np.int64)
    coded = lines.filter(full).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = np.unique(row * max(1, len(coded.dictionary)) + ids) // max(1, len(coded.dictionary))
    ended = pc.match_substring_regex(trimmed.filter(full), r"[.!?:;\"')]$").to_numpy(zero_copy_only=False)
    n_lines = np.bincount(row, minlength=n)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": np.bincount(words.doc, chars, minlength=n).astype(np.int64),
        "n_symbols": bytes_in(texts, b"#*$%&|<>"),
        "n_dup_lines": n_lines - np.bincount(distinct, minlength=n),
        "n_repeat_words": repeated_words(words),
        "n_lines": n_lines,
        "n_ended": np.bincount(row[ended], minlength=n),
        "n_upper": bytes_in(texts, bytes(range(65, 91))),
        "n_letters": bytes_in(texts, bytes([*range(65, 91), *range(97, 123)])),
        "n_bars": bytes_in(texts, b"|"),
    }


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_ended", "n_upper", "n_letters", "n_bars",
)


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and the text measures as longs; one narrow pass, a few megabytes of text in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            found = text_measures(pc.fill_null(batch.column("_text"), ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], ["_key", *MEASURES]
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = f"_key {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    return rows.mapInArrow(run, schema).withColumnRenamed("_key", key)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(value: Column, bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes over the measures: 1 good, -1 bad, 0 abstains."""
    symbols, dup = _share("n_symbols", "word_chars"), _share("n_dup_lines", "n_lines")
    repeat, mean = _share("n_repeat_words", "n_words"), _share("word_chars", "n_words")
    upper, ended, bars = _share("n_upper", "n_letters"), _share("n_ended", "n_lines"), _share("n_bars", "n_words")
    none = F.lit(False)
    return {
        "few_symbols": _vote(symbols, symbols > 0.05, symbols < 0.01),
        "few_copied_lines": _vote(dup, dup > 0.3, none),
        "few_repeats": _vote(repeat, repeat > 0.15, none),
        "usual_words": _vote(mean, (mean < 2.5) | (mean > 15), none),
        "usual_case": _vote(upper, upper > 0.3, none),
        "sentences": _vote(ended, ended < 0.2, ended > 0.6),
        "no_table": _vote(bars, bars > 0.05, none),
        "substance": _vote(F.col("n_words"), F.col("n_words") < 5, F.col("n_words") >= 50),
    }


def fit_rules(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns (patterns x rules) that occur `counts` times.

    Given the hidden quality y, rules vote independently; an abstention says
    nothing. Returns the probability of a right vote of each rule for bad and for
    good texts (2 x rules), the posterior of each pattern, and the prior. The start,
    in which a bad vote outweighs the good ones, fixes which class is the good one;
    a few imagined votes keep rules that hardly vote near it.
    """
    up, down = (votes > 0).astype(float), (votes < 0).astype(float)
    posterior = np.where(down.any(1), 0.1, 0.9)
    for _ in range(rounds):
        good, bad = counts * posterior, counts * (1 - posterior)
        right = np.stack([(bad @ down + 3.5) / (bad @ (up + down) + 5), (good @ up + 3.5) / (good @ (up + down) + 5)])
        right = right.clip(0.01, 0.99)
        prior = float(np.clip(good.sum() / max(counts.sum(), 1), 0.02, 0.98))
        score = np.log(prior / (1 - prior)) + up @ np.log(right[1] / (1 - right[0])) + down @ np.log((1 - right[1]) / right[0])
        before, posterior = posterior, 1 / (1 + np.exp(-score))
        if np.abs(posterior - before).max(initial=0) < 1e-9:
            break
    return right, posterior, prior


def judge_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`doc_id`, the measures, a vote per rule, `quality` (posterior), `base_failed` and `kept`.

    A text fails the base filter with fewer than ten words, or if over 20 % of its
    words stand in repeated five-word windows; other texts are kept if the
    posterior probability of good quality, given the votes, reaches `threshold`.

    Scale: one pass measures every text and writes a few numbers per document; the
    model is fitted on the counts of vote patterns, at most 3 to the number of rules
    (6,561) whatever the corpus, and goes back as a broadcast of those patterns.

    Null and empty texts have no words and fail; equal rows get equal results; an
    empty table gives no rows; other columns are not read.
    """
    voting = rules()
    code = sum(((vote + 1) * F.lit(3**i) for i, vote in enumerate(voting.values())), F.lit(0)).cast("int")
    measured = stored(measures(docs).withColumn("_code", code), "quality-measures")
    patterns = sorted((r["_code"], r["n"]) for r in measured.groupBy("_code").agg(F.count("*").alias("n")).collect())
    codes = np.array([p[0] for p in patterns], np.int64)
    votes = np.stack([codes // 3**i % 3 - 1 for i in range(len(voting))], axis=1)
    _, posterior, _ = fit_rules(votes, np.array([p[1] for p in patterns], float))
    spark = docs.sparkSession
    model = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, posterior)], "_code int, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * int(100 * MAX_REPEATED))
    judged = measured.join(F.broadcast(model), "_code").withColumn("base_failed", failed)
    return judged.select(
        "doc_id", *MEASURES, *(vote.alias(f"vote_{name}") for name, vote in voting.items()), "quality", "base_failed",
        (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )
