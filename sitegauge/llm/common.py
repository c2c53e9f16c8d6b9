"""Helpers the corpus operators share: tables, written stages, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from sitegauge.streaming.folders import run_folder

# A word, in the syntax of Java, RE2 and Python alike.
WORD = r"[^\x20\x09-\x0D]+"
# Characters of text one step inside a task works on at once: bounds its memory.
SLICE_CHARS = 2_000_000
# Whether the files of a query's shuffles go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: lineage is cut, and a lost executor loses nothing.

    The shuffles of the write go with it: else they stay until the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, run_folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # A frame keeps the setting under which it was made.
        df.select("*").write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def with_columns(df: DataFrame, extra: str) -> str:
    """Schema text of the columns of `df` and `extra` ones."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), extra])


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that `column` holds about `limit` bytes at most; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


@dataclass
class Words:
    """Words of some texts in order: `ids` index `vocabulary`, `doc` is the row each word belongs to."""

    ids: np.ndarray
    doc: np.ndarray
    counts: np.ndarray
    vocabulary: pa.Array

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, the same in every task."""
        return self.hashed_vocabulary()[self.ids]

    def hashed_vocabulary(self) -> np.ndarray:
        words = self.vocabulary.to_pylist()
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Texts with every byte replaced by its entry in `table`; nulls become empty."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = (texts.buffers()[2] or pa.py_buffer(b""))[int(offsets[0]) : int(offsets[-1])].to_pybytes()
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data.translate(table)))


def words_of(texts: pa.Array) -> Words:
    """Maximal runs of characters other than blank and U+0009 to U+000D; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    rows = rows[full.to_numpy(zero_copy_only=False)]
    coded = flat.filter(full).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(ids, rows.astype(np.int64), np.bincount(rows, minlength=len(texts)), coded.dictionary)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `n` words within one text, and the index of its first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        value = hashes[:m].copy()
        for i in range(1, n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mixed(value[at]), at


def bytes_in(texts: pa.Array, wanted: bytes) -> np.ndarray:
    """Per text, how many of its bytes are in `wanted` (ASCII, so bytes are characters)."""
    flags = np.zeros(256, np.int64)
    flags[list(wanted)] = 1
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    upto = np.concatenate([[0], np.cumsum(flags[data])])
    at = offsets - offsets[0]
    return upto[at[1:]] - upto[at[:-1]]
