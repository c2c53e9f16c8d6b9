"""Rate limits and window counts over a live request stream, on the engine's keyed state.

Both stateful operators see counts only: a stateless step folds the rows of a task to
counts per client and second (or window) before the shuffle, so a client that sends
a third of the stream costs its state a few rows. Counts travel packed, and state is
keyed by window and a share of its clients: what the engine asks per key (calls to the
store, timers, batches) is paid for many clients at once. The requests themselves go around
the operator, through the same streaming query, and are written beside what it says.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from sitegauge.operators import ratelimit as rl

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OFFSETS = "client_ip string, second bigint, minute_before bigint, day_before bigint, batch bigint"
# Rows a task folds and packs at once: bounds its memory.
FOLD_ROWS = 500_000
# Packed rows of an Arrow batch.
PACK_ROWS = 1_000
# Shares the clients of a window are dealt to: so many a minute of its span, within bounds.
SHARES_A_MINUTE, MOST_SHARES = 2, 256

# What the operators say per key, in the order of their schemas: the watermark, and lists of one length.
_OFFSET = Row("watermark", "client_ip", "second", "minute_before", "day_before")
_COUNT = Row("watermark", "client_ip", "window_start", "n")


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in the store that keyed state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _shares(span: int) -> int:
    return min(MOST_SHARES, SHARES_A_MINUTE * max(1, span // rl.MINUTE))


def _counts(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """How often each row occurs, for every `FOLD_ROWS` rows of a task: a partial count without state."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= FOLD_ROWS:
            yield pa.Table.from_batches(held).group_by(keys).aggregate([([], "count_all")]).rename_columns([*keys, "n"])
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).group_by(keys).aggregate([([], "count_all")]).rename_columns([*keys, "n"])


def _types(rows: DataFrame, form: str = "{}") -> list[str]:
    return [f"{f.name} {form.format(f.dataType.simpleString())}" for f in rows.schema]


def _folded(rows: DataFrame) -> DataFrame:
    """Each row once per task or a few times, with how often it occurs."""
    keys = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counts in _counts(batches, keys):
            yield from counts.to_batches()

    return rows.mapInArrow(run, ", ".join([*_types(rows), "n bigint"]))


def _packed(rows: DataFrame, span: int, window: str) -> DataFrame:
    """`rows`, folded, as one row per window (the column named) and share of its clients with lists of the rest."""
    rows = rows.select(F.pmod(F.xxhash64("client_ip"), F.lit(_shares(span))).alias("share"), window, *[c for c in rows.columns if c != window])
    folded, keys, listed = rows.columns, ["share", window], [*rows.columns[2:], "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counts in _counts(batches, folded):
            counts = counts.sort_by([(k, "ascending") for k in keys]).combine_chunks()
            column = {c: counts[c].combine_chunks() for c in counts.column_names}
            share, at = (column[k].to_numpy(zero_copy_only=False) for k in keys)
            first = np.flatnonzero(np.concatenate([[True], (share[1:] != share[:-1]) | (at[1:] != at[:-1])]))
            offsets = pa.array(np.append(first, len(share)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, column[c]) for c in listed]
            packed = pa.Table.from_arrays([*(column[k].take(pa.array(first)) for k in keys), *lists], [*keys, *listed])
            yield from packed.to_batches(max_chunksize=PACK_ROWS)

    types = [*_types(rows.select(*keys)), *_types(rows.drop(*keys), "array<{}>"), "n array<bigint>"]
    return rows.mapInArrow(run, ", ".join(types))


def _unpacked(said: DataFrame) -> DataFrame:
    """What an operator said, row by row; of a key without anything to say its watermark is left."""
    lists = [c for c in said.columns if c != "watermark"]
    rows = said.select("watermark", F.expr(f"inline_outer(arrays_zip({', '.join(lists)}))"))
    return rows.select(F.lit("said").alias("kind"), *lists, "watermark")


def _closed(start: Column | int, span: int, watermark: Column | int) -> Column | bool:
    """Whether the window of `span` seconds that begins at `start` ended at or before the watermark (milliseconds)."""
    return (start + span) * 1000 <= watermark


class _DayCounts(StatefulProcessor):
    """Requests of a day and a share of its clients, counted by client and second; says how many came before each second that changed.

    An earlier second may come later: then all seconds of its client after it are said again,
    with their new numbers. Given a horizon, minutes that closed count no more, and the
    state goes when the day closes.
    """

    def __init__(self, horizon: bool):
        self.horizon = horizon

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "clients array<string>, seconds array<array<bigint>>, counts array<array<bigint>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        _, day = key
        # The requests beside this operator are judged by the same watermark.
        watermark = timerValues.getCurrentWatermarkInMs() if self.horizon else None
        came: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for row in rows:
            for client, second, n in zip(row.client_ip, row.second, row.n):
                if not self.horizon or not _closed(second - second % rl.MINUTE, rl.MINUTE, watermark):
                    came[client][second] += n
        said = _OFFSET(watermark, [], [], [], [])
        if came:
            if self.horizon:
                self.handle.registerTimer((day + 1) * rl.DAY * 1000)
            clients, seconds, counts = self.counts.get() or ((), (), ())
            known = {client: dict(zip(s, n)) for client, s, n in zip(clients, seconds, counts)}
            for client, new in came.items():
                self._add(client, known.setdefault(client, {}), new, said)
            self.counts.update((list(known), [list(c) for c in known.values()], [list(c.values()) for c in known.values()]))
        yield said

    @staticmethod
    def _add(client: str, counts: dict[int, int], new: dict[int, int], said: Row) -> None:
        """Count new requests of a client, and say the numbers of the first changed second and all after it."""
        for second, n in new.items():
            counts[second] = counts.get(second, 0) + n
        first, minute, in_minute, in_day = min(new), None, 0, 0
        for second in sorted(counts):
            if second // rl.MINUTE != minute:
                minute, in_minute = second // rl.MINUTE, 0
            if second >= first:
                said.client_ip.append(client)
                said.second.append(second)
                said.minute_before.append(in_minute)
                said.day_before.append(in_day)
            in_minute += counts[second]
            in_day += counts[second]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


class _WindowCounts(StatefulProcessor):
    """Requests of a window and a share of its clients, counted by client until the window closes."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "clients array<string>, counts array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        _, start = key
        watermark = timerValues.getCurrentWatermarkInMs()
        came: dict[str, int] = defaultdict(int)
        if not _closed(start, self.span, watermark):
            for row in rows:
                for client, n in zip(row.client_ip, row.n):
                    came[client] += n
        if came:
            known = dict(zip(*(self.counts.get() or ((), ()))))
            for client, n in came.items():
                known[client] = known.get(client, 0) + n
            self.counts.update((list(known), list(known.values())))
            self.handle.registerTimer((start + self.span) * 1000)
        yield _COUNT(watermark, list(came), [start] * len(came), [known[client] for client in came])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


def _identified(requests: DataFrame, lateness: str | None) -> DataFrame:
    """`client_ip, second` of requests with a client, under a watermark over these where there is a horizon."""
    rows = requests.select("ts", rl.client_ip("headers").alias("client_ip")).where(F.col("client_ip").isNotNull())
    if lateness:
        rows = rows.withWatermark("ts", lateness)
    return rows.select("client_ip", F.unix_seconds("ts").alias("second"))


def _beside(requests: DataFrame, said: DataFrame) -> DataFrame:
    """The requests and what the operator says of the same micro-batch, in one stream."""
    rows = requests.select(
        F.lit("request").alias("kind"), rl.client_ip("headers").alias("client_ip"),
        F.unix_seconds("ts").alias("second"), "request_id", "ts",
    )
    return rows.unionByName(said, allowMissingColumns=True)


def _start(stream: DataFrame, folder: str, step, trigger: dict) -> StreamingQuery:
    def persisted(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read by the clock and by each table written
        try:
            step(batch, batch_id)
        finally:
            batch.unpersist()

    with _keyed_state(stream.sparkSession):
        return (
            stream.writeStream.outputMode("update")
            .foreachBatch(persisted)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def _requests_of(batch: DataFrame, span: int) -> DataFrame:
    """The requests of a micro-batch; `late` are those whose window had closed before it."""
    watermark = batch.where("kind = 'said'").agg(F.max("watermark")).first()[0]
    start = F.col("second") - F.col("second") % span
    late = F.lit(False) if watermark is None else F.col("client_ip").isNotNull() & _closed(start, span, F.lit(watermark))
    return batch.where("kind = 'request'").select("request_id", "ts", "client_ip", "second", late.alias("late"))


def _empty(spark: SparkSession, path: str, schema) -> None:
    """A table to read before the first micro-batch, or if none ever comes."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=-1")


def start_rate_limit(
    requests: DataFrame,
    folder: str,
    per_minute: object = rl.PER_MINUTE,
    per_day: object = rl.PER_DAY,
    lateness_seconds: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Limits a stream of requests; `read_decisions` reads what holds so far.

    State is keyed by day and share of the clients and holds counts by client and second. Files may come in
    any order and fall into any micro-batches: a request that comes after later ones
    changes their numbers, and the operator says the changed ones again. So after
    every micro-batch decisions are those of the batch job over the same requests.
    A query started again on the same folder goes on where the last one stopped.

    Without `lateness_seconds` all state stays. With it, a minute closes once the
    watermark (the newest time seen, less that many seconds) has passed its end; a
    request that comes later than that is let through unenforced and marked late
    (`late_rows`), and a day's state goes when the day closes. A request without a
    client is never late, as nothing is enforced for it.
    """
    spark, limits = requests.sparkSession, rl.caps(per_minute, per_day)
    lateness = None if lateness_seconds is None else f"{lateness_seconds} seconds"
    seconds = _identified(requests, lateness).select(
        "client_ip", F.expr(f"second div {rl.DAY}").alias("day"), "second"
    )
    said = _packed(seconds, rl.DAY, "day").groupBy("share", "day").transformWithState(
        _DayCounts(lateness is not None),
        "watermark bigint, client_ip array<string>, second array<bigint>, minute_before array<bigint>, day_before array<bigint>",
        "Update",
        "EventTime" if lateness else "None",
    )
    stream = _beside(requests, _unpacked(said))
    kind = requests.schema["request_id"].dataType.simpleString()
    _empty(spark, f"{folder}/requests", f"request_id {kind}, ts timestamp, client_ip string, second bigint, late boolean")
    _empty(spark, f"{folder}/offsets", _OFFSETS.removesuffix(", batch bigint"))
    spark.createDataFrame([limits], "per_minute int, per_day int").write.mode("overwrite").parquet(f"{folder}/caps")

    def step(batch: DataFrame, batch_id: int) -> None:
        _requests_of(batch, rl.MINUTE).write.mode("overwrite").parquet(f"{folder}/requests/batch={batch_id}")
        offsets = batch.where("kind = 'said' AND client_ip IS NOT NULL").select("client_ip", "second", "minute_before", "day_before")
        offsets.write.mode("overwrite").parquet(f"{folder}/offsets/batch={batch_id}")

    return _start(stream, folder, step, trigger)


def read_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Every request with its decision, by the newest numbers of its second."""
    per_minute, per_day = spark.read.parquet(f"{folder}/caps").first()
    requests = spark.read.parquet(f"{folder}/requests").drop("batch")
    counted = requests.withColumn("client_ip", F.when(~F.col("late"), F.col("client_ip")))
    newest = F.max_by(F.struct("minute_before", "day_before"), "batch").alias("newest")
    offsets = spark.read.schema(_OFFSETS).parquet(f"{folder}/offsets").groupBy("client_ip", "second").agg(newest)
    numbered = rl.number_requests(counted, offsets.select("client_ip", "second", "newest.*"))
    return rl.decide(numbered, per_minute, per_day).select(
        "request_id",
        "ts",
        "client_ip",
        "minute_count",
        "day_count",
        "allowed",
        "retry_after_seconds",
        "enforced",
        "late",
    )


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that came after their window had closed: counted nowhere, kept here, with the micro-batch they came in."""
    return spark.read.parquet(f"{folder}/requests").where("late").drop("late")


def late_requests(spark: SparkSession, folder: str) -> int:
    """How many requests came too late to be counted; 0 for a stream without a horizon."""
    return late_rows(spark, folder).count()


def start_bounded_counts(
    requests: DataFrame, folder: str, unit_seconds: int = rl.MINUTE, lateness_seconds: int = rl.DAY, **trigger
) -> StreamingQuery:
    """Requests per client and window of a stream that never ends: state goes when its window closes.

    A window closes once the watermark (the newest time seen, less `lateness_seconds`)
    has passed its end. Rows that come later are not dropped but split off, by
    the watermark their micro-batch ran under: `read_counts` and `late_rows` together
    hold every request with a client, once.
    """
    spark = requests.sparkSession
    start = F.col("second") - F.col("second") % unit_seconds
    windows = _identified(requests, f"{lateness_seconds} seconds").select("client_ip", start.alias("window_start"))
    said = _packed(windows, unit_seconds, "window_start").groupBy("share", "window_start").transformWithState(
        _WindowCounts(unit_seconds),
        "watermark bigint, client_ip array<string>, window_start array<bigint>, n array<bigint>",
        "Update",
        "EventTime",
    )
    stream = _beside(requests, _unpacked(said))
    kind = requests.schema["request_id"].dataType.simpleString()
    _empty(spark, f"{folder}/requests", f"request_id {kind}, ts timestamp, client_ip string, second bigint, late boolean")
    _empty(spark, f"{folder}/counts", "client_ip string, window_start bigint, n bigint")

    def step(batch: DataFrame, batch_id: int) -> None:
        late = _requests_of(batch, unit_seconds).where("late")
        late.write.mode("overwrite").parquet(f"{folder}/requests/batch={batch_id}")
        counts = batch.where("kind = 'said' AND client_ip IS NOT NULL").select("client_ip", "window_start", "n")
        counts.write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")

    return _start(stream, folder, step, trigger)


def windowed_counts(requests: DataFrame, unit: str = "1 minute") -> DataFrame:
    """Requests per client and tumbling window of a bounded replay: no row is dropped, and state grows with the windows."""
    rows = requests.select("ts", rl.client_ip("headers").alias("client_ip")).where(F.col("client_ip").isNotNull())
    return (
        rows.groupBy(F.window("ts", unit), "client_ip")
        .agg(F.count("*").alias("n"))
        .select("client_ip", F.unix_seconds("window.start").alias("window_start"), "n")
    )


def start_counts(counts: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Write every changed count; `read_counts` keeps the newest per client and window."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    updates = spark.read.parquet(f"{folder}/counts")
    return updates.groupBy("client_ip", "window_start").agg(F.max_by("n", "batch").alias("n"))
