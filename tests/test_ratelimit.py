"""Client identity, running numbers, decisions, store outcomes, batch and stream."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import ratelimit as rl
from sitegauge.plans.queries import QUERIES
from sitegauge.streaming import limits
from sitegauge.streaming.folders import run_folder

START = dt.datetime(2025, 3, 1, 23, 58, 30, tzinfo=dt.timezone.utc)
SCHEMA = "request_id bigint, ts timestamp, headers map<string,string>"

FORWARDED, REAL = "x-forwarded-for", "x-real-ip"
VALID, INVALID = ("203.0.113.77", "2001:db8:7::9"), ("203.0.113", "203.0.113.777", "host.test", "203.0.113.77:443", "unknown", " ", "")
CLIENTS = [({}, None)]
for ip in VALID:
    for other in VALID:
        # The leftmost forwarded address decides, whatever stands behind it or in the other header.
        CLIENTS += [({FORWARDED.title(): f" {ip} ,{other}, 10.9.8.7", REAL: other}, ip), ({REAL.upper(): f"\t{ip} "}, ip)]
    for bad in INVALID:
        # An invalid leftmost entry is not skipped to the next one; the other header is asked.
        CLIENTS += [({FORWARDED: f"{bad},{ip}"}, None), ({FORWARDED: f"{bad},10.9.8.7", REAL: ip}, ip), ({FORWARDED: bad, REAL: bad}, None)]


def test_client_ip(spark):
    rows = [(i, START, h) for i, (h, _) in enumerate(CLIENTS)]
    got = spark.createDataFrame(rows, SCHEMA).select("request_id", rl.client_ip("headers").alias("ip")).collect()
    assert {r.request_id: r.ip for r in got} == {i: ip for i, (_, ip) in enumerate(CLIENTS)}


def test_caps():
    assert rl.caps() == (20, 200)
    assert rl.caps("5", "x") == (20, 200)
    assert rl.caps(0, -3) == (1, 1)
    assert rl.caps("7", 9) == (7, 9)


@pytest.mark.parametrize(
    "minute, day, allowed, low, high",
    [(1, 1, True, 0, 0), (20, 20, True, 0, 0), (5, 200, True, 0, 0), (21, 21, False, 1, 60), (5, 201, False, 61, 86400), (25, 250, False, 61, 86400)],
)
def test_decision(spark, minute, day, allowed, low, high):
    frame = spark.createDataFrame([("c", 1_740_000_007, minute, day)], "client_ip string, second bigint, minute_count bigint, day_count bigint")
    row = rl.decide(frame, 20, 200).first()
    assert (row.allowed, row.enforced) == (allowed, True)
    assert low <= row.retry_after_seconds <= high


def log(seed: int = 7, n: int = 1500):
    """A log in which one client sends a third of all requests, many in the same instant."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        client = "9.9.9.9" if rng.random() < 0.34 else f"10.0.0.{rng.randrange(40)}"
        headers = {} if rng.random() < 0.05 else {"x-forwarded-for": client}
        offset = rng.choice([0, 0, 1, 2, 30, 59, 60, 61, 89, 90, 91, 150]) + rng.choice([0, 0.25, 0.5])
        rows.append((i, START + dt.timedelta(seconds=offset), headers))
    return rows


def by_hand(rows, per_minute, per_day):
    minute, day, out = Counter(), Counter(), {}
    for i, ts, headers in sorted(rows, key=lambda r: (r[1], r[0])):
        ip = headers.get("x-forwarded-for")
        if ip is None:
            out[i] = (None, None, True, 0, False)
            continue
        now = int(ts.timestamp())
        minute[ip, now // 60] += 1
        day[ip, now // 86400] += 1
        m, d = minute[ip, now // 60], day[ip, now // 86400]
        waits = ([60 - now % 60] if m > per_minute else []) + ([86400 - now % 86400] if d > per_day else [])
        out[i] = (m, d, not waits, max(waits, default=0), True)
    return out


def decisions(frame):
    cols = ["minute_count", "day_count", "allowed", "retry_after_seconds", "enforced"]
    return {r.request_id: tuple(r[c] for c in cols) for r in frame.collect()}


@pytest.mark.parametrize("caps", [(20, 200), (3, 7), (1, 1)])
def test_whole_log_against_brute_force(spark, caps):
    rows = log()
    assert decisions(rl.rate_limit(spark.createDataFrame(rows, SCHEMA), *caps)) == by_hand(rows, *caps)


def test_thirty_requests_of_one_client(spark):
    rows = [(i, START, {"x-forwarded-for": "1.1.1.1"}) for i in range(1, 31)]
    got = decisions(rl.rate_limit(spark.createDataFrame(rows, SCHEMA)))
    assert [got[i][2] for i in range(1, 31)] == [True] * 20 + [False] * 10
    assert all(got[i][3] >= 1 for i in range(21, 31))


def test_hot_client_is_spread(spark):
    """No exchange of requests is keyed by the client alone: rows go by client and second."""
    frame = rl.rate_limit(spark.createDataFrame(log(n=50), SCHEMA))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    numbering = [line for line in plan.splitlines() if "Window [row_number()" in line]
    assert len(numbering) == 1
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)]
    assert "client_ip, second" in keys
    assert "client_ip" not in keys
    # Counts, already aggregated, are the only rows that meet by client and day.
    assert keys.count("client_ip, day_bucket") == 1


STORE = [
    # configured, identified, status, parsed -> label, allowed, retry, enforced
    (False, True, 429, True, "unconfigured", True, 0, False), (True, False, 429, True, "unidentified", True, 0, False),
    (True, True, None, None, "unreachable", True, 0, False), (True, True, 429, None, "drained", False, 60, True),
    (True, True, 403, None, "drained", False, 60, True), (True, True, 401, None, "store_error", True, 0, False),
    (True, True, 404, None, "store_error", True, 0, False), (True, True, 500, None, "store_error", True, 0, False),
    (True, True, 200, False, "unreadable", True, 0, False), (True, True, 200, None, "unreadable", True, 0, False),
    (True, True, 200, True, "counted", None, 0, True),
]


def test_store_outcomes(spark):
    frame = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(STORE)], "i int, c boolean, d boolean, s int, p boolean")
    outcome = rl.limiter_outcome(F.col("c"), F.col("d"), F.col("s"), F.col("p"))
    got = {r.i: tuple(r.o) for r in frame.select("i", outcome.alias("o")).collect()}
    assert [got[i] for i in range(len(STORE))] == [r[4:] for r in STORE]


PATHS = [
    ("/api/score?url=example.com", "example.com"), ("/api/score", None), ("/api/score?url=", None),
    ("/api/score?url=&url=b", "b"), ("/api/score?a=1&url=x&url=y", "x"), ("/api/score?url=a%20b+c", "a b c"),
    ("/api/score?url=100%&x=1", "100%"), ("/api/score?url=a%3Db=c", "a=b=c"), ("/api/score?url=a#url=b", "a"),
    ("/api/score#?url=b", None), ("/api/score?curl=b", None), ("/api/score?u%72l=z", "z"), ("/api/score?url", None),
]


def test_query_parameter(spark):
    frame = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PATHS)], "i int, path string")
    got = {r.i: r.u for r in frame.select("i", rl.query_parameter(F.col("path"), "url").alias("u")).collect()}
    assert [got[i] for i in range(len(PATHS))] == [e for _, e in PATHS]


def test_labels(spark):
    frame = spark.createDataFrame([(1,), (59,), (60,), (61,), (3599,), (3600,), (3601,), (86400,)], "s int")
    got = [r.x for r in frame.select(rl.retry_label(F.col("s")).alias("x")).collect()]
    assert got == ["1s", "59s", "1 min", "2 min", "60 min", "1 h", "2 h", "24 h"]
    outcome = spark.range(1).select(
        rl.request_outcome(F.lit(False), F.lit(None)).alias("a"), rl.request_outcome(F.lit(True), F.lit(None)).alias("b"),
        rl.request_outcome(F.lit(True), F.lit("x"), F.lit(True)).alias("c"), rl.request_outcome(F.lit(True), F.lit("x")).alias("d"),
    ).first()
    assert tuple(outcome) == (429, 400, 500, 200)


def write_batches(spark, rows, folder, parts):
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.mode("append").json(folder)


def test_stream_equals_batch(spark, tmp_path):
    rows = log(seed=11, n=400)
    source, out = str(tmp_path / "in"), run_folder(spark, "t")
    write_batches(spark, rows, source, 4)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    limits.start_rate_limit(stream, out, 3, 7).awaitTermination()
    got = decisions(limits.read_decisions(spark, out))
    # Files are read in the order they were written, so the stream sees the log in order of time.
    assert got == by_hand(rows, 3, 7)


def test_late_requests_are_let_through_and_marked(spark, tmp_path):
    source, out = str(tmp_path / "in"), run_folder(spark, "t")
    head = {"x-forwarded-for": "1.1.1.1"}
    spark.createDataFrame([(1, START, head), (2, START + dt.timedelta(hours=2), head)], SCHEMA).coalesce(1).write.json(source)
    spark.createDataFrame([(3, START, head)], SCHEMA).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    limits.start_rate_limit(stream, out, 1, 1, lateness_seconds=600).awaitTermination()
    got = {r.request_id: (r.allowed, r.enforced, r.late) for r in limits.read_decisions(spark, out).collect()}
    assert got == {1: (True, True, False), 2: (True, True, False), 3: (True, False, True)}
    assert limits.late_requests(spark, out) == 1
    # Without a horizon nothing is late: the earlier minute is still counted.
    out = run_folder(spark, "t")
    limits.start_rate_limit(stream, out, 1, 1).awaitTermination()
    got = {r.request_id: (r.allowed, r.enforced, r.late) for r in limits.read_decisions(spark, out).collect()}
    assert got == {1: (True, True, False), 2: (True, True, False), 3: (False, True, False)}
    assert limits.late_requests(spark, out) == 0


def deliver(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)


def test_stream_in_any_order_and_restarted_equals_batch(spark, tmp_path):
    """One client sends a third of the log; files come shuffled, each a micro-batch, and the query is started three times."""
    rows = log(seed=5, n=300)
    random.Random(1).shuffle(rows)
    source, out = str(tmp_path / "in"), run_folder(spark, "t")
    for start in range(0, 300, 100):
        deliver(spark, rows[start : start + 60], source)
        stream = deliver(spark, rows[start + 60 : start + 100], source)
        limits.start_rate_limit(stream, out, 3, 7).awaitTermination()
        # What holds so far is what the batch job says of what has come so far.
        assert decisions(limits.read_decisions(spark, out)) == by_hand(rows[: start + 100], 3, 7)
    assert limits.late_requests(spark, out) == 0


def test_an_earlier_half_that_comes_later_corrects_decisions(spark, tmp_path):
    head = {"x-forwarded-for": "1.1.1.1"}
    rows = [(i, START + dt.timedelta(milliseconds=900 * i), head) for i in range(28)]
    source, out = str(tmp_path / "in"), run_folder(spark, "t")
    deliver(spark, rows[14:], source)
    limits.start_rate_limit(deliver(spark, rows[:14], source), out, 20, 200).awaitTermination()
    blocked = sorted(r.request_id for r in limits.read_decisions(spark, out).where("NOT allowed").collect())
    assert blocked == list(range(20, 28))


def test_an_empty_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), run_folder(spark, "t")
    spark.createDataFrame([], SCHEMA).write.json(source)
    stream = spark.readStream.schema(SCHEMA).json(source)
    limits.start_rate_limit(stream, out, lateness_seconds=60).awaitTermination()
    assert limits.read_decisions(spark, out).count() == limits.late_requests(spark, out) == 0
    limits.start_bounded_counts(stream, f"{out}-counts").awaitTermination()
    assert limits.read_counts(spark, f"{out}-counts").count() == limits.late_rows(spark, f"{out}-counts").count() == 0


def test_counted_and_late_are_all_rows(spark, tmp_path):
    """Files shuffled under a short horizon: each row is counted once or kept as late, by the watermark of its micro-batch."""
    rows = log(seed=9, n=240)
    random.Random(2).shuffle(rows)
    source, out = str(tmp_path / "in"), run_folder(spark, "t")
    expected, late, newest = Counter(), set(), 0
    for start in range(0, 240, 60):
        part = rows[start : start + 60]
        for i, ts, head in part:
            if "x-forwarded-for" in head:
                window = int(ts.timestamp()) // 60 * 60
                if (window + 60) * 1000 <= newest - 30_000:
                    late.add(i)
                else:
                    expected[head["x-forwarded-for"], window] += 1
        newest = max([newest, *(int(ts.timestamp() * 1000) for _, ts, head in part if "x-forwarded-for" in head)])
        query = limits.start_bounded_counts(deliver(spark, part, source), out, lateness_seconds=30)
        query.awaitTermination()
    assert late and expected
    assert {(r.client_ip, r.window_start): r.n for r in limits.read_counts(spark, out).collect()} == dict(expected)
    assert {r.request_id for r in limits.late_rows(spark, out).collect()} == late
    # Closed windows left the state.
    open_windows = {w for w in expected if (w[1] + 60) * 1000 > newest - 30_000}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * len(open_windows)


def test_a_day_that_closed_leaves_the_state(spark, tmp_path):
    head = {"x-forwarded-for": "1.1.1.1"}
    source, out = str(tmp_path / "in"), run_folder(spark, "t")
    deliver(spark, [(1, START, head), (2, START + dt.timedelta(days=3), head)], source)
    stream = deliver(spark, [(3, START, head), (4, START + dt.timedelta(days=3, seconds=1), head), (5, START, {})], source)
    query = limits.start_rate_limit(stream, out, 1, 1, lateness_seconds=600)
    query.awaitTermination()
    got = {r.request_id: (r.allowed, r.enforced, r.late) for r in limits.read_decisions(spark, out).collect()}
    assert got == {1: (True, True, False), 2: (True, True, False), 3: (True, False, True), 4: (False, True, False), 5: (True, False, False)}
    assert [(r.request_id, r.batch) for r in limits.late_rows(spark, out).collect()] == [(3, 1)]


def test_only_counts_reach_the_state(spark):
    """What is shuffled to the keyed state is folded to seconds before."""
    rows = [(i, START, {"x-forwarded-for": "1.1.1.1"}) for i in range(1_000)]
    folded = limits._folded(limits._identified(spark.createDataFrame(rows, SCHEMA).coalesce(1), None))
    assert folded.count() <= 4 and folded.groupBy().sum("n").first()[0] == 1_000


def test_streamed_counts(spark, tmp_path):
    rows = log(seed=3, n=300)
    source, out = str(tmp_path / "in"), run_folder(spark, "t")
    write_batches(spark, rows, source, 3)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    limits.start_counts(limits.windowed_counts(stream), out).awaitTermination()
    got = {(r.client_ip, r.window_start): r.n for r in limits.read_counts(spark, out).collect()}
    expected = Counter(
        (h["x-forwarded-for"], int(ts.timestamp()) // 60 * 60) for _, ts, h in rows if "x-forwarded-for" in h
    )
    assert got == dict(expected)


def test_streams_read_a_folder_of_files(spark, tmp_path):
    """The same table as one file and as a folder of several, as a cluster stores it."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    whole = {r.request_id: r.allowed for r in QUERIES["rate_limit_decisions"](spark, str(tmp_path)).collect()}
    live = {r.request_id: r.allowed for r in QUERIES["rate_limit_stream"](spark, str(tmp_path)).collect()}
    assert live == whole and len(live) == events.count()
    counts = {(r.client_ip, r.window_start): r.n for r in QUERIES["minute_counts_stream"](spark, str(tmp_path)).collect()}
    assert counts == {(r.client_ip, r.window_start): r.n for r in QUERIES["minute_counts_stream"](spark, "/root/testdata/sf0.001").collect()}


def test_state_is_keyed_by_shares_of_clients(spark, tmp_path):
    """Many clients of a day or a minute share a key: what the engine does per key does not grow with the clients."""
    rows = [(i, START, {"x-forwarded-for": f"10.1.{i // 250}.{i % 250}"}) for i in range(1_000)]
    source, out = str(tmp_path / "in"), run_folder(spark, "t")
    query = limits.start_rate_limit(deliver(spark, rows, source), out, 1, 1)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= limits.MOST_SHARES
    assert limits.read_decisions(spark, out).where("allowed AND minute_count = 1 AND day_count = 1").count() == 1_000
    query = limits.start_bounded_counts(deliver(spark, rows, source), f"{out}-counts")
    query.awaitTermination()
    assert query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 2 * limits.SHARES_A_MINUTE
    counted = {(r.client_ip, r.n) for r in limits.read_counts(spark, f"{out}-counts").collect()}
    assert counted == {(head["x-forwarded-for"], 2) for _, _, head in rows}
