"""The operators built of column functions alone, against plain Python and their SQL."""

from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from corpus import documents, prose
from sitegauge.llm import mixing, preferences, urlfilter
from sitegauge.llm.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", list(ORACLES))
def test_query_equals_its_sql(spark, key):
    assert compare(spark, connect(TABLES), TABLES, key) is None


def test_names_of_queries():
    assert set(QUERIES) <= set(entry.queries())
    assert {k.split("_")[0] for k in QUERIES} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}


@pytest.mark.parametrize("key", ["op9_mixing", "op10_preferences"])
def test_native_operators_run_no_python(spark, key):
    plan = QUERIES[key](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Scan ExistingRDD"))


def water_filled(sizes: dict, repeats: int = 3) -> dict:
    """The contract by its words: share, stop at the cap, share the excess by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(repeats * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free} | {s: repeats * sizes[s] for s in capped}
        above = {s for s in free if target[s] > repeats * sizes[s]}
        if not above:
            return target
        capped |= above


def test_targets_and_taken_words(spark):
    rnd = random.Random(4)
    for trial, spread in enumerate(([400] * 6, [1, 900, 3, 40, 700], [0, 50, 3000, 2], [5])):
        rows, doc = [], 0
        for s, total in enumerate(spread):
            for _ in range(max(1, total // 10)):
                rows.append((doc, prose(min(total, rnd.randrange(1, 20)), doc) if total else None, None if trial == 1 and s == 2 else f"s{s}"))
                doc += 1
        docs = documents(spark, rows)
        for bucket_rows in (4, 10**6):
            got = mixing.mix(docs, bucket_rows=bucket_rows).collect()
            size, taken, target = defaultdict(int), defaultdict(int), {}
            for r in got:
                size[r.source] += r.size
                taken[r.source] += r.taken
                target[r.source] = r.target
                assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
            assert target == pytest.approx(water_filled(size))
            assert all(abs(taken[s] - target[s]) <= 20 for s in size)
            assert len(got) == len(rows)
            again = mixing.mix(docs.repartition(5), bucket_rows=bucket_rows).collect()
            assert sorted(map(str, again)) == sorted(map(str, got))


def test_whole_epochs_come_first(spark):
    rows = [(i, prose(10, i), "a") for i in range(40)] + [(100 + i, prose(10, i), "b") for i in range(10)]
    got = mixing.mix(documents(spark, rows)).collect()
    # Shares 1 : 2 of 500 words: 166.7 of 400 for a, and 333.3 of 100 for b, of which 300 can be taken.
    assert {r.taken for r in got if r.source == "b"} == {30}
    assert sum(r.taken for r in got if r.source == "a") == 200


def long_and_short(n: int) -> list[tuple]:
    """One document in ten is a hundred times as long as the others, one in five is full of marks; a third is of one source."""
    rnd = random.Random(n)
    rows = []
    for i in range(n):
        text = " ".join(f"w{rnd.randrange(999)}" for _ in range(2_000 if i % 10 == 0 else rnd.randrange(10, 30)))
        rows.append((i, text.replace(" ", " ##") if i % 5 == 1 else text, "hot" if i % 3 == 0 else f"s{i % 7}"))
    return [*rows, (n, None, "hot"), (n + 1, "", "s1"), (1, rows[1][1], "s1")]


@pytest.mark.parametrize("bucket_rows", [4, 100, 10**9])
def test_budgets_are_filled_whatever_the_buckets(spark, tmp_path, bucket_rows):
    """Equal to the SQL form, and no document left would still fit."""
    docs = documents(spark, long_and_short(600))
    docs.write.parquet(f"{tmp_path}/documents")
    got = mixing.mix(docs, bucket_rows=bucket_rows).collect()
    rows = duckdb.sql(mixing.mix_sql(f"SELECT * FROM '{tmp_path}/documents/*.parquet'")).fetchall()
    assert sorted((r.doc_id, r.size, r.source_size, r.taken) for r in got) == sorted((r[0], r[1], r[2], r[4]) for r in rows)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        lacking, epochs = own[0].target - sum(r.taken for r in own), int(own[0].target // own[0].source_size)
        left = [r.size for r in own if 0 < r.size and r.taken == r.size * epochs]
        assert lacking >= 0 and (not left or lacking < min(left))


def test_buckets_are_even_for_mixed_weights(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 5 = 0 THEN 0.05 WHEN id % 5 = 1 THEN 0.3 ELSE 1.0 END AS _weight", "id")
    rows = rows.selectExpr("_weight", "-ln((pmod(xxhash64(id), 1000003) + 0.5) / 1000003) / _weight AS _key", "'a' AS source", "'sa' AS _source", "1L AS size")
    placed = rows.join(mixing.key_classes(rows).drop("source"), "_source").select(mixing.bucket_of(200).alias("b"))
    sizes = [r["count"] for r in placed.groupBy("b").count().collect()]
    assert len(sizes) == 100 and max(sizes) < 2 * 200


def test_better_documents_come_first(spark):
    rows = [(i, prose(10, i) if i % 2 else " ".join(w + "###" for w in prose(10, i).split()), "b") for i in range(2_000)]
    rows += [(10_000 + i, prose(10, i), "a") for i in range(200)]
    got = [r for r in mixing.mix(documents(spark, rows)).collect() if r.source == "b" and r.taken]
    clean = sum(r.doc_id % 2 for r in got)
    assert clean > 0.5 * len(got)


def test_prompt_is_the_longest_common_prefix(spark):
    rnd, chosen, rejected = random.Random(3), [], []
    for pair in range(60):
        same, more = rnd.randrange(5), (rnd.randrange(4), rnd.randrange(4))
        start = [("user" if t % 2 == 0 else "assistant", f"{pair} {t}") for t in range(same)]
        ends = [start + [("assistant", f"{pair} {side} {k}") for k in range(n)] for side, n in enumerate(more)]
        chosen += [(pair, t, *turn) for t, turn in enumerate(ends[0])]
        rejected += [(pair, t, *turn) for t, turn in enumerate(ends[1])]
    schema = "pair_id bigint, turn bigint, role string, text string"
    rows = preferences.format_preferences(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()
    sides = defaultdict(dict)
    for r in rows:
        sides[r.pair_id, r.side][r.turn] = r
    for pair in range(60):
        a = {t: (role, text) for p, t, role, text in chosen if p == pair}
        b = {t: (role, text) for p, t, role, text in rejected if p == pair}
        prompt = 0
        while prompt in a and a.get(prompt) == b.get(prompt):
            prompt += 1
        assert sorted(sides[pair, "prompt"]) == list(range(prompt))
        assert sorted(sides[pair, "chosen"]) == [t for t in a if t >= prompt]
        assert sorted(sides[pair, "rejected"]) == [t for t in b if t >= prompt]
    for r in rows:
        learned = r.rendered[r.loss_from : r.loss_to]
        assert learned == ("" if r.side == "prompt" or r.role != "assistant" else r.rendered.split("\n", 1)[1])


def test_rules_and_list(spark):
    cases = {
        "http://shop.example.com/en/1": ("block", "com/en/"), "https://example.com/en/7x": ("allow", "example.com/en/7"),
        "http://a.example.com/en/71": ("allow", "example.com/en/7"), "ftp://example.net/de/8": ("block", "example.net/de/8"),
        "http://other.net/de/8": ("allow", "net/de/"), "http://com/en/": ("block", "com/en/"), "http://telecom/en/": ("allow", None),
        "http://x.org/ES/": ("allow", None), "http://x.ORG/es/?a": ("block", "org/es/"), "http://bad.test/a/b.html": ("block", None),
        "http://www.bad.test/a/b/": ("block", None), "http://bad.test/a/b/c": ("allow", None), "http://x.test/?u=http://a.com/en/": ("allow", None),
    }
    urls = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string")
    listed = spark.createDataFrame([("https://m.bad.test/a/b",), *[(f"http://l{i}.test/{i}",) for i in range(3_000)]], "url string")
    for broadcast_blocks in (1 << 16, 0):
        rows = urlfilter.judge_urls(urls, listed, broadcast_blocks=broadcast_blocks).collect()
        assert {r.url: (r.verdict, r.rule) for r in rows} == cases


def test_the_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(5_000).selectExpr("concat('http://site', id, '.test/page') AS url")
    urls = spark.range(20_000).selectExpr("id AS page_id", "concat('http://site', id, '.test/page') AS url")
    rows = urlfilter.judge_urls(urls, listed).collect()
    assert all(r.possible and r.listed and r.verdict == "block" for r in rows if r.page_id < 5_000)
    others = [r for r in rows if r.page_id >= 5_000]
    assert not any(r.listed for r in others) and sum(r.possible for r in others) < 0.02 * len(others)


def test_the_subpackage_stands_alone():
    """Nothing else in the library imports it."""
    root = Path(__file__).resolve().parents[2]
    for path in (root / "sitegauge").rglob("*.py"):
        if "llm" not in path.parts:
            assert "sitegauge.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
