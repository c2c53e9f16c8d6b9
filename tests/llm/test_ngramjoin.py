"""The n-gram join against all pairs."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus import documents, odd_rows, words
from sitegauge.llm import common, ngramjoin


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({tuple(w)} if w else set())


def by_hand(rows):
    sets = [shingles(text) for _, text in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if x and 100 * x >= 85 * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def run(spark, rows):
    found = ngramjoin.join_components(documents(spark, rows, clashing=True))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, found.collect()), key=str)


def edited(text, n, rnd):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    """Chains and stars of edited copies around the threshold, short texts, and passages that many texts share."""
    rnd = random.Random(seed)
    rows = [" ".join(words(rnd.choice((3, 5, 8, 20, 60, 200)), seed * 100 + i, 60)) for i in range(40)]
    rows += [edited(rnd.choice(rows[:40]), rnd.randrange(1, 6), rnd) for _ in range(60)]
    rows += [edited(rows[-1], 1, rnd) for _ in range(10)]
    passage = " ".join(words(40, 77))
    rows += [passage + " " + " ".join(words(rnd.choice((3, 6, 40)), 900 + i)) for i in range(30)]
    rows += [rows[5].upper(), "a b", "A b", "b a", "a b c", "a", "", None]
    return [(i, text) for i, text in enumerate(rows)]


@pytest.mark.parametrize(("small", "block", "shingle_block"), [(64, 1_024, 1 << 20), (2, 4, 1 << 20), (5, 1_024, 300)])
def test_equal_to_all_pairs(spark, monkeypatch, small, block, shingle_block):
    # Mostly pairs of short lists; mostly blocks of long ones; and blocks bounded by their shingles.
    monkeypatch.setattr(ngramjoin, "SMALL", small)
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "BLOCK_SHINGLES", shingle_block)
    rows = corpus(small)
    assert run(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_what_overlaps_enough(seed):
    rnd = np.random.default_rng(seed)
    base = [np.unique(rnd.integers(0, 300, rnd.integers(1, 80)).astype(np.uint64)) for _ in range(12)]
    sets = [np.unique(np.where(rnd.random(len(s)) < 0.06, rnd.integers(0, 300, len(s)).astype(np.uint64), s)) for s in base * 6]
    lists = ngramjoin.Lists(sets)
    for query in sets + [np.array([10**6], np.uint64)]:
        want = [i for i, s in enumerate(sets) if (x := len(np.intersect1d(s, query))) and 100 * x >= 85 * (len(s) + len(query) - x)]
        assert sorted(lists.search(query).tolist()) == want


def test_the_order_of_shingles_does_not_change_links(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(ngramjoin, "commonness", lambda docs: np.random.default_rng(1).integers(0, 30, ngramjoin.BUCKETS).astype(np.uint8))
    assert run(spark, rows) == by_hand(rows)


def test_common_shingles_are_told(spark):
    passage = " ".join(words(12, 5))
    docs = documents(spark, [(i, passage + " " + " ".join(words(30, 1_000 + i, 10**6))) for i in range(300)])
    classes = ngramjoin.commonness(docs)
    _, value = ngramjoin.shingle_sets(pa.array([passage]))
    assert classes[(value & np.uint64(ngramjoin.BUCKETS - 1)).astype(np.int64)].min() >= 8 and np.median(classes) == 0


def test_odd_rows(spark):
    assert run(spark, odd_rows()) == by_hand(odd_rows())
    assert run(spark, []) == []
    assert run(spark, [(1, None), (None, ""), (2, " ")]) == by_hand([(1, None), (None, ""), (2, " ")])


def test_shingles_of_some_texts_are_told_among_many(spark, monkeypatch):
    """Eighty texts share a passage; by chance alone the counts of 256 buckets, some 230 each, vary by 15."""
    monkeypatch.setattr(ngramjoin, "BUCKETS", 256)
    monkeypatch.setattr(ngramjoin, "CHUNK", 256)
    passage = " ".join(words(5, 5))
    texts = [" ".join(words(32, i, 10**6)) for i in range(2_000)]
    docs = documents(spark, [(i, f"{passage} {text}" if i < 80 else text) for i, text in enumerate(texts)])
    classes = ngramjoin.commonness(docs)
    _, value = ngramjoin.shingle_sets(pa.array([passage]))
    assert classes[(value & np.uint64(255)).astype(np.int64)].min() >= 5 and (classes == 0).mean() > 0.4


def test_sets_in_one_long_list_are_not_wanted(spark, monkeypatch):
    """Texts that share a single shingle are in a list of any length, but cannot link: their whole sets stay where they are."""
    run_sets = [" ".join(["same", "four", "words", "here", *words(40, i, 10**6)]) for i in range(12)]
    copies = [edited(" ".join(words(60, 500, 10**6)), 1, random.Random(i)) for i in range(8)]
    rows = list(enumerate(run_sets + copies))
    _, value = ngramjoin.shingle_sets(pa.array(["same four words here"]))
    # The shared shingle comes first in every set.
    classes = np.ones(ngramjoin.BUCKETS, np.uint8)
    classes[(value & np.uint64(ngramjoin.BUCKETS - 1)).astype(np.int64)] = 0
    found, plain = [], ngramjoin.whole_sets

    def seen(docs, reps, wanted):
        found.extend(reps.join(wanted, "rid").select("doc_id").distinct().collect())
        return plain(docs, reps, wanted)

    monkeypatch.setattr(ngramjoin, "commonness", lambda docs: classes)
    monkeypatch.setattr(ngramjoin, "whole_sets", seen)
    monkeypatch.setattr(ngramjoin, "SMALL", 2)
    assert run(spark, rows) == by_hand(rows)
    assert {row.doc_id for row in found} == set(range(12, 20))


@pytest.mark.parametrize("bits", [8, 64])
def test_a_full_map_of_wanted_texts_changes_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(ngramjoin, "MAP_BITS", bits)
    monkeypatch.setattr(ngramjoin, "MAP_CHUNK", 8)
    rows = corpus(5)
    assert run(spark, rows) == by_hand(rows)


def test_texts_are_not_shuffled_for_whole_sets(spark):
    docs = documents(spark, [(i, " ".join(words(30, i))) for i in range(50)])
    base = ngramjoin.short_lists(docs, np.zeros(ngramjoin.BUCKETS, np.uint8))
    reps = common.stored(base.withColumn("rid", F.monotonically_increasing_id()), "sets")
    sets = ngramjoin.whole_sets(docs, reps, reps.where("doc_id % 5 = 0").select("rid"))
    assert sorted(r.n for r in sets.collect()) == sorted(len(shingles(" ".join(words(30, i)))) for i in range(0, 50, 5))
    lines = sets._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    below = [line for line in lines[at + 1 :] if depth(line) > depth(lines[at])]
    assert below and not [line for line in below if "Exchange" in line or "Join" in line]


def test_shuffles_go_with_their_stage(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()

    def shuffles():
        files = env.blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffles()
    counts = spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = common.stored(counts.join(counts.withColumnRenamed("count", "again"), "k"), "counts")
    # Files are removed by a message to the executors.
    for _ in range(100):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert kept.count() == 7 and spark.conf.get(common.CLEANUP, None) is None
