"""Ranked lexical search against sums over all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpus import documents, odd_rows
from sitegauge.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, top=10):
    said = [(doc, Counter(terms(text)), len(terms(text))) for doc, text in docs]
    said = [s for s in said if s[2]]
    n, total = len(said), sum(s[2] for s in said)
    rows = []
    for item, text in items:
        scored = []
        for doc, tf, size in said:
            m = 25 + 75 * size * n // total
            score = 0
            for term in terms(text):
                df = sum(term in other for _, other, _ in said)
                if tf[term]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * tf[term] // (1000 * tf[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        rows += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:top], 1)]
    return sorted(rows, key=str)


def run(spark, docs, items, **options):
    found = lexical.search(documents(spark, docs, clashing=True), spark.createDataFrame(items, "item_id bigint, text string"), **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=str)


def corpus(n, seed):
    rnd = random.Random(seed)
    word = lambda: f"w{min(int(rnd.paretovariate(0.6)), 300)}"
    docs = [(i, " ".join(word() for _ in range(rnd.randrange(1, 80)))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(20)]  # ties
    return docs, [(i, " ".join(word() for _ in range(rnd.randrange(1, 12)))) for i in range(15)]


@pytest.mark.parametrize(("accumulators", "span", "shard"), [(0, 16, 10**6), (60, 16, 500), (10**6, 10**6, 10**6), (200, 64, 2_000)])
def test_equal_to_sums_over_all_documents(spark, monkeypatch, accumulators, span, shard):
    # No short list, some, and only short lists; many shards and one.
    monkeypatch.setattr(lexical, "ACCUMULATORS", accumulators)
    monkeypatch.setattr(lexical, "RANGE", span)
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", shard)
    docs, items = corpus(300, 5)
    statistics, shard_rows = shard_of(docs, items)
    queries = lexical.Queries.of([i for i, _ in items], [t for _, t in items])
    got = []
    for no, item in enumerate(queries.ids):
        best = []
        for part in lexical.shards(iter(shard_rows.to_batches())):
            piece = lexical.Shard(part, statistics)
            found, scores = piece.search(queries.terms[no], queries.times[no], 1, 10)
            best += [(-s, piece.ids[d]) for d, s in zip(found.tolist(), scores.tolist())]
        got += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(best)[:10], 1)]
    assert sorted(got, key=str) == by_hand(docs, items)


def shard_of(docs, items):
    vocabulary = lexical.Queries.of([0] * len(items), [t for _, t in items]).vocabulary
    index = {t: i for i, t in enumerate(vocabulary.to_pylist())}
    counts = [Counter(index[t] for t in terms(text) if t in index) for _, text in docs]
    rows = pa.table({
        "doc_id": [d for d, _ in docs], "n": pa.array([len(terms(t)) for _, t in docs], pa.int64()),
        "terms": pa.array([sorted(c) for c in counts], pa.list_(pa.int32())),
        "tfs": pa.array([[c[t] for t in sorted(c)] for c in counts], pa.list_(pa.int32())),
    })
    df = [sum(i in c for c in counts) for i in range(len(index))]
    weights = [math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * d + 1))) for d in df]
    return lexical.Statistics(len(docs), sum(len(terms(t)) for _, t in docs), np.array(weights)), rows


def test_skipping_leaves_postings_unread():
    # A rare term settles the ten best, so the list of the common one is only probed.
    docs = [(i, "rare rare rare" if i < 10 else "common filler words here") for i in range(5_000)]
    statistics, rows = shard_of(docs, [(1, "rare common")])
    shard = lexical.Shard(rows, statistics)
    queries = lexical.Queries.of([1], ["rare common"])
    found, scores = shard.search(queries.terms[0], queries.times[0], 1, 10)
    assert sorted(found.tolist()) == list(range(10)) and scores.min() > shard.most.min()


def test_whole_search(spark):
    docs, items = corpus(200, 8)
    assert run(spark, docs, items) == by_hand(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = corpus(60, 3)
    monkeypatch.setattr(lexical, "ITEM_BLOCK", 4)
    assert run(spark, docs, items, top=3) == by_hand(docs, items, 3)


def test_odd_rows(spark):
    items = [(1, "w1 w2 w3"), (1, "w1 w2 w3"), (2, None), (3, ""), (4, "- . !"), (None, "one"), (5, "nowhere"), (6, "É é ÉÉ ONE a")]
    docs = [*odd_rows(), (30, "É é one"), (31, "éÉ\x00one x")]
    want = by_hand(docs, [items[0], items[5], items[7]])
    assert run(spark, docs, items) == want
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
