from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from corpus import documents, prose, words
from sitegauge.llm import minhash


def brute_similarity(x: dict, y: dict) -> float:
    shared = set(x) & set(y)
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in shared)


def shingles(text: str) -> dict:
    found = text.split()
    n = min(5, len(found))
    counts: dict = {}
    for i in range(len(found) - n + 1) if n else ():
        key = tuple(found[i : i + n])
        counts[key] = counts.get(key, 0) + 1
    return {k: 1 + np.log(c) for k, c in counts.items()}


def edited(text: str, n: int, seed: int) -> str:
    rnd, found = random.Random(seed), text.split()
    for _ in range(n):
        found[rnd.randrange(len(found))] = f"edit{rnd.randrange(10**6)}"
    return " ".join(found)


def test_verification_is_the_probability_jaccard():
    base = prose(80, 1)
    pairs = [(base, edited(base, k, k)) for k in range(0, 12, 2)]
    pairs += [("a b c d e f g " * 9, "a b c d e f g " * 4 + "h"), ("one two", "one two"), ("one two", "one"), ("", ""), (base, prose(80, 2))]
    left, right = (pa.array(list(side)) for side in zip(*pairs))
    want = [brute_similarity(shingles(a), shingles(b)) for a, b in pairs]
    assert minhash.similarities(left, right) == pytest.approx(want)


def test_registers_agree_with_the_probability_jaccard():
    base = prose(150, 3)
    texts = [base, edited(base, 4, 1), edited(base, 15, 2), "x y z x y z x y z x y z " * 6]
    rows, value, weight = minhash.weighted_shingles(pa.array(texts))
    sketch = minhash.probminhash(rows, value, weight, len(texts), 2_000)
    for i in (1, 2, 3):
        share = (sketch[0] == sketch[i]).mean()
        assert share == pytest.approx(brute_similarity(shingles(texts[0]), shingles(texts[i])), abs=0.05)


def brute_classes(texts: dict) -> dict:
    sets = {d: shingles(t) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if texts[a] == texts[b] or (sets[a] and sets[b] and brute_similarity(sets[a], sets[b]) >= 0.8):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


@pytest.fixture(scope="module")
def texts():
    """Copies, stars of edits around originals that come last, chains in which only neighbours are near, and strangers."""
    found, doc = {}, 0
    for star in range(4):
        base = prose(120, 10 + star)
        for k in range(12):
            found[doc] = edited(base, 2, 100 * star + k)
            doc += 1
        found[doc] = base
        doc += 1
    long = words(140, 60, 100_000)
    for k in range(8):
        found[doc] = " ".join(long[2 * k : 2 * k + 110])
        doc += 1
    for k in range(20):
        found[doc] = prose(70, 700 + k)
        doc += 1
    for k in range(6):
        found[doc] = found[3]
        doc += 1
    return found


def test_classes_are_those_of_all_pairs(spark, texts):
    rows = minhash.near_duplicates(documents(spark, list(texts.items()))).collect()
    want = brute_classes(texts)
    assert {r.doc_id: r.class_id for r in rows} == want
    size = {c: list(want.values()).count(c) for c in set(want.values())}
    assert all(r.class_size == size[r.class_id] for r in rows)


def test_one_of_each_class_stays(spark, texts):
    docs = documents(spark, [*texts.items(), (0, texts[0])])
    assert sorted(r.doc_id for r in minhash.keep_one(docs).collect()) == sorted(set(brute_classes(texts).values()))


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + rnd.randrange(30), 200 + rnd.randrange(30)) for _ in range(40)]
    found = {r.id: r.root for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 130))
    assert all(found[a] == found[b] for a, b in edges if a != b)
    more = minhash.merged(
        minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")), spark.createDataFrame([(129, 40), (999, 998)], "a bigint, b bigint")
    )
    found = {r.id: r.root for r in more.collect()}
    assert found[129] == found[5] == 0 and found[999] == found[998] == 998
