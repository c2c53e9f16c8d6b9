"""Hard negatives against all inner products."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sitegauge.llm import negatives

VECTORS = "vec_id bigint, label bigint, vector array<bigint>, rank int, search string"


def by_hand(rows, anchor_ids, positives=5, count=10):
    out = []
    usable = [(i, label, v) for i, label, v in rows if None not in (i, label, v)]
    of = {i: (label, v) for i, label, v in usable}
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    for anchor in anchor_ids:
        label, v = of[anchor]
        scored = sorted((-dot(v, w), i, other) for i, other, w in usable if i != anchor)
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p]
            out += [(anchor, positive, rank, n[1], -p, -n[0]) for rank, n in enumerate(fit[:count], 1)]
    return sorted(out)


def run(spark, rows, anchor_ids, **options):
    frame = spark.createDataFrame([(*r, 0, "own") for r in rows], VECTORS)
    found = negatives.mine(frame, frame.where(frame.vec_id.isin(list(anchor_ids))), **options)
    return sorted(tuple(r) for r in found.collect())


def vectors(n, width, seed, around=0):
    """Random rows with many ties; with `around`, copies near that many centres."""
    rnd = np.random.default_rng(seed)
    rows = rnd.integers(-6, 7, (n, width)) if not around else rnd.integers(-200, 200, (around, width))[rnd.integers(0, around, n)] + rnd.integers(-9, 10, (n, width))
    return [(i, int(rnd.integers(0, 4)), [int(x) for x in row]) for i, row in enumerate(rows)]


@pytest.mark.parametrize(("width", "around", "cluster", "step"), [(3, 0, 4, 16), (8, 6, 5, 8), (16, 0, 1, 64), (8, 6, 64, 512)])
def test_equal_to_all_inner_products(spark, monkeypatch, width, around, cluster, step):
    monkeypatch.setattr(negatives, "CLUSTER", cluster)
    monkeypatch.setattr(negatives, "STEP", step)
    rows = vectors(300, width, 7, around)
    block = walked(rows, range(0, 300, 10), 3)
    assert block == by_hand(rows, range(0, 300, 10))


def walked(rows, anchor_ids, slices):
    """The method without Spark: slices of candidates walked one after another."""
    ids, label, matrix = (np.array(x) for x in zip(*rows))
    at = np.array(list(anchor_ids))
    anchors = negatives.Anchors.of(ids[at], label[at], matrix[at])
    n = len(at)

    def walk(wanted):
        task = negatives.Walk(anchors, wanted)
        for part in np.array_split(np.arange(len(ids)), slices):
            task.through(ids[part], label[part], matrix[part])
        search, score, vec = task.found()
        return sorted(zip(search.tolist(), (-score).tolist(), vec.tolist()))

    near = walk(negatives.Wanted(np.arange(n), np.full(n, negatives.LEAST), np.full(n, negatives.MOST), 5, True))
    under = np.array([math.ceil(-30 * p / 100) for _, p, _ in near])
    over = np.array([math.floor(-90 * p / 100) for _, p, _ in near])
    out, rank, last = [], 0, None
    for search, score, vec in walk(negatives.Wanted(np.array([a for a, _, _ in near]), under, over, 10, False)):
        rank, last = (rank + 1 if search == last else 1), search
        a, p, positive = near[search]
        out.append((int(anchors.ids[a]), positive, rank, vec, -p, -score))
    return sorted(out)


def test_a_walk_ends_early_where_clusters_are_tight():
    rnd = np.random.default_rng(3)
    centres = rnd.integers(-200, 200, (8, 16))
    of = rnd.integers(0, 8, 20_000)
    matrix = centres[of] + rnd.integers(-4, 5, (20_000, 16))
    ids, label = np.arange(20_000), np.zeros(20_000, np.int64)
    anchors = negatives.Anchors.of(ids[:64], label[:64], matrix[:64])
    task = negatives.Walk(anchors, negatives.Wanted(np.arange(64), np.full(64, negatives.LEAST), np.full(64, negatives.MOST), 5, True))
    task.through(ids, label, matrix)
    steps = sum(party.steps for party in task.parties)
    assert steps < 0.7 * 64 * math.ceil(20_000 / negatives.STEP)


def test_whole_mining_in_blocks_of_anchors(spark, monkeypatch):
    rows = vectors(200, 4, 11)
    assert run(spark, rows, range(0, 200, 9)) == by_hand(rows, range(0, 200, 9))
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 200)
    monkeypatch.setattr(negatives, "SLICE_BYTES", 700)
    assert run(spark, rows, range(0, 200, 40), positives=2, negatives=3) == by_hand(rows, range(0, 200, 40), 2, 3)


def test_odd_rows(spark):
    rows = [(0, 1, [3, 4]), (1, 1, [3, 4]), (2, 1, [0, 0]), (3, 2, [1, 1]), (4, 2, []), (5, 2, [1]), (6, None, [3, 4]), (7, 1, None), (None, 2, [1, 1]),
            (8, 3, [2, 1, 100]), (9, 1, [-3, -4])]
    padded = [(i, label, None if v is None else [*v, *[0] * (3 - len(v))]) for i, label, v in rows]
    assert run(spark, rows, [0, 2, 4]) == by_hand(padded, [0, 2, 4])
    assert run(spark, [], []) == [] and run(spark, rows, []) == []


def test_scores_beyond_doubles_and_longs(spark):
    near = [(0, 1, [2**30, 1]), (1, 1, [2**30, 1]), (2, 2, [2**29, 3]), (3, 2, [2**29, 4]), (4, 2, [2**29, 4])]
    assert run(spark, near, [0]) == by_hand(near, [0])
    far = [(0, 1, [2**40, 1]), (1, 1, [2**40, 1]), (2, 2, [2**22, 0])]
    assert run(spark, far, [0]) == [(0, 1, 1, 2, 2**63 - 1, 2**62)]
    assert run(spark, far, [2]) == []


def test_repeated_rows(spark):
    rows = [(0, 1, [5, 5]), (0, 1, [5, 5]), (1, 1, [5, 5]), (1, 1, [5, 5]), (2, 2, [3, 2]), (2, 2, [3, 2])]
    found = run(spark, rows, [0])
    assert found == sorted([(0, 1, rank, 2, 50, 25) for rank in (1, 2)] * 2)


def test_whole_numbers_leave_out_what_is_no_vector(spark):
    rows = [(1, 0, [0.5, -0.001]), (2, 0, [float("nan"), 0.0]), (3, 0, [float("inf"), 0.0]), (4, None, [0.5, 0.5]), (5, 0, None), (6, 0, [None, 1.0]), (7, 0, [3e38, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    assert {r.vec_id: r.vector for r in negatives.whole_numbers(frame).collect()} == {1: [128, -1], 7: [2**63 - 1, 0]}
