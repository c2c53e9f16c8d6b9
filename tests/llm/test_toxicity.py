from __future__ import annotations

import random

import numpy as np
import pytest

from corpus import documents, prose
from sitegauge.llm import toxicity


def test_logistic_regression_is_at_its_optimum():
    rng = np.random.default_rng(0)
    rows, cols = np.nonzero(rng.random((200, 12)) < 0.3)
    dense, y = rng.random((200, 2)), (rng.random(200) < 0.3).astype(float)
    weights = toxicity.fit_logistic(rows, cols, dense, y, 12, l2=1.0, rounds=500)
    mass = np.where(y > 0, 100 / y.sum(), 100 / (200 - y.sum()))
    error = mass * (toxicity.predict(weights, rows, cols, dense) - y)
    slope = np.concatenate([np.bincount(cols, error[rows], minlength=12), dense.T @ error]) + weights[:-1]
    assert np.abs(slope).max() < 0.05 and abs(error.sum()) < 0.05


def test_later_categories_learn_from_earlier_ones():
    """The second category is the first one but for noise; the text features say nothing about it by themselves."""
    rng = np.random.default_rng(1)
    first = rng.random(400) < 0.5
    rows = np.flatnonzero(first)
    labels = np.stack([first, first ^ (rng.random(400) < 0.02)], axis=1)
    models, _ = toxicity.fit_chain(rows, np.zeros(len(rows), np.int64), np.zeros((400, 3)), labels, np.arange(400) % 4, 1)
    assert len(models[0]) == 1 + 3 + 1 and len(models[1]) == 1 + 3 + 1 + 1
    assert models[1][1 + 3] > 0.5


def test_threshold_parts_the_classes():
    p, y = np.array([0.9] * 30 + [0.3] * 30 + [0.01] * 60), np.array([1] * 60 + [0] * 60)
    assert 0.01 < toxicity.best_threshold(p, y) < 0.3
    assert toxicity.best_threshold(p[:5], y[:5]) == 0.5


def corpus(spark):
    rnd, rows, labels = random.Random(6), [], []
    for i in range(600):
        text, toxic, poor = prose(60, i).split(), i % 7 == 0, i % 5 == 0
        if toxic:
            text.insert(rnd.randrange(60), rnd.choice(["Vilebag!", "vilebags", "rotter,", "Rotters"]))
        rows.append((i, " ".join(f"{w}###" if poor else w for w in text)))
        if i % 3:
            labels.append((i, 1 - poor, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_texts_are_judged_rightly(spark):
    docs, labels = corpus(spark)
    rows = toxicity.judge_toxicity(docs, labels).collect()
    held_out = [r for r in rows if r.doc_id % 3 == 0]
    assert np.mean([r.toxic == (r.doc_id % 7 == 0) for r in held_out]) > 0.97
    assert not any(r.toxic for r in held_out if r.doc_id % 7)
    assert np.mean([(r.p_low_quality > 0.5) == (r.doc_id % 5 == 0) for r in held_out]) > 0.97
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {r.doc_id for r in rows if not r.toxic}


def two_word_corpus(spark):
    rnd, rows, labels = random.Random(6), [], []
    for i in range(1_200):
        text, toxic, poor = prose(40, i).split(), i % 7 == 0, i % 5 == 0
        for _ in range(2 * toxic):
            text.insert(rnd.randrange(40), rnd.choice(["Vilebag!", "vilebags", "rotter,", "Rotters"]))
        rows.append((i, " ".join(f"{w}###" if poor else w for w in text)))
        if i % 3:
            labels.append((i, 1 - poor, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_texts_with_two_words_are_judged_rightly(spark):
    docs, labels = two_word_corpus(spark)
    rows = toxicity.judge_toxicity(docs, labels).collect()
    held_out = [r for r in rows if r.doc_id % 3 == 0]
    assert np.mean([r.toxic == (r.doc_id % 7 == 0) for r in held_out]) > 0.97
    assert np.mean([r.toxic for r in held_out if r.doc_id % 7]) < 0.01
    assert np.mean([(r.p_low_quality > 0.5) == (r.doc_id % 5 == 0) for r in held_out]) > 0.97
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {r.doc_id for r in rows if not r.toxic}


def test_the_sample_is_bounded_and_repeatable(spark):
    docs, labels = corpus(spark)
    one = toxicity.train(docs, toxicity.category_labels(labels), toxicity.CATEGORIES, max_labelled=50)
    two = toxicity.train(docs.repartition(7), toxicity.category_labels(labels), toxicity.CATEGORIES, max_labelled=50)
    assert one.index == two.index and len(one.index) <= toxicity.MAX_FEATURES
    for a, b in zip(one.weights, two.weights):
        assert a == pytest.approx(b)
