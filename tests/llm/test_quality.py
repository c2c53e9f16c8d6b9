from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpus import documents, prose
from sitegauge.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str) -> tuple:
    found = WORD.findall(text)
    windows = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    covered = set()
    for i in range(len(found) - 4):
        if windows[tuple(found[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines, seen, copies = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        copies += line in seen
        seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered)


def random_text(seed: int) -> str:
    rnd = random.Random(seed)
    pool = ["a", "bé", "c&d", "über", "x", "|", "<b>", "\n", "\n", "\t", " ", "  ", "\x0b", "\x85", "\u3000"]
    return "".join(rnd.choice(pool) + rnd.choice(["", " "]) for _ in range(rnd.randrange(120)))


def test_measures_are_those_of_the_definition():
    texts = [random_text(i) for i in range(300)] + ["", "\n\n", "a b c d e " * 40, "same line\nsame line\n same line"]
    found = quality.text_measures(pa.array(texts))
    for i, text in enumerate(texts):
        got = tuple(int(found[m][i]) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == brute(text), repr(text)


def test_em_finds_the_reliable_rules():
    rng = np.random.default_rng(4)
    truth = rng.random(4_000) < 0.8
    right = np.array([0.95, 0.9, 0.6])
    votes = np.where(rng.random((4_000, 3)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    votes[rng.random((4_000, 3)) < 0.3] = 0
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    accuracy, posterior, prior = quality.fit_rules(patterns, counts.astype(float))
    assert ((posterior[which.ravel()] > 0.5) == truth).mean() > 0.9
    assert prior == pytest.approx(0.8, abs=0.08)
    assert (accuracy[:, 0] > accuracy[:, 2]).all()


def test_junk_goes_and_clean_texts_stay(spark):
    clean = [(i, ". ".join(prose(12, 50 * i + k) for k in range(8))) for i in range(40)]
    junk = [(100 + i, " ".join(f"{w}&&&" for w in prose(60, 900 + i).split())) for i in range(8)]
    short, copied = (200, "too few words"), (201, "the very same seven words here " * 30)
    rows = {r.doc_id: r for r in quality.judge_quality(documents(spark, [*clean, *junk, short, copied])).collect()}
    assert all(rows[i].kept for i, _ in clean)
    assert not any(rows[i].kept for i, _ in junk)
    assert rows[200].base_failed and rows[201].base_failed and not rows[200].kept and not rows[201].kept
