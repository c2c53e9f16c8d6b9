from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpus import documents, words
from sitegauge.llm import fmindex, substrings


def sequences(seed: int):
    rnd = random.Random(seed)
    size, parts = rnd.choice([2, 3, 20]), []
    for _ in range(rnd.randrange(1, 8)):
        part = [rnd.randrange(1, size + 1) for _ in range(rnd.randrange(80))]
        if parts and rnd.random() < 0.6:
            other = rnd.choice(parts)
            at = rnd.randrange(len(other) + 1)
            part = part[:10] + other[at : at + rnd.randrange(60)] + part[10:]
        parts.append(part)
    return parts


@pytest.mark.parametrize("window, segment, probe", [(3, 4, 2), (5, 512, 8), (12, 20, 8), (35, 1, 8)])
def test_runs_are_those_of_all_windows(window, segment, probe, monkeypatch):
    monkeypatch.setattr(fmindex, "SEGMENT", segment)
    monkeypatch.setattr(fmindex, "PROBE", probe)
    for seed in range(25):
        text, begin, end = [], [], []
        for part in sequences(seed):
            begin.append(len(text))
            end.append(len(text) + len(part))
            text += [*part, 0]
        places = [i for a, b in zip(begin, end) for i in range(a, b - window + 1)]
        count = Counter(tuple(text[i : i + window]) for i in places)
        want = np.zeros(len(text), bool)
        for i in places:
            want[i : i + window] |= count[tuple(text[i : i + window])] > 1
        got = np.zeros(len(text), bool)
        for a, b in zip(*fmindex.repeated_runs(np.array(text), np.array(begin), np.array(end), window)):
            got[a:b] = True
        assert (got == want).all()


def test_backward_search_counts_occurrences():
    text = np.array([int(c) for c in "1213121312211312" * 5 + "0"])
    index = fmindex.FMIndex(text)
    flat = "".join(map(str, text))
    for pattern in ("1", "12", "1312", "2213", "33", "21312"):
        low, high = np.array([0]), np.array([index.n])
        for c in reversed(pattern):
            low, high = index.extend(np.array([int(c)]), low, high)
        assert high[0] - low[0] == sum(flat.startswith(pattern, i) for i in range(len(flat)))


def brute(texts: list) -> list:
    """Rows (n_words, n_removed, sha256), every document an occurrence of its windows."""
    split = [(t or "").split() for t in texts]
    count = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    rows = []
    for w in split:
        gone = set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        rows.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return rows


def shared_texts() -> list:
    passage, near, text = words(50, 1, 10**6), words(200, 2, 10**6), []
    for k in range(12):
        own = words(60, 100 + k, 10**6)
        cut = k % 6 * 3
        text.append(" ".join([*own[:20], *passage[cut : cut + 35 + k % 3], *own[20:]]))
    for k in range(10):
        copy = list(near)
        copy[17 * k] = "changed"
        text.append(" ".join(copy))
    twice = words(40, 5, 10**6)
    text += [" ".join([*twice, "x", *twice]), "again and " * 60, " ".join(words(34, 6)), " ".join(words(34, 6)), None, ""]
    return [*text, text[3], text[3], " ".join(words(80, 7, 10**6)) + "\n\tend"]


@pytest.mark.parametrize("hot", [10**9, 3])
def test_removed_words_are_those_of_all_windows(spark, monkeypatch, hot):
    """With a tiny bound every home counts as hot, and its windows are compared one by one."""
    monkeypatch.setattr(substrings, "HOT_ANCHORS", hot)
    monkeypatch.setattr(substrings, "SHARD_ANCHORS", 20)
    texts = shared_texts()
    rows = substrings.remove_repeated(documents(spark, list(enumerate(texts))), with_words=True).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in rows] == brute(texts)
    assert all(hashlib.sha256(r.kept_words.encode()).hexdigest() == r.kept_sha256 for r in rows if r.kept_words is not None)


def test_equal_windows_choose_equal_anchors():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 35, np.uint64)
    a = np.concatenate([rng.integers(0, 2**63, 50, np.uint64), common, rng.integers(0, 2**63, 20, np.uint64)])
    b = np.concatenate([rng.integers(0, 2**63, 7, np.uint64), common])
    one, at = substrings.anchors(a, np.zeros(len(a), np.int64))
    two, by = substrings.anchors(b, np.zeros(len(b), np.int64))
    first = {(v, p - 50) for v, p in zip(one.tolist(), at.tolist()) if 50 <= p <= 79}
    second = {(v, p - 7) for v, p in zip(two.tolist(), by.tolist()) if 7 <= p}
    assert first & second
