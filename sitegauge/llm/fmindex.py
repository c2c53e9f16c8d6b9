"""FM-index over the words of a shard: wavelet matrix, backward search, repeated runs of words."""

from __future__ import annotations

import numpy as np

# Longest run one backward search follows; suffixes are sorted to that depth.
DEPTH = 256
# Words a lane of the search covers, and words of a first, cheap look into a window.
SEGMENT, PROBE = 512, 8


class Bits:
    """Bit vector with constant-time rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Self-index of a sequence of symbols (0 separates texts and is never searched for).

    The Burrows-Wheeler transform is kept as a wavelet matrix: one bit per symbol
    and level, so about 17 bits a word for a shard of 100,000 distinct words.
    """

    def __init__(self, symbols: np.ndarray, depth: int = DEPTH):
        n = len(symbols)
        order = suffix_order(symbols, depth)
        bwt = symbols[order - 1]
        self.n = n
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        current = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(int(n - bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        every = np.arange(int(symbols.max(initial=0)) + 1)
        count = np.bincount(symbols, minlength=len(every))
        # What turns a position at the foot of the matrix into one in the suffix order.
        self.shift = np.cumsum(count) - count - self._descend(every, np.zeros(len(every), np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.levels - 1 - i)) & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the interval of each pattern with `symbol` put in front."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        both += np.concatenate([self.shift[symbol]] * 2)
        return both[: len(symbol)], both[len(symbol) :]


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the `depth` symbols that follow (prefix doubling); enough for patterns up to that length."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        sorted_rank = rank[order]
        new = np.zeros(n, np.int64)
        new[1:] = sorted_rank[1:] != sorted_rank[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if step >= depth or rank[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        rank = rank * (n + 1) + ahead
        order = np.argsort(rank, kind="stable")
        step *= 2


def repeated_runs(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs [start, stop) inside the given parts whose windows of `window` symbols all occur twice or more in `symbols`.

    Every part is streamed from its right end. From the end of a window a backward
    search goes left as long as what it has read occurs twice; the length it
    reaches is the matching statistic there. A run of at least `window` symbols is
    reported, and the search goes on with the first window that holds the symbol
    it broke at. Most windows of a text occur once, and a look at their first
    eight symbols shows it: a break there rules out every window that holds those, so
    the search leaps. Parts are cut into overlapping lanes, which all advance together.
    """
    index = FMIndex(symbols)
    starts, ends = [], []
    for a, b in zip(begin.tolist(), end.tolist()):
        if b - a >= window:
            cut = np.arange(a, max(a + 1, b - window + 1), SEGMENT)
            starts.append(cut)
            ends.append(np.minimum(cut + SEGMENT + window - 1, b))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left = np.concatenate(starts)
    last = np.concatenate(ends) - 1
    n = len(symbols)
    probe_end = last - window + min(PROBE, window)
    place = probe_end.copy()
    low, high = np.zeros(len(left), np.int64), np.full(len(left), n, np.int64)
    whole = np.zeros(len(left), bool)
    found_from, found_to = [], []
    while len(left):
        new_low, new_high = index.extend(symbols[place], low, high)
        twice = new_high - new_low >= 2
        low, high = np.where(twice, new_low, low), np.where(twice, new_high, high)
        place = place - twice
        length = probe_end - place
        probed = twice & ~whole & (place < last - window + 1)
        ended = whole & (~twice | (place < left) | (length >= DEPTH))
        hit = ended & (length >= window)
        if hit.any():
            found_from.append(place[hit] + 1)
            found_to.append(last[hit] + 1)
        missed = ~twice & ~hit
        last = np.where(hit, place + window - 1, np.where(missed, probe_end - 1, last))
        fresh = hit | missed
        restart = fresh | probed
        whole = np.where(fresh, False, whole | probed)
        probe_end = np.where(fresh, last - window + min(PROBE, window), np.where(probed, last, probe_end))
        place = np.where(restart, probe_end, place)
        low, high = np.where(restart, 0, low), np.where(restart, n, high)
        alive = last - left + 1 >= window
        if not alive.all():
            left, last, probe_end, place = left[alive], last[alive], probe_end[alive], place[alive]
            low, high, whole = low[alive], high[alive], whole[alive]
    if not found_from:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_from), np.concatenate(found_to)
