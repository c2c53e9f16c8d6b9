"""Benchmark decontamination: CGK embedding of item-sized windows, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sitegauge.llm.common import grams, mixed, sliced, table, words_of

# Share of an item's words that may be edited, and the LSH: repetitions and sampled positions of each.
EDIT_SHARE = 0.2
REPEATS, SAMPLES = 32, 2
# Items that travel with one pass over the documents; more items take more passes.
ITEM_BLOCK = 20_000
WINDOW_BLOCK = 2_048
PAD = np.uint64(0)


def edits_allowed(n_words, share: float = EDIT_SHARE):
    return np.floor(np.asarray(n_words) * share + 1e-9).astype(np.int64)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts, and the row of each."""
    words = words_of(texts)
    lower = pc.utf8_lower(words.vocabulary).to_pylist()
    code = np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 for w in lower), np.uint64, len(lower))
    return code[words.ids], words.doc


def cgk_samples(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, repeat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Symbols that random walks show at the sampled steps `at` (lanes x samples).

    The CGK walk of a lane reads `length` symbols from `start`: each step shows the
    current one (padding after the last) and goes on to the next with a coin that
    depends on the symbol, the step and the repetition. Two strings at a small edit
    distance fall back into step after each edit and agree at most steps.
    """
    shown = np.zeros(at.shape, np.uint64)
    place = np.zeros(len(start), np.int64)
    last = at.max(axis=1, initial=0)
    lanes = np.arange(len(start))
    for step in range(int(last.max(initial=-1)) + 1):
        if step % 16 == 0:
            lanes = lanes[last[lanes] >= step]
        inside = place[lanes] < length[lanes]
        now = np.where(inside, symbols[np.minimum(start[lanes] + place[lanes], len(symbols) - 1)], PAD)
        for i in range(at.shape[1]):
            hit = at[lanes, i] == step
            shown[lanes[hit], i] = now[hit]
        with np.errstate(over="ignore"):
            coin = mixed(now ^ (repeat[lanes].astype(np.uint64) * np.uint64(1_000_003) + np.uint64(step)) * np.uint64(0x9E3779B97F4A7C15))
        place[lanes] += (coin >> np.uint64(63)).astype(np.int64)
    return shown


def best_match(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance of `item` to any run of `region`, and the end of the first such run."""
    step = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    end = int(row.argmin())
    return int(row[end]), end


def locate(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Edit distance, start and end of the best match of `item` in `region`."""
    edits, end = best_match(item, region)
    _, back = best_match(item[::-1], region[:end][::-1])
    return edits, end - back, end


@dataclass
class Items:
    """Benchmark items ready for the search: words, pieces that survive the allowed edits, samples of their walks."""

    ids: list
    words: list[np.ndarray]
    piece: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    at: np.ndarray
    shown: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Items:
        code, row = hashed_words(pa.array(texts, pa.string()))
        words = [code[row == i] for i in range(len(texts))]
        ids, words = [i for i, w in zip(ids, words) if len(w)], [w for w in words if len(w)]
        # k edits leave one of k + 1 pieces whole: an item can only match where one of its pieces stands.
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        for no, w in enumerate(words):
            parts = int(edits_allowed(len(w))) + 1
            size = len(w) // parts
            for offset in range(0, size * parts, size):
                value, _ = grams(w[offset : offset + size], np.zeros(size, np.int64), size)
                by_length.setdefault(size, []).append((int(value[0]), no, offset))
        piece = {}
        for size, rows in by_length.items():
            value, no, offset = zip(*sorted(rows))
            piece[size] = (np.array(value, np.uint64), np.array(no), np.array(offset))
        length = np.array([len(w) for w in words], np.int64)
        draw = mixed(np.arange(1, REPEATS * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        share = (draw >> np.uint64(11)).astype(float).reshape(REPEATS, SAMPLES) / 2.0**53
        # A walk of 2 n steps reads about all n words.
        at = (share[None] * (2 * length)[:, None, None]).astype(np.int64)
        flat = np.concatenate(words) if words else np.empty(0, np.uint64)
        first = np.cumsum(length) - length
        lane_item = np.repeat(np.arange(len(words)), REPEATS)
        repeat = np.tile(np.arange(REPEATS), len(words))
        shown = cgk_samples(flat, first[lane_item], length[lane_item], repeat, at.reshape(-1, SAMPLES)) if words else np.zeros((0, SAMPLES), np.uint64)
        return cls(ids, words, piece, at, shown.reshape(-1, REPEATS, SAMPLES))

    def windows(self, code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item and start of the item-sized windows around every whole piece of an item."""
        items, starts = [], []
        for size, (value, no, offset) in self.piece.items():
            found, at = grams(code, row, size)
            # A bit table first: nearly all grams of a corpus end here.
            bits = np.zeros(1 << 20, bool)
            bits[(value & np.uint64(0xFFFFF)).astype(np.int64)] = True
            keep = bits[(found & np.uint64(0xFFFFF)).astype(np.int64)]
            found, at = found[keep], at[keep]
            low, high = np.searchsorted(value, found, "left"), np.searchsorted(value, found, "right")
            count = high - low
            which = np.repeat(np.arange(len(found)), count)
            entry = np.repeat(low, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            items.append(no[entry])
            starts.append(at[which] - offset[entry])
        if not items:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        item, start = np.concatenate(items), np.concatenate(starts)
        # Edits before the piece shift the window by at most their number.
        reach = edits_allowed(np.array([len(w) for w in self.words], np.int64))[item]
        width = 2 * reach + 1
        which = np.repeat(np.arange(len(item)), width)
        shift = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width) - np.repeat(reach, width)
        both = np.unique(np.stack([item[which], start[which] + shift], axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def similar(self, code: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Windows that show the same symbols as their item at all sampled steps of some repetition."""
        hit = np.zeros(len(item), bool)
        for a in range(0, len(item), WINDOW_BLOCK):
            no, first = item[a : a + WINDOW_BLOCK], start[a : a + WINDOW_BLOCK]
            length = np.array([len(w) for w in self.words], np.int64)[no]
            length = np.clip(stop[a : a + WINDOW_BLOCK] - first, 0, length)
            lane = np.repeat(np.arange(len(no)), REPEATS)
            repeat = np.tile(np.arange(REPEATS), len(no))
            shown = cgk_samples(code, first[lane], length[lane], repeat, self.at[no].reshape(-1, SAMPLES))
            same = (shown.reshape(-1, REPEATS, SAMPLES) == self.shown[no]).all(axis=2)
            hit[a : a + WINDOW_BLOCK] = same.any(axis=1)
        return hit

    def find(self, texts: pa.Array) -> list[tuple[int, object, int, int, int]]:
        """Row, item id, first word, end word (exclusive) and edits of every leak in texts without nulls."""
        code, row = hashed_words(texts)
        if not len(code) or not self.words:
            return []
        count = np.bincount(row, minlength=len(texts))
        begin = np.cumsum(count) - count
        item, start = self.windows(code, row)
        # A window belongs to the text its piece is in; it is cut at that text's ends.
        inside = (start >= 0) & (start < len(code))
        item, start = item[inside], start[inside]
        owner = row[start]
        hit = self.similar(code, item, start, begin[owner] + count[owner])
        item, start, owner = item[hit], start[hit], owner[hit]
        leaks = []
        order = np.lexsort((start, item, owner))
        item, start, owner = item[order], start[order], owner[order]
        reach = edits_allowed(np.array([len(w) for w in self.words], np.int64))[item] if len(item) else item
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (owner[1:] != owner[:-1]) | (start[1:] - start[:-1] > 2 * reach[1:] + 1)
        firsts = np.flatnonzero(new)
        for a, b in zip(firsts, np.append(firsts[1:], len(item))):
            word, slack, doc = self.words[item[a]], int(reach[a]), int(owner[a])
            low = max(int(start[a]) - slack, int(begin[doc]))
            high = min(int(start[b - 1]) + len(word) + slack, int(begin[doc] + count[doc]))
            # Places may stand next to each other: what is left on both sides of one is looked through, too.
            open_ = [(low, high)]
            while open_:
                low, high = open_.pop()
                if high - low < len(word) - slack:
                    continue
                edits, x, y = locate(word, code[low:high])
                if edits <= slack:
                    leaks.append((doc, self.ids[item[a]], low + x - int(begin[doc]), low + y - int(begin[doc]), edits))
                    open_ += [(low, low + x), (low + y, high)]
        return sorted(set(leaks), key=lambda k: (k[0], str(k[1]), k[2]))


def item_blocks(benchmark: DataFrame, block: int = ITEM_BLOCK) -> Iterator[Items]:
    """The items in blocks of about `block`, each prepared on the driver."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    parts = -(-items.count() // block)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield Items.of([r["item_id"] for r in rows], [r["text"] for r in rows])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Where documents hold benchmark items: `doc_id, item_id, word_from, word_to, edits`, a row per place.

    A place matches if a run of its words is within 20 % word edits of the item
    (case ignored). Item-sized windows of every document are embedded by CGK random
    walks and compared with their item at the sampled steps of 32 repetitions; a
    window that agrees in one repetition is aligned exactly, and only true matches
    are returned. Windows are embedded only where one of the item's pieces stands
    unchanged: k edits leave one of k + 1 pieces whole, so this drops no match.

    Scale: documents are never shuffled; the items (a block of at most 20,000) travel
    with the task, more items take another pass. A pass costs one hash per word and piece length.

    Null and empty texts hold nothing; items without words match nothing; equal
    items and equal rows each give their rows; other columns are not read.
    """
    kinds = {"doc_id": docs.schema["doc_id"].dataType, "item_id": benchmark.schema["item_id"].dataType}
    schema = ", ".join(f"{n} {t.simpleString()}" for n, t in kinds.items()) + ", word_from bigint, word_to bigint, edits bigint"
    item_type = to_arrow_type(kinds["item_id"])
    found = docs.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                leaks = items.find(pc.fill_null(batch.column("text"), ""))
                if leaks:
                    row, item, *rest = zip(*leaks)
                    columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, item_type), *(pa.array(r, pa.int64()) for r in rest)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "word_from", "word_to", "edits"])

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; `docs` is not shuffled."""
    clean = docs
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                keep = np.ones(batch.num_rows, bool)
                keep[[leak[0] for leak in items.find(pc.fill_null(batch.column("text"), ""))]] = False
                yield batch.filter(pa.array(keep))

        clean = clean.mapInArrow(run, docs.schema)
    return clean


def query(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
