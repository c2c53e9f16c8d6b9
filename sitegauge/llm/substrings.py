"""Substring dedup: words inside long runs that occur elsewhere too, found by an FM-index per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import grams, mixed, sliced, stored, table, words_of
from sitegauge.llm.fmindex import repeated_runs

WINDOW = 35
# Words of the grams that route a window to its shard.
GRAM = 6
# Anchors a shard is planned for, and above which one home is split by window; an anchor stands for about 14 words.
SHARD_ANCHORS, HOT_ANCHORS = 50_000, 200_000


def anchors(hashes: np.ndarray, doc: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the least gram of every window (winnowing): equal windows choose the same one.

    The leftmost least hash of each run of `window - gram + 1` grams, one gram in
    about fifteen; every window within a text holds the anchor it chose.
    """
    n, reach = len(hashes), window - gram + 1
    if n < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    value, _ = grams(hashes, np.zeros(n, np.int64), gram)
    # High bits of the hash, then the place: the least number is the leftmost of the least.
    shift = np.uint64(max(1, int(n).bit_length()))
    least = (value >> shift << shift) | np.arange(len(value), dtype=np.uint64)
    width = 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    inside = doc[: n - window + 1] == doc[window - 1 :]
    place = np.unique((least[: n - window + 1][inside] & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64))
    return value[place], place


def anchor_runs(value: np.ndarray, place: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Anchors of equal hash at most a window apart in one text as one: hash, first and last place, by text.

    If one of them is repeated, all words between them are looked at anyway. In a
    text that repeats a few words over and over, where every gram is an anchor, this leaves a handful.
    """
    order = np.lexsort((place, value, doc[place]))
    value, place = value[order], place[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[place[1:]] != doc[place[:-1]]) | (place[1:] - place[:-1] > window)
    first = np.flatnonzero(new)
    return value[first], place[first], place[np.append(first[1:], len(value))[: len(first)] - 1]


def joined_sha256(flat: pa.Array, offsets: np.ndarray) -> list[str]:
    """SHA-256 of the words of each text joined by one blank."""
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)
    return [hashlib.sha256((t or "").encode()).hexdigest() for t in pc.binary_join(lists, " ").to_pylist()]


def _base(docs: DataFrame) -> DataFrame:
    """One row per document: `doc_id, tid` (hash of the text), `n_words`, `sha` of its words, and of its anchors
    (see `anchor_runs`) the `gram`, the first and the last `place`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            # Copies inside a slice are worked on once.
            coded = batch.column("text").dictionary_encode()
            which = coded.indices
            words = words_of(coded.dictionary)
            ends = np.cumsum(words.counts)
            value, place, last = anchor_runs(*anchors(words.hashes(), words.doc), words.doc)
            at = np.searchsorted(words.doc[place], np.arange(len(ends) + 1)).astype(np.int32)
            begin = np.repeat(ends - words.counts, np.diff(at))
            sha = joined_sha256(words.vocabulary.take(pa.array(words.ids)), np.append(0, ends))
            made = {
                "n_words": pa.array(words.counts.astype(np.int64)),
                "sha": pa.array(sha, pa.string()),
                "gram": pa.ListArray.from_arrays(pa.array(at), pa.array(value.view(np.int64))),
                "place": pa.ListArray.from_arrays(pa.array(at), pa.array((place - begin).astype(np.int32))),
                "last": pa.ListArray.from_arrays(pa.array(at), pa.array((last - begin).astype(np.int32))),
            }
            # The anchors of copies in a slice are given once, with the first of them.
            order = which.to_numpy(zero_copy_only=False)
            again = np.ones(len(order), bool)
            again[np.unique(order, return_index=True)[1]] = False
            columns = [batch.column("doc_id"), batch.column("tid"), made["n_words"].take(which), made["sha"].take(which)]
            first = pa.array(order, mask=again)
            columns += [pc.coalesce(made[c].take(first), pa.scalar([], made[c].type)) for c in ("gram", "place", "last")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tid", *made])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, tid bigint, n_words bigint, sha string, gram array<bigint>, place array<int>, last array<int>"
    return docs.mapInArrow(run, schema)


def spans_around(places: list, n_words: int, window: int = WINDOW, gram: int = GRAM) -> list[tuple[int, int]]:
    """The words of all windows that hold one of the grams at `places` (first, last), as disjoint spans of a text."""
    spans: list[tuple[int, int]] = []
    for first, last in sorted({(p["place"], p["last"]) for p in places}):
        start, stop = max(0, first + gram - window), min(n_words, last + window)
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(stop, spans[-1][1]))
        else:
            spans.append((start, stop))
    return [s for s in spans if s[1] - s[0] >= window]


def _word_lists(texts: pa.Array) -> pa.Array:
    """Words of each text as a list array."""
    words = words_of(texts)
    offsets = np.append(0, np.cumsum(words.counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), words.vocabulary.take(pa.array(words.ids)))


def _pieces(texts: DataFrame) -> DataFrame:
    """Cuts the marked spans out of the texts: `shard, tid, start, words` (joined by one blank); hot spans have no shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            lists = _word_lists(batch.column("text"))
            tids, marks = batch.column("tid").to_pylist(), batch.column("marks").to_pylist()
            offsets = lists.offsets.to_numpy()
            rows, cuts = [], []
            for i, (tid, own) in enumerate(zip(tids, marks)):
                for mark in own:
                    for start, stop in spans_around(mark["places"], int(offsets[i + 1] - offsets[i])):
                        rows.append((mark["shard"], tid, start))
                        cuts.append((int(offsets[i]) + start, int(offsets[i]) + stop))
            if not rows:
                continue
            lengths = np.array([b - a for a, b in cuts], np.int64)
            first = np.array([a for a, _ in cuts], np.int64)
            ends = np.cumsum(lengths)
            take = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(first, lengths)
            flat = lists.values.take(pa.array(take))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), flat), " ")
            shard, tid, start = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int64()), pa.array(tid, pa.int64()), pa.array(start, pa.int64()), joined],
                ["shard", "tid", "start", "words"],
            )

    return texts.select("tid", "text", "marks").mapInArrow(run, "shard bigint, tid bigint, start bigint, words string")


def _search_shard(piece: pa.Table) -> pa.Table:
    """Repeated runs of one shard: an FM-index over its pieces, through which every piece is streamed."""
    piece = piece.combine_chunks()
    words = words_of(piece.column("words").chunk(0))
    # Every piece ends in a separator; words are numbered from 1.
    ends = np.cumsum(words.counts + 1)
    begin = ends - words.counts - 1
    symbols = np.zeros(int(ends[-1]), np.int64)
    symbols[np.arange(len(words.ids)) + words.doc] = words.ids + 1
    low, high = repeated_runs(symbols, begin, ends - 1, WINDOW)
    owner = np.searchsorted(ends, low, side="right")
    start = piece.column("start").chunk(0).to_numpy()[owner] - begin[owner]
    return pa.table({
        "tid": piece.column("tid").chunk(0).take(pa.array(owner)),
        "low": pa.array(low + start, pa.int64()),
        "high": pa.array(high + start, pa.int64()),
    })


def _hot_windows(pieces: DataFrame) -> DataFrame:
    """Runs of hot pieces: every window by itself, by two hashes that partial aggregates fold before they are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "words", 500_000):
            words = words_of(batch.column("words"))
            hashes = words.hashes()
            one, at = grams(hashes, words.doc, WINDOW)
            two, _ = grams(mixed(hashes), words.doc, WINDOW)
            owner = words.doc[at]
            place = at - words.starts[owner] + batch.column("start").to_numpy()[owner]
            yield pa.RecordBatch.from_arrays(
                [batch.column("tid").take(pa.array(owner)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(place)],
                ["tid", "one", "two", "low"],
            )

    windows = stored(
        pieces.mapInArrow(run, "tid bigint, one bigint, two bigint, low bigint").withColumn("at", F.xxhash64("tid", "low")),
        "hot-windows",
    )
    twice = windows.groupBy("one", "two").agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a <> b")
    return windows.join(twice, ["one", "two"]).select("tid", "low", (F.col("low") + WINDOW).alias("high"))


def repeated_spans(docs: DataFrame, base: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Texts that may hold repeated windows (`tid, text, marks`), and their repeated runs (`tid, low, high`)."""
    marked = base.select("tid", F.explode(F.arrays_zip("gram", "place", "last")).alias("m")).select("tid", "m.gram", "m.place", "m.last")
    grouped = marked.groupBy("gram").agg(
        F.min("tid").alias("home"), F.max("tid").alias("top"), F.min("place").alias("p"), F.max("last").alias("q")
    )
    again = grouped.where("home <> top OR p <> q").select("gram", "home")
    marks = stored(marked.join(again, "gram").select("tid", "home", "place", "last"), "anchors")
    # A run weighs as many anchors as its words would have at the usual distance.
    weight = marks.groupBy("home").agg(F.sum(1 + F.floor((F.col("last") - F.col("place")) / 14)).alias("n"))
    total = weight.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = max(1, -(-total // SHARD_ANCHORS))
    hot = stored(weight.where(F.col("n") > HOT_ANCHORS).select("home", F.lit(True).alias("hot")), "hot-homes")
    home = F.pmod(F.xxhash64("home"), F.lit(shards))
    is_hot = hot.count()
    if is_hot:
        # At most one home in 200,000 anchors is hot, so this table is that much smaller than the anchors.
        placed = marks.join(hot, "home", "left").withColumn("shard", F.when(~F.coalesce("hot", F.lit(False)), home))
    else:
        placed = marks.withColumn("shard", home)
    per_text = placed.groupBy("tid", "shard").agg(F.collect_set(F.struct("place", "last")).alias("places"))
    per_text = per_text.groupBy("tid").agg(F.collect_list(F.struct("shard", "places")).alias("marks"))
    wanted = per_text.join(owners.select("tid", "doc_id"), "tid")
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["tid"] == wanted["tid"])
    texts = docs.join(wanted, same).select(wanted["tid"], "text", "marks")
    # A repeated row is the same text twice: its runs are found once too often, and removed once all the same.
    texts = stored(texts.dropDuplicates(["tid"]), "marked-texts")
    pieces = _pieces(texts)
    runs = (
        pieces.where("shard IS NOT NULL").groupBy("shard").applyInArrow(_search_shard, "tid bigint, low bigint, high bigint")
    )
    if is_hot:
        runs = runs.unionByName(_hot_windows(pieces.where("shard IS NULL")))
    return texts, stored(runs, "runs")


def _covered(n_words: int, runs: list) -> np.ndarray:
    depth = np.zeros(n_words + 1, np.int64)
    for run in runs:
        depth[run["low"]] += 1
        depth[run["high"]] -= 1
    return np.cumsum(depth)[:-1] > 0


def _cut_texts(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """`tid, n_cut, cut_sha, cut_words`: how many words the runs cover, and what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            lists = _word_lists(batch.column("text"))
            sizes = np.diff(lists.offsets.to_numpy())
            gone = [_covered(n, own) for n, own in zip(sizes, batch.column("runs").to_pylist())]
            keep = ~np.concatenate(gone) if gone else np.empty(0, bool)
            left = np.array([len(g) - g.sum() for g in gone], np.int64)
            flat = lists.values.filter(pa.array(keep))
            offsets = np.append(0, np.cumsum(left)).astype(np.int32)
            words = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), flat), " ")
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in words.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("tid"), pa.array(sizes - left, pa.int64()), pa.array(sha), words], ["tid", "n_cut", "cut_sha", "cut_words"]
            )

    per_text = runs.distinct().groupBy("tid").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    return texts.select("tid", "text").join(per_text, "tid").mapInArrow(run, "tid bigint, n_cut bigint, cut_sha string, cut_words string")


def remove_repeated(docs: DataFrame, with_words: bool = False) -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256`, and `kept_words` if asked for (null where nothing is removed).

    Removes every word inside a window of 35 words whose sequence starts anywhere
    else too, judged on the input. Each window chooses its least six-word gram as an
    anchor, so equal windows choose equal anchors. Anchors that occur once are
    dropped; the others have a home, the least text they occur in, and the words
    around them go to the shard of that home: all places of a repeated window meet in
    one shard. There an FM-index is built over the pieces and every piece is streamed
    through it by backward search. Texts with a copy are repeated throughout.

    Scale: one pass writes about 80 bytes per hundred words; the exchanges hold
    anchors, and text only where it may be repeated. A shard is planned for 700,000
    words. A home with over 200,000 anchors (a huge group of near copies) does not go
    to one shard: its windows are compared one by one, with map-side folding.

    Null and empty texts have no words; texts under 35 words stay whole; equal rows
    count as copies; an empty table gives no rows; other columns are not read.
    """
    source = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    base = stored(_base(source), "word-base")
    owners = base.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    texts, runs = repeated_spans(source, base, owners)
    cut = _cut_texts(texts, runs)
    if not with_words:
        cut = cut.drop("cut_words")
    cut = stored(cut, "cut-texts")
    light = base.select("doc_id", "tid", "n_words", "sha").join(owners.select("tid", "copies"), "tid").join(cut, "tid", "left")
    copied = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    result = light.select(
        "doc_id", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        *([F.when(copied, "").otherwise(F.col("cut_words")).alias("kept_words")] if with_words else []),
    )
    return result


def query(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated(table(spark, folder, "documents"))
