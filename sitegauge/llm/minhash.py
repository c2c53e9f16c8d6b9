"""Near-duplicates by ProbMinHash: sketches of weighted shingles, banding, verification, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import grams, mixed, sliced, stored, table, words_of

SHINGLE, SIMILARITY = 5, 0.8
# Registers of a sketch: a pair of similarity 0.8 agrees on all four of a band with 0.41,
# on none of 24 bands with 3 in a million.
BANDS, ROWS = 24, 4
# Registers of the wide sketches of texts left for closer comparison: the share they agree in has a
# standard deviation of 0.0125 at similarity 0.8, and pairs up to four of them below go to verification.
WIDE = 1_024
# Texts of a bucket that are compared as a block, and those up to which a bucket is joined with itself.
BLOCK, SMALL = 1_024, 24


def weighted_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of the distinct shingles of texts: five words, or all words of a shorter text.

    A shingle that occurs c times weighs 1 + ln c, so a repeated passage counts more than once, but not by length.
    """
    words = words_of(texts)
    hashes = words.hashes()
    value, at = grams(hashes, words.doc, SHINGLE)
    rows = words.doc[at]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            first = words.starts[short]
            keep = np.zeros(len(hashes), bool)
            for i in range(n):
                keep[first + i] = True
            few, where = grams(hashes[keep], words.doc[keep], n)
            value = np.concatenate([value, few])
            rows = np.concatenate([rows, words.doc[keep][where]])
    # Rows are few and hashes many: sort by one number of both, then compare both.
    with np.errstate(over="ignore"):
        key = mixed(value + mixed(rows.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    value, rows = value[order], rows[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(value)))
    order = np.lexsort((value[start], rows[start])) if len(start) else start
    start, count = start[order], count[order]
    return rows[start], value[start], 1 + np.log(count)


def probminhash(rows: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Sketches (n x m): per register the shingle of the earliest arrival.

    Every shingle is a Poisson process of rate `weight`: arrival k comes an
    exponential time after arrival k - 1 and goes to a random register, both drawn
    from the shingle's hash and k, so equal shingles arrive alike in every text. Two
    texts agree in a register with their probability Jaccard similarity. All
    processes advance together; one ends as soon as its next arrival is later than
    the latest of its text's registers, which mostly is at its first or second.
    """
    time = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    latest = np.full(n, np.inf)
    clock = np.zeros(len(value))
    active = np.arange(len(value))
    k = 0
    while len(active):
        k += 1
        with np.errstate(over="ignore"):
            draw = mixed(value[active] + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15))
        clock[active] -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight[active]
        active_at = clock[active] < latest[rows[active]]
        active, draw = active[active_at], draw[active_at]
        slot = rows[active] * m + (mixed(draw ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(time, slot, clock[active])
        won = time[slot] == clock[active]
        winner[slot[won]] = value[active[won]]
        latest = time.reshape(n, m).max(axis=1)
    return winner.reshape(n, m)


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard similarity of two weight vectors over the same shingles (0: absent).

    The sum over shared shingles d of 1 / sum over e of max(x_e / x_d, y_e / y_d). In
    the order of x / y, the maximum is the first term from d on and the second before it.
    """
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    from_here = np.cumsum(x[::-1])[::-1]
    before = np.cumsum(y) - y
    both = (x > 0) & (y > 0)
    return float((1 / (from_here[both] / x[both] + before[both] / y[both])).sum())


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Probability Jaccard of each pair of texts, exactly."""
    n = len(left)
    (rx, vx, wx), (ry, vy, wy) = weighted_shingles(left), weighted_shingles(right)
    rows = np.concatenate([rx, ry])
    value = np.concatenate([vx, vy])
    x = np.concatenate([wx, np.zeros(len(wy))])
    y = np.concatenate([np.zeros(len(wx)), wy])
    order = np.lexsort((value, rows))
    rows, value, x, y = rows[order], value[order], x[order], y[order]
    new = np.ones(len(rows), bool)
    new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        return np.zeros(n)
    rows, x, y = rows[start], np.add.reduceat(x, start), np.add.reduceat(y, start)
    ends = np.searchsorted(rows, np.arange(n + 1))
    return np.array([probability_jaccard(x[a:b], y[a:b]) if b > a else 0.0 for a, b in zip(ends[:-1], ends[1:])])


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """`doc_id`, `tid` (hash of the text) and `bands`: a hash per band of the sketch; none for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            # Copies inside a slice are sketched once.
            coded = batch.column("text").dictionary_encode()
            which = coded.indices.to_numpy(zero_copy_only=False)
            owner, value, weight = weighted_shingles(coded.dictionary)
            sketch = probminhash(owner, value, weight, len(coded.dictionary), bands * rows)
            key = np.zeros((len(sketch), bands), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(rows):
                    key = mixed(key * np.uint64(31) + sketch.reshape(len(sketch), bands, rows)[:, :, i])
            full = np.bincount(owner, minlength=len(sketch)) > 0
            size = np.where(full[which], bands, 0)
            flat = key[which][full[which]].view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), lists], ["doc_id", "tid", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("tid"), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, tid bigint, bands array<bigint>"
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of `edges` (`a`, `b`): `id, root`, the least id of the component, for every end of an edge.

    Every vertex points to its least neighbour, pointers are followed once, and
    the edges are drawn between what they lead to, until none is left: a
    logarithmic number of rounds, each a few joins on ids, written to the shared folder.
    """
    live = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    found = live.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)
    first = True
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root"))
        point = stored(point, name)
        ahead = point.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = stored(point.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root")), name)
        onward = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if first:
            found, first = step, False
        else:
            found = stored(found.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root")), name)
        a = step.select(F.col("id").alias("a"), F.col("root").alias("x"))
        b = step.select(F.col("id").alias("b"), F.col("root").alias("y"))
        live = live.join(a, "a").join(b, "b").where("x <> y")
        live = stored(live.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), name)
    return found


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components (`id, root`) after more `links` between their members or new ids."""
    to_a = roots.select(F.col("id").alias("a"), F.col("root").alias("x"))
    to_b = roots.select(F.col("id").alias("b"), F.col("root").alias("y"))
    lifted = links.join(to_a, "a", "left").join(to_b, "b", "left")
    step = components(lifted.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    onward = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
    moved = roots.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    fresh = step.join(roots, "id", "left_anti").select("id", "root")
    return stored(moved.unionByName(fresh), "components")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (`a`, `b`) whose texts (`tid`, `text`) are as similar as asked, each pair compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "x", 1_000_000):
            near = similarities(batch.column("x"), batch.column("y")) >= similarity - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(near))

    x = texts.select(F.col("tid").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("tid").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def wide_sketches(texts: DataFrame) -> DataFrame:
    """`tid, wide`: sketches of `WIDE` registers, two bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1_000_000):
            sketch = probminhash(*weighted_shingles(batch.column("text")), batch.num_rows, WIDE)
            wide = [row.astype(np.uint16).tobytes() for row in sketch]
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(wide, pa.binary())], ["tid", "wide"])

    return texts.select("tid", "text").mapInArrow(run, "tid bigint, wide binary")


def block_pairs(block: pa.Table, similarity: float) -> pa.Table:
    """Pairs of a block (two parts of a bucket) that are in different components and whose wide sketches are near.

    A pair that meets in several bands is given in the first of them only.
    """
    block = block.combine_chunks()
    part, root = block.column("part").to_numpy(), block.column("root").to_numpy()
    wide = np.stack([np.frombuffer(w, np.uint16) for w in block.column("wide").to_pylist()])
    keys = np.array(block.column("bands").to_pylist(), np.int64)
    i, j, band = (block.column(c)[0].as_py() for c in ("i", "j", "band"))
    x, y = np.flatnonzero(part == i), np.flatnonzero(part == j)
    some = WIDE // 8
    agree = np.zeros((len(x), len(y)), np.uint16)
    for k in range(some):
        agree += wide[x, k][:, None] == wide[y, k][None]
    rough = similarity - 5 * np.sqrt(similarity * (1 - similarity) / some)
    a, b = np.nonzero((agree >= rough * some) & (root[x][:, None] != root[y][None]))
    a, b = x[a], y[b]
    if i == j:
        a, b = a[a < b], b[a < b]
    limit = similarity - 4 * np.sqrt(similarity * (1 - similarity) / WIDE)
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), 4_096):
        one, two = a[at : at + 4_096], b[at : at + 4_096]
        near = (wide[one] == wide[two]).mean(axis=1) >= limit
        keep[at : at + 4_096] = near & ~(keys[one, :band] == keys[two, :band]).any(axis=1)
    tid = block.column("tid").to_numpy()
    return pa.table({"a": tid[a[keep]], "b": tid[b[keep]]})


def remaining_pairs(members: DataFrame, texts: DataFrame, owners: DataFrame, similarity: float) -> DataFrame:
    """Pairs (`a`, `b`) of the open buckets (`band, key, tid, root`) that may be near and are in different components.

    Small buckets are joined with themselves. The others are cut into parts at
    random; blocks of two parts are compared by wide sketches inside a task, so a
    bucket of any size is spread over tasks and only near pairs leave them.
    """
    sizes = members.groupBy("band", "key").agg(F.count("*").alias("n"))
    sized = members.join(sizes, ["band", "key"])
    few = sized.where(F.col("n") <= SMALL)
    left = few.select("band", "key", F.col("tid").alias("a"), F.col("root").alias("ra"))
    right = few.select("band", "key", F.col("tid").alias("b"), F.col("root").alias("rb"))
    meet = (left["band"] == right["band"]) & (left["key"] == right["key"]) & (left["ra"] < right["rb"])
    pairs = left.join(right, meet).select("a", "b")
    many = sized.where(F.col("n") > SMALL)
    wide = stored(wide_sketches(texts.join(many.select("tid").distinct(), "tid", "left_semi")), "wide-sketches")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = many.withColumn("part", F.pmod(F.xxhash64("tid"), parts).cast("int"))
    blocks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    blocks = blocks.select(
        "band", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "tid", "root"
    )
    full = blocks.join(wide, "tid").join(owners.select("tid", "bands"), "tid")
    near = full.groupBy("band", "key", "i", "j").applyInArrow(lambda t: block_pairs(t, similarity), "a bigint, b bigint")
    return pairs.unionByName(near)


def duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`doc_id, tid, root`: documents linked by copies and similar pairs have the same `root`.

    Equal texts are one text from the start. Texts that agree in a band of their
    sketches share a bucket. A bucket never yields all its pairs: its members are
    compared with the one that sits in the fullest buckets (the original of a group
    of edited copies), and links are joined into components. A bucket whose members
    are all in one component is done, as further links could not change a class. In
    the others, pairs of different components are compared too: by wide sketches,
    and exactly if those are near. So no link between classes is lost to the star shape.

    Scale: one pass sketches the texts and writes 200 bytes per document; copies
    fold map-side by hash; only texts that share a bucket are moved again, once.
    Every later exchange holds ids, and hot ids are join keys the planner can split.

    """
    base = stored(sketches(docs), "sketches")
    owners = base.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    split = owners.select("tid", F.posexplode("bands").alias("band", "key"))
    member = split.groupBy("band", "key")
    buckets = member.agg(F.count("*").alias("n")).where("n > 1")
    # Memberships in buckets of two texts or more; `pull` is how full a text's buckets are.
    shared = stored(split.join(buckets, ["band", "key"]), "buckets")
    pull = shared.groupBy("tid").agg(F.sum("n").alias("pull"))
    shared = stored(shared.drop("n").join(pull, "tid"), "buckets")
    owner_ids = shared.select("tid").distinct()
    picked = owner_ids.join(owners.select("tid", "doc_id"), "tid")
    raw = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    same = raw["doc_id"].eqNullSafe(picked["doc_id"]) & (raw["tid"] == picked["tid"])
    texts = raw.join(picked, same).select(picked["tid"], "text").dropDuplicates(["tid"])
    texts = stored(texts, "candidate-texts")
    ordered = lambda pairs: pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    top = shared.groupBy("band", "key").agg(F.max(F.struct("pull", "tid")).alias("top"))
    star = top.select("band", "key", F.col("top.tid").alias("b"))
    pairs = stored(ordered(shared.join(star, ["band", "key"]).where("tid <> b").select(F.col("tid").alias("a"), "b")), "star-pairs")
    roots = components(stored(verified(pairs, texts, similarity), "links"))
    placed = shared.join(roots.withColumnRenamed("id", "tid"), "tid", "left").select("band", "key", "tid", F.coalesce("root", "tid").alias("root"))
    apart = placed.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    members = stored(placed.join(apart.select("band", "key"), ["band", "key"]), "open-buckets")
    if not members.isEmpty():
        rest = ordered(remaining_pairs(members, texts, owners, similarity)).join(pairs, ["a", "b"], "left_anti")
        links = stored(verified(rest, texts, similarity), "links")
        if not links.isEmpty():
            roots = merged(roots, links)
    ids = base.select("doc_id", "tid")
    return ids.join(roots.withColumnRenamed("id", "tid"), "tid", "left").select("doc_id", "tid", F.coalesce("root", "tid").alias("root"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`doc_id, class_id, class_size` of every document; `class_id` is the least id of its class (see `duplicate_classes`).

    Null and empty texts are equal texts without words: copies of one another.
    Texts under five words are one shingle, so they link only to texts with the
    same words. Equal rows are in one class; a null id takes part and never names a
    class unless it is alone; an empty table gives no rows; other columns are not read.
    """
    ids = duplicate_classes(docs, similarity)
    classes = ids.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return ids.join(classes, "root").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that with the least id, with all its columns; of equal rows one stays."""
    ids = duplicate_classes(docs, similarity)
    rows = ids.groupBy("root", "doc_id", "tid").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid", "n")).alias("k"))
    keepers = stored(first.select(F.col("k.doc_id").alias("_kept_id"), F.col("k.tid").alias("_kept_tid"), F.col("k.n").alias("_copies")), "keepers")
    # A row travels as one value, so none of its columns can clash with those used here.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in")
    keyed = docs.select(row, F.col("doc_id").alias("_row_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_row_tid"))
    match = F.col("_row_id").eqNullSafe(F.col("_kept_id")) & (F.col("_row_tid") == F.col("_kept_tid"))
    once = keyed.join(keepers.where("_copies = 1"), match, "left_semi").select("_in.*")
    several = keepers.where("_copies > 1")
    if several.isEmpty():
        return once
    return once.unionByName(keyed.join(several, match, "left_semi").dropDuplicates(["_row_id", "_row_tid"]).select("_in.*"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
