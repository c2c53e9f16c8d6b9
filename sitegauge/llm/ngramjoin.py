"""N-gram Jaccard join: T-occurrence search that merges short inverted lists and probes the long ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegauge.llm.common import grams, mixed, sliced, stored, table, translated, words_of
from sitegauge.llm.minhash import components, merged

SHINGLE, PERCENT = 4, 85
# Short lists a document takes part in beyond those in which a link must show once: a link shows in so many of them.
SHOWN = 4
# Counters of the sketch that tells common shingles from rare ones, and those that travel as one row.
BUCKETS, CHUNK = 1 << 22, 4_096
# Bits of the map that tells texts whose whole sets are wanted from nearly all others, and those that travel as one row.
MAP_BITS, MAP_CHUNK = 1 << 26, 1 << 16
# Members up to which a list gives its pairs; members and shingles of a longer list that are one side of a block.
SMALL, BLOCK, BLOCK_SHINGLES = 64, 1_024, 1 << 20
# Characters of text a task takes at once: a dozen arrays of this many words and shingles are alive together.
TEXT_SLICE = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def required(n):
    """The least overlap a set of `n` shingles has with any set it links to."""
    return (PERCENT * n + 99) // 100


def shown(n):
    """In how many short lists a set of `n` meets a linked set of no fewer shingles, at least."""
    least = required(required(n))
    return np.minimum(SHOWN, least) if isinstance(n, np.ndarray) else min(SHOWN, least)


def overlap_needed(a, b):
    """The least overlap of linked sets of `a` and `b` shingles: 100 x >= 85 (a + b - x)."""
    return -((-PERCENT * (a + b)) // (100 + PERCENT))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of texts, ascending; a text of fewer words is one shingle."""
    words = words_of(translated(texts, _LOWER))
    hashes = words.hashes()
    value, at = grams(hashes, words.doc, SHINGLE)
    rows = words.doc[at]
    for n in range(1, SHINGLE):
        of = np.isin(words.doc, np.flatnonzero(words.counts == n))
        if of.any():
            few, where = grams(hashes[of], words.doc[of], n)
            value, rows = np.concatenate([value, mixed(few + np.uint64(n))]), np.concatenate([rows, words.doc[of][where]])
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], value[new]


def commonness(docs: DataFrame) -> np.ndarray:
    """A class per bucket of shingles: 0 where counts are usual or less, else 1 + log2 of the excess.

    A counting sketch of a fixed 4 million buckets: any class gives right results, as
    it only orders the shingles; a common one just must not come first. Half of the
    buckets are of class 0, and a set needs a sixth of its shingles. The more texts, the more a count
    varies by chance; were that allowed for, shingles of a hundred texts would pass as rare in large corpora.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for part in sliced([batch], "text", TEXT_SLICE):
                _, value = shingle_sets(part.column("text"))
                bucket, times = np.unique((value & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
                counters[bucket] += times.astype(np.uint32)
        full = np.flatnonzero(counters.reshape(-1, CHUNK).any(axis=1))
        for start in range(0, len(full), 64):
            some = full[start : start + 64]
            # Nearly all counts are small: compressed, they are a fraction of their size on the way.
            rows = [pa.compress(np.minimum(row, 65_535).astype(np.uint16).tobytes(), "zstd", asbytes=True) for row in counters.reshape(-1, CHUNK)[some]]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(rows, pa.binary())], ["chunk", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                row = np.frombuffer(pa.decompress(counts, 2 * CHUNK, "zstd", asbytes=True), np.uint16)
                sums[chunk] = sums.get(chunk, 0) + row.astype(np.int64)
        rows = []
        for counts in sums.values():
            excess = counts - np.median(counts)
            rows.append(np.where(excess > 0, 1 + np.log2(np.maximum(excess, 1)), 0).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(rows, pa.binary())], ["chunk", "classes"])

    counted = docs.select("text").mapInArrow(count, "chunk bigint, counts binary")
    classes = np.zeros((BUCKETS // CHUNK, CHUNK), np.uint8)
    for row in stored(counted.repartition("chunk").mapInArrow(total, "chunk bigint, classes binary"), "classes").toLocalIterator():
        classes[row["chunk"]] = np.frombuffer(row["classes"], np.uint8)
    return classes.ravel()


def identities(rows: np.ndarray, value: np.ndarray, n: int) -> list[bytes | None]:
    """16 bytes that tell sets apart: two sums of scrambled shingles; None for an empty set."""
    size = np.bincount(rows, minlength=n)
    start = np.cumsum(size) - size
    out = np.zeros((n, 2), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        with np.errstate(over="ignore"):
            for i, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                out[full, i] = np.add.reduceat(mixed(value ^ np.uint64(salt)), start[full])
    return [row.tobytes() if size[i] else None for i, row in enumerate(out)]


def short_lists(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """`doc_id, sid, n, short`: identity and size of each document's set, and its shingles whose lists are short.

    Shingles are ordered from rare to common (class, then hash). A set of n linked to
    another shares at least t = 0.85 n with it, so at least `SHOWN` of the first n - t + `SHOWN`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", TEXT_SLICE):
            rows, value = shingle_sets(batch.column("text"))
            size = np.bincount(rows, minlength=batch.num_rows)
            sid = identities(rows, value, batch.num_rows)
            rank = classes[(value & np.uint64(BUCKETS - 1)).astype(np.int64)]
            order = np.argsort(rows * 64 + rank, kind="stable")
            rows, value = rows[order], value[order]
            place = np.arange(len(rows)) - (np.cumsum(size) - size)[rows]
            most = size - required(size) + shown(size)
            keep = place < most[rows]
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows[keep], minlength=batch.num_rows))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(value[keep].view(np.int64)))
            columns = [batch.column("doc_id"), pa.array(sid, pa.binary()), pa.array(size.astype(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sid", "n", "short"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sid binary, n bigint, short array<bigint>")


def bitmap(keys: DataFrame) -> np.ndarray:
    """One bit for each `key` (a hash), by its lowest bits: a set bit says that a key may be there."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            for chunk in np.unique(bit // MAP_CHUNK).tolist():
                chunks.setdefault(chunk, np.zeros(MAP_CHUNK, bool))[bit[bit // MAP_CHUNK == chunk] % MAP_CHUNK] = True
        rows = [pa.compress(np.packbits(bits, bitorder="little").tobytes(), "zstd", asbytes=True) for bits in chunks.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int64()), pa.array(rows, pa.binary())], ["chunk", "bits"])

    bits = keys.select(F.expr(f"key & {MAP_BITS - 1}").alias("bit")).distinct()
    filled = bits.repartition(F.expr(f"bit div {MAP_CHUNK}")).mapInArrow(fill, "chunk bigint, bits binary")
    full = np.zeros((MAP_BITS // MAP_CHUNK, MAP_CHUNK // 8), np.uint8)
    for row in stored(filled, "bitmap").toLocalIterator():
        full[row["chunk"]] = np.frombuffer(pa.decompress(row["bits"], MAP_CHUNK // 8, "zstd", asbytes=True), np.uint8)
    return full.ravel()


def whole_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """`rid, n, shingles` of the wanted sets: all their shingles, ascending, eight bytes each.

    A map of the wanted ids travels to the texts, so texts stay where they are read: only sets
    are shuffled, once, with few that are not wanted among them.
    """
    found = reps.join(wanted, "rid", "left_semi").select("rid", "sid", F.xxhash64("doc_id").alias("key"))
    found = stored(found, "wanted")
    full = bitmap(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("key").to_numpy() & (MAP_BITS - 1)
            for part in sliced([batch.filter(pa.array((full[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0))], "text", TEXT_SLICE):
                rows, value = shingle_sets(part.column("text"))
                size = np.bincount(rows, minlength=part.num_rows)
                sid = identities(rows, value, part.num_rows)
                parts = [one.tobytes() for one in np.split(value, np.cumsum(size)[:-1])]
                columns = [pa.array(sid, pa.binary()), pa.array(size.astype(np.int64)), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["sid", "n", "shingles"])

    texts = docs.select("text", F.xxhash64("doc_id").alias("key"))
    sets = texts.mapInArrow(run, "sid binary, n bigint, shingles binary").where("sid IS NOT NULL")
    once = sets.groupBy("sid").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    return once.join(found.select("rid", "sid"), "sid").select("rid", "n", "shingles")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (`a`, `b`) whose sets overlap enough: every shingle of the smaller set is probed in the larger one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = (np.frombuffer(side.as_buffer(), np.uint64) for side in (x, y))
                keep[i] = probe(*((x, y) if len(x) <= len(y) else (y, x))) >= overlap_needed(len(x), len(y))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    x = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def probe(few: np.ndarray, many: np.ndarray) -> int:
    """How many of `few` are in `many`, both ascending, by binary search."""
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    return int((many[at] == few).sum()) if len(many) else 0


class Lists:
    """Inverted lists of some sets, for T-occurrence search."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        value = np.concatenate(sets)
        member = np.repeat(np.arange(len(sets)), self.size)
        order = np.lexsort((member, value))
        value, self.member = value[order], member[order]
        self.first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        self.value = value[self.first]
        self.last = np.append(self.first[1:], len(value))

    def search(self, query: np.ndarray) -> np.ndarray:
        """Members that overlap enough with `query`, by DivideSkip.

        With L long lists left aside, a member of the answer occurs in T - L short
        ones at least. The short lists are merged into counts; members with
        enough of them are looked up in the long lists by binary search, longest last, and
        dropped as soon as the lists that are left cannot make up for what they lack.
        """
        n = len(query)
        at = np.minimum(np.searchsorted(self.value, query), len(self.value) - 1)
        at = at[self.value[at] == query]
        size = self.last[at] - self.first[at]
        at = at[np.argsort(size, kind="stable")]
        t = max(int(required(n)), 1)
        long = max(t - int(shown(n)), 0)
        # The shingles no member has are empty lists, the shortest of all.
        merge = max(n - long - (n - len(at)), 0)
        parts = [self.member[self.first[i] : self.last[i]] for i in at[:merge]]
        count = np.bincount(np.concatenate(parts) if parts else np.empty(0, np.int64), minlength=len(self.size))
        needed = np.maximum(overlap_needed(n, self.size), 1)
        fits = (100 * self.size >= PERCENT * n) & (PERCENT * self.size <= 100 * n)
        left = len(at) - merge
        found = np.flatnonzero(fits & (count + left >= needed))
        count = count[found]
        for k, i in enumerate(at[merge:]):
            if not len(found):
                break
            members = self.member[self.first[i] : self.last[i]]
            where = np.minimum(np.searchsorted(members, found), len(members) - 1)
            count += members[where] == found
            able = count + left - k - 1 >= needed[found]
            found, count = found[able], count[able]
        return found[count >= needed[found]]


def block_links(block: pa.Table) -> pa.Table:
    """Links between sets of a block that are in different components: enough of them to join what belongs together."""
    block = block.combine_chunks()
    outside, part = block.column("outside").to_numpy(zero_copy_only=False), block.column("part").to_numpy()
    i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()
    rid, root = block.column("rid").to_numpy(), block.column("root").to_numpy()
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in block.column("shingles")]
    asking = np.flatnonzero(outside & (part == i))
    answering = np.flatnonzero(part == j)
    group = {r: r for r in set(root.tolist())}

    def top(r):
        while group[r] != r:
            group[r] = group[group[r]]
            r = group[r]
        return r

    a, b = [], []
    if len(asking) and len(answering):
        lists = Lists([sets[k] for k in answering])
        for q in asking:
            for k in answering[lists.search(sets[q])]:
                x, y = top(root[q]), top(root[k])
                if x != y:
                    group[x] = y
                    a.append(rid[q])
                    b.append(rid[k])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def long_lists(lists: DataFrame) -> DataFrame:
    """The rows of lists over `SMALL` that can lead to a link which no shorter list shows.

    Such a pair shares `shown` long lists at least, so a set in fewer has none, and
    one in more may leave out its longest, all but one of that number: in an order
    that is the same for all sets, the first of the lists a pair shares has the others behind it on both sides.
    """
    least = "n"
    for _ in range(3):
        least = f"(({PERCENT} * {least} + 99) div 100)"
    place = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("m"), F.desc("h")))
    long = lists.where(F.col("m") > SMALL).withColumn("place", place)
    return long.where(f"place >= least({SHOWN}, {least})").drop("place")


def links_in_long_lists(lists: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (`a`, `b`) between components inside lists of any length.

    Of each list with several components, those outside its largest component are
    compared with all members, in blocks of two parts of it.
    """
    placed = lists.select("h", "rid", "n").join(roots.withColumnRenamed("id", "rid"), "rid", "left")
    placed = placed.withColumn("root", F.coalesce("root", "rid"))
    sizes = placed.groupBy("h", "root").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
    main = sizes.groupBy("h").agg(F.max(F.struct("k", "root")).alias("main"), F.sum("k").alias("m"), F.sum("size").alias("size"))
    main = main.where("main.k < m").select("h", F.col("main.root").alias("main"), "m", "size")
    members = placed.join(main, "h").withColumn("outside", F.col("root") != F.col("main"))
    parts = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int")
    dealt = members.withColumn("part", F.pmod(F.xxhash64("rid"), parts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    asking = dealt.where("outside").select("h", F.col("part").alias("i"), other.alias("j"), "part", "rid", "root", "outside")
    answering = dealt.select("h", other.alias("i"), F.col("part").alias("j"), "part", "rid", "root", "outside")
    answering = answering.join(asking.select("h", "i").distinct(), ["h", "i"])
    blocks = asking.unionByName(answering).distinct().join(sets.select("rid", "shingles"), "rid")
    return blocks.groupBy("h", "i", "j").applyInArrow(block_links, "a bigint, b bigint")


def set_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`doc_id, sid, n` of every document, and `sid, root` of every set that has a shingle: linked sets have one root."""
    classes = commonness(docs)
    base = stored(short_lists(docs, classes), "short-lists")
    reps = base.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("short").alias("short"))
    reps = stored(reps.withColumn("rid", F.monotonically_increasing_id()), "sets")
    # An inverted list per rare shingle; a shingle only one set has says nothing.
    entries = reps.select("rid", "n", F.explode("short").alias("h"))
    lists = entries.withColumn("m", F.count("*").over(Window.partitionBy("h"))).where("m > 1")
    lists = stored(lists, "inverted-lists")
    load = lists.groupBy("rid").agg(F.sum("m").alias("pull"), F.count_if(F.col("m") > SMALL).alias("long"))
    # Short lists merged: how often two sets meet in them, and might meet in long ones.
    few = lists.where(F.col("m") <= SMALL)
    x = few.select("h", F.col("rid").alias("a"), F.col("n").alias("na"))
    y = few.select("h", F.col("rid").alias("b"), F.col("n").alias("nb"))
    near = (F.col("a") > F.col("b")) & (100 * F.col("nb") >= PERCENT * F.col("na")) & (100 * F.col("na") >= PERCENT * F.col("nb"))
    met = x.join(y, "h").where(near).groupBy("a", "b").agg(F.count("*").alias("times"), F.min(F.least("na", "nb")).alias("n"))
    la = load.select(F.col("rid").alias("a"), F.col("long").alias("la"))
    lb = load.select(F.col("rid").alias("b"), F.col("long").alias("lb"))
    t = F.floor((PERCENT * F.floor((PERCENT * F.col("n") + 99) / 100) + 99) / 100)
    pairs = met.join(la, "a").join(lb, "b").where(F.col("times") + F.least("la", "lb") >= F.least(F.lit(SHOWN), t)).select("a", "b")
    pairs = stored(pairs, "pairs")
    many = stored(long_lists(lists).join(load.select("rid", "pull"), "rid"), "long-lists")
    # First each set against the one that meets most others: its best neighbour, and the hub of each long list.
    degree = pairs.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count("*").alias("d"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.join(degree.withColumnRenamed("rid", "b"), "b").groupBy("a").agg(F.max(F.struct("d", "b")).alias("top")).select("a", F.col("top.b").alias("b"))
    hub = many.groupBy("h").agg(F.max(F.struct("pull", "rid", "n")).alias("top"))
    star = many.join(hub.select("h", "top"), "h").where("rid <> top.rid").where(
        f"100 * n >= {PERCENT} * top.n AND 100 * top.n >= {PERCENT} * n"
    ).select(F.col("rid").alias("a"), F.col("top.rid").alias("b"))
    first = best.unionByName(star).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    first = stored(first, "first-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rid")).unionByName(many.select("rid")).distinct()
    sets = stored(whole_sets(docs, reps, wanted), "whole-sets")
    roots = components(stored(linked(first, sets), "links"))
    # Then what is still apart.
    at = lambda end, name: roots.select(F.col("id").alias(end), F.col("root").alias(name))
    apart = pairs.join(at("a", "ra"), "a", "left").join(at("b", "rb"), "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)")
    rest = stored(linked(apart.select("a", "b").join(first, ["a", "b"], "left_anti"), sets), "links")
    links = stored(rest.unionByName(links_in_long_lists(many, roots, sets)), "links")
    if not links.isEmpty():
        roots = merged(roots, links)
    rooted = reps.select("rid", "sid").join(roots.withColumnRenamed("id", "rid"), "rid", "left")
    return base.select("doc_id", "sid", "n"), rooted.select("sid", F.coalesce("root", "rid").alias("root"))


def join_components(docs: DataFrame) -> DataFrame:
    """`doc_id, n_shingles, component_id` of every document: the size of its set, and the least id its links lead to.

    A set is the distinct runs of four words (A-Z in lower case); fewer words are one
    run. Two documents link when 100 |x and y| >= 85 |x or y|. The join is a T-occurrence
    search: a linked set shares T shingles, so leaving aside the lists of T - 4 shingles,
    the most common ones, it is met four times in the others. Those are merged by
    a shuffle on the shingle, and what is met often enough is probed in the rest.

    Scale: equal sets are one from the start. Common shingles are told by a sketch of
    fixed size, so lists are short; one longer than 64 gives no pairs: all its
    sets that might have a link which short lists do not show are compared with one hub, and
    where that leaves several components, with those
    outside the largest, in blocks of 1,024 (`Lists.search`), of which only the links that
    join components leave. A pair is in some list, so no link between components is lost.
    Texts are never shuffled, whole sets only of what might link.

    Null texts and texts without words have an empty set: they link with nothing, and
    their component is their own id. Equal rows are linked (if they have words). A null id
    takes part, and names a component only where it is alone. Empty tables give no
    rows; other columns are not read. Shingles are compared by 64-bit hashes, sets by 128 bits.
    """
    ids, roots = set_classes(docs)
    full = ids.join(roots, "sid")
    names = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    rows = full.join(names, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = ids.where("sid IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.unionByName(alone)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return join_components(table(spark, folder, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents WHERE text IS NOT NULL
), shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM both_in JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * x >= 85 * (p.n + q.n - x)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT doc_id AS start, doc_id AS node FROM documents
    UNION SELECT start, b FROM reach JOIN ways ON node = a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT start, min(node) AS component_id FROM reach GROUP BY start) r ON r.start = d.doc_id
"""
