"""Hard-negative mining: anchors in clusters walk candidate lists sorted once per cluster by an angular upper bound."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegauge.llm.common import stored, table
from sitegauge.streaming.folders import run_folder

POSITIVES, NEGATIVES = 5, 10
# A negative scores between these hundredths of its positive's score.
LOW, HIGH = 30, 90
# Bytes of anchor vectors that travel with a task, and of candidate vectors that a task holds at once.
ANCHOR_BYTES, SLICE_BYTES = 8_000_000, 32_000_000
# Anchors of a cluster, rounds of its fitting, and steps of a walk between two looks at the bound.
CLUSTER, ROUNDS, STEP = 32, 6, 512
# Room for rounding in the angles, which are computed in doubles.
SLACK = 1e-6
MOST = 2**63 - 1
LEAST = -MOST


def matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Lists of whole numbers as rows of an array; shorter lists end in zeros."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width = max(int(size.max(initial=0)), width)
    full = np.zeros((len(size), width), np.int64)
    full[np.arange(width) < size[:, None]] = flat
    return full


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) if rows.shape[1] < width else rows


def exact_type(*parts: np.ndarray):
    """The fastest number type in which inner products of such rows are exact."""
    most = 1.0
    for part in parts:
        most *= float(np.abs(part.astype(np.float64)).max(initial=1.0))
    most *= max(parts[0].shape[1], 1)
    return np.float64 if most < 2.0**52 else np.int64 if most < 2.0**62 else object


def as_long(scores: np.ndarray) -> np.ndarray:
    """Whole numbers as longs; beyond 64 bits, the nearest one."""
    if scores.dtype == object:
        scores = np.minimum(np.maximum(scores, LEAST), MOST)
    return scores.astype(np.int64)


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.astype(np.float64)
    norm = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(norm > 0, norm, 1)[:, None], norm


@dataclass
class Anchors:
    """A block of anchors, in clusters: `members[c]` are the anchors around `centres[c]`, none farther than `spread[c]`."""

    ids: np.ndarray
    label: np.ndarray
    rows: np.ndarray
    norm: np.ndarray
    centres: np.ndarray
    members: list[np.ndarray]
    spread: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, label: np.ndarray, rows: np.ndarray) -> Anchors:
        direction, norm = unit(rows)
        k = max(1, -(-len(ids) // CLUSTER))
        centres = direction[np.linspace(0, len(ids) - 1, k).astype(int)]
        for _ in range(ROUNDS):
            nearest = (direction @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, direction)
            mean, size = unit(sums)
            centres = np.where((size > 0)[:, None], mean, centres)
        nearest = (direction @ centres.T).argmax(axis=1)
        angle = np.arccos(np.clip((direction * centres[nearest]).sum(axis=1), -1, 1))
        used = np.unique(nearest)
        members = [np.flatnonzero(nearest == c) for c in used]
        return cls(ids, label, rows, norm, centres[used], members, np.array([angle[m].max() for m in members]))


@dataclass
class Wanted:
    """Searches of a block: search `i` belongs to anchor `anchor[i]` and takes the best `k` scores within `low` to `high`.

    `same` tells whether rows of the anchor's label are wanted or those of other labels.
    """

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int
    same: bool


class Party:
    """The members of a cluster, their searches, and the best these have found so far."""

    def __init__(self, anchors: Anchors, cluster: int, wanted: Wanted):
        self.anchors, self.cluster, self.wanted = anchors, cluster, wanted
        self.members = anchors.members[cluster]
        self.searches = np.flatnonzero(np.isin(wanted.anchor, self.members))
        self.member = np.searchsorted(self.members, wanted.anchor[self.searches])
        # A search takes scores of at least its floor: its own lower limit, then its k-th best score.
        self.floor, self.high = wanted.low[self.searches], wanted.high[self.searches]
        self.found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.steps = 0

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Joins finds to the best: of each search the first k by score, then by id."""
        search, score, ids = (np.concatenate(pair) for pair in zip(self.found, (search, score, ids)))
        order = np.lexsort((ids, -score, search))
        search, score, ids = search[order], score[order], ids[order]
        place = np.arange(len(search)) - np.searchsorted(search, search, side="left")
        keep, last = place < self.wanted.k, place == self.wanted.k - 1
        self.floor[search[last]] = np.maximum(self.floor[search[last]], score[last])
        self.found = search[keep], score[keep], ids[keep]

    def walk(self, bound: np.ndarray, ids: np.ndarray, label: np.ndarray, rows: np.ndarray, own: np.ndarray) -> None:
        """Sorts the candidates by `bound` (for anchors of length one) and lets every member walk down until the bound ends it."""
        order = np.argsort(-bound, kind="stable")
        norm, own_label, own_id = (x[self.members] for x in (self.anchors.norm, self.anchors.label, self.anchors.ids))
        own = own[self.members]
        for start in range(0, len(order), STEP):
            floor = np.full(len(self.members), np.inf)
            np.minimum.at(floor, self.member, self.floor.astype(np.float64))
            # Nothing from here on scores more than the bound; floors are whole numbers.
            walking = np.flatnonzero(bound[order[start]] * norm * (1 + np.sign(bound[order[start]]) * SLACK) + 1 >= floor)
            if not len(walking):
                break
            self.steps += len(walking)
            step = order[start : start + STEP]
            score = as_long(own[walking] @ rows[step].T)
            fit = (own_label[walking][:, None] == label[step]) == self.wanted.same
            fit &= ids[step] != own_id[walking][:, None]
            place = np.full(len(self.members), -1)
            place[walking] = np.arange(len(walking))
            search = np.flatnonzero(place[self.member] >= 0)
            at = place[self.member[search]]
            hit = fit[at] & (score[at] >= self.floor[search][:, None]) & (score[at] <= self.high[search][:, None])
            i, j = np.nonzero(hit)
            if len(i):
                self.add(search[i], score[at[i], j], ids[step][j])


class Walk:
    """The searches of one task."""

    def __init__(self, anchors: Anchors, wanted: Wanted):
        self.anchors = anchors
        self.parties = [Party(anchors, c, wanted) for c in range(len(anchors.members))]

    def through(self, ids: np.ndarray, label: np.ndarray, rows: np.ndarray) -> None:
        """One slice of candidates: for each cluster one list, sorted once."""
        width = max(rows.shape[1], self.anchors.rows.shape[1])
        rows, own = widened(rows, width), widened(self.anchors.rows, width)
        direction, norm = unit(rows)
        angles = np.arccos(np.clip(direction @ widened(self.anchors.centres, width).T, -1, 1))
        number = exact_type(rows, own)
        rows, own = rows.astype(number), own.astype(number)
        for party in self.parties:
            nearest = np.maximum(angles[:, party.cluster] - self.anchors.spread[party.cluster] - SLACK, 0)
            party.walk(norm * np.cos(nearest), ids, label, rows, own)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Search, score and id of the best of all searches."""
        parts = [(party.searches[search], score, ids) for party in self.parties for search, score, ids in [party.found]]
        return tuple(np.concatenate(part) for part in zip(*parts))


def searched(vectors: DataFrame, anchors: Anchors, wanted: Wanted) -> DataFrame:
    """`search, score, vec_id`: per task, the best finds of each search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(anchors, wanted)
        held, size = [], 0
        for batch in batches:
            bytes_each = 8 * max(1, int(pc.max(pc.list_value_length(batch.column("vector"))).as_py() or 1) if batch.num_rows else 1)
            most = max(1, SLICE_BYTES // bytes_each)
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                held.append(part)
                size += part.num_rows * bytes_each
                if size >= SLICE_BYTES:
                    walk_slice(walk, held)
                    held, size = [], 0
        if held:
            walk_slice(walk, held)
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in walk.found()], ["search", "score", "vec_id"])

    return vectors.select("vec_id", "label", "vector").mapInArrow(run, "search bigint, score bigint, vec_id bigint")


def walk_slice(walk: Walk, batches: list[pa.RecordBatch]) -> None:
    part = pa.Table.from_batches(batches).combine_chunks()
    if part.num_rows:
        walk.through(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("vector").combine_chunks()))




def best(found: DataFrame, k: int) -> DataFrame:
    """The first `k` finds of each search with their `rank`, first within parts, so that no search's finds all meet unsorted."""
    order = [F.desc("score"), "vec_id"]
    some = found.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("search", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("search").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def anchor_blocks(anchors: DataFrame) -> Iterator[Anchors]:
    """The anchors in blocks of bounded bytes, each in clusters; of rows with one id that of the least label and vector counts."""
    first = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")
    size = first.agg(F.coalesce(F.sum(8 * F.size("vector") + 16), F.lit(0))).first()[0]
    parts = -(-size // ANCHOR_BYTES)
    for part in range(parts):
        block = first.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).orderBy("vec_id").toArrow()
        if block.num_rows:
            rows = matrix(block.column("vector").combine_chunks())
            yield Anchors.of(block.column("vec_id").to_numpy(), block.column("label").to_numpy(), rows)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives: `anchor_id, positive_id, rank, negative_id, positive_score, negative_score`.

    `vectors` and `anchors` hold `vec_id bigint, label bigint, vector array<bigint>`.
    A row's score is its inner product with the anchor. The positives of an anchor
    are the first `positives` other rows of its label, by score, then by id; for each of
    them come the first `negatives` rows of other labels whose score is within `low`
    to `high` hundredths of the positive's.

    Anchors are put into clusters. For a cluster, candidates are sorted once by the
    most that any direction within the cluster's widest angle could score with them,
    |x| cos(max(0, angle to the centre - widest angle)); every member then walks that
    list and stops where this bound is under the worst score it could still use. So
    the result is exact, whatever the clusters are.

    Scale: anchors go through in blocks of 8 MB, each two passes (positives, then
    negatives) in which candidates stay where they are: a task sorts its own candidates
    in slices of 32 MB and keeps what it found as its floor for the next, so only its
    best few finds per search are shuffled.

    Ids are unique; should they repeat, rows with an anchor's id are never its
    positives or negatives and it is mined once, other rows count each. Rows with a
    null id, label or vector take no part. Shorter vectors end in zeros. A score
    beyond 64 bits counts as the nearest long. Empty tables give no rows; other columns are not read.
    """
    spark, path = vectors.sparkSession, run_folder(vectors.sparkSession, "negatives")
    usable = "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"
    vectors, anchors = vectors.where(usable), anchors.where(usable)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    blocks = 0
    for block in anchor_blocks(anchors):
        n = len(block.ids)
        every = Wanted(np.arange(n), np.full(n, LEAST), np.full(n, MOST), positives, True)
        near = best(searched(vectors, block, every), positives).collect()
        pairs = sorted((r["search"], r["rank"], r["vec_id"], r["score"]) for r in near)
        if not pairs:
            continue
        at = np.array([p[0] for p in pairs])
        # In hundredths the limits are whole: low * p <= 100 * n <= high * p.
        under = np.array([-((-low * p[3]) // 100) for p in pairs], np.int64)
        over = np.array([(high * p[3]) // 100 for p in pairs], np.int64)
        hard = best(searched(vectors, block, Wanted(at, under, over, negatives, False)), negatives)
        keys = pa.table({
            "search": pa.array(range(len(pairs)), pa.int64()), "anchor_id": pa.array(block.ids[at]),
            "positive_id": pa.array([p[2] for p in pairs], pa.int64()), "positive_score": pa.array([p[3] for p in pairs], pa.int64()),
        })
        rows = hard.join(spark.createDataFrame(keys), "search").withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        rows.select(*(c.split()[0] for c in schema.split(", "))).write.mode("append").parquet(path)
        blocks += 1
    return spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)


def whole_numbers(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """`vec_id, label, vector`: components times `scale`, rounded down; rows with a null or non-finite part are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    parts = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), parts.alias("vector"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every hundredth row against all; every seventh has a wrong label first."""
    rows = whole_numbers(table(spark, folder, "embeddings"))
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = stored(rows.withColumn("label", wrong), "vectors")
    return mine(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
