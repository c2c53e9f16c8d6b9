"""Ranked lexical search: short lists summed into accumulators, then document-at-a-time skipping over the long ones."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from sitegauge.llm.common import Words, sliced, stored, table, translated, words_of
from sitegauge.streaming.folders import run_folder

TOP = 10
# Query items that travel with a task at once, and the bytes of their texts.
ITEM_BLOCK, ITEM_BYTES = 20_000, 8_000_000
# Postings of one shard of the index: what a task holds at once.
SHARD_POSTINGS = 2_000_000
# Lists are short as long as all of an item's accumulators are no more than this.
ACCUMULATORS = 16_384
# Documents of a shard that are looked at between two looks at the bounds.
RANGE = 8_192
# A term is a run of ASCII letters and digits and of all characters beyond ASCII; only A-Z lose their case.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(texts: pa.Array) -> Words:
    return words_of(translated(texts, _FOLD))


@dataclass
class Queries:
    """A block of items: per item the distinct terms (indices into `vocabulary`) and how often it says them."""

    ids: list
    vocabulary: pa.Array
    terms: list[np.ndarray]
    times: list[np.ndarray]

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Queries:
        words = terms_of(pa.array(texts, pa.string()))
        split = np.split(words.ids, np.cumsum(words.counts)[:-1]) if texts else []
        pairs = [np.unique(one, return_counts=True) for one in split]
        return cls(ids, words.vocabulary, [p[0] for p in pairs], [p[1] for p in pairs])


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """The items in blocks of bounded rows and bytes; equal rows are one item, null texts none."""
    rows = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // ITEM_BLOCK), -(-size // ITEM_BYTES))
    for part in range(parts):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        block.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        yield Queries.of([r["item_id"] for r in block], [r["text"] for r in block])


def postings(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """`doc_id, n, terms, tfs` of the documents with a term: all their terms counted, those of `vocabulary` listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            words = terms_of(batch.column("text"))
            wanted = pc.fill_null(pc.index_in(words.vocabulary, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            term = wanted[words.ids].astype(np.int64)
            hit = term >= 0
            key, tf = np.unique(words.doc[hit] * max(len(vocabulary), 1) + term[hit], return_counts=True)
            doc, term = np.divmod(key, max(len(vocabulary), 1))
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, tf)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(words.counts > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>")


@dataclass
class Statistics:
    """What scores need of the whole corpus: documents with a term, all their terms, and the weight of each query term."""

    documents: int
    terms: int
    weights: np.ndarray

    @classmethod
    def of(cls, index: DataFrame, vocabulary: pa.Array) -> Statistics:
        n, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        df = np.zeros(len(vocabulary), np.int64)
        for row in held:
            df[row["term"]] = row["count"]
        weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df]
        return cls(n, total, np.array(weights, np.int64))


class Shard:
    """Inverted lists of some documents, in ascending order of their ids, with what each posting adds to a score."""

    def __init__(self, docs: pa.Table, statistics: Statistics):
        docs = docs.sort_by("doc_id").combine_chunks()
        self.ids = docs.column("doc_id").to_pylist()
        terms = docs.column("terms").combine_chunks()
        doc = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        term = terms.flatten().to_numpy(zero_copy_only=False)
        tf = docs.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = docs.column("n").to_numpy()
        m = 25 + 75 * n * statistics.documents // statistics.terms
        adds = statistics.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.doc, self.adds = doc[order], adds[order]
        bounds = np.searchsorted(term[order], np.arange(len(statistics.weights) + 1))
        self.first, self.last = bounds[:-1], bounds[1:]
        self.most = np.zeros(len(statistics.weights), np.int64)
        np.maximum.at(self.most, term, adds)

    def search(self, terms: np.ndarray, times: np.ndarray, floor: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of at least `floor` that can be among the `top` best of this shard, best first.

        Lists are read in two ways. The shortest are summed term at a time into one
        list of accumulators. That list and the long ones are then iterators with a
        bound each: in every range of documents, only documents of iterators whose
        bounds together reach the floor are scored, and the other lists are probed,
        highest bound first, for what is still able to reach it.
        """
        size = self.last[terms] - self.first[terms]
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        short = order[np.cumsum(size[order]) <= ACCUMULATORS]
        iterators = []
        if len(short):
            docs = np.concatenate([self.doc[self.first[terms[i]] : self.last[terms[i]]] for i in short])
            adds = np.concatenate([self.adds[self.first[terms[i]] : self.last[terms[i]]] * times[i] for i in short])
            docs, where = np.unique(docs, return_inverse=True)
            sums = np.zeros(len(docs), np.int64)
            np.add.at(sums, where, adds)
            iterators.append((int(sums.max()), docs, sums, 1))
        for i in order[len(short) :]:
            t = terms[i]
            iterators.append((int(self.most[t] * times[i]), self.doc[self.first[t] : self.last[t]], self.adds[self.first[t] : self.last[t]], int(times[i])))
        iterators.sort(key=lambda it: it[0])
        below = np.cumsum([0] + [it[0] for it in iterators])  # bound of all iterators before this one
        best_doc, best_score = np.empty(0, np.int64), np.empty(0, np.int64)
        for start in range(0, len(self.ids), RANGE):
            stop = min(start + RANGE, len(self.ids))
            optional = int(np.searchsorted(below[1:], floor, side="left"))
            score = np.zeros(stop - start, np.int64)
            for _, docs, adds, time in iterators[optional:]:
                a, b = np.searchsorted(docs, (start, stop))
                score[docs[a:b] - start] += adds[a:b] * time
            found = np.flatnonzero(score)
            for k in range(optional - 1, -1, -1):
                found = found[score[found] + below[k + 1] >= floor]
                if not len(found):
                    break
                _, docs, adds, time = iterators[k]
                at = np.minimum(np.searchsorted(docs, found + start), len(docs) - 1)
                held = docs[at] == found + start
                score[found[held]] += adds[at[held]] * time
            found = found[score[found] >= floor]
            if len(found):
                best_doc = np.concatenate([best_doc, found + start])
                best_score = np.concatenate([best_score, score[found]])
                keep = np.lexsort((best_doc, -best_score))[:top]
                best_doc, best_score = best_doc[keep], best_score[keep]
                if len(keep) == top:
                    floor = max(floor, int(best_score[-1]))
        return best_doc, best_score


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of the index in tables of about `SHARD_POSTINGS` postings."""
    held, size = [], 0
    for batch in batches:
        upto = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False) + 1)
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + SHARD_POSTINGS - size, side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(upto[stop - 1] - before)
            start = stop
            if size >= SHARD_POSTINGS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def best_of(index: DataFrame, queries: Queries, statistics: Statistics, item_kind, top: int) -> DataFrame:
    """`item_id, item_no, doc_id, score`: per task, the documents that can be among the best of an item."""
    doc_kind = index.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries.ids]
        for part in shards(batches):
            shard = Shard(part, statistics)
            for no, (terms, times) in enumerate(zip(queries.terms, queries.times)):
                floor = -best[no][-1][0] if len(best[no]) == top else 1
                docs, scores = shard.search(terms, times, max(floor, 1), top)
                if len(docs):
                    ids = [shard.ids[d] for d in docs.tolist()]
                    rows = [(-s, d is None, 0 if d is None else d, d) for s, d in zip(scores.tolist(), ids)]
                    best[no] = sorted(best[no] + rows, key=lambda r: r[:3])[:top]
        flat = [(no, row) for no, rows in enumerate(best) for row in rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([queries.ids[no] for no, _ in flat], to_arrow_type(item_kind)),
                pa.array([no for no, _ in flat], pa.int32()),
                pa.array([row[3] for _, row in flat], to_arrow_type(doc_kind)),
                pa.array([-row[0] for _, row in flat], pa.int64()),
            ],
            ["item_id", "item_no", "doc_id", "score"],
        )

    return index.mapInArrow(run, f"item_id {item_kind.simpleString()}, item_no int, doc_id {doc_kind.simpleString()}, score bigint")


def ranked(best: DataFrame, top: int) -> DataFrame:
    """The `top` best of each item, first within parts of its rows, so that no item's rows meet in one task unsorted."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = Window.partitionBy("item_no", "part").orderBy(*order)
    whole = Window.partitionBy("item_no").orderBy(*order)
    some = best.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(32))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    rows = some.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
    return rows.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` best documents of each item: `item_id, rank, doc_id, score` (see `Shard.search` for the method).

    Scores are whole numbers: per term of the item (repeats included) its weight
    floor(1000 ln((2N + 2) / (2 df + 1))) times its saturated frequency, damped by
    the document's length against the mean. Statistics cover all documents.

    Scale: one pass cuts the texts into terms and writes the postings of the items'
    terms only, another searches them in shards of bounded size, each task keeping
    its ten best per item and their least score as a floor for its next shard.
    Texts are never shuffled. Items travel with the tasks in blocks of bounded bytes.

    Null texts have no terms; documents without terms count nowhere; an item
    without terms, or without a document that scores, has no rows. Equal scores go
    by ascending id, a null id last. Equal documents are ranked each, equal items
    once; different texts under one item id are ranked apart. Empty tables give no
    rows; other columns are not read.
    """
    item_kind, doc_kind = items.schema["item_id"].dataType, docs.schema["doc_id"].dataType
    schema = f"item_id {item_kind.simpleString()}, rank int, doc_id {doc_kind.simpleString()}, score bigint"
    spark, path = docs.sparkSession, run_folder(docs.sparkSession, "search")
    blocks = 0
    for queries in query_blocks(items):
        index = stored(postings(docs, queries.vocabulary), "postings")
        statistics = Statistics.of(index, queries.vocabulary)
        ranked(best_of(index, queries, statistics, item_kind, top), top).write.mode("append").parquet(path)
        blocks += 1
    return spark.read.schema(schema).parquet(path) if blocks else spark.createDataFrame([], schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL = r"""
WITH doc_terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE text IS NOT NULL
), sizes AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
item_terms AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL
), said AS (SELECT item_id, term, count(*) AS times FROM item_terms GROUP BY item_id, term),
tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM said) GROUP BY doc_id, term),
weight AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole
), adds AS (
    SELECT tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS adds
    FROM tf JOIN sizes USING (doc_id) JOIN weight USING (term), whole
), scored AS (
    SELECT item_id, doc_id, sum(times * adds)::BIGINT AS score FROM said JOIN adds USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
