"""Toxicity by classifier chains: each category's linear model also sees the earlier categories' probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import bytes_in, sliced, stored, table, with_columns, words_of

# Bound of the labelled rows the models are fitted on, and of the text features they may use.
MAX_LABELLED, MAX_FEATURES, MIN_DOCS = 6_000, 2_048, 3
FOLDS = 4
# Labelled texts either class needs before a threshold is drawn from them.
MIN_TO_TUNE = 20
PREFIXES = (4, 5)
N_DENSE = 3


def feature_keys(word: str) -> tuple[int, ...]:
    """Hashes of a lower-cased word and of its first four and five letters, as signed 64-bit numbers."""
    names = ["=" + word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return tuple(xxhash.xxh3_64_intdigest(name) - (1 << 63) for name in names)


def dense_measures(texts: pa.Array, n_words: np.ndarray) -> np.ndarray:
    """Length, share of mark-up characters and share of capitals, all about 0 to 1."""
    chars = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1)
    capitals = bytes_in(texts, bytes(range(65, 91)))
    return np.stack([np.log1p(n_words) / 10, bytes_in(texts, b"#*$%&|<>") / chars, capitals / chars], axis=1)


def _word_features(vocabulary: pa.Array, index: dict[int, int] | None = None) -> list[tuple[int, ...]]:
    words = pc.utf8_lower(vocabulary).to_pylist()
    if index is None:
        return [feature_keys(w) for w in words]
    return [tuple(index[k] for k in feature_keys(w) if k in index) for w in words]


def _pairs(texts: pa.Array, features: list[tuple[int, ...]], words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of some texts."""
    length = np.array([len(f) for f in features], np.int64)
    flat = np.fromiter((k for f in features for k in f), np.int64, int(length.sum()))
    codes, flat = np.unique(flat, return_inverse=True)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    found = []
    for j in range(int(length.max())):
        has = length[words.ids] > j
        found.append(words.doc[has] * len(codes) + flat[start[words.ids[has]] + j])
    key = np.unique(np.concatenate(found))
    return key // len(codes), codes[key % len(codes)]


def how_telling(rows, cols, y: np.ndarray, n_features: int) -> np.ndarray:
    """Log-ratio of each feature's smoothed shares in the two classes, without its sign, over the largest one."""
    hits = np.bincount(cols, y[rows], minlength=n_features)
    rest = np.bincount(cols, minlength=n_features) - hits
    ratio = np.abs(np.log((hits + 1) / (y.sum() + 2)) - np.log((rest + 1) / (len(y) - y.sum() + 2)))
    return ratio / max(ratio.max(initial=0), 1e-9)


def fit_logistic(
    rows, cols, dense: np.ndarray, y: np.ndarray, n_features: int, l2: float = 0.1, rounds: int = 100, scale: np.ndarray | None = None
) -> np.ndarray:
    """Weights of an L2-regularised logistic regression by L-BFGS: features, dense columns, intercept.

    A feature counts as its `scale` instead of 1 while fitting, so weight on one with a small scale costs more.
    """
    scale = np.ones(n_features) if scale is None else scale
    n, n_dense = dense.shape
    positive = float(y.sum())
    if positive in (0.0, float(n)):
        # One class only: the intercept alone, a probability near that class.
        return np.concatenate([np.zeros(n_features + n_dense), [-8.0 if positive == 0 else 8.0]])

    # Rare classes count as much as common ones; a category's probability is not that of its share.
    mass = np.where(y > 0, n / (2 * positive), n / (2 * (n - positive)))

    def value(w):
        z = np.bincount(rows, (w[:n_features] * scale)[cols], minlength=n) + dense @ w[n_features:-1] + w[-1]
        loss = mass @ (np.logaddexp(0, z) - y * z) + l2 / 2 * (w[:-1] @ w[:-1])
        error = mass * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        slope = np.concatenate([scale * np.bincount(cols, error[rows], minlength=n_features), dense.T @ error, [error.sum()]])
        slope[:-1] += l2 * w[:-1]
        return loss, slope

    w = np.zeros(n_features + n_dense + 1)
    loss, slope = value(w)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, stack = slope.copy(), []
        for s, g in reversed(history):
            a = (s @ direction) / (s @ g)
            direction -= a * g
            stack.append(a)
        if history:
            s, g = history[-1]
            direction *= (s @ g) / (g @ g)
        else:
            direction /= max(1.0, np.linalg.norm(slope))
        for (s, g), a in zip(history, reversed(stack)):
            direction += s * (a - (g @ direction) / (s @ g))
        step = 1.0
        while step > 1e-6:
            after = w - step * direction
            new_loss, new_slope = value(after)
            if new_loss <= loss - 1e-4 * step * (slope @ direction):
                break
            step /= 2
        else:
            break
        change, turn = after - w, new_slope - slope
        if change @ turn > 1e-12:
            history = [*history[-9:], (change, turn)]
        done = loss - new_loss < 1e-6 * max(1.0, abs(loss))
        w, loss, slope = after, new_loss, new_slope
        if done:
            break
    w[:n_features] *= scale
    return w


def predict(weights: np.ndarray, rows, cols, dense: np.ndarray) -> np.ndarray:
    n_dense = dense.shape[1]
    z = np.bincount(rows, weights[cols], minlength=len(dense)) + dense @ weights[-1 - n_dense : -1] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Chain:
    """Fitted chain: text features by hash, and a weight vector and a threshold per category in chain order."""

    categories: tuple[str, ...]
    index: dict[int, int]
    weights: list[np.ndarray]
    thresholds: list[float]

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probabilities (texts x categories) of texts without nulls."""
        words = words_of(texts)
        rows, cols = _pairs(texts, _word_features(words.vocabulary, self.index), words)
        dense = dense_measures(texts, words.counts)
        for weights in self.weights:
            dense = np.column_stack([dense, predict(weights, rows, cols, dense)])
        return dense[:, N_DENSE:]


def best_threshold(probability: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 score: half-way (in log-odds) between the last text taken and
    the first one left; 0.5 where one class has too few texts to tell."""
    if min(y.sum(), len(y) - y.sum()) < MIN_TO_TUNE:
        return 0.5
    odds = np.log(np.clip(probability, 1e-12, 1 - 1e-12)) - np.log1p(-np.clip(probability, 1e-12, 1 - 1e-12))
    order = np.argsort(-odds, kind="stable")
    odds, hits = odds[order], np.cumsum(y[order])
    ends = np.flatnonzero(np.append(odds[1:] < odds[:-1], True))
    at = ends[np.argmax(2 * hits[ends] / (ends + 1 + y.sum()))]
    middle = (odds[at] + (odds[at + 1] if at + 1 < len(odds) else odds[at])) / 2
    return float(1 / (1 + np.exp(-middle)))


def fit_chain(rows, cols, dense: np.ndarray, labels: np.ndarray, fold: np.ndarray, n_features: int):
    """A model and a threshold per column of `labels`. Later models are fitted on out-of-fold
    probabilities of the earlier ones, so they learn how reliable those are on unseen
    texts; the thresholds come from out-of-fold probabilities too. Features are scaled by how telling
    they are in the texts of the fit: many weak ones must not outweigh a single word that settles it."""
    models, thresholds = [], []
    for j in range(labels.shape[1]):
        y = labels[:, j].astype(float)
        models.append(fit_logistic(rows, cols, dense, y, n_features, scale=how_telling(rows, cols, y, n_features)))
        held_out = np.full(len(y), y.mean())
        for k in range(FOLDS):
            train, test = fold != k, fold == k
            if not train.any() or not test.any():
                continue
            at = np.cumsum(train) - 1
            keep = train[rows]
            inner = at[rows[keep]], cols[keep]
            scale = how_telling(*inner, y[train], n_features)
            part = fit_logistic(*inner, dense[train], y[train], n_features, scale=scale)
            held_out[test] = predict(part, rows, cols, dense)[test]
        thresholds.append(best_threshold(held_out, y))
        dense = np.column_stack([dense, held_out])
    return models, thresholds


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], max_labelled: int = MAX_LABELLED) -> Chain:
    """Fits the chain on at most `max_labelled` labelled rows, those with the least hashes of their id.

    Of labels that contradict each other the largest counts (toxic, if any says so); of several
    texts under one id the least by code point is read, so reruns agree.

    Document frequencies of the features are Spark aggregates over that sample; the
    driver receives the `MAX_FEATURES` most telling features and the (row, feature)
    pairs of the sample, both bounded by the parameters.
    """
    spark = docs.sparkSession
    complete = labels.select("doc_id", *categories).dropna().groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories))
    chosen = complete.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    several = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = several.groupBy("doc_id", *categories).agg(F.min("text").alias("text"))
    names = list(categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            words = words_of(texts)
            rows, keys = _pairs(texts, _word_features(words.vocabulary), words)
            offsets = pa.array(np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32))
            dense = dense_measures(texts, words.counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(c) for c in names),
                 pa.ListArray.from_arrays(offsets, pa.array(keys)), *(pa.array(dense[:, i]) for i in range(N_DENSE))],
                ["doc_id", *names, "keys", *(f"d{i}" for i in range(N_DENSE))],
            )

    kinds = {f.name: f.dataType.simpleString() for f in sample.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, " + "".join(f"{c} {kinds[c]}, " for c in names) + "keys array<bigint>"
    schema += "".join(f", d{i} double" for i in range(N_DENSE))
    rows = stored(sample.select("doc_id", *names, "text").mapInArrow(run, schema), "toxicity-sample")
    long = rows.select("doc_id", *names, F.explode("keys").alias("key"))
    totals = rows.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names)).first()
    if not totals["n"]:
        return Chain(categories, {}, [np.concatenate([np.zeros(N_DENSE + j), [-8.0]]) for j in range(len(names))], [0.5] * len(names))
    counts = long.groupBy("key").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names))
    gaps = [
        F.abs(F.col(c) / max(totals[c], 1) - (F.col("n") - F.col(c)) / max(totals["n"] - totals[c], 1)) for c in names
    ]
    best = counts.where(F.col("n") >= MIN_DOCS).withColumn("gap", F.greatest(F.lit(0.0), *gaps))
    best = best.orderBy(F.desc("gap"), "key").select("key").limit(MAX_FEATURES)
    index = {r["key"]: i for i, r in enumerate(best.collect())}
    lookup = spark.createDataFrame(list(index.items()), "key bigint, col bigint")
    head = rows.select("doc_id", *names, *(f"d{i}" for i in range(N_DENSE))).orderBy("doc_id").toArrow()
    place = {d: i for i, d in enumerate(head.column("doc_id").to_pylist())}
    pairs = long.join(F.broadcast(lookup), "key").select("doc_id", "col").orderBy("doc_id", "col").toArrow()
    at = np.array([place[d] for d in pairs.column("doc_id").to_pylist()], np.int64)
    dense = np.stack([head.column(f"d{i}").to_numpy() for i in range(N_DENSE)], axis=1)
    y = np.stack([head.column(c).to_numpy() for c in names], axis=1)
    fold = np.array([xxhash.xxh3_64_intdigest(str(d)) % FOLDS for d in place])
    return Chain(categories, index, *fit_chain(at, pairs.column("col").to_numpy(), dense, y, fold, len(index)))


def score_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """Adds `p_<category>` to every document.

    Scale: one narrow pass; the model (a few thousand weights) travels with the task.
    Null and empty texts are scored as texts without words, whole texts of any length
    are read, equal rows score alike, and other columns stay (those named like a result are replaced).
    """
    results = [f"p_{c}" for c in chain.categories]
    base = docs.drop(*results)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = chain.score(pc.fill_null(batch.column("text"), ""))
            columns = [*batch.columns, *(pa.array(found[:, j].astype(float)) for j in range(len(results)))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *results])

    extra = ", ".join(f"`{r}` double" for r in results)
    return base.mapInArrow(run, with_columns(base, extra))


CATEGORIES = ("low_quality", "toxic", "toxic_low_quality")


def category_labels(labels: DataFrame) -> DataFrame:
    """The categories of the chain, from two labels: poor text, toxic text, and both at once."""
    low = 1 - F.col("quality")
    return labels.select("doc_id", low.alias("low_quality"), F.col("toxic"), (low * F.col("toxic")).alias("toxic_low_quality"))


def judge_toxicity(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """Adds `p_low_quality, p_toxic, p_toxic_low_quality` and `toxic`: whether `p_toxic`
    reaches `threshold`, which defaults to the best one on held-out labelled texts."""
    chain = train(docs, category_labels(labels), CATEGORIES)
    limit = chain.thresholds[CATEGORIES.index("toxic")] if threshold is None else threshold
    return score_toxicity(docs.drop("toxic"), chain).withColumn("toxic", F.col("p_toxic") >= limit)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """The documents that `judge_toxicity` does not find toxic, with all their columns."""
    chain = train(docs, category_labels(labels), CATEGORIES)
    column = CATEGORIES.index("toxic")
    limit = chain.thresholds[column] if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = chain.score(pc.fill_null(batch.column("text"), ""))
            yield batch.filter(pa.array(found[:, column] < limit))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return judge_toxicity(docs, table(spark, folder, "labels")).drop("text")
