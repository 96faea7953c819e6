"""Toxicity by a classifier chain over sparse word features.

Each category's logistic model sees the words and the probabilities of the categories before
it; while training those are out-of-fold predictions, so a later model learns how far an
earlier one can be trusted on texts it has not seen.  Models are fitted on a bounded sample
of labelled documents; every document is scored on its whole text in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoreel.llm._io import Scratch, free_name, read_table
from chronoreel.llm._linear import Example, fit_binary, labelled_sample
from chronoreel.llm._text import NOT_ALPHA, Words, buffers, chunks, mix64, tidied

#: Sampled documents that must hold a feature before it gets a weight.
LEAST_DOCUMENTS = 5
#: Bytes of the word beginnings that are features besides the whole word: inflected forms share them.
STEMS = (4, 5, 6)
#: Labelled documents of each label that training sees.
SAMPLE_PER_LABEL = 3000
FOLDS = 5
EPOCHS = 3


def word_features(words: Words) -> np.ndarray:
    """A row of 64-bit feature hashes for each word: itself and its beginnings (0 where it is shorter)."""
    out = np.zeros((len(words.hash), 1 + len(STEMS)), dtype=np.uint64)
    out[:, 0] = words.hash
    for k, size in enumerate(STEMS, 1):
        at = np.flatnonzero(words.length >= size)
        h = np.full(len(at), size, dtype=np.uint64)
        for j in range(size):
            h = mix64(h * np.uint64(0x100000001B3) + words.text[words.start[at] + j])
        out[at, k] = h
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Chain:
    """Categories in order, the features with a weight (sorted hashes), their weights, the weights of
    earlier categories' probabilities, and the biases."""

    categories: tuple[str, ...]
    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray
    thresholds: tuple[float, ...]

    def probabilities(self, base: np.ndarray) -> np.ndarray:
        """From the sums of word weights (texts x categories): each category in turn."""
        p = np.zeros_like(base)
        for k in range(base.shape[1]):
            p[:, k] = _sigmoid(base[:, k] + self.bias[k] + p[:, :k] @ self.earlier[k, :k])
        return p


def _features(column: pa.Array) -> Iterator[tuple[int, Words, np.ndarray]]:
    data, offsets = buffers(column)
    for i, j in chunks(offsets):
        words = Words(data, offsets[i : j + 1], NOT_ALPHA)
        yield i, words, word_features(words)


def _distinct(docs: DataFrame, text: str, found, name: str, kind: str) -> DataFrame:
    """``docs`` with ``found(distinct feature hashes of a text)`` in the place of the text."""
    others = [c for c in docs.columns if c != text]

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, words, features in _features(batch.column(0)):
                for a, z in zip(words.first[:-1], words.first[1:], strict=True):
                    u = np.unique(features[a:z])
                    out.append(found(u[u != 0]))
            held = pa.list_(pa.int64()) if kind == "array<long>" else pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(out, held), *batch.columns[1:]], [name, *others])

    schema = T.StructType([T.StructField(name, T._parse_datatype_string(kind)), *(docs.schema[c] for c in others)])
    return docs.select(text, *others).mapInArrow(work, schema)


def _vocabulary(sample: DataFrame, text: str) -> np.ndarray:
    """Sorted hashes of features that at least LEAST_DOCUMENTS documents of the sample hold."""
    held = _distinct(sample.select(text), text, lambda u: u.view(np.int64), "features", "array<long>")
    counts = held.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") >= LEAST_DOCUMENTS).select("feature").toArrow()
    return np.sort(found.column("feature").to_numpy().view(np.uint64))


def _sample(sample: DataFrame, text: str, labels: tuple[str, ...], vocabulary: np.ndarray) -> list:
    """Rows (draw, at, labels): the places in the vocabulary of each sampled document's features, as 32-bit numbers."""
    shared = sample.sparkSession.sparkContext.broadcast(vocabulary)

    def places(u: np.ndarray) -> bytes:
        known = shared.value
        if not len(known):
            return b""
        at = np.minimum(np.searchsorted(known, u), len(known) - 1)
        return at[known[at] == u].astype(np.int32).tobytes()

    rows = sample.select(F.col(text), F.xxhash64(text).alias("draw"), F.array(*(F.col(c).cast("int") for c in labels)).alias("labels"))
    return _distinct(rows, text, places, "at", "binary").collect()


def _fits(spark: SparkSession, words: list[np.ndarray], earlier: np.ndarray, ys: np.ndarray, fold: np.ndarray, features: int) -> list[np.ndarray]:
    """Weights of a category's models: one that leaves out each fold, and one of all documents; a task each.  The sample
    is broadcast, and its size is bounded by ``per_label``."""
    shared = spark.sparkContext.broadcast((words, earlier, ys, fold))

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.column(0).to_pylist():
                words, earlier, ys, fold = shared.value
                width = earlier.shape[1]
                own = np.arange(features, features + width)
                inside = np.flatnonzero(fold != f)
                xs: list[Example] = [(np.append(words[i], own).astype(np.int64), np.append(np.ones(len(words[i])), earlier[i])) for i in inside]
                w = fit_binary(xs, ys[inside].tolist(), features + width, alpha=0.6, l1=1.0, l2=0.25, epochs=EPOCHS)
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([w.tobytes()], pa.binary())], ["fold", "w"])

    rows = spark.range(FOLDS + 1).repartition(FOLDS + 1, "id").mapInArrow(work, "fold long, w binary").collect()
    shared.unpersist()
    return [np.frombuffer(r.w) for r in sorted(rows, key=lambda r: r.fold)]


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The least probability, one half or more, with the best F1 on out-of-fold predictions."""
    best, at = -1.0, 0.5
    for t in np.linspace(0.5, 0.99, 50):
        hit = p >= t
        f1 = 2 * (hit & (y == 1)).sum() / max(1, hit.sum() + (y == 1).sum())
        if f1 > best + 1e-9:
            best, at = f1, float(t)
    return at


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], text: str = "text", key: str = "doc_id", per_label: int = SAMPLE_PER_LABEL) -> Chain | None:
    """A chain over 0/1 label columns in the given order, from about ``per_label`` documents with and as many
    without the last label.  Documents that lack one of the labels are left out.  None if there is no labelled text or
    the last label has one value only."""
    for c in categories:
        labels = labels.where(F.col(c).isNotNull())
    sample = Scratch(docs.sparkSession, "toxicity").save(labelled_sample(docs, labels, categories[-1], per_label, key, text), "sample")
    features = _vocabulary(sample, text)
    rows = sorted(_sample(sample, text, categories, features), key=lambda r: (r.draw, r.labels))
    if len({r.labels[-1] for r in rows}) < 2:
        return None
    labels = np.array([r.labels for r in rows])
    words = [np.frombuffer(r.at, dtype=np.int32) for r in rows]
    n = len(features)
    fold = np.array([r.draw % FOLDS for r in rows])
    k = len(categories)
    weights, before, bias = np.zeros((n, k)), np.zeros((k, k)), np.zeros(k)
    earlier = np.zeros((len(rows), 0))
    thresholds = []
    for c in range(k):
        models = _fits(docs.sparkSession, words, earlier, labels[:, c], fold, n)
        unseen = np.array([models[f][at].sum() + e @ models[f][n:-1] + models[f][-1] for at, e, f in zip(words, earlier, fold.tolist(), strict=True)])
        w = models[FOLDS]
        weights[:, c], before[c, :c], bias[c] = w[:n], w[n:-1], w[-1]
        thresholds.append(_threshold(_sigmoid(unseen), labels[:, c]))
        earlier = np.column_stack([earlier, _sigmoid(unseen)])
    used = np.any(weights != 0, axis=1)
    return Chain(categories, features[used], weights[used], before, bias, tuple(thresholds))


def score(docs: DataFrame, chain: Chain | None, categories: tuple[str, ...], text: str = "text", prefix: str = "p_", flag: str = "toxic") -> DataFrame:
    """``docs`` with a probability for each category and ``flag``: the last one's reaches its threshold.

    Texts that are null or without words have no word weights and get the chain's prior; without a chain all
    probabilities are 0 and nothing is flagged.  Equal texts get equal results; other columns pass through, and those
    named like the results are replaced.
    """
    docs = docs.drop(*(c for c in (flag, *(f"{prefix}{c}" for c in categories)) if c != text))
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    extra = [T.StructField(f"{prefix}{c}", T.DoubleType()) for c in categories]
    schema = T.StructType([*docs.schema.fields, *extra, T.StructField(flag, T.BooleanType())])

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        maybe = np.zeros(1 << 16, dtype=bool)
        if chain is not None:
            maybe[chain.features & np.uint64(0xFFFF)] = True
        for batch in batches:
            p = np.zeros((batch.num_rows, len(categories)))
            hit = np.zeros(batch.num_rows, dtype=bool)
            if chain is not None and len(chain.features):
                for i, words, features in _features(batch.column(names.index(text))):
                    row, col = np.nonzero(maybe[features & np.uint64(0xFFFF)])
                    at = np.searchsorted(chain.features, features[row, col])
                    at[at == len(chain.features)] = 0
                    sure = chain.features[at] == features[row, col]
                    owner = np.searchsorted(words.first, row[sure], side="right") - 1
                    pairs = np.unique(owner * len(chain.features) + at[sure])
                    base = np.zeros((words.n, len(categories)))
                    np.add.at(base, pairs // len(chain.features), chain.weights[pairs % len(chain.features)])
                    p[i : i + words.n] = chain.probabilities(base)
                hit = p[:, -1] >= chain.thresholds[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, c]) for c in range(len(categories))), pa.array(hit)], [*names, *(f"{prefix}{c}" for c in categories), flag])

    return docs.mapInArrow(work, schema)


#: The labels name one kind of toxicity; junk comes first in the chain, as its texts look unlike prose.
CATEGORIES = ("junk", "toxic")


def category_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, junk, toxic).  A document labelled more than once takes the larger of each."""
    return labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("junk"), F.max("toxic").alias("toxic"))


def classify(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """``docs`` with p_junk, p_toxic and toxic; trained on ``training`` (default: ``docs``) and ``labels``."""
    chain = train(docs if training is None else training, category_labels(labels), CATEGORIES)
    return score(docs, chain, CATEGORIES)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that the chain does not call toxic; columns stay as they are."""
    chain = train(docs, category_labels(labels), CATEGORIES)
    prefix, flag = "__p_", free_name("__toxic", *docs.columns)
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return score(docs, chain, CATEGORIES, prefix=prefix, flag=flag).where(~F.col(flag)).select(*docs.columns)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's category probabilities and verdict."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, read_table(spark, sf_dir, "labels")).drop("text")
