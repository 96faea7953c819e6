"""Quality by hierarchical empirical Bayes.

A logistic model gives each document's evidence: it reads the form of a text (character
classes, repetition, word shape) and its words, as the out-of-fold score of a sparse model of
hashed words.  Grouped sums of it give every host and every path a
beta-binomial posterior: a host is shrunk toward the global rate, a path toward its host,
with strengths fitted by the method of moments from all groups.  A document's posterior
joins its own evidence with the rate of its path, from which it is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoreel.llm._io import Scratch, read_table
from chronoreel.llm._linear import Example, fit_binary, labelled_sample, logits
from chronoreel.llm._text import SPACES, Words, buffers, chunks, tidied

SAMPLE_PER_LABEL = 4000
#: Words are numbered by the upper bits of their hash.
WORD_BITS = 16
#: Shares of a text's words are multiplied by this, so that a typical text's sum is near one.
SCALE = 20.0
FOLDS, EPOCHS = 3, 2
#: Bounds of a prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e4
#: Documents whose posterior is at least this are kept.
KEEP = 0.5

_CLASSES = ("upper", "lower", "digit", "space", "stop", "bar", "symbol", "other")


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other"))
    for c in range(128):
        x = chr(c)
        kind = "upper" if x.isupper() else "lower" if x.islower() else "digit" if x.isdigit() else "space" if x.isspace() else "stop" if x in ".,;:'\"?()-" else "bar" if x in "|<>{}[]=/\\" else "symbol"
        table[c] = _CLASSES.index(kind)
    return table


_TABLE = _class_table()
FEATURES = (*_CLASSES, "log words", "word length", "distinct words", "repeated words", "log line words", "one-byte words")


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """A few texts at a time: a row of FEATURES for each, zeros for texts without words, and their words' numbers."""
    data, offsets = buffers(column)
    c = len(_CLASSES)
    for i, j in chunks(offsets):
        out = np.zeros((j - i, len(FEATURES)))
        part = data[int(offsets[i]) : int(offsets[j])]
        sizes = np.diff(offsets[i : j + 1])
        owner = np.repeat(np.arange(j - i), sizes)
        counts = np.bincount(owner * c + _TABLE[part], minlength=(j - i) * c).reshape(-1, c)
        lines = np.bincount(owner[part == 10], minlength=j - i)
        words = Words(data, offsets[i : j + 1], SPACES)
        same = np.append(False, words.hash[1:] == words.hash[:-1]) if len(words.hash) else np.zeros(0, bool)
        for k in np.flatnonzero(np.diff(words.first)).tolist():
            a, z = words.first[k], words.first[k + 1]
            n, row = z - a, out[k]
            row[:c] = counts[k] / sizes[k]
            row[c] = np.log1p(n)
            row[c + 1] = words.length[a:z].mean()
            row[c + 2] = len(np.unique(words.hash[a:z])) / n
            row[c + 3] = same[a + 1 : z].sum() / n
            row[c + 4] = np.log1p(n / (1 + lines[k]))
            row[c + 5] = (words.length[a:z] == 1).sum() / n
        numbers = (words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        yield out, [numbers[a:z] for a, z in zip(words.first[:-1], words.first[1:], strict=True)]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: by word number, and the bias as the last one
    words: np.ndarray
    #: share of good documents in training
    prior: float

    def probability(self, form: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        scores = np.array([word_score(self.words, x) for x in words]).reshape(-1, 1)
        z = np.clip((np.hstack([form, scores]) - self.mean) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-np.clip(expand(z) @ self.weights, -12, 12)))


def word_score(weights: np.ndarray, words: np.ndarray) -> float:
    """The sparse model's log odds for a text of these words."""
    return float(weights[-1] + (SCALE * weights[words].mean() if len(words) else 0.0))


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, their squares (both tails of a feature can be junk) and one."""
    return np.column_stack([z, z * z, np.ones(len(z))])


def fit_words(examples: list[Example], y: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the sparse model (FTRL, elastic net) from all texts, and each text's score by the model of the other folds."""

    def fit(inside: np.ndarray) -> np.ndarray:
        return fit_binary([examples[i] for i in inside], y[inside].tolist(), 1 << WORD_BITS, alpha=1.0, l1=0.02, l2=0.02, epochs=EPOCHS)

    unseen = np.zeros(len(y))
    for f in np.unique(fold):
        model = fit(np.flatnonzero(fold != f))
        for i in np.flatnonzero(fold == f):
            unseen[i] = logits(model, examples[i])
    return fit(np.arange(len(y))), unseen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the features and weights of a ridge logistic regression, by Newton steps."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    d = expand(np.clip((x - mean) / scale, -6, 6))
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        h = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, d.T @ (p - y) + ridge * w)
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", per_label: int = SAMPLE_PER_LABEL) -> QualityModel | None:
    """From about ``per_label`` documents of each 0/1 label; their shares in training are the model's prior.
    Folds go by the text, so copies share one.  None where only one label occurs."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, words = [], []
            for some, numbers in features(batch.column(0)):
                form += list(some)
                words += [np.unique(x, return_counts=True) for x in numbers]
            packed = [pa.array([x[side].astype(np.int32).tobytes() for x in words], pa.binary()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(form, pa.list_(pa.float64())), *packed], ["draw", "y", "form", "words", "counts"])

    known = labels.select(key, F.col(label).cast("int").alias(label))
    chosen = labelled_sample(docs, known, label, per_label, key, text).select(text, F.xxhash64(text), label)
    rows = sorted(chosen.mapInArrow(work, "draw long, y int, form array<double>, words binary, counts binary").collect(), key=lambda r: (r.draw, r.y))
    y = np.array([r.y for r in rows], dtype=float)
    if len(set(y)) < 2:
        return None
    examples: list[Example] = []
    for r in rows:
        n = np.frombuffer(r.counts, dtype=np.int32)
        examples.append((np.frombuffer(r.words, dtype=np.int32).astype(np.int64), SCALE * n / max(1, n.sum())))
    weights, unseen = fit_words(examples, y, np.array([r.draw % FOLDS for r in rows]))
    return QualityModel(*fit_logistic(np.column_stack([np.array([r.form for r in rows]), unseen]), y), weights, float(y.mean()))


def evidence(docs: DataFrame, model: QualityModel | None, text: str = "text", name: str = "p_doc") -> DataFrame:
    """``docs`` with the document classifier's probability; one half where there is no text, word or model."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            p = np.full(batch.num_rows, 0.5)
            if model is not None:
                at = 0
                for form, words in features(batch.column(names.index(text))):
                    p[at : at + len(form)] = np.where(form.any(axis=1), model.probability(form, words), 0.5)
                    at += len(form)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*names, name])

    return docs.mapInArrow(work, schema)


def _strength(groups: DataFrame, n: Column, total: Column, toward: Column) -> float:
    """Documents that a prior counts for: from the spread of groups' means around ``toward`` beyond what
    sampling explains, over all groups."""
    spread = n * F.pow(total / n - toward, 2)
    r = groups.agg(F.sum(spread).alias("s"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("g"), F.sum(n * toward * (1 - toward)).alias("v")).first()
    if not r.g or r.g < 2 or not r.v:
        return MOST_STRENGTH
    sampling = r.v / r.n
    between = max(0.0, (r.s - r.g * sampling) / r.n)
    return float(np.clip(sampling / between - 1 if between > 0 else MOST_STRENGTH, LEAST_STRENGTH, MOST_STRENGTH))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def posterior(scored: DataFrame, prior: float, host: str = "host", path: str = "path", p: str = "p_doc") -> DataFrame:
    """``scored`` with host_rate, path_rate, quality and keep.

    ``scored`` must be cheap to read again (a written table).  Sums are taken per (host, path) before any shuffle
    of documents and joined back; a host with a third of all documents is split by the join's skew handling.
    Null hosts and paths form groups of their own.
    """
    spark = scored.sparkSession
    scratch = Scratch(spark, "sites")
    by_path = scratch.save(scored.groupBy(host, path).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s")), "paths")
    hosts = by_path.groupBy(host).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    rate = (total.s / total.n) if total.n else prior
    k_host = _strength(hosts, F.col("hn"), F.col("hs"), F.lit(rate))
    hosts = hosts.withColumn("host_rate", (F.col("hs") + F.lit(k_host * rate)) / (F.col("hn") + F.lit(k_host)))
    sites = by_path.join(hosts.withColumnRenamed(host, "h"), F.col(host).eqNullSafe(F.col("h")))
    k_path = _strength(sites, F.col("n"), F.col("s"), F.col("host_rate"))
    sites = scratch.save(sites.select(F.col(host).alias("h"), F.col(path).alias("q"), "n", "s", "host_rate"), "sites")
    out = scored.join(sites, F.col(host).eqNullSafe(F.col("h")) & F.col(path).eqNullSafe(F.col("q")))
    others = (F.col("s") - F.col(p) + F.lit(k_path) * F.col("host_rate")) / (F.col("n") - 1 + F.lit(k_path))
    out = out.withColumn("path_rate", F.least(F.greatest(others, F.lit(0.0)), F.lit(1.0)))
    logit = _logit(F.col(p)) + _logit(F.col("path_rate")) - _logit(F.lit(prior))
    return out.withColumn("quality", 1 / (1 + F.exp(-logit))).withColumn("keep", F.col("quality") >= F.lit(KEEP)).drop("h", "q", "n", "s")


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, host, path, p_doc, host_rate, path_rate, quality, keep) of every row of ``docs``.

    A document labelled more than once takes its larger label.  Null and empty texts have even evidence, so their
    site decides; without labels of both kinds all evidence is even.  Only the named columns are read.
    """
    one = labels.groupBy(key).agg(F.max("quality").alias("quality"))
    model = train(docs, one, text, "quality", key)
    cols = docs.select(F.col(key), F.col(host).cast("string").alias("host"), F.concat_ws("/", F.col(host).cast("string"), F.col(path).cast("string")).alias("path"), F.col(text).alias("__text"))
    scored = Scratch(docs.sparkSession, "evidence").save(evidence(cols, model, "__text").drop("__text"), "scored")
    return posterior(scored, model.prior if model else 0.5)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's evidence, site rates, posterior and verdict; a source is the host, source and language the path."""
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
