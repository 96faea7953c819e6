"""Sparse linear models for bounded samples: follow-the-regularised-leader with elastic net."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (feature numbers, values) of one example
Example = tuple[np.ndarray, np.ndarray]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal multinomial logistic regression with per-coordinate rates."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features + 1, classes))
        self.n = np.zeros((features + 1, classes))
        self.bias = features

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, x: Example, y: int) -> None:
        at = np.append(x[0], self.bias)
        values = np.append(x[1], 1.0)
        w = self._weights(at)
        p = softmax(values @ w)
        p[y] -= 1.0
        g = np.outer(values, p)
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g

    def fit(self, xs: list[Example], ys: list[int], epochs: int, seed: int = 7) -> Ftrl:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(xs)).tolist():
                self.learn(xs[i], ys[i])
        return self

    def weights(self) -> np.ndarray:
        """(features + 1, classes); the last row is the bias."""
        return self._weights(np.arange(len(self.z)))


def fit_binary(xs: list[Example], ys: list[int], features: int, alpha: float, l1: float, l2: float, epochs: int, beta: float = 1.0, seed: int = 7) -> np.ndarray:
    """Weights (features + 1, the last one the bias) of a two-class model by the same rule."""
    z, n = np.zeros(features + 1), np.zeros(features + 1)
    xs = [(np.append(at, features), np.append(values, 1.0)) for at, values in xs]

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(xs)).tolist():
            at, values = xs[i]
            seen, before = n[at], z[at]
            w = weights(before, seen)
            g = (1 / (1 + np.exp(-min(max(float(values @ w), -40.0), 40.0))) - ys[i]) * values
            after = seen + g * g
            z[at] = before + g - (np.sqrt(after) - np.sqrt(seen)) / alpha * w
            n[at] = after
    return weights(z, n)


def logits(weights: np.ndarray, x: Example) -> np.ndarray:
    return x[1] @ weights[x[0]] + weights[-1]


def fit_temperature(scores: np.ndarray, ys: np.ndarray) -> float:
    """The temperature with the least log loss on held-back examples, by golden section."""
    if not len(ys):
        return 1.0

    def loss(log_t: float) -> float:
        return float(-np.log(np.maximum(softmax(scores / np.exp(log_t))[np.arange(len(ys)), ys], 1e-12)).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def bounded_sample(df: DataFrame, label: str, per_label: int, *keys: str) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of ``keys``: the same rows whatever
    the partitioning, without a sort or a shuffle of the rows."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect() if r[label] is not None}
    if not counts:
        return df.limit(0)
    chosen = F.lit(False)
    draw = F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 30))
    for value, n in counts.items():
        chosen = chosen | ((F.col(label) == F.lit(value)) & (draw < F.lit(int(min(1.0, per_label / n) * (1 << 30)))))
    return df.where(chosen)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, key: str, text: str) -> DataFrame:
    """Texts of about ``per_label`` labelled documents of each ``label``, with the label columns.  ``labels`` has a row
    a key.  Labels are drawn first, so what is broadcast to find the texts is bounded by ``per_label``."""
    drawn = bounded_sample(labels.where(F.col(label).isNotNull()), label, per_label, key)
    texts = docs.select(F.col(key), F.col(text)).where(F.col(text).isNotNull())
    return texts.join(F.broadcast(drawn), key)
