"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover every training document; the regression (FTRL, elastic net) is
fitted on a bounded sample of them and calibrated by one temperature on a part held back.
Scoring is one pass over whole texts, vectorised over a batch's characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoreel.llm._io import free_name
from chronoreel.llm._linear import Example, Ftrl, bounded_sample, fit_temperature, logits, softmax
from chronoreel.llm._text import chunks, tidied

FEATURES = 1 << 15
ORDERS = (1, 2, 3)
#: Training documents per language that the regression sees.
SAMPLE_PER_LANGUAGE = 1000
EPOCHS = 3
#: Characters whose n-grams are made together, or one longer text.
CHARACTERS = 1 << 16
#: Typical sums of TF-IDF values are brought near one.
SCALE = 20.0
UNDETERMINED = "und"
_K = np.uint64(0x9E3779B97F4A7C15)


@cache
def _folded() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    table = np.full(0x110000, 32, dtype=np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _grams(text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, whether an n-gram that begins there holds a letter, feature numbers) of each order."""
    chars = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    letter = chars != 32
    value = np.zeros(len(chars), dtype=np.uint64)
    has = np.zeros(len(chars), dtype=bool)
    for n in range(1, max(ORDERS) + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        value = value[:m] * _K + chars[n - 1 :]
        has = has[:m] | letter[n - 1 :]
        if n in ORDERS:
            yield n, has, ((value + np.uint64(n)) * _K >> np.uint64(64 - 15)).astype(np.int32)


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams that hold a letter, by text, and where each text's begin (n + 1 bounds).
    A text counts as if a space stood before and after it."""
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t or "") + 2 for t in texts])
    features, owners = [], []
    for n, has, feature in _grams("".join(f" {t or ''} " for t in texts)):
        at = np.flatnonzero(has & (text_of[: len(has)] == text_of[n - 1 :]))
        features.append(feature[at])
        owners.append(text_of[at])
    owner, feature = np.concatenate(owners), np.concatenate(features)
    order = np.argsort(owner, kind="stable")
    return feature[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


def long_counts(text: str) -> np.ndarray:
    """How often each feature occurs in one text: pieces of CHARACTERS are counted one by one, each with as many
    characters behind it as an n-gram that begins in it needs."""
    counts, whole = np.zeros(FEATURES, dtype=np.int64), len(text) + 2
    for a in range(0, whole, CHARACTERS):
        end = a + CHARACTERS + max(ORDERS) - 1
        piece = f"{' ' if a == 0 else ''}{text[max(0, a - 1) : end - 1]}{' ' if end >= whole else ''}"
        for _, has, feature in _grams(piece):
            counts += np.bincount(feature[:CHARACTERS][has[:CHARACTERS]], minlength=FEATURES)
    return counts


def _by_text(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(first row, end row, features, bounds, counts) in chunks of bounded size; a text longer than a chunk comes alone,
    with its distinct features and their counts (None otherwise)."""
    for first in range(0, len(column), 256):
        texts = column.slice(first, 256).to_pylist()
        at = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])])
        for i, j in chunks(at, CHARACTERS):
            if at[j] - at[i] <= CHARACTERS:
                yield first + i, first + j, *ngrams(texts[i:j]), None
                continue
            counts = long_counts(texts[i])
            features = np.flatnonzero(counts)
            yield first + i, first + j, features, np.array([0, len(features)]), counts[features]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: IDF times weight by feature and language, and the bias as the last row
    weights: np.ndarray
    temperature: float

    def scores(self, features: np.ndarray, bounds: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """Calibrated probabilities of each text with n-grams; zeros for those without.  With counts, of one text."""
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(bounds))
        if len(full) and counts is not None:
            mean = SCALE * (counts @ self.weights[features].astype(np.float64)) / counts.sum() + self.weights[-1]
            out[0] = softmax(mean[None, :] / self.temperature)[0]
        elif len(full):
            sums = np.stack([np.add.reduceat(self.weights[features, k], bounds[full]) for k in range(len(self.languages))], axis=1)
            mean = SCALE * sums / np.diff(bounds)[full][:, None] + self.weights[-1]
            out[full] = softmax(mean.astype(np.float64) / self.temperature)
        return out


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, over all rows: FEATURES counts from each task, summed."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, rows = np.zeros(FEATURES, dtype=np.int64), np.zeros(FEATURES, dtype=bool), 0
        for batch in batches:
            for i, j, features, bounds, _ in _by_text(batch.column(0)):
                rows += j - i
                for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                    seen[features[a:z]] = True
                    held += seen
                    seen[features[a:z]] = False
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(held[at], rows), pa.int64())], ["feature", "n"])

    found = docs.select(text).mapInArrow(work, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(FEATURES)
    for r in found:
        if r.feature >= 0:
            counts[r.feature] = r.n
    return counts, next((r.n for r in found if r.feature < 0), 0)


def _sample_features(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, draw, features, counts) of sampled documents, counted where they are, as 32-bit numbers."""

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, features, bounds, counts in _by_text(batch.column(2)):
                found += [(features, counts)] if counts is not None else [np.unique(features[a:z], return_counts=True) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
            packed = [pa.array([x[side].astype(np.int32).tobytes() for x in found], pa.binary()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["lang", "draw", "features", "counts"])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("draw"), F.col(text))
    return rows.mapInArrow(work, "lang string, draw long, features binary, counts binary")


def train(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """A model of ``docs``' languages from texts and non-null labels alone; None if no text has a letter.

    Document frequencies are those of all labelled documents.  The regression sees about ``per_language``
    documents of each language at most, chosen by a hash of the text, copies once; a fifth of them only sets the temperature.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang)
    counts, total = document_frequencies(known, text)
    idf = np.log((1 + total) / (1 + counts)) + 0.1
    rows = _sample_features(bounded_sample(known, lang, per_language, text).dropDuplicates([text, lang]), text, lang).collect()
    rows = sorted((r for r in rows if r.features), key=lambda r: (r.draw, r.lang))
    languages = tuple(sorted({r.lang for r in rows}))
    if not languages:
        return None
    examples: list[Example] = []
    for r in rows:
        at, n = np.frombuffer(r.features, dtype=np.int32).astype(np.int64), np.frombuffer(r.counts, dtype=np.int32).astype(float)
        examples.append((at, SCALE * idf[at] * n / n.sum()))
    labels = [languages.index(r.lang) for r in rows]
    held = [i for i, r in enumerate(rows) if r.draw % 5 == 0]
    fitted = [i for i, r in enumerate(rows) if r.draw % 5] or held
    model = Ftrl(FEATURES, len(languages), alpha=1.0, l1=0.02, l2=0.02).fit([examples[i] for i in fitted], [labels[i] for i in fitted], EPOCHS)
    weights = model.weights()
    scores = np.array([logits(weights, examples[i]) for i in held]).reshape(-1, len(languages))
    temperature = fit_temperature(scores, np.array([labels[i] for i in held], dtype=int))
    return LanguageModel(languages, np.vstack([weights[:-1] * idf[:, None], weights[-1:]]).astype(np.float32), temperature)


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability (0 to 1).

    A text that is null or has no letter is ``und`` with score 0, as is every text if there is no model.  Equal
    texts get equal results; ties go to the first language in order.  Other columns pass through; those named like the
    two results are replaced.
    """
    docs = docs.drop(*(c for c in (pred, score) if c != text))
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            labels, best = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            if model is not None:
                for i, j, features, bounds, counts in _by_text(batch.column(names.index(text))):
                    p = model.scores(features, bounds, counts)
                    best[i:j] = p.max(axis=1)
                    for k in np.flatnonzero(np.diff(bounds)).tolist():
                        labels[i + k] = model.languages[int(p[k].argmax())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(best)], [*names, pred, score])

    return docs.mapInArrow(work, schema)


#: A text whose best language has gone less than this share of the way from chance to certainty is in no learned
#: language: 0.35 of 1 with four languages, 0.57 with two, 0.14 with a hundred.
LEAST_SHARE = 2 / 15


def least_score(model: LanguageModel) -> float:
    chance = 1 / len(model.languages)
    return chance + LEAST_SHARE * (1 - chance)


def keep_known(docs: DataFrame, model: LanguageModel | None, text: str = "text", least: float | None = None) -> DataFrame:
    """``docs`` whose texts have letters and a language with probability ``least`` (default: ``least_score``) or more;
    without a model nothing can be told and all rows stay.  Columns stay as they are."""
    if model is None:
        return docs
    least = least_score(model) if least is None else least
    pred, score = free_name("__lang_pred", *docs.columns), free_name("__lang_score", *docs.columns)
    judged = identify(docs, model, text, pred, score)
    return judged.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= least)).select(*docs.columns)


def held_out(key) -> F.Column:
    """The fold that training never sees: crc32 of the key as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4 == 2


def op1_language_id(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Contract columns for ``documents``."""
    model = train(documents.where(~held_out(F.col("doc_id"))))
    out = identify(documents.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
