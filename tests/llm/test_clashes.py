"""Stages keep columns that are named like their own private ones."""

import numpy as np
import pytest
from conftest_llm import prose
from pyspark.sql import functions as F

from chronoreel.llm import decontam, langid, minhash, toxicity

PRIVATE = ("__lang_pred", "__LANG_SCORE", "__toxic", "__toxic_", "__p_junk", "__P_toxic", "__found", "__row_name", "__Row_Name_")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i, 60), "en" if i % 2 else "de") for i in range(40)] + [(3, prose(3, 60), "en"), (3, prose(99, 50), "en"), (None, prose(98, 50), "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for i, name in enumerate(PRIVATE):
        df = df.withColumn(name, F.concat(F.lit(f"{i}:"), F.col("text")))
    return df.cache()


def kept_columns(docs, out):
    assert out.dtypes == docs.dtypes
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[name].split(":")[0] == str(i) for i, name in enumerate(PRIVATE))
    return rows


def test_four_stages(spark, docs):
    kept_columns(docs, langid.keep_known(docs, langid.train(docs), least=0.0))
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    kept_columns(docs, toxicity.keep_clean(docs, labels))
    items = spark.createDataFrame([("a", prose(7, 60))], "item_id string, text string")
    assert not any(r.doc_id == 7 for r in kept_columns(docs, decontam.clean(docs, items)))
    rows = kept_columns(docs, minhash.deduplicate(docs))
    assert len(rows) == 42


def test_long_texts_are_counted_in_pieces(monkeypatch):
    """A text beyond a chunk has the n-grams that it has as a whole."""
    text = prose(5, 3000) + "é日" + prose(6, 20)
    whole, bounds = langid.ngrams([text])
    assert bounds.tolist() == [0, len(whole)]
    monkeypatch.setattr(langid, "CHARACTERS", 100)
    assert (langid.long_counts(text) == np.bincount(whole, minlength=langid.FEATURES)).all()
    for n in (98, 99, 100, 101, 198, 199, 200):
        assert (langid.long_counts(text[:n]) == np.bincount(langid.ngrams([text[:n]])[0], minlength=langid.FEATURES)).all()


def test_memory_of_a_long_text():
    import tracemalloc

    text = "some words here " * 1_250_000
    langid.long_counts(text[:1000])
    tracemalloc.start()
    counts = langid.long_counts(text)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert counts.sum() > 20_000_000 and peak < len(text)
