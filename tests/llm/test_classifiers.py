"""Language, toxicity and quality models: held-out accuracy, edge cases, independence of inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoreel.llm import langid, quality, toxicity
from chronoreel.llm._linear import Ftrl, fit_temperature, logits


def test_ftrl_is_sparse_and_learns():
    r = np.random.default_rng(1)
    xs, ys = [], []
    for _ in range(400):
        y = int(r.integers(2))
        at = np.unique(np.append(r.integers(10, 500, 20), [y]))
        xs.append((at, np.ones(len(at))))
        ys.append(y)
    w = Ftrl(500, 2, l1=2.0).fit(xs[:300], ys[:300], 3).weights()
    assert np.mean([np.argmax(logits(w, x)) == y for x, y in zip(xs[300:], ys[300:], strict=True)]) > 0.97
    assert (w[10:500] == 0).mean() > 0.5


def test_temperature():
    r = np.random.default_rng(2)
    ys = r.integers(2, size=4000)
    sure = np.where(r.random(4000) < 0.8, 1, -1) * np.where(ys == 1, 1, -1) * 4.0
    t = fit_temperature(np.stack([-sure / 2, sure / 2], axis=1), ys)
    assert 1 / (1 + np.exp(-4.0 / t)) == pytest.approx(0.8, abs=0.02)


def test_language_messy(spark, messy, messy_rows):
    docs = messy.drop("lang_pred", "score")
    out = langid.identify(docs, langid.train(docs))
    got = out.collect()
    assert len(got) == len(messy_rows)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == letters and 0 <= r.score <= 1
    assert langid.keep_known(messy, langid.train(messy)).columns == messy.columns


def test_language_empty(spark, empty):
    assert langid.train(empty) is None
    assert langid.op1_language_id(spark, empty).collect() == []
    some = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.op1_language_id(spark, some).collect()] == [("und", 0.0)]


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = langid.op1_language_id(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    # neither the held-out labels nor ids and sources take part
    blind = docs.withColumn("lang", F.when(~langid.held_out(F.col("doc_id")), F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    again = {r.doc_id: r.lang_pred for r in langid.op1_language_id(spark, blind).collect()}
    assert all(again[r.doc_id] == r.lang_pred for r in rows)


@pytest.fixture(scope="module")
def toxic_world(spark):
    from conftest_llm import prose

    rows, labels = [], []
    for i in range(2000):
        bad = i % 5 == 0
        words = prose(i, 60).split()
        if bad:
            words[i % 50] = ("idiot", "moron", "scumbag", "scummy")[i // 10 % 4]
        rows.append((i, " ".join(words), "en", "s", 1))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns(spark, toxic_world):
    docs, labels = toxic_world
    got = {r.doc_id: r.toxic for r in toxicity.classify(docs, labels).collect()}
    assert sum(got[i] != (i % 5 == 0) for i in got) <= 10
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 2000 - sum(got.values())


def test_toxicity_messy(spark, messy, messy_rows, empty, toxic_world):
    _, labels = toxic_world
    odd = labels.unionByName(spark.createDataFrame([(None, None, None), (0, None, 1), (2, 0, None), (2, 0, 0)], labels.schema))
    out = toxicity.keep_clean(messy, odd)
    assert out.columns == messy.columns
    assert toxicity.keep_clean(empty, odd).collect() == []
    assert toxicity.keep_clean(messy, odd.limit(0)).count() == len(messy_rows)


def test_chain_uses_earlier_categories(spark):
    """The second category is the first one or a word of its own: the chain gives the first a weight."""
    from conftest_llm import prose

    rows = []
    for i in range(600):
        a, b = i % 3 == 0, i % 7 == 0
        text = prose(1000 + i, 30) + (" " + ("rude", "crude", "lewd", "nasty", "vile", "foul")[i // 3 % 6] if a else "") + (" special" if b else "")
        rows.append((i, text, int(a), int(a or b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, a int, b int")
    chain = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "a", "b"), ("a", "b"))
    assert chain.earlier[1, 0] > 0.2
    got = toxicity.score(df.select("doc_id", "text"), chain, ("a", "b"), flag="is_b").collect()
    assert np.mean([r.is_b == (r.doc_id % 3 == 0 or r.doc_id % 7 == 0) for r in got]) > 0.97


def test_toxicity_table(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = {r.doc_id: r.toxic for r in toxicity.op5_toxicity(spark, d).collect()}
    assert all(got[i] for i, t in truth.items() if t)
    assert sum(got[i] for i, t in truth.items() if not t) <= 0.01 * len(truth)


def test_quality_messy(spark, messy, messy_rows, empty):
    labels = spark.createDataFrame([(0, 1, 0), (7, 0, 0), (10, 1, 0), (None, 0, 0), (5, None, 0), (0, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(messy.drop("score"), labels).collect()
    assert len(got) == len(messy_rows)
    assert all(0 <= r.quality <= 1 and 0 <= r.p_doc <= 1 and 0 <= r.path_rate <= 1 for r in got)
    assert quality.judge(empty, labels).collect() == []
    assert {r.p_doc for r in quality.judge(messy, labels.limit(0)).collect()} == {0.5}


def test_quality_shrinks_sparse_sites(spark):
    rows = [("big", "big/a", 0.9)] * 50 + [("big", "big/b", 0.1)] + [("low", "low/a", 0.1)] * 50 + [("new", "new/a", 0.99)]
    out = {(r.host, r.path): r for r in quality.posterior(spark.createDataFrame(rows, "host string, path string, p_doc double"), 0.5).collect()}
    assert out[("big", "big/a")].host_rate > 0.8 and out[("low", "low/a")].host_rate < 0.2
    # a single document is left out of its own path, which falls back to the host
    assert out[("big", "big/b")].path_rate == pytest.approx(out[("big", "big/b")].host_rate, abs=0.05)
    assert 0.3 < out[("new", "new/a")].host_rate < 0.9


def test_quality_table(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = {r.doc_id: r.keep for r in quality.op9_quality(spark, d).collect()}
    assert np.mean([got[i] == bool(q) for i, q in truth.items()]) > 0.98
