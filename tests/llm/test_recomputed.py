"""Fitted models applied again in plain Python, and the pipeline's stages by brute force."""

import math
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ITEM_WORD, components_of, contamination, lower_ascii, prose
from pyspark.sql import functions as F

import corpus_pipeline
from chronoreel.llm import decontam, langid, quality, toxicity
from chronoreel.llm._text import NOT_ALPHA, SPACES, Words, buffers


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def feature_of(gram):
    """The number of an n-gram by the stated hash, in unbounded integers."""
    value = 0
    for c in gram:
        value = (value * int(langid._K) + ord(c)) % 2**64
    return ((value + len(gram)) * int(langid._K) % 2**64) >> 49


def test_language_scores(spark, messy, messy_rows, sf_dir):
    """Every text's score from its n-grams and the model's weights, one n-gram at a time."""
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(messy.select("doc_id", "text", "lang", "source", "n_chars")))
    got = langid.identify(messy, model).collect()
    assert len(got) == len(messy_rows)
    for r in got:
        folded = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {r.text or ''} ")
        grams = [folded[i : i + n] for n in (1, 2, 3) for i in range(len(folded) - n + 1)]
        at = [feature_of(g) for g in grams if g.strip(" ")]
        if not at:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sums = [langid.SCALE * math.fsum(float(model.weights[i, k]) for i in at) / len(at) + float(model.weights[-1, k]) for k in range(len(model.languages))]
        e = [math.exp((x - max(sums)) / model.temperature) for x in sums]
        best = max(range(len(e)), key=lambda k: e[k])
        assert r.lang_pred == model.languages[best] and r.score == pytest.approx(e[best] / sum(e), abs=2e-3)


def test_chain_scores(spark, messy, sf_dir):
    """Every text's probabilities from its distinct words and stems, one category after the other."""
    d = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    chain = toxicity.train(docs, toxicity.category_labels(spark.read.parquet(f"{d}/labels.parquet")), toxicity.CATEGORIES)
    weight = dict(zip(chain.features.tolist(), chain.weights, strict=True))
    asked = messy.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    rows = toxicity.score(asked, chain, toxicity.CATEGORIES).collect()
    assert len(rows) == asked.count()
    for r in rows[:600]:
        data, offsets = buffers(pa.array([r.text], pa.string()))
        held = set(toxicity.word_features(Words(data, offsets, NOT_ALPHA)).ravel().tolist()) - {0}
        p = []
        for k in range(len(chain.categories)):
            x = math.fsum(weight[f][k] for f in held if f in weight) + chain.bias[k] + sum(q * chain.earlier[k, j] for j, q in enumerate(p))
            p.append(sigmoid(x))
        assert (r.p_junk, r.p_toxic) == pytest.approx(tuple(p), abs=1e-9)
        assert r.toxic == (r.p_toxic >= chain.thresholds[-1])


def test_quality_evidence(spark, messy, sf_dir):
    """The classifier's probability from a text's form and words."""
    d = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(docs, labels)
    for r in quality.evidence(messy, model).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(r.text))
        if not words:
            assert r.p_doc == 0.5
            continue
        raw = r.text.encode()
        kinds = [quality._CLASSES[quality._TABLE[c]] for c in raw]
        sizes = [len(w.encode()) for w in words]
        form = [kinds.count(k) / len(raw) for k in quality._CLASSES]
        form += [math.log1p(len(words)), sum(sizes) / len(words), len(set(words)) / len(words), sum(a == b for a, b in zip(words, words[1:])) / len(words)]
        form += [math.log1p(len(words) / (1 + raw.count(b"\n"))), sizes.count(1) / len(words)]
        numbers = Words(*buffers(pa.array([r.text], pa.string())), SPACES).hash >> np.uint64(64 - quality.WORD_BITS)
        form.append(float(model.words[-1]) + quality.SCALE * math.fsum(float(model.words[i]) for i in numbers.tolist()) / len(words))
        z = [min(6, max(-6, (x - m) / s)) for x, m, s in zip(form, model.mean, model.scale, strict=True)]
        x = math.fsum(w * v for w, v in zip(model.weights, [*z, *(v * v for v in z), 1.0], strict=True))
        assert r.p_doc == pytest.approx(sigmoid(min(12, max(-12, x))), abs=1e-9)


def test_quality_sees_words(spark):
    """Texts of one form that differ in their words only."""
    rows, labels = [], []
    for i in range(800):
        good = i % 2
        words = prose(i, 40).split()
        word = (("casino", "bonuses", "luckily"), ("meadow", "gardens", "wintery"))[good][i // 2 % 3]
        words[3::7] = [word] * len(words[3::7])
        rows.append((i, " ".join(words), f"s{i % 5}", "en"))
        if i < 600:
            labels.append((i, good, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.p_doc >= 0.5 for r in quality.judge(docs, labels).collect()}
    assert np.mean([got[i] == bool(i % 2) for i in range(600, 800)]) > 0.97


def test_quality_posterior(spark, sf_dir):
    """Host and path rates, their strengths and the posterior, from sums over all rows in plain Python."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, "some odd words", None, None, None), (-2, None, "en", "lonely", 0)], docs.schema)
    docs = docs.unionByName(odd)
    one = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    prior = quality.train(docs, one).prior
    rows = quality.judge(docs, labels).collect()
    hosts, paths = {}, {}
    for r in rows:
        for sums, name in ((hosts, r.host), (paths, (r.host, r.path))):
            n, s = sums.get(name, (0, 0.0))
            sums[name] = n + 1, s + r.p_doc

    def strength(groups):
        """groups: (n, sum, rate it shrinks to)"""
        n = sum(g[0] for g in groups)
        v = sum(g[0] * g[2] * (1 - g[2]) for g in groups)
        if len(groups) < 2 or not v:
            return quality.MOST_STRENGTH
        between = max(0.0, (sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups) - len(groups) * v / n) / n)
        return min(quality.MOST_STRENGTH, max(quality.LEAST_STRENGTH, v / n / between - 1)) if between else quality.MOST_STRENGTH

    rate = sum(s for _, s in hosts.values()) / len(rows)
    k = strength([(n, s, rate) for n, s in hosts.values()])
    of_host = {h: (s + k * rate) / (n + k) for h, (n, s) in hosts.items()}
    k = strength([(n, s, of_host[h]) for (h, _), (n, s) in paths.items()])
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    assert len(rows) == docs.count()
    for r in rows:
        n, s = paths[(r.host, r.path)]
        path_rate = min(1.0, max(0.0, (s - r.p_doc + k * of_host[r.host]) / (n - 1 + k)))
        posterior = sigmoid(logit(r.p_doc) + logit(path_rate) - logit(prior))
        assert (r.host_rate, r.path_rate, r.quality) == pytest.approx((of_host[r.host], path_rate, posterior), abs=1e-6)
        assert r.keep == (r.quality >= 0.5)


def test_pipeline_by_brute_force(spark, messy_rows, tmp_path):
    """Near-duplicate and benchmark stages on rows that hold every odd case, against all pairs and all windows; what is
    packed are the tokens of what is left."""
    import public_tokenizers
    from tokenizers import Tokenizer

    items = [(1, prose(2, 400)), (2, prose(77, 30)), (3, "short item")]
    planted = prose(5, 20) + " " + prose(77, 30) + " " + prose(6, 60)
    rows = [r for r in messy_rows if r[0] is not None and r[0] != 200] + [(300, planted, "en", "s", len(planted)), (301, prose(77, 30), "en", "s", 1)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_dedup"](spark, docs, str(tmp_path)).cache()
    texts = {r[0]: r[1] for r in rows}
    first = components_of(list(texts.items()), 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in texts if first[i] == i)

    left = stages["decontamination"](spark, kept, str(tmp_path)).cache()
    got = {r.doc_id: r.text for r in left.collect()}
    limit = Fraction(str(decontam.MAX_COVERAGE))
    for i in (i for i in texts if first[i] == i):
        words, hit, _ = contamination(texts[i], items, decontam.WINDOW)
        assert (i in got) == (len(hit) <= limit * len(words)), i
        if i in got and not hit:
            assert got[i] == texts[i]
        elif i in got:
            assert ITEM_WORD.findall(lower_ascii(got[i])) == [w for n, w in enumerate(words) if n not in hit]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in stages["packing"](spark, left, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, dtype="<u4").tolist()))
    for i, text in got.items():
        assert [t for _, ids in sorted(pieces[i]) for t in ids] == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    assert set(pieces) == set(got)
