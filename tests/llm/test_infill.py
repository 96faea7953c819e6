"""Fill-in-middle against the definition in plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from chronoreel.llm import infill

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def expected(key, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [None, "", "a", "word", "two words", "é", "日本語 text\U0001f600mixed", "a<P>b", "x<S>", "<M>", "<P", "P><S", "\n\r\n", "ab\x00cd", "Z" * 3000, "<" * 700, "é" * 1000 + "ab" * 1000 + "\U0001f600"]


def rows_of(texts):
    # every text under many keys, so that each form is drawn
    return [(i * 100 + j if j else None, t) for i, t in enumerate(texts) for j in range(30)]


@pytest.mark.parametrize("span", [infill.SPAN, 512])
def test_definition(spark, monkeypatch, span):
    monkeypatch.setattr(infill, "SPAN", span)
    rows = rows_of(TEXTS)
    done = infill.transform(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    done = done.withColumn("restored", infill.restore(done["output"], done["form"]))
    found = sorted(((r.doc_id is None, r.doc_id, r.text or ""), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in done.collect() if r.doc_id is not None)
    want = sorted(((False, k, t or ""), *expected(k, t), t or "") for k, t in rows if k is not None)
    assert found == want
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    for r in done.where("doc_id is null").collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(None, r.text) and r.restored == (r.text or "")


def test_messy(spark, messy, messy_rows, empty):
    done = infill.transform(messy)
    assert done.columns == [*messy.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    found = sorted((repr((r.doc_id, r.text)), r.n, r.form, r.output, r.found) for r in done.collect())
    assert found == sorted((repr((k, t)), *(lambda e: (e[0], e[1], e[4]))(expected(k, t)), "clash") for k, t, *_ in messy_rows)
    assert infill.op13_infill(spark, empty).collect() == [] and infill.transform(empty).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "some text here", "a", 2, 3, "mine")], "doc_id long, text string, form string, N int, draw_0 int, DRAW_4 string")
    r = infill.transform(df).collect()[0]
    assert (r.draw_0, r.DRAW_4, r.n, r.output) == (3, "mine", expected(1, "some text here")[0], expected(1, "some text here")[4])


@pytest.mark.parametrize("density", [0.0, 0.01, 0.5, 1.0])
def test_rank_select(density):
    r = np.random.default_rng(int(density * 100))
    for n in (1, 7, 8, 511, 512, 513, 20_000):
        bits = r.random(n) < density
        b = infill.Bits(np.packbits(bits))
        assert b.total == bits.sum()
        before = np.concatenate([[0], np.cumsum(bits)])
        assert all(b.rank(i) == before[i] for i in random.Random(n).sample(range(n), min(n, 300)))
        places = np.flatnonzero(bits)
        assert all(b.select(k) == places[k] for k in range(0, len(places), max(1, len(places) // 300)))


def test_long_text():
    """A text of some ten spans, cut where each span ends too."""
    text = ("word é日 " * 300_000)[: 3 * infill.SPAN]
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    units, points = infill.boundaries(data)
    assert units.total == len(UNIT.findall(text)) and points.total == len(text)
