import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoreel.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, texts, contexts=packing.CONTEXTS):
    """Every id lies in one piece, sequences are gapless and as long as a context or a smaller power of two."""
    t = Tokenizer.from_file(PATH)
    documents, sequences = {}, {}
    for p in pieces:
        documents.setdefault(p.row, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    assert set(documents) == set(texts)
    for row, parts in documents.items():
        ids = np.array([*t.encode(texts[row] or "", add_special_tokens=False).ids, packing.EOS], dtype="<u4").tobytes()
        parts.sort(key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in parts) == ids
        assert [p.start for p in parts] == list(np.cumsum([0, *(p.length for p in parts)])[:-1])
        assert {p.doc_tokens for p in parts} == {len(ids) // 4}
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == list(np.cumsum([0, *(p.length for p in parts)])[:-1])
        total = sum(p.length for p in parts)
        assert total <= contexts[-1] and total & (total - 1) == 0 and {p.context for p in parts} == {total}


@pytest.mark.parametrize("window", [packing.WINDOW_TOKENS, 3000])
def test_messy(spark, messy, window):
    rows = messy.withColumn("row", F.monotonically_increasing_id()).cache()
    texts = {r.row: r.text for r in rows.select("row", "text").collect()}
    check(packing.pack(rows, PATH, key="row", window_tokens=window).collect(), texts)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "row")
    pieces = packing.pack(docs, PATH, key="row").collect()
    check(pieces, {r.row: r.text for r in docs.select("row", "text").collect()})
    loads = {}
    for p in pieces:
        loads[p.step_group] = loads.get(p.step_group, 0) + p.length
    assert max(loads.values()) <= packing.STEP_TOKENS


def test_empty(spark, empty):
    assert packing.pack(empty, PATH).collect() == []
    assert packing.op3_packing(spark, empty).collect() == []


def test_special_strings():
    """Texts that spell special tokens, contractions, marks, other spaces and long runs."""
    t, words = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    texts = ["a <|endoftext|> b<|startoftext|>", "<|ENDOFTEXT|> X", "It's we'LL they'd", "e\u0301 E\u0301 \u0130stanbul \u03a3\u03a3 \u00df", "a\u00a0b\u2003c\td\re", "w.,w .. a,b 12,3. X. Y,", "   ", "\n\n", "ﬁ ㎏ 한국어 \U0001f600x", "a" * 5000, "A.B.C. U.S., ok."]
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_every_letter_before_every_mark():
    """Some letters are a letter and a mark once they are normalised, and take the mark behind them along."""
    t, words = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    texts = [form for c in letters for form in (c + ",", "a" + c + ".")]
    odd = [c for c in letters if not packing._letters(c)]
    texts += [x + c + m for c in [*odd, "a", "İ", "क़"] for m in packing._MARKS for x in ("", "a")]
    for i in range(0, len(texts), 20_000):
        part = texts[i : i + 20_000]
        for text, ids, want in zip(part, words.encode(part), t.encode_batch_fast(part, add_special_tokens=False), strict=True):
            assert ids == np.array(want.ids, dtype="<u4").tobytes(), repr(text)
    assert len(odd) >= 30


def test_random_texts():
    """Texts of characters from all of Unicode, common ones more often."""
    r = random.Random(11)
    t, words = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    common = "abcXYZ  \n\t.,!'-0İΣσΑé\u0301क़日"
    some = lambda: chr(r.choice([r.randrange(0x20, 0x3000), r.randrange(0x3000, 0xD800), r.randrange(0xE000, 0x20000)]))
    texts = ["".join(r.choice(common) if r.random() < 0.7 else some() for _ in range(r.randrange(60))) for _ in range(6000)]
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_kept_words(monkeypatch):
    words = packing.WordTokenizer(PATH)
    first = words.encode(["alpha beta gamma. delta"])
    words.forget(2)
    assert len(words.known) == 2 and 0 < words.held < 1000
    assert words.encode(["alpha beta gamma. delta"]) == first


def test_cache_reset(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 1)
    words = packing.WordTokenizer(PATH, 1000)
    first = words.encode(["alpha beta gamma delta", None])
    assert words.encode(["alpha beta gamma delta", ""]) == first
    # beyond its bound it forgets all but the first
    words = packing.WordTokenizer(PATH, 2000)
    words.encode(["alpha"])
    words.encode(["beta. epsilon zeta eta theta iota kappa lambda mu nu xi"])
    assert words.held > 2000
    assert words.encode(["omega"]) == packing.WordTokenizer(PATH).encode(["omega"])
    assert set(words.known) == {"alpha", "omega"} and words.held == packing._size(words.known, words.known.values())
