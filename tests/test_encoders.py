"""Byte pairs against the public library, word pieces against trying every prefix."""

import random
import unicodedata

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoreel.functions import tokens as K
from chronoreel.operators import encoders as E

PATH = public_tokenizers.path("word_bpe_49k.json")
COMMON = "abcdefgXYZ  \n\t.,!'-0123İΣσΑé́क़日本。語ﬁ"


def some_texts(seed, n):
    r = random.Random(seed)

    def some():
        # what a newer character is depends on each library's tables
        while unicodedata.ucd_3_2_0.category(c := chr(r.choice([r.randrange(0x20, 0x3000), r.randrange(0x3000, 0xD800), r.randrange(0xE000, 0x20000)]))) == "Cn":
            pass
        return c

    return ["".join(r.choice(COMMON) if r.random() < 0.8 else some() for _ in range(r.randrange(80))) for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    return E.pair_tables(spark, PATH)


@pytest.fixture(scope="module")
def pairs(tables):
    vocabulary, merges = tables
    return K.BytePairs({r.token: r.id for r in vocabulary.collect()}, [(r.left, r.right) for r in merges.orderBy("rank").collect()])


@pytest.fixture(scope="module")
def pieces(tables):
    return K.WordPieces({r.token: r.id for r in E.piece_table(tables[0]).collect()})


def test_byte_pairs_equal_the_library(pairs):
    t = Tokenizer.from_file(PATH)
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha() and unicodedata.normalize("NFC", c).lower() != c]
    texts = [*some_texts(5, 4000), *(f for c in letters for f in (c + ",", "a" + c + ".")), "it's we'LL THEY'D o'clock", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "ab" * 4000, "\U0001f600" * 50, ""]
    for text, want in zip(texts, t.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert pairs.encode(text) == want.ids, repr(text)


def test_merges_by_trying_all(pairs):
    """The heap takes what a scan for the best pair takes, one merge at a time."""
    ranks = {k: v for k, v in pairs.ranks.items()}
    for word in ["internationalisation", "aaaaaaaaaaaaa", "strengths", "ababababab", "ééé", "zzzzzq"]:
        raw = word.encode()
        s = [*(pairs.inner[b] for b in raw[:-1]), pairs.final[raw[-1]]]
        while True:
            found = [(ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a << 32 | b in ranks]
            if not found:
                break
            (_, both), i = min(found)
            s[i : i + 2] = [both]
        assert pairs.word(word) == s, word


def plain_words(text):
    out, word = [], ""
    for c in text:
        if c in "\0�":
            continue
        point = ord(c)
        alone = any(a <= point <= z for a, z in K.IDEOGRAPHS) or unicodedata.category(c)[0] == "P" or (point < 128 and not c.isalnum() and 32 < point < 127)
        space = c in "\t\n\v\f\r \x85" or unicodedata.category(c)[0] == "Z"
        if alone or space:
            out += [word] if word else []
            out += [c] if alone else []
            word = ""
        else:
            word += c.lower()[0]
    return out + ([word] if word else [])


def plain_pieces(word, vocabulary):
    raw, out, at = word.encode(), [], 0
    while at < len(raw):
        for end in range(len(raw), at, -1):
            part = raw[at:end].decode("utf-8", "surrogateescape")
            if (i := vocabulary.get(("##" if at else "") + part)) is not None:
                out.append(i)
                at = end
                break
        else:
            out.append(vocabulary[K.UNKNOWN])
            at += 1
    return out


def test_word_pieces_by_every_prefix(pieces):
    texts = [*some_texts(9, 1500), "unaffordable inter-national_word", "İstanbul ΣΊΣΥΦΟΣ", "東京tower𠀀x", "##a ##", "[CLS] [UNK]", "a\0b�c", "\x1c\x1d"]
    for text in texts:
        words = plain_words(text)
        assert pieces.words(text) == words, repr(text)
        assert pieces.encode(text) == [i for w in words for i in plain_pieces(w, pieces.vocabulary)], repr(text)
    assert any(pieces.vocabulary[K.UNKNOWN] in pieces.encode(t) for t in texts)


def test_memory_is_bounded(pairs, monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 3)
    pairs.known.clear()
    first = pairs.encode("alpha beta gamma delta epsilon")
    assert len(pairs.known) <= 3 and pairs.encode("alpha beta gamma delta epsilon") == first


def test_tables(spark, tables, pairs, pieces):
    rows = [(1, None), (2, ""), (3, "two words"), (4, "word " * 300), (4, "日本語 " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("IDS", F.lit("clash"))
    got = sorted((r.doc_id, r.n_tokens, r.ids, r.n_used) for r in E.byte_pair_input(docs, *tables).collect())
    first, last = pairs.vocabulary[K.START], pairs.vocabulary[K.END]
    want = sorted((i, len(ids := pairs.encode(t or "")), ([first, *ids[:75], last] + [0] * 77)[:77], min(len(ids), 75) + 2) for i, t in rows)
    assert got == want
    v = pieces.vocabulary
    got = sorted((r.doc_id, r.n_tokens, r.ids, r.n_used, r.mask) for r in E.word_piece_input(docs, E.piece_table(tables[0])).withColumn("mask", E.attention_mask(F.col("ids"))).collect())
    want = [(i, len(ids := pieces.encode(t or "")), ([v[K.CLS], *ids[:510], v[K.SEP]] + [v[K.PAD]] * 512)[:512], min(len(ids), 510) + 2) for i, t in rows]
    assert [g[:4] for g in got] == sorted(want) and all(g[4] == [1] * g[3] + [0] * (512 - g[3]) for g in got)


def test_vocabulary_is_bounded(spark, tables, monkeypatch):
    monkeypatch.setattr(E, "MOST_ENTRIES", 10)
    with pytest.raises(ValueError, match="more than 10"):
        E.piece_table(tables[0])
