import hashlib

import pytest
from conftest_llm import contamination, prose

from chronoreel.llm import decontam


@pytest.fixture(scope="module")
def items(spark, messy_rows):
    base = messy_rows[0][1].split()
    long = messy_rows[10][1].split()
    rows = [(1, " ".join(base[5:30])), (2, " ".join(long[100:112])), (3, "Two, WORDS!"), (4, ""), (5, None), (None, "word"), (7, " ".join(base[10:25]) + " tail"), (8, "日本語"), (9, "word two"), (7, "x y z")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block_words", [decontam.BLOCK_WORDS, 12])
def test_messy(spark, messy, messy_rows, items, block_words):
    rows, table = items
    named = [(i, t) for i, t in rows if i is not None]
    got = decontam.scan(messy.drop("found"), table, block_words=block_words).collect()
    assert len(got) == len(messy_rows)
    for r in got:
        words, hit, found = contamination(r.text, named, 10)
        assert (r.found.n_words, r.found.n_hit, r.found["items"]) == (len(words), len(hit), sorted(found))
        assert {i for a, z in r.found.spans for i in range(a, z)} == hit


def test_clash_and_clean(spark, messy, messy_rows, items):
    rows, table = items
    named = [(i, t) for i, t in rows if i is not None]
    out = decontam.clean(messy, table)
    assert out.columns == messy.columns
    for r in out.collect():
        words, hit, _ = contamination(r.text, named, 10)
        before = next(x for x in messy_rows if x[0] == r.doc_id and (x[1] is None) == (r.text is None))
        if r.text != before[1]:
            assert len(hit) < len(contamination(before[1], named, 10)[1])
    gone = {x[0] for x in messy_rows} - {r.doc_id for r in out.collect()}
    assert all(2 * len(contamination(t, named, 10)[1]) > len(contamination(t, named, 10)[0]) for i, t, *_ in messy_rows if i in gone)


def test_empty(spark, empty, items):
    assert decontam.scan(empty, items[1]).collect() == []
    nothing = items[1].limit(0)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontam.scan(docs, nothing).first().found.n_hit == 0


def test_random_automaton():
    """Windows against brute force over a tiny alphabet, where overlaps and repeats abound."""
    import random

    import numpy as np

    from chronoreel.llm._text import NOT_ALNUM, Words

    r = random.Random(3)
    for _ in range(60):
        n = r.randint(1, 4)
        items = [(str(i), [r.randint(1, 3) for _ in range(r.randint(1, 8))]) for i in range(r.randint(1, 4))]
        text = [r.randint(1, 4) for _ in range(60)]
        word = lambda x: f"w{x}"
        index = decontam.ItemIndex([(k, [word(x).encode() for x in w]) for k, w in items], n)
        data = np.frombuffer(" ".join(map(word, text)).encode(), dtype=np.uint8)
        spans, found, _ = index.scan(Words(data, np.array([0, len(data)]), NOT_ALNUM), 0, len(text))
        _, hit, want = contamination(" ".join(map(word, text)), [(k, " ".join(map(word, w))) for k, w in items], n)
        assert ({i for a, z in spans for i in range(a, z)}, found) == (hit, want)


def test_query_on_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in decontam.op7_decontamination(spark, sf_dir).collect()}
    assert any(r.contaminated for r in got.values())
    for d, text in docs:
        words, hit, found = contamination(text, items, 10)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(words), len(hit), len(found), digest, bool(hit))


def test_long_item(spark):
    text = prose(77, 5000)
    docs = spark.createDataFrame([(1, text), (2, prose(78, 50))], "doc_id long, text string")
    items = spark.createDataFrame([("a", text)], "item_id string, text string")
    got = {r.doc_id: r.found.n_hit for r in decontam.scan(docs, items).collect()}
    assert got == {1: 5000, 2: 0}


def thue_morse(n):
    """Two words of 2^n characters that sums over powers of an odd number, modulo 2^64, do not tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("colliding", [False, True])
def test_unlike_words_do_not_match(spark, monkeypatch, colliding):
    """Words are compared by their bytes, whatever their hashes are."""
    if colliding:
        from chronoreel.llm import _text

        monkeypatch.setattr(_text, "_multipliers", lambda n: _text._P ** _text.np.arange(n, dtype=_text.np.uint64))
    one, other = thue_morse(11)
    assert one != other
    items = spark.createDataFrame([(1, one), (2, "some " + other)], "item_id long, text string")
    index = decontam.ItemIndex([("1", [one.encode()])], 10)
    from chronoreel.llm._text import NOT_ALNUM, Words, buffers, pa

    for text, hit in ((one, {"1"}), (other, set())):
        data, offsets = buffers(pa.array([text]))
        assert index.scan(Words(data, offsets, NOT_ALNUM), 0, 1)[1] == hit
    if colliding:  # in this process only, not in workers
        return
    docs = spark.createDataFrame([(1, one), (2, other), (3, "some " + one), (4, "some " + other)], "doc_id long, text string")
    got = {r.doc_id: r.found["items"] for r in decontam.scan(docs, items).collect()}
    assert got == {1: ["1"], 2: [], 3: ["1"], 4: ["2"]}


def test_column_named_like_the_result(spark, items):
    docs = spark.createDataFrame([(1, "two words", 5)], "doc_id long, text string, found int")
    out = decontam.scan(docs, items[1])
    assert out.columns == ["doc_id", "text", "found"] and out.first().found["items"] == ["3"]
