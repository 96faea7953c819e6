"""Near duplicates against brute force on exact shingle sets."""

import random

import pytest
from conftest_llm import components_of, prose, shingles

from chronoreel.llm import minhash


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_messy(spark, messy, messy_rows, k, percent):
    got = minhash.near_duplicates(messy, k=k, threshold=percent / 100).collect()
    assert len(got) == len(messy_rows)
    want = components_of([(r[0], r[1]) for r in messy_rows if r[0] is not None], k, percent)
    sets = {r[0]: shingles(r[1], k) for r in messy_rows}
    for r in got:
        if r.doc_id is not None:
            assert (r.component_id, r.kept, r.n_shingles) == (want[r.doc_id], want[r.doc_id] == r.doc_id, len(sets[r.doc_id]))
    unnamed = sorted((r.component_id is None, r.component_id, r.kept) for r in got if r.doc_id is None)
    assert unnamed == [(False, 0, False), (True, None, True)]


def test_empty(spark, empty):
    assert minhash.near_duplicates(empty).collect() == []
    assert minhash.deduplicate(empty).columns == empty.columns


def test_chains_and_large_groups(spark):
    """A long chain whose ends are unlike each other, and a group wider than a block."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    rows, text = [], [word() for _ in range(100)]
    for i in range(60):
        rows.append((1000 - i, " ".join(text)))
        text[(i * 7) % 100] = word()
        text[(i * 7 + 1) % 100] = word()
    base = [word() for _ in range(120)]
    for i in range(1300):
        copy = list(base)
        for at in r.sample(range(120), r.randint(0, 4)):
            copy[at] = word()
        rows.append((5000 + i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs, k=3, threshold=0.85).collect()}
    assert got == components_of(rows, 3, 85)


def test_deduplicate_leaves_one_row(spark, messy, messy_rows):
    kept = minhash.deduplicate(messy)
    assert kept.columns == messy.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    want = components_of([(r[0], r[1]) for r in messy_rows if r[0] is not None], 5, 80)
    assert ids == sorted({i for i, c in want.items() if i == c})
    assert sum(r.doc_id is None for r in kept.collect()) == 1


def test_query_on_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in minhash.op10_near_duplicates(spark, docs).collect()}
    assert got == components_of(rows, 3, 85)


def test_one_key_with_two_texts(spark):
    """A document given twice with unlike texts joins the groups of both."""
    a, b = prose(50, 80), prose(51, 80)
    rows = [(5, a), (5, b), (7, a + " more"), (9, "less " + b), (3, prose(52, 80))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, threshold=0.85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 5), (5, 5), (7, 5), (9, 5)]


@pytest.mark.parametrize("block", [16, 64])
def test_buckets_larger_than_a_block(spark, monkeypatch, block):
    """With small blocks the star and rest passes run, with members outside the largest part."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(300):
        copy = list(base)
        for at in r.sample(range(120), r.randint(0, 8)):
            copy[at] = word()
        rows.append((5000 - i, " ".join(copy)))
    sizes = {"star": [], "rest": [], "outside": 0}
    star, rest = minhash._star_rows, minhash._rest_rows

    def stars(large, scratch):
        sizes["star"].append(large.groupBy("bucket").count().agg({"count": "max"}).first()[0])
        return star(large, scratch)

    def rests(parts, scratch):
        counts = parts.groupBy("bucket", "part").count().groupBy("bucket").agg({"count": "max", "part": "count"}).collect()
        sizes["rest"].append(len(counts))
        sizes["outside"] = sum(x["count(part)"] > 1 for x in counts)
        return rest(parts, scratch)

    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "_star_rows", stars)
    monkeypatch.setattr(minhash, "_rest_rows", rests)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs, k=3, threshold=0.85).collect()}
    assert sizes["star"] and sizes["star"][0] > block and sizes["outside"] > 0, sizes
    assert got == components_of(rows, 3, 85)


def test_unlike_words_are_not_linked(spark, monkeypatch):
    """Sets are of words, not of their hashes: with a hash that makes these words equal nothing is linked."""
    from test_decontam import thue_morse

    from chronoreel.llm import _text

    one, other = thue_morse(11)
    docs = spark.createDataFrame([(1, one), (2, other), (3, f"{one} {one}"), (4, one + "\n")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.op10_near_duplicates(spark, docs).collect())
    assert got == [(1, 1, True), (2, 2, True), (3, 3, True), (4, 1, False)]
    monkeypatch.setattr(_text, "_multipliers", lambda n: _text._P ** _text.np.arange(n, dtype=_text.np.uint64))
    sets = minhash.exact_sets(_text.pa.array([one, other, f"{one} {other} x y", "", None, f"{one} {other} x"]), 3)
    assert [len(x) for x in sets] == [1, 1, 2, 0, 0, 1] and sets[0] != sets[1] and len(set(sets[2]) & set(sets[5])) == 1


@pytest.mark.parametrize("k", [1, 3, 5, 9])
def test_exact_sets(k):
    """Numbered shingles have the same sizes and intersections as the shingles themselves."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(k)
    texts = [" ".join(r.choices("abcd", k=r.randint(0, 30))) for _ in range(40)]
    got, want = minhash.exact_sets(pa.array(texts), k), [shingles(t, k) for t in texts]
    for i in range(40):
        for j in range(40):
            assert len(np.intersect1d(got[i], got[j])) == len(set(want[i]) & set(want[j]))


def brute_survivors(rows, k, percent):
    """Indexes of the rows that stay, by the rule that ``deduplicate`` states."""
    import hashlib

    order = lambda r: (r[0] is None, r[0] if r[0] is not None else 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    distinct = sorted({(r[0], r[1]) for r in rows if shingles(r[1], k)}, key=order)
    groups = components_of([(i, t) for i, (_, t) in enumerate(distinct)], k, percent)
    first = {}
    for i, root in groups.items():
        first.setdefault(root, distinct[i])
    stay = sorted(first.values(), key=order)
    return stay, [r for r in rows if not shingles(r[1], k)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_deduplicate_with_repeated_keys(spark, kind):
    """Unlike texts under one key both stay; survivors are those of brute force, whatever the keys' type."""
    named = (lambda k: k) if kind == "long" else (lambda k: None if k is None else f"k{k:03d}")
    a, b, c = prose(60, 80), prose(61, 80), prose(62, 70)
    rows = [(1, a), (1, b), (2, a + " more"), (2, c), (None, c), (None, prose(63, 50)), (3, None), (3, ""), (None, None), (4, "  "), (5, b), (5, b), (6, prose(64, 30)), (6, prose(64, 30)), (11, prose(65, 40)), (9, prose(65, 40))]
    rows = [(named(k), t) for k, t in rows]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"doc_id {kind}, text string, n int").repartition(3)
    got = [(r.doc_id, r.text) for r in minhash.deduplicate(docs).collect()]
    stay, wordless = brute_survivors(rows, 5, 80)
    assert sorted(map(repr, got)) == sorted(map(repr, stay + wordless))


def test_blocks_are_bounded_in_shingles(spark, monkeypatch):
    """Long documents make blocks of few members; links are the same."""
    r = random.Random(8)
    base, rows = prose(70, 2000).split(), []
    for i in range(60):
        copy = list(base)
        for at in r.sample(range(2000), r.randint(0, 120)):
            copy[at] = f"w{r.random()}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 10_000)
    most = []
    compare = minhash._compare

    def watched(groups, full, *rest):
        groups = groups.cache()
        most.extend(x["count"] for x in groups.groupBy(*minhash.GROUP).count().collect())
        return compare(groups, full, *rest)

    monkeypatch.setattr(minhash, "_compare", watched)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs, k=3, threshold=0.85).collect()}
    assert got == components_of(rows, 3, 85) and 1 < max(most) < 40


def test_components_write_few_files_and_no_round_for_stars(spark, tmp_path):
    """Where partitions aren't coalesced, a small table of links is written by a task a core, not by one a partition; links that
    are stars already need no round."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    chain = [(i, i + 1) for i in range(200)] + [(i, 300 + i) for i in range(0, 200, 7)] + [(1000, 1001)]
    star = [(1, i) for i in range(2, 400)] + [(500, 501)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        scratch = minhash.Scratch(spark, "few")
        found = minhash.components(scratch, spark.createDataFrame(chain, "a long, b long"), len(chain))
        assert {tuple(r) for r in found.collect()} == {(i, 0) for _, i in chain[:-1]} | {(1001, 1000)}
        assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert scratch.made > 1
        scratch = minhash.Scratch(spark, "stars")
        found = minhash.components(scratch, spark.createDataFrame(star, "a long, b long"))
        assert {tuple(r) for r in found.collect()} == {(b, a) for a, b in star}
        assert scratch.made == 1
        none = minhash.components(minhash.Scratch(spark, "none"), spark.createDataFrame([], "a long, b long"))
        assert none.collect() == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
