"""Vector codes against plain Lloyd rounds in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from chronoreel.llm import codes


def plain(rows, parts, entries, rounds):
    """{place: (codes, error)} and the digest; rows are (id, vector)."""
    ok = [(i, k, v) for i, (k, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((x for x in ok if x[1] is not None), key=lambda x: (x[1], x[2]))
    if not named:
        return {}, hashlib.sha256(b"").hexdigest()
    length = len(named[0][2])
    width = -(-length // parts)
    whole = lambda v: [math.floor(256 * x) for x in v] + [0] * (parts * width - length)
    ok = [(i, k, whole(v)) for i, k, v in ok if len(v) == length]
    first = [whole(v) for _, _, v in named if len(v) == length][:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: {i: [min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e)) for p in range(parts)] for i, _, v in ok}
    found = assign()
    for _ in range(rounds):
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for i, _, v in ok if found[i][p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        found = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (found[i], sum(far(cut(v, p), books[p][found[i][p]]) for p in range(parts))) for i, _, v in ok}, digest


def clouds(n, d, seed=3, spread=0.02):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(7, d))
    return [(i, (middle[r.integers(7)] + spread * r.normal(size=d)).tolist()) for i in range(n)]


def held(spark, rows, parts, entries, rounds, block=codes.BLOCK):
    df = spark.createDataFrame([(i, v, i) for i, (_, v) in enumerate(rows)], "place long, embedding array<double>, label long")
    keys = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(rows)], "place long, vec_id long")
    # the label names the row, so that results can be told apart when keys repeat
    out, books = codes.encode(df.join(keys, "place").repartition(3), parts=parts, entries=entries, rounds=rounds, block=block)
    return {r.label: (r.codes, r.error) for r in out.collect()}, books.digest() if books else hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("rounds, block", [(1, 8192), (2, 50), (4, 64)])
def test_rounds(spark, rounds, block):
    rows = clouds(400, 12)
    assert held(spark, rows, 4, 16, rounds, block) == plain(rows, 4, 16, rounds)


def test_ties_and_copies(spark):
    """Whole numbers on a small grid: most distances tie; the most common vector is a third of all."""
    r = np.random.default_rng(5)
    rows = [(i, (r.integers(-2, 3, 8) / 256).tolist()) for i in range(200)] + [(500 + i, [0.0] * 8) for i in range(100)]
    assert held(spark, rows, 2, 20, 3, 40) == plain(rows, 2, 20, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clouds(40, 7) + [(None, [0.5] * 7), (3, [0.25] * 7), (3, [0.25] * 7), (-5, None), (-4, [nan] * 7), (-3, [inf, *[0.0] * 6]), (-2, []), (-1, [None, *[0.0] * 6]), (900, [0.1] * 6), (901, [-0.0] * 7)]
    found = held(spark, rows, 4, 8, 2)
    assert found == plain(rows, 4, 8, 2)
    # fewer rows than entries; no row at all; no key
    few = clouds(3, 8)
    assert held(spark, few, 4, 64, 2) == plain(few, 4, 64, 2)
    assert held(spark, [(1, None)], 4, 8, 2) == ({}, plain([], 4, 8, 2)[1]) and held(spark, [(None, [1.0] * 4)], 4, 8, 2)[0] == {}


def test_large_numbers(spark):
    """Components beyond products in doubles are compared by differences; beyond most_of they count as that."""
    rows = [(i, (np.array(v) * 1e5).tolist()) for i, v in clouds(60, 8)]
    assert held(spark, rows, 2, 8, 2) == plain(rows, 2, 8, 2)
    most = codes.most_of(4)
    assert codes.whole(np.array([[1e30, -1e30, 1.0, 0.0]])).tolist() == [[most, -most, 256, 0]]
    assert 4 * (2 * most) ** 2 < 1 << 63


def test_heaps_pop_what_drift_reaches():
    r = np.random.default_rng(1)
    entry, key = r.integers(0, 9, 3000), r.normal(size=3000)
    heaps = codes.Heaps.of(entry, key, 9)
    for turn in range(5):
        for e in range(9):
            a, z = heaps.first[e], heaps.first[e + 1]
            assert all(heaps.key[a + (i - 1) // 2] <= heaps.key[a + i] for i in range(1, z - a))
        drift = r.normal(size=9) - 1
        rows = heaps.pop(drift)
        assert sorted(rows) == np.flatnonzero(key <= drift[entry]).tolist(), turn
        entry[rows], key[rows] = r.integers(0, 9, len(rows)), r.normal(size=len(rows))
        heaps = heaps.push(entry[rows], rows, key[rows])
        assert sorted(heaps.row.tolist()) == list(range(3000)) and (np.repeat(np.arange(9), np.diff(heaps.first)) == entry[heaps.row]).all() and (heaps.key == key[heaps.row]).all()


def test_few_are_looked_at_again():
    """Bounds keep most parts from being compared in a round in which entries hardly move."""
    points = np.array([v for _, v in clouds(2000, 8, spread=0.01)])
    whole = codes.whole(points).reshape(-1, 2, 4)
    books = codes.Codebooks(np.ascontiguousarray(np.unique(whole, axis=0)[:: len(np.unique(whole, axis=0)) // 7][:7].transpose(1, 0, 2)))
    block, sums = codes.Block.fresh(whole, books)
    looked = []
    for _ in range(4):
        books = books.moved({(p, e, c): int(sums[p, e, c]) for p in range(2) for e in range(7) for c in range(5)})
        pop = codes.Heaps.pop
        counts = []
        codes.Heaps.pop = lambda self, drift, pop=pop, counts=counts: (counts.append(len(found := pop(self, drift))), found)[1]
        try:
            sums = sums + block.advance(books)
        finally:
            codes.Heaps.pop = pop
        looked.append(sum(counts))
    assert looked[-1] < 400


def test_label_sums(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2, i) for i in range(300)], "vec_id long, label int, error long")
    want = {k: sum(i for i in range(300) if (None if i % 3 == 0 else i % 2) == k) for k in (None, 0, 1)}
    for most in (codes.BROADCAST_LABELS, 1):
        monkeypatch.setattr(codes, "BROADCAST_LABELS", most)
        found = codes.label_sums(rows, "label", "error", "vec_id", "total").collect()
        assert len(found) == 300 and all(r.total == want[r.label] for r in found)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert codes.op12_codes(spark, df).collect() == []
    one = spark.createDataFrame([(1, [0.5] * 16, None)], "vec_id long, embedding array<float>, label int")
    r = codes.op12_codes(spark, one).collect()
    assert [(x.vec_id, x.code, x.error, x.label_error) for x in r] == [(1, "00" * 16, 0, 0)]
