"""Embedding near duplicates against all pairs in Python."""

import math

import numpy as np
import pytest

from chronoreel.llm import vectors


def plain(rows, threshold):
    """(n_links, component) by row place; rows are (id, label, vector)."""
    good = {i for i, (_, label, v) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: np.array(rows[i][2], dtype=float) / np.abs(rows[i][2]).max() for i in good}
    parent, count = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(good):
        for j in sorted(good):
            if i < j and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] / (np.linalg.norm(unit[i]) * np.linalg.norm(unit[j])) >= threshold:
                count[i] += 1
                count[j] += 1
                parent[find(i)] = find(j)
    ids = {}
    for i, (key, _, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(key)
    least = {r: min((k for k in v if k is not None), default=None) for r, v in ids.items()}
    return [(count[i], least[find(i)]) for i in range(len(rows))]


def near(n, d, groups, seed, spread):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, d))
    return [(middle[g] / np.linalg.norm(middle[g]) * r.uniform(0.5, 3) + spread * r.normal(size=d)).tolist() for g in r.integers(0, groups, n)]


def check(spark, rows, kind="double", tile=vectors.TILE, threshold=0.98):
    df = spark.createDataFrame([(k, label, v) for k, label, v in rows], f"vec_id long, label int, embedding array<{kind}>").repartition(3)
    found = sorted(((repr(r.vec_id), r.n_links, repr(r.component_id), r.kept) for r in vectors.near_duplicates(df, tile=tile, threshold=threshold).collect()))
    if kind == "float":
        rows = [(k, label, v and [None if x is None else float(np.float32(x)) for x in v]) for k, label, v in rows]
    want = plain(rows, threshold)
    assert found == sorted((repr(k), n, repr(c), c is None or k == c) for (k, _, _), (n, c) in zip(rows, want, strict=True))
    return want


@pytest.mark.parametrize("kind, tile, d", [("float", 4096, 24), ("double", 16, 40), ("double", 50, 3)])
def test_groups(spark, kind, tile, d):
    """A third of all rows has one label; groups about as wide as the threshold, so many pairs lie on either side."""
    r = np.random.default_rng(d)
    vs = near(300, d, 12, d, 0.1 / d**0.5)
    rows = [(1000 - i, 7 if i % 3 == 0 else int(r.integers(0, 4)), v) for i, v in enumerate(vs)]
    want = check(spark, rows, kind, tile)
    assert 20 < sum(n > 0 for n, _ in want) < 300


def test_chain_over_tiles(spark):
    """Neighbours on a circle link only to the next: one component over many tiles."""
    step = math.acos(0.98) * 0.99
    rows = [(500 - i, 1, [math.cos(i * step), math.sin(i * step) * 0.6, math.sin(i * step) * 0.8]) for i in range(28)]
    assert len({c for _, c in check(spark, rows, tile=4)}) == 1


def test_copies_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.1, 0.2, 0.3, 0.4]
    rows = [(i, 1, v) for i in range(60, 120)] + [(i, 1, [x * 3 for x in v]) for i in range(20, 30)] + [(i, 2, v) for i in range(5)]
    rows += [(200, None, v), (201, 1, None), (202, 1, []), (203, 1, [0.0] * 4), (204, 1, [0.0, -0.0, 0.0, 0.0]), (205, 1, [nan, *v[1:]]), (206, 1, [inf, *v[1:]]), (207, 1, [None, *v[1:]]), (208, 1, v[:3]), (209, 1, v[:3])]
    rows += [(None, 1, v), (None, 3, v), (None, 3, v), (None, 4, v), (300, 5, [0.0, 1.0]), (300, 5, [0.0, 1.0]), (301, 5, [-0.0, 1.0]), (302, 6, [1e300, 1e300]), (303, 6, [1e-300, 1e-300]), (304, 6, [5e-324, 0.0])]
    check(spark, rows, tile=8)


def test_dense_group(spark, monkeypatch):
    """Near copies all alike: every pair of a tile is a link, and what leaves the task is a row or two a member."""
    monkeypatch.setattr(vectors, "ROWS", 64)
    vs = near(400, 20, 1, 2, 0.001)
    rows = [(i, 1, v) for i, v in enumerate(vs)]
    assert {n for n, _ in check(spark, rows, tile=150)} == {399}


def test_empty_and_single(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert vectors.op11_embeddings(spark, spark.createDataFrame([], schema)).collect() == []
    r = vectors.op11_embeddings(spark, spark.createDataFrame([(4, 1, [1.0])], schema)).collect()
    assert [tuple(x) for x in r] == [(4, 0, 4, True)]


def test_forest_spans():
    r = np.random.default_rng(4)
    i, j = r.integers(0, 300, 250), r.integers(0, 300, 250)
    forest = vectors.Forest(300)
    for a in range(0, 250, 40):
        forest.join(i[a : a + 40], j[a : a + 40])
    edges = np.concatenate(forest.edges)
    assert len(edges) == 300 - len(np.unique(forest.root))
    assert (forest.root[i] == forest.root[j]).all()
    assert all(any((x == a and y == b) for x, y in zip(i, j, strict=True)) for a, b in edges.tolist())


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0], "x", "y"), (2, 1, [1.0, 0.1], "x", "y")], "vec_id long, label int, embedding array<double>, n_links string, digest string")
    assert sorted(tuple(r) for r in vectors.near_duplicates(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]
