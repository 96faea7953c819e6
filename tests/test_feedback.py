"""One-to-one assignment and time errors by trying all; rewriting on small cases."""

import itertools
import random

import pytest

from chronoreel.operators import feedback as B
from chronoreel.plans import feedback as plans
from chronoreel.sources import fixtures as X


def least(costs):
    n, m = len(costs), len(costs[0]) if costs else 0
    if n > m:
        return least([list(c) for c in zip(*costs, strict=True)]) if m else 0
    return min((sum(costs[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n)), default=0)


def test_assignment():
    r = random.Random(1)
    for turn in range(400):
        n, m, most = r.randrange(6), r.randrange(6), r.choice((2, 10, 10**9))
        costs = [[r.randrange(most) for _ in range(m)] for _ in range(n)]
        to = B.assignment(costs)
        used = [j for j in to if j >= 0]
        assert len(to) == n and len(set(used)) == len(used) == min(n, m)
        assert sum(costs[i][j] for i, j in enumerate(to) if j >= 0) == least(costs), (turn, costs)


def errors_by_trying(found, truth, within=B.WITHIN_MS):
    a, b = (found, truth) if len(found) <= len(truth) else (truth, found)
    best = (0, 0)
    for p in itertools.permutations(b, len(a)):
        e = [abs(x[0] - y[0]) + abs(x[1] - y[1]) for x, y in zip(a, p, strict=True)]
        now = (sum(e), sum(v >= 2 * within for v in e))
        best = now if p == tuple(b[: len(a)]) else min(best, now)
    return len(found), len(truth), len(a), best[0] / 2, len(a) - best[1]


def test_time_errors(spark):
    r = random.Random(2)
    found, truth, want = [], [], {}
    for q in range(60):
        sides = [[(s := r.randrange(20_000), s + r.randrange(8000)) for _ in range(r.randrange(5))] for _ in range(2)]
        if sides[0] or sides[1]:
            want[q] = errors_by_trying(*sides)
        found += [(q, *x) for x in sides[0]]
        truth += [(q, *x) for x in sides[1]]
    schema = "query_id long, start_ms long, end_ms long"
    odd = [(0, None, 5), (99, 7, None)]
    rows = B.temporal_error(spark.createDataFrame(found + odd, schema), spark.createDataFrame(truth, schema))
    got = {x.query_id: tuple(x)[1:] for x in rows.collect()}
    assert got == want
    s = B.temporal_summary(rows).first()
    matched = sum(w[2] for w in want.values())
    assert (s.n_questions, s.recall, s.mean_ms, s.share_within) == (len(want), matched / len(truth), pytest.approx(sum(w[3] for w in want.values()) / matched), sum(w[4] for w in want.values()) / matched)
    assert B.temporal_error(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).collect() == []


def test_time_errors_of_conversations(spark, sf_dir):
    """The registered query against trying every assignment, for conversations of up to seven intervals a side."""
    from pyspark.sql import functions as F

    shift = F.pmod(F.xxhash64("video_id", "seg_idx"), F.lit(9000)) - 4500
    sides = {}
    for r in X.segments(spark, sf_dir).withColumn("shift", shift).collect():
        found, truth = sides.setdefault(r.video_id, ([], []))
        if r.seg_idx % 3 < 2:
            found.append((r.start_ms + r.shift, r.end_ms + r.shift))
        if r.seg_idx % 2 == 0:
            truth.append((r.start_ms, r.end_ms))
    got = {r.query_id: tuple(r)[1:] for r in plans.temporal_errors(spark, sf_dir).collect()}
    assert set(got) == {k for k, (a, b) in sides.items() if a or b}
    for k, (a, b) in sides.items():
        if k in got and max(len(a), len(b)) <= 7:
            assert got[k] == errors_by_trying(a, b)
    assert any(0 < g[4] < g[2] for g in got.values())


def test_rewrite(spark):
    docs = [(1, "alpha beta gamma"), (2, "alpha beta beta delta"), (3, "epsilon zeta"), (4, None), (5, ""), (6, "delta eta")]
    words = B.document_words(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = B.own_terms(spark.createDataFrame([(1, "alpha"), (2, "nothing known"), (3, None), (4, "epsilon epsilon")], "query_id long, query string"))
    got = {}
    for r in B.rewrite(words, asked, hits=2, terms=2).collect():
        got.setdefault(r.query_id, {})[r.term] = (r.weight, r.own)
    assert got[2] == {"nothing": (1.0, True), "known": (1.0, True)} and 3 not in got
    assert got[4] == {"epsilon": (1.0, True), "zeta": (0.5, False)}
    assert got[1]["alpha"] == (1.0, True) and set(got[1]) == {"alpha", "beta", "gamma"} and max(w for w, own in got[1].values() if not own) == 0.5
    ranked = [(r.query_id, r.doc_id, r.rank) for r in B.rerank(words, B.rewrite(words, asked, hits=2, terms=2), 2).orderBy("query_id", "rank").collect()]
    # the document that only holds what was added comes in behind those with the question's own term
    assert ranked == [(1, 1, 1), (1, 2, 2), (4, 3, 1)] or ranked == [(1, 2, 1), (1, 1, 2), (4, 3, 1)]
