"""Ordered operators read groups as Arrow batches."""

import math

from chronoreel.operators import entities, extras


def test_groups_are_streamed(spark):
    """One video over many Arrow batches: no group is collected, and the pieces and entities are those of a plain loop."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        vectors = [[math.cos(i * i), math.sin(i * i)] for i in range(100)]
        rows = [(1, i, i, "person", v) for i, v in enumerate(vectors)]
        found = entities.cluster(spark.createDataFrame(rows, "video_id long, desc_id long, ts_ms long, entity_type string, embedding array<double>").repartition(5), 0.9)
        leaders, want = [], []
        for v in vectors:
            scores = [a * v[0] + b * v[1] for a, b in leaders]
            if not scores or max(scores) < 0.9:
                leaders.append(v)
                scores.append(1.0)
            want.append(f"person_{scores.index(max(scores)) + 1}")
        assert [r.entity_id for r in found.orderBy("desc_id").collect()] == want and len(leaders) > 5

        said = [(1, i, i * 3000, i * 3000 + 2500, ("a.", "b", "c. ", " ")[i % 4]) for i in range(100)]
        pieces = extras.semantic_segments(spark.createDataFrame(said, "video_id long, seg_idx int, start_ms long, end_ms long, text string").repartition(5))
        cut = []
        for _, _, s, e, t in said:
            p = cut[-1] if cut else None
            if p and e - p[0] <= 30_000 and (p[1] - p[0] < 15_000 or (s - p[1] < 800 and p[3].rstrip()[-1:] != ".")):
                cut[-1] = (p[0], max(p[1], e), p[2] + 1, f"{p[3]} {t}")
            else:
                cut.append((s, e, 1, t))
        assert [tuple(r)[1:] for r in pieces.orderBy("start_ms").collect()] == cut and len(cut) > 10
    finally:
        spark.conf.set(size, was)
    for df in (found, pieces):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "collect_list" not in plan
