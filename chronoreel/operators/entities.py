"""Entities: best match, as-of match, reference resolution, online clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCH, RESOLVE = 0.75, 0.60

# Cues of references to earlier entities.
JUST_NOW = "(刚才的?|之前的?|上一个)"
BEGINNING = "(开头的?|开始的?|一开始的?|最初的?)"
ENDING = "(结尾的?|最后的?|结束的?)"


def best_entity(scored: DataFrame, least: float, by: str = "query_id", key: str = "entity_id") -> DataFrame:
    """(by, key, score) of the best scored entity of each query if it reaches ``least``; ties go to the smaller key."""
    best = Window.partitionBy(by).orderBy(F.col("score").desc(), key)
    return scored.withColumn("__n", F.row_number().over(best)).where((F.col("__n") == 1) & (F.col("score") >= least)).drop("__n")


def entity_asof(anchors: DataFrame, entities: DataFrame) -> DataFrame:
    """(video_id, anchor_id, entity_id, last_ms): the entity whose last appearance is nearest before or at the anchor.

    One pass: entities and anchors of a video are ordered together and the latest entity seen is carried forward, so
    no pair is formed.  Of entities that appeared last at one time the smallest id counts; an anchor without an
    earlier entity has none.  ``anchors`` has anchor_id and anchor_ms, ``entities`` entity_id and last_ms (null or
    negative: never appeared).
    """
    seen = entities.where(F.col("last_ms") >= 0).groupBy("video_id", "last_ms").agg(F.min("entity_id").alias("entity_id"))
    seen = seen.select("video_id", F.col("last_ms").alias("at"), F.lit(0).alias("kind"), F.struct("last_ms", "entity_id").alias("e"), F.lit(None).cast(anchors.schema["anchor_id"].dataType).alias("anchor_id"))
    asked = anchors.select("video_id", F.col("anchor_ms").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(seen.schema["e"].dataType).alias("e"), "anchor_id")
    order = Window.partitionBy("video_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = seen.unionByName(asked).withColumn("e", F.last("e", ignorenulls=True).over(order))
    return carried.where("kind = 1").select("video_id", "anchor_id", F.col("e.entity_id").alias("entity_id"), F.col("e.last_ms").alias("last_ms"))


def resolve(reference: Column, anchor_ms: Column, just_now: Column, earliest: Column, latest: Column, similar: Column) -> Column:
    """The entity a reference means, by the first cue that finds one; else the most similar."""
    return F.coalesce(
        F.when(reference.rlike(JUST_NOW) & (anchor_ms > 0), just_now),
        F.when(reference.rlike(BEGINNING), earliest),
        F.when(reference.rlike(ENDING), latest),
        similar,
    )


def extremes(entities: DataFrame) -> DataFrame:
    """(video_id, earliest, latest) by first and last appearance; never seen counts as -1; ties go to the smaller id."""
    first, last = F.coalesce("first_ms", F.lit(-1)), F.coalesce("last_ms", F.lit(-1))
    return entities.groupBy("video_id").agg(F.min_by("entity_id", F.struct(first, "entity_id")).alias("earliest"), F.min_by("entity_id", F.struct(-last, "entity_id")).alias("latest"))


def next_suffix(entity_ids: Column) -> Column:
    """One more than the greatest number after a trailing underscore (aggregate)."""
    return F.coalesce(F.max(F.regexp_extract(entity_ids, r"_(\d+)$", 1).try_cast("int")), F.lit(0)) + 1


def cluster(descriptions: DataFrame, threshold: float = MATCH) -> DataFrame:
    """Online leader clustering within each video, in the order of (ts_ms, desc_id): a description joins the entity whose
    first description is most similar, if the cosine reaches ``threshold``, else opens ``<entity_type>_<n>``.

    Order decides, so one task reads a video's descriptions, sorted by Spark and as Arrow batches; it holds a batch and the
    first descriptions of the current video's entities.  Null times and ids come last.
    """
    schema = "video_id long, desc_id long, ts_ms long, entity_id string, opened boolean"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, current = False, None
        leaders, names = np.zeros((0, 0)), []
        for batch in batches:
            found, fresh = [], []
            for video, kind, vector in zip(batch.column("video_id").to_pylist(), batch.column("entity_type").to_pylist(), batch.column("embedding"), strict=True):
                v = np.asarray(vector.values, dtype=np.float64)
                if not started or video != current:
                    started, current = True, video
                    leaders, names = np.zeros((8, len(v))), []
                length = np.sqrt(v @ v)
                v = v / length if length > 0 else v
                n = len(names)
                scores = leaders[:n] @ v
                best = int(scores.argmax()) if n else -1
                new = n == 0 or scores[best] < threshold
                if new:
                    if n == len(leaders):
                        leaders = np.vstack([leaders, np.zeros_like(leaders)])
                    leaders[n] = v
                    names.append(f"{kind}_{n + 1}")
                    best = n
                found.append(names[best])
                fresh.append(bool(new))
            ids = [batch.column(c) for c in ("video_id", "desc_id", "ts_ms")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(found, pa.string()), pa.array(fresh, pa.bool_())], ["video_id", "desc_id", "ts_ms", "entity_id", "opened"])

    ids = [F.col(c).cast("long").alias(c) for c in ("video_id", "desc_id", "ts_ms")]
    rows = descriptions.select(*ids, "entity_type", "embedding").repartition("video_id")
    return rows.sortWithinPartitions("video_id", F.col("ts_ms").asc_nulls_last(), F.col("desc_id").asc_nulls_last()).mapInArrow(assign, schema)


def appearances(assigned: DataFrame) -> DataFrame:
    """(video_id, entity_id, first_ms, last_ms, n) of clustered descriptions."""
    return assigned.groupBy("video_id", "entity_id").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("n"))
