"""Lifecycle of the chunk index and of the tables beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str, *ties: str) -> DataFrame:
    """Replace on key: of all rows of a key the one with the greatest version stays, whole.  Validity is the caller's
    filter.  Equal keys and versions fall to the greatest ``ties``."""
    rows = existing.unionByName(incoming, allowMissingColumns=True)
    newest = Window.partitionBy(*keys).orderBy(F.col(version).desc(), *(F.col(t).desc() for t in ties))
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def update_fields(rows: DataFrame, changes: DataFrame, key: str, at: str, *fields: str) -> DataFrame:
    """``rows`` with the newest given value of each field: ``changes`` has the key, ``at`` and fields, of which null ones stay as
    they are; ``at`` becomes the time of the last change that is not older.  Changes of unknown keys are dropped."""
    last = changes.groupBy(key).agg(F.max(at).alias("__at"), *(F.max(F.when(F.col(f).isNotNull(), F.struct(at, f))).alias(f"__{f}") for f in fields))
    met = rows.join(last, key, "left")
    values = [F.when(F.coalesce(F.col(f"__{f}")[at] >= F.col(at), F.lit(False)), F.col(f"__{f}")[f]).otherwise(F.col(f)).alias(f) for f in fields]
    kept = {f: v for f, v in zip(fields, values, strict=True)} | {at: F.greatest(at, "__at").alias(at)}
    return met.select(*(kept.get(c, F.col(c)) for c in rows.columns))


def merge_recent(opened: DataFrame) -> DataFrame:
    """(path, last_opened, duration_ms): the last opening, and the latest positive duration, 0 if there is none.
    ``opened`` has path, opened_at and duration_ms."""
    positive = F.max(F.when(F.col("duration_ms") > 0, F.struct("opened_at", "duration_ms")))
    g = opened.groupBy("path").agg(F.max("opened_at").alias("last_opened"), positive.alias("p"))
    return g.select("path", "last_opened", F.coalesce("p.duration_ms", F.lit(0).cast("long")).alias("duration_ms"))


def recent(files: DataFrame, limit: int = 60) -> DataFrame:
    """The most recently opened files."""
    return files.orderBy(F.col("last_opened").desc(), "path").limit(limit)


def delete_video(table: DataFrame, video_id) -> DataFrame:
    return table.where(~F.col("video_id").eqNullSafe(F.lit(video_id)))


def delete_collection(chunks: DataFrame, video_id, collection) -> DataFrame:
    return chunks.where(~(F.col("video_id").eqNullSafe(F.lit(video_id)) & F.col("collection").eqNullSafe(F.lit(collection))))


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the keys in ``gone``."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def drop_stale(rows: DataFrame, now_ms: int, days: int = 30, at: str = "accessed_ms") -> DataFrame:
    """Rows accessed within ``days`` of ``now_ms``."""
    return rows.where(F.col(at) >= now_ms - days * 86_400_000)


def append_missing(existing: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``existing`` and those of ``found`` whose key it lacks."""
    return existing.unionByName(found.join(existing.select(key), key, "left_anti"))


def video_summary(chunks: DataFrame, created: str = "created_ms", path: str = "file_path") -> DataFrame:
    """One row a video: chunk counts by collection (entity chunks stay out of the total), level, last indexing, and the
    file path of the first collection of text, visual and cache that has one."""
    c = F.col("collection")
    n = lambda i: F.count_if(c == i).alias
    priority = F.when(c == 1, 0).when(c == 0, 1).when(c == 3, 2)
    named = F.min_by(path, F.when(priority.isNotNull() & (F.coalesce(F.col(path), F.lit("")) != ""), F.struct(priority.alias("p"), F.col("chunk_id").alias("c"))))
    g = chunks.groupBy("video_id").agg(
        n(0)("n_visual"), n(1)("n_text"), n(3)("n_qa"), F.max(created).alias("last_indexed"), F.bool_or((c == 1) & (F.col("chunk_type") == "SceneSummary")).alias("described"), named.alias("path")
    )
    level = F.when(F.col("described"), 2).when(F.col("n_text") > 0, 1).when(F.col("n_visual") > 0, 0).otherwise(-1)
    short = F.concat(F.left(F.col("video_id").cast("string"), F.lit(16)), F.lit("..."))
    name = F.coalesce(F.substring_index("path", "/", -1), short)
    return g.select("video_id", "n_visual", "n_text", "n_qa", (F.col("n_visual") + F.col("n_text") + F.col("n_qa")).alias("total"), level.alias("level"), "last_indexed", name.alias("file_name"))


def by_recency(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Distinct keys, the latest first."""
    return rows.groupBy(key).agg(F.max(at).alias(at)).orderBy(F.col(at).desc(), key)


def search_box(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with ``needle`` in any of the columns, whatever the case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.col(c).cast("string")).contains(needle.lower())
    return rows.where(F.coalesce(found, F.lit(False)))


def last_per_key(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    latest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(latest)).where(F.col("__n") <= n).drop("__n")


def current_generation(rows: DataFrame, key: str, generation: str) -> DataFrame:
    """Rows of each key's greatest generation; what superseded tasks wrote is dropped."""
    top = rows.groupBy(key).agg(F.max(generation).alias("__top"))
    return rows.join(top, key).where(F.col(generation) == F.col("__top")).drop("__top")


def collection_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("video_id", "collection").agg(F.count(F.lit(1)).alias("n"))


def cacheable(question_is_command: Column, confidence: Column, vector: Column) -> Column:
    """Answers worth caching: to questions with a vector that are no player commands, with confidence 0.6 or more."""
    return ~question_is_command & (confidence >= 0.6) & (F.coalesce(F.size(vector), F.lit(0)) > 0)


def qa_chunk(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Q: "), question, F.lit("\nA: "), answer)
