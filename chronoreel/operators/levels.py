"""Progressive levels: staged builds of videos, resumed and renewed only where their inputs changed.

A level is a stored table of rows and one of stamps: what a video was built from, and in which run.  A run goes
through the levels from the lowest.  A video's stamp at a level is a digest of its input rows and, above the lowest level,
the run in which the level below was built for it; so a level opens for a video once the one below is
published, and only videos whose stamp differs are built again.  Rows are published before stamps: a run that stops
in between builds the same videos again next time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoreel.sources.store import BUCKETS, Store

Build = Callable[[DataFrame, dict[str, DataFrame], DataFrame | None], DataFrame]


@dataclass(frozen=True)
class Level:
    """``build`` takes the videos to build, the level's inputs for these, and their rows of the level below; its rows have
    ``schema``, with the video's column."""

    name: str
    inputs: tuple[str, ...]
    schema: str
    build: Build


def digests(tables: Sequence[DataFrame], video: str) -> DataFrame:
    """(video, digest): number, sum and exclusive or of the hashes of each table's rows.  Rows are hashed where they are, so
    a hot video is a few numbers a task."""
    parts = []
    for i, t in enumerate(tables):
        h = F.xxhash64(*sorted(t.columns))
        sums = t.groupBy(video).agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
        parts.append(sums.select(video, F.concat_ws(":", F.lit(i), "n", "s", "x").alias("part")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(video).agg(F.concat_ws(";", F.array_sort(F.collect_list("part"))).alias("digest"))


class Levels:
    """Staged tables in ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, levels: Sequence[Level], video: str = "video_id", kind: str = "long", buckets: int = BUCKETS):
        self.levels, self.video = tuple(levels), video
        self.rows = {x.name: Store(spark, f"{path}/{x.name}/rows", x.schema, video, buckets) for x in levels}
        stamp = f"{video} {kind}, digest string, built long"
        self.stamps = {x.name: Store(spark, f"{path}/{x.name}/stamps", stamp, video, buckets) for x in levels}

    def read(self, name: str) -> DataFrame:
        """The published rows of a level, with the run in which each video was built."""
        return self.rows[name].read().join(self.stamps[name].read().select(self.video, "built"), self.video)

    def stale(self, level: Level, tables: dict[str, DataFrame], below: str | None) -> DataFrame:
        """(video, digest): videos to build or, with a null digest, to take away.  Rows without a video don't count."""
        mine = [tables[n].where(F.col(self.video).isNotNull()) for n in level.inputs]
        now = digests(mine, self.video) if mine else None
        if below:
            opened = self.stamps[below].read().select(self.video, F.col("built").cast("string").alias("below"))
            now = opened.withColumn("digest", F.lit("")) if now is None else now.join(opened, self.video)
            now = now.select(self.video, F.concat_ws("|", "digest", "below").alias("digest"))
        known = self.stamps[level.name].read().select(self.video, F.col("digest").alias("was"))
        return now.join(known, self.video, "full").where(~F.col("digest").eqNullSafe(F.col("was"))).select(self.video, "digest")

    def run(self, tables: dict[str, DataFrame], upto: str | None = None) -> dict[str, int]:
        """Brings the levels up to date, ``upto`` being the last one, and returns how many videos each built or took away."""
        done, below = {}, None
        for level in self.levels:
            rows, stamps = self.rows[level.name], self.stamps[level.name]
            number = stamps.generation() + 1
            # what is stale is settled in a table of its own, so that rows and stamps agree whatever runs again
            draft = f"{stamps.path}-stale-{uuid.uuid4().hex}"
            self.stale(level, tables, below).write.parquet(draft)
            stale = rows.spark.read.schema(T.StructType([stamps.schema[self.video], stamps.schema["digest"]])).parquet(draft)
            done[level.name] = stale.count()
            if done[level.name]:
                videos = stale.where("digest is not null").select(self.video)
                inputs = {n: tables[n].join(videos, self.video, "left_semi") for n in level.inputs}
                lower = self.rows[below].read().join(videos, self.video, "left_semi") if below else None
                rows.rebuild(stale.select(self.video), level.build(videos, inputs, lower))
                stamps.rebuild(stale.select(self.video), stale.where("digest is not null").withColumn("built", F.lit(number)))
            stamps.delete(draft)
            if level.name == upto:
                break
            below = level.name
        return done
