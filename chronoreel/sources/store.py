"""Stored tables of videos: upserts, deletes and rebuilds as generations of Parquet folders.

Rows are dealt to buckets by a hash of the video.  A change writes the buckets it touches anew, all in one folder of its
own, then a table of which folder each bucket is read from, and at last one small file with the next generation's number,
renamed into place.  Readers follow the newest such file, so they see a whole generation or the one before: a
write that stops half way, or tasks that run again, change nothing.  Of two writers that started from one
generation the second to publish fails and leaves the table as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoreel.operators.index import upsert as latest

#: Buckets of a table: what one change rewrites at least is a bucket, and the driver holds a row for each.
BUCKETS = 64


class ConcurrentWrite(RuntimeError):
    """Another writer published the generation that this one was about to."""


class Store:
    """A table in ``path`` (a folder that driver and executors share), with rows of ``schema`` keyed by ``video``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, video: str = "video_id", buckets: int = BUCKETS):
        self.spark, self.path, self.video, self.buckets = spark, path.rstrip("/"), video, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self._stored = T.StructType([*self.schema.fields, T.StructField("write", T.StringType()), T.StructField("bucket", T.IntegerType())])

    # files

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        target, fs = self._hadoop(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def delete(self, path: str) -> None:
        """A folder or file and all below it."""
        target, fs = self._hadoop(path)
        fs.delete(target, True)

    def generation(self) -> int:
        """The newest published generation; 0 for a table that has none."""
        return max((int(n) for n in self._names(f"{self.path}/published") if n.isdigit()), default=0)

    def heads(self, generation: int | None = None) -> dict[int, str]:
        """The folder from which each filled bucket is read."""
        number = self.generation() if generation is None else generation
        if not number:
            return {}
        write = self.spark.read.text(f"{self.path}/published/{number:09d}").first()[0]
        rows = self.spark.read.schema("bucket int, write string").parquet(f"{self.path}/heads/{write}").collect()
        return {r["bucket"]: r["write"] for r in rows}

    # reading

    def read(self, generation: int | None = None) -> DataFrame:
        """The rows of a generation, the newest by default.  Folders of other writes and buckets are pruned by their names."""
        return self._rows(self.heads(generation))

    def _rows(self, heads: dict[int, str]) -> DataFrame:
        if not heads or not self._names(f"{self.path}/data"):
            return self.spark.createDataFrame([], self.schema)
        of: dict[str, list[int]] = {}
        for bucket, write in heads.items():
            of.setdefault(write, []).append(bucket)
        live = F.lit(False)
        for write, buckets in sorted(of.items()):
            live = live | ((F.col("write") == write) & F.col("bucket").isin(*buckets))
        return self.spark.read.schema(self._stored).parquet(f"{self.path}/data").where(live).select(*self.schema.names)

    # writing

    def bucket(self, video=None) -> F.Column:
        return F.pmod(F.xxhash64(F.col(self.video) if video is None else video), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def change(self, touched: list[int], make: Callable[[DataFrame], DataFrame]) -> int:
        """Publishes a generation in which the rows of the touched buckets are what ``make`` makes of them, and returns
        its number; without a touched bucket nothing is written."""
        start = self.generation()
        if not touched:
            return start
        before = self.heads(start)
        write = f"w{uuid.uuid4().hex}"
        rows = make(self._rows({b: w for b, w in before.items() if b in touched}))
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields)).withColumn("bucket", self.bucket())
        folder = f"{self.path}/data/write={write}"
        # adaptive execution splits a large bucket, as of a hot video, and joins small ones
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
        filled = {int(n.removeprefix("bucket=")) for n in self._names(folder) if n.startswith("bucket=")}
        after = {b: w for b, w in before.items() if b not in touched} | {b: write for b in filled}
        self.spark.createDataFrame(sorted(after.items()), "bucket int, write string").coalesce(1).write.parquet(f"{self.path}/heads/{write}")
        self._publish(start + 1, write)
        return start + 1

    def _publish(self, generation: int, write: str) -> None:
        """Renames a file that names the write to the generation's number, unless that is there."""
        jvm = self.spark._jvm
        draft, fs = self._hadoop(f"{self.path}/drafts/{write}")
        out = fs.create(draft, True)
        out.write(bytearray(f"{write}\n".encode()))
        out.close()
        final, _ = self._hadoop(f"{self.path}/published/{generation:09d}")
        fs.mkdirs(final.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), none)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise ConcurrentWrite(f"generation {generation} of {self.path} was published by another writer") from error
            raise

    def upsert(self, rows: DataFrame, keys: list[str], version: str, *ties: str) -> int:
        """Of all rows of a key, stored and new, the one with the greatest version stays."""
        return self.change(self._touched(rows), lambda old: latest(old, rows, keys, version, *ties))

    def remove(self, videos: DataFrame) -> int:
        """Without the rows of these videos (null among them, if given)."""
        return self.change(self._touched(videos), lambda old: old.join(videos.select(self.video).distinct().withColumnRenamed(self.video, "__gone"), F.col(self.video).eqNullSafe(F.col("__gone")), "left_anti"))

    def rebuild(self, videos: DataFrame, rows: DataFrame) -> int:
        """These videos' rows are replaced by ``rows``, which may have none for some; rows of other videos don't count."""
        named = videos.select(self.video).distinct().withColumnRenamed(self.video, "__named")
        mine = F.col(self.video).eqNullSafe(F.col("__named"))
        return self.change(self._touched(videos), lambda old: old.join(named, mine, "left_anti").unionByName(rows.join(named, mine, "left_semi").select(*self.schema.names)))

    def clean(self, keep: int = 2) -> int:
        """Deletes what none of the last ``keep`` generations reads, half-done writes among it, and returns how many writes
        went.  Not to be run beside a writer, or while older generations are read."""
        numbers = [int(n) for n in self._names(f"{self.path}/published") if n.isdigit()]
        kept = sorted(numbers)[-keep:]
        heads = {self.spark.read.text(f"{self.path}/published/{n:09d}").first()[0] for n in kept}
        data = {w for n in kept for w in self.heads(n).values()}
        for n in set(numbers) - set(kept):
            self.delete(f"{self.path}/published/{n:09d}")
        for name in set(self._names(f"{self.path}/heads")) - heads:
            self.delete(f"{self.path}/heads/{name}")
        gone = [n for n in self._names(f"{self.path}/data") if n.removeprefix("write=") not in data]
        for name in gone:
            self.delete(f"{self.path}/data/{name}")
        self.delete(f"{self.path}/drafts")
        return len(gone)
