"""Shared-folder tables: lineage is cut by writing where every executor can read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, on one machine, a temporary folder is set for the
    session; on a cluster executors would not share it, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronoreel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of a few short columns that one task may well write.
ROWS_A_TASK = 100_000


class Scratch:
    """Written intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def save(self, df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
        """Write df as Parquet and read it back with the written schema.  ``rows`` is a bound of df's rows, which must be dealt
        evenly: then a shuffle's partitions are written by as few tasks as that takes, though one a core, as a file costs more than its rows."""
        if rows is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._chronoreel_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later step reads."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._chronoreel_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, *columns: str) -> str:
    """``name``, with as many underscores behind it as it takes to be no column's, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_long(column) -> F.Column:
    """CRC-32 of the UTF-8 bytes, unsigned; null counts as the empty string."""
    return F.crc32(F.coalesce(column, F.lit("")))
