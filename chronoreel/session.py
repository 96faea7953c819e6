"""Session with the settings the operators are written for."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "chronoreel", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew-join handling; ``conf`` keys use ``__`` for dots.  Workers get the package."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.  Where that is unset, on one machine, a temporary
    folder is set for the session; on a cluster executors would not share it, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronoreel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written in the shared folder and read back, so that later steps don't make it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a context, unless PYTHONPATH already leads there."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    listed = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in listed or getattr(context, "_chronoreel_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="chronoreel-")) / "chronoreel.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted((root / "chronoreel").rglob("*.py")):
            z.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    context._chronoreel_shipped = True
