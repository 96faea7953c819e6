"""Pictures as binary columns: histograms and their distances, planes, crops, and batches of fixed shape for a model."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoreel.functions import pixels as P
from chronoreel.functions.vectors import histogram_distance
from chronoreel.session import shared_dir

#: Frames of a batch and their height and width: what the boundary network takes.
WINDOW, HEIGHT, WIDTH = 100, 27, 48
#: Pictures that are worked on together.
ROWS = 64

Model = Callable[[np.ndarray], np.ndarray]
RAW = ("pixels", "width", "height", "format")


def _pictures(batch: pa.RecordBatch, first: int) -> Iterator[np.ndarray | None]:
    for row in zip(*(batch.column(first + i).to_pylist() for i in range(4)), strict=True):
        yield P.picture(*row)


def _with(pictures: DataFrame, name: str, kind: str, arrow: pa.DataType, make: Callable[[np.ndarray], object]) -> DataFrame:
    """``pictures`` (RAW and other columns) without RAW, with ``name`` made of each picture, null for what is none."""
    kept = [c for c in pictures.columns if c not in RAW and c.lower() != name.lower()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                made = [None if p is None else make(p) for p in _pictures(batch, len(kept))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(made, arrow)], [*kept, name])

    schema = T.StructType([*(pictures.schema[c] for c in kept), T.StructField(name, T._parse_datatype_string(kind))])
    return pictures.select(*kept, *RAW).mapInArrow(work, schema)


def histograms(pictures: DataFrame, side: int = P.SIDE) -> DataFrame:
    """With ``histogram``: 48 shares, 16 for each of red, green and blue."""
    return _with(pictures, "histogram", "array<double>", pa.list_(pa.float64()), lambda p: P.histogram(p, side))


def difference(a: Column, b: Column) -> Column:
    """How far two pictures' histograms are apart; 1 if one is no picture."""
    return F.when(a.isNull() | b.isNull(), F.lit(1.0)).otherwise(histogram_distance(a, b))


def regions(pictures: DataFrame, box: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0), fit: tuple[int, int] = (0, 0)) -> DataFrame:
    """With ``region`` (struct of pixels, width and height): each picture's part in a box of shares of its sides, scaled to fit
    into ``fit`` pixels, as RGB."""

    def part(p: np.ndarray) -> dict | None:
        cut = P.cropped(p, *box)
        if cut is None:
            return None
        small = P.scaled_to_fit(cut, *fit)
        return {"pixels": np.ascontiguousarray(small).tobytes(), "width": small.shape[1], "height": small.shape[0]}

    arrow = pa.struct([("pixels", pa.binary()), ("width", pa.int32()), ("height", pa.int32())])
    return _with(pictures, "region", "struct<pixels:binary,width:int,height:int>", arrow, part)


def numbered(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """``rows`` with ``position``: 0, 1, ... within each ``by``, in the order given.

    Rows are sorted by ranges and written once; a range numbers its own rows, and what earlier ranges hold of the
    same ``by`` is added.  So rows of one ``by`` fill as many tasks as they need.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/numbered-{uuid.uuid4().hex}"
    rows.repartitionByRange(by, *order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("__range", T.IntegerType())])).parquet(path)
    before = Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(F.col(by).alias("__by"), F.col("__range").alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("__by", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset")).where("__offset > 0")
    inside = F.row_number().over(Window.partitionBy("__range", by).orderBy(*order)) - 1
    own = dealt.withColumn("position", inside.cast("long"))
    met = own.join(offsets, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__part")), "left")
    return met.withColumn("position", F.col("position") + F.coalesce("__offset", F.lit(0))).drop("__by", "__part", "__offset", "__range")


def changes(batch: np.ndarray) -> np.ndarray:
    """A stand-in for the boundary network: the mean difference of each frame from the next, over 255; 0 for the last."""
    step = np.abs(np.diff(batch, axis=1)).mean(axis=(2, 3, 4)) / np.float32(255)
    return np.concatenate([step, np.zeros((len(batch), 1), dtype=np.float32)], axis=1)


def batch_probabilities(frames: DataFrame, model: Model = changes, by: str = "video_id", order: tuple[str, ...] = ("frame_id",), window: int = WINDOW) -> DataFrame:
    """(by, *order, window, place, n_padded, probability) for each frame.

    ``frames`` has ``by``, ``order`` and RAW.  Each ``window`` frames of a video in order, and the rest of them, are one tensor (1,
    window, 27, 48, 3) of single numbers, filled up with zeros; ``model`` gives a number for each place, of which those
    of frames are dealt back.  What is no picture counts as black.  A group is a window, so no task holds more than one.
    """
    keys = [by, *order]
    placed = numbered(frames.select(*keys, *RAW), by, *order)
    placed = placed.withColumn("window", F.floor(F.col("position") / window)).withColumn("place", (F.col("position") % window).cast("int")).drop("position")
    schema = T.StructType([*(frames.schema[c] for c in keys), *T._parse_datatype_string("window long, place int, n_padded int, probability double")])

    def work(table: pa.Table) -> pa.Table:
        tensor = np.zeros((1, window, HEIGHT, WIDTH, 3), dtype=np.float32)
        places = table.column("place").to_pylist()
        rows = zip(places, *(table.column(c).to_pylist() for c in RAW), strict=True)
        for place, *raw in rows:
            p = P.picture(*raw)
            if p is not None:
                tensor[0, place] = P.mean_scaled(p, WIDTH, HEIGHT)
        found = np.asarray(model(tensor), dtype=np.float64).reshape(-1)[places]
        n = len(places)
        columns = [*(table.column(c) for c in keys), table.column("window"), table.column("place"), pa.array([window - n] * n, pa.int32()), pa.array(found)]
        return pa.table(dict(zip([*keys, "window", "place", "n_padded", "probability"], columns, strict=True)))

    return placed.groupBy(by, "window").applyInArrow(work, schema)
