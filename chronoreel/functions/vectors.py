"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0 for null, empty, unequally long or zero vectors."""
    lengths = norm(a) * norm(b)
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.coalesce(F.when(fits, F.when(lengths > 0, dot(a, b) / lengths)), F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """The vector over its length; vectors no longer than 1e-8 stay as they are."""
    length = norm(a)
    return F.when(length > 1e-8, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def histogram_distance(p: Column, q: Column, channels: int = 3, normalized: bool = False) -> Column:
    """1 minus the Bhattacharyya sum of two histograms whose channels each sum to one, clamped to [0, 1].

    The sum of three channels reaches 3, so identical frames are far below zero before clamping;
    ``normalized`` divides it by the number of channels.
    """
    total = F.aggregate(F.zip_with(p, q, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, x: s + x)
    if normalized:
        total = total / channels
    return F.least(F.greatest(1 - total, F.lit(0.0)), F.lit(1.0))
