"""Tensor-like array expressions: argmax, shape products, pixel scaling and channel order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(values: Column) -> Column:
    """struct<score, idx>: the first maximum, 0-based; an empty array gives the lowest float and -1."""
    top = F.array_max(values)
    found = F.struct(top.alias("score"), (F.array_position(values, top) - 1).cast("int").alias("idx"))
    none = F.struct(F.lit(-3.4028234663852886e38).cast("float").alias("score"), F.lit(-1).alias("idx"))
    return F.when(F.size(values) > 0, found).otherwise(none)


def shape_size(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def mean_or_zero(scores: Column) -> Column:
    """Mean in double precision, 0 for none."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(scores) > 0, total / F.size(scores)).otherwise(F.lit(0.0))


def unit_pixels(px: Column) -> Column:
    """Bytes to [0, 1]."""
    return F.transform(px, lambda v: (v.cast("float") / F.lit(255).cast("float")).cast("float"))


def centered_pixels(px: Column) -> Column:
    """Bytes to [-1, 1]."""
    return F.transform(px, lambda v: ((v.cast("double") / 255.0 - 0.5) / 0.5).cast("float"))


def planes_from_pixels(px: Column, height: Column, width: Column) -> Column:
    """Interleaved BGR rows to R, G and B planes."""
    n = height * width
    return F.transform(F.sequence(F.lit(0), 3 * n - 1), lambda i: F.get(px, ((i % n) * 3 + (2 - F.floor(i / n))).cast("int")))


def is_text_pixel(p: Column) -> Column:
    """A probability cast to a byte, halves to even: nonzero only above one half."""
    return F.bround(p.cast("double")).cast("int")
