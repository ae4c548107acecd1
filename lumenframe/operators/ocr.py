"""Text detection from probability maps and recognition from step scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import geometry as G
from lumenframe.functions.arrays import argmax, mean_or_zero
from lumenframe.functions.geometry import hull_ratio
from lumenframe.operators.components import dilated, mask_boxes
from lumenframe.operators.lookup import character
from lumenframe.operators.score import float_rows
from lumenframe.operators.suppress import fold
from lumenframe.schema import OCR_THRESHOLD
from lumenframe.cluster import ship


def best_steps(steps: Column) -> Column:
    """The best class of each time step: array<struct<score, idx>>."""
    return F.transform(steps, argmax)


def kept_steps(best: Column, threshold: float = OCR_THRESHOLD) -> Column:
    """Steps that are no blank and above the threshold; repeats are not merged."""
    t = F.lit(threshold).cast("float")
    return F.filter(best, lambda s: (s["idx"] != 0) & (s["score"] > t))


def read_line(steps: Column, dictionary: Column, threshold: float = OCR_THRESHOLD) -> Column:
    """struct<line, confidence> from the scores of all steps and a map from index to character."""
    kept = kept_steps(best_steps(steps), threshold)
    return F.struct(
        F.array_join(F.transform(kept, lambda s: character(s["idx"], dictionary)), "").alias("line"),
        mean_or_zero(F.transform(kept, lambda s: s["score"])).cast("float").alias("confidence"),
    )


def first_line(lines: Column) -> Column:
    """Of a recognition result the first line counts, even if its text is empty."""
    return F.get(lines, 0)


def dilate(mask: Column, width: Column, reach: int = 3) -> Column:
    """A map's array of rows with each element the maximum over the ``reach`` before it, in both directions.

    Three passes of a 2 x 2 kernel anchored at its lower right corner are one maximum over four columns and
    four rows, and that is two passes over the array: no pixel leaves its row.
    """

    def backward(values: Column, step: Column, inside) -> Column:
        near = lambda v, i: [F.when(inside(i, k), F.get(values, (i - k * step).cast("int"))) for k in range(1, reach + 1)]
        return F.transform(values, lambda v, i: F.greatest(v, *near(v, i)))

    across = backward(mask, F.lit(1), lambda i, k: i % width >= k)
    return F.transform(F.array(across), lambda m: backward(m, width, lambda i, k: i >= k * width))[0]


def detect_boxes(maps: DataFrame, threshold: float = 0.3, min_area: int = 64) -> DataFrame:
    """Maps (frame_id, width, height, probs, orig_w, orig_h) to text boxes in image coordinates.

    The task that has a map binarises, dilates and labels it and gives one row with its boxes, so nothing is shuffled and a map is read
    once. Boxes are deduplicated in model coordinates, in component order, and scaled after that.
    """
    ship(maps.sparkSession)
    box = pa.struct([(c, pa.int32()) for c in ("box_no", "x", "y", "w", "h")])
    names = ["frame_id", "width", "height", "orig_w", "orig_h"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at = [], [0]
            for w, h, probs in zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), float_rows(batch.column("probs")), strict=True):
                mask = np.zeros((0, 0), bool) if probs is None else probs.reshape(h, w) > 0.5
                boxes = mask_boxes(dilated(mask)) if mask.size else np.zeros((0, 4), np.int64)
                found.append(np.concatenate([np.arange(len(boxes))[:, None], boxes], 1))
                at.append(at[-1] + len(boxes))
            cols = np.concatenate(found).astype(np.int32) if found else np.zeros((0, 5), np.int32)
            boxes = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(cols[:, i])) for i in range(5)], fields=list(box)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), boxes], [*names, "boxes"])

    kinds = ", ".join(f"{c} {maps.schema[c].dataType.simpleString()}" for c in names)
    labelled = maps.select(*names, "probs").mapInArrow(label, f"{kinds}, boxes array<struct<box_no:int,x:int,y:int,w:int,h:int>>")
    large = F.filter("boxes", lambda b: b["w"] * b["h"] > min_area)
    kept = labelled.select(*names, F.explode_outer(fold(large, lambda k, b: F.coalesce(hull_ratio(k, b) > threshold, F.lit(False)))).alias("_r")).where("_r IS NOT NULL")
    scaled = kept.withColumn("_b", G.scale_coords(F.col("_r"), *(F.col(c) for c in ("width", "height", "orig_w", "orig_h"))))
    return scaled.select("frame_id", F.col("_r.box_no").alias("box_no"), *(F.col(f"_b.{c}").alias(c) for c in "xywh"))
