"""Greedy overlap suppression within frames: an ordered fold, as a suppressed box must not suppress others.

One shuffle brings a frame's boxes together; the fold runs over their sorted array. A frame is bounded by
what a model gives for one image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.geometry import hull_ratio, iou
from lumenframe.schema import NMS_THRESHOLD
from lumenframe.cluster import ship


def fold(boxes: Column, overlaps) -> Column:
    """Keep a box if it overlaps none kept before it; ``overlaps`` says whether two do."""
    none = F.filter(boxes, lambda b: F.lit(False))
    return F.aggregate(boxes, none, lambda kept, b: F.when(F.exists(kept, lambda k: overlaps(k, b)), kept).otherwise(F.concat(kept, F.array(b))))


def by_frame(rows: DataFrame, frame: str) -> DataFrame:
    """Frames dealt to as many tasks as the session asks for: folds cost far more than their bytes say, so few large tasks would be slow."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), frame)


def _folded(rows: DataFrame, frame: str, order: list[Column], carry: list[str], overlaps) -> DataFrame:
    box = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), *(F.col(c) for c in carry))
    grouped = by_frame(rows, frame).groupBy(frame).agg(F.array_sort(F.collect_list(box)).alias("_b"))
    # explode_outer: a plain explode would have the optimizer evaluate the fold once more in a filter; no frame is empty here
    kept = grouped.select(frame, F.explode_outer(fold(F.col("_b"), overlaps)).alias("_k"))
    return kept.select(frame, *(F.col(f"_k.{c}").alias(c) for c in carry))


def nms(rows: DataFrame, *, frame: str = "frame_id", order: str = "det_no", threshold: float = NMS_THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """Class-agnostic suppression by falling confidence, ties by input order; scores of zero or less never enter."""
    carry = carry or [c for c in rows.columns if c != frame]
    return _folded(rows.where(F.col("confidence") > 0), frame, [-F.col("confidence"), F.col(order)], carry, lambda k, b: iou(k, b) > threshold)


def large_enough(rows: DataFrame, min_area: int) -> DataFrame:
    """Boxes of more than ``min_area`` pixels."""
    return rows.where(F.col("w") * F.col("h") > min_area)


def hull_dedupe(rows: DataFrame, *, frame: str = "frame_id", order: str = "box_no", threshold: float = NMS_THRESHOLD, min_area: int | None = 64, carry: list[str] | None = None) -> DataFrame:
    """Suppression in input order by the hull ratio; 0/0 overlaps nothing. Boxes of at most ``min_area`` are dropped before."""
    carry = carry or [c for c in rows.columns if c != frame]
    rows = rows if min_area is None else large_enough(rows, min_area)
    return _folded(rows, frame, [F.col(order)], carry, lambda k, b: F.coalesce(hull_ratio(k, b) > threshold, F.lit(False)))


def nms_dense(rows: DataFrame, *, frame: str = "frame_id", order: str = "det_no", threshold: float = NMS_THRESHOLD) -> DataFrame:
    """The same result as ``nms`` for very dense frames: numpy per frame, through Arrow."""
    import numpy as np
    import pyarrow as pa

    ship(rows.sparkSession)

    def keep(group: pa.Table) -> pa.Table:
        x, y, w, h = (group.column(c).to_numpy().astype(np.float64) for c in "xywh")
        rank = np.lexsort((group.column(order).to_numpy(), -group.column("confidence").to_numpy()))
        alive, kept = np.ones(len(rank), bool), []
        for at, i in enumerate(rank):
            if not alive[at]:
                continue
            kept.append(i)
            rest = rank[at + 1 :]
            inter = np.maximum(0, np.minimum(x[i] + w[i], x[rest] + w[rest]) - np.maximum(x[i], x[rest])) * np.maximum(0, np.minimum(y[i] + h[i], y[rest] + h[rest]) - np.maximum(y[i], y[rest]))
            both = w[i] * h[i] + w[rest] * h[rest]
            with np.errstate(invalid="ignore", divide="ignore"):
                ratio = np.where(both <= 0, 1.0, inter / (both - inter))
            alive[at + 1 :] &= ~(ratio > threshold)
        return group.take(pa.array(kept))

    return by_frame(rows.where(F.col("confidence") > 0), frame).groupBy(frame).applyInArrow(keep, rows.schema)
