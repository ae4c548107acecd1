"""Object detection post-processing from anchors or rows to detections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import geometry as G
from lumenframe.functions.arrays import argmax
from lumenframe.operators.suppress import nms
from lumenframe.schema import HTTP_THRESHOLD, YOLO_VERSIONS

BOX = ["det_no", "class_id", "x", "y", "w", "h", "confidence"]


def confident(rows: DataFrame, threshold: float, strict: bool = True) -> DataFrame:
    """Version 11 keeps what is above the threshold, version 10 what reaches it."""
    t = F.lit(threshold).cast(rows.schema["confidence"].dataType)
    return rows.where(F.col("confidence") > t if strict else F.col("confidence") >= t)


def best_class(scores: Column) -> Column:
    return argmax(scores)


def decode_v11(anchors: DataFrame, threshold: float = HTTP_THRESHOLD, suppress: bool = True) -> DataFrame:
    """Rows (frame_id, det_no, cx, cy, bw, bh, scores, model_w, model_h, orig_w, orig_h) to detections.

    The order matters: best class, filter, corner, integers (halves to even), scaling with clipping, then
    suppression on the clipped integers.
    """
    best = anchors.withColumn("_best", best_class(F.col("scores")))
    best = confident(best.select("*", F.col("_best.score").alias("confidence"), F.col("_best.idx").alias("class_id")), threshold)
    corner = G.int_rect(G.corner_from_center(F.col("cx"), F.col("cy"), F.col("bw"), F.col("bh")))
    scaled = best.withColumn("_r", corner).withColumn("_b", G.scale_coords(F.col("_r"), *(F.col(c) for c in ("model_w", "model_h", "orig_w", "orig_h"))))
    found = scaled.select("frame_id", "det_no", "class_id", *(F.col(f"_b.{c}").alias(c) for c in "xywh"), "confidence")
    return nms(found, carry=BOX) if suppress else found


def decode_v10(rows: DataFrame, threshold: float = HTTP_THRESHOLD, suppress: bool = True) -> DataFrame:
    """Rows (frame_id, det_no, left, top, right, bottom, confidence, class_id, model_w, model_h, orig_w, orig_h) to detections."""
    best = confident(rows, threshold, strict=False)
    r = G.unscale_by_axis(*(F.col(c) for c in ("left", "top", "right", "bottom", "model_w", "model_h", "orig_w", "orig_h")))
    found = best.withColumn("_b", r).select("frame_id", "det_no", F.col("class_id").cast("int").alias("class_id"), *(F.col(f"_b.{c}").alias(c) for c in "xywh"), "confidence")
    return nms(found, carry=BOX) if suppress else found


@dataclass(frozen=True)
class Decoder:
    """How a model's output becomes rows and these become detections.

    ``transposed`` says that anchors are the output's last axis; ``columns`` takes rows (frame_id, det_no, values, model_w, model_h, orig_w, orig_h),
    values being one anchor's numbers, and gives what ``decode`` takes with a threshold.
    """

    transposed: bool
    columns: Callable[[DataFrame], DataFrame]
    decode: Callable[[DataFrame, float], DataFrame]


def anchor_columns(rows: DataFrame) -> DataFrame:
    v = F.col("values")
    return rows.select("*", *(v[i].alias(c) for i, c in enumerate(("cx", "cy", "bw", "bh"))), F.slice(v, F.lit(5), F.size(v) - 4).alias("scores"))


def corner_columns(rows: DataFrame) -> DataFrame:
    v = F.col("values")
    return rows.select("*", *(v[i].alias(c) for i, c in enumerate(("left", "top", "right", "bottom", "confidence"))), v[5].cast("int").alias("class_id"))


DECODERS: dict[str, Decoder] = {"kV11": Decoder(True, anchor_columns, decode_v11), "kV10": Decoder(False, corner_columns, decode_v10)}


def register_decoder(version: str, decoder: Decoder) -> None:
    """Add a version, such as a custom one, or replace it."""
    if version not in YOLO_VERSIONS:
        raise ValueError(f"kParameterError: {version} is no version of a detection model")
    DECODERS[version] = decoder


def decoder_of(version: str) -> Decoder:
    if version not in DECODERS:
        raise ValueError(f"kParameterError: no decoder for version {version}")
    return DECODERS[version]


def decode(rows: DataFrame, version: str, threshold: float = HTTP_THRESHOLD) -> DataFrame:
    return decoder_of(version).decode(rows, threshold)
