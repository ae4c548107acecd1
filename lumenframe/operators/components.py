"""Connected regions of binary maps and their bounding boxes.

A frame's set pixels are brought together once as runs along rows, and runs that touch, eight
neighbours counting, are labelled together. Boxes are numbered in raster order of their first pixel. Contours of holes, which some contour tracers
give as regions of their own, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenframe.cluster import ship


def run_boxes(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """x, y, w and h of each region of runs [start, end) that are sorted by row and start."""
    n = len(row)
    if not n:
        return np.zeros((0, 4), np.int64)
    low = int(start.min())
    s, e = start - low, end - low
    span = int(e.max()) + 2
    place = (row - row.min()) * span
    # the runs of the row above that end at or behind this one's start and start at or before its end
    first = np.searchsorted(place + e, place - span + s, side="left")
    last = np.maximum(np.searchsorted(place + s, place - span + e, side="right"), first)
    count = last - first
    a = np.repeat(np.arange(n), count)
    b = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    _, of = np.unique(label, return_inverse=True)
    k = int(of.max()) + 1
    least, most = np.full((2, k), np.iinfo(np.int64).max), np.full((2, k), np.iinfo(np.int64).min)
    for d, (x, y) in enumerate(((start, end - 1), (row, row))):
        np.minimum.at(least[d], of, x)
        np.maximum.at(most[d], of, y)
    return np.stack([least[0], least[1], most[0] - least[0] + 1, most[1] - least[1] + 1], 1)


def mask_boxes(mask: np.ndarray) -> np.ndarray:
    """x, y, w and h of each region of a boolean map."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge > 0)
    return run_boxes(row, start, np.nonzero(edge < 0)[1])


def dilated(mask: np.ndarray, reach: int = 3) -> np.ndarray:
    """Every set pixel also sets the ``reach`` pixels behind it in both directions."""
    out = mask.copy()
    for axis in (0, 1):
        base = out.copy()
        for k in range(1, min(reach, mask.shape[axis] - 1) + 1):
            np.moveaxis(out, axis, 0)[k:] |= np.moveaxis(base, axis, 0)[:-k]
    return out


def component_boxes(pixels: DataFrame) -> DataFrame:
    """(frame_id, x, y) of set pixels to (frame_id, box_no, x, y, w, h)."""
    ship(pixels.sparkSession)

    def boxes(group: pa.Table) -> pa.Table:
        x, y = group.column("x").to_numpy().astype(np.int64), group.column("y").to_numpy().astype(np.int64)
        order = np.lexsort((x, y))
        x, y = x[order], y[order]
        new = np.ones(len(x), bool)
        new[1:] = (y[1:] != y[:-1]) | (x[1:] > x[:-1] + 1)
        at = np.flatnonzero(new)
        found = run_boxes(y[at], x[at], x[np.append(at[1:], len(x)) - 1] + 1)
        frame = group.column("frame_id")
        cols = {"frame_id": pa.array([frame[0].as_py()] * len(found), frame.type), "box_no": pa.array(np.arange(len(found), dtype=np.int32))}
        return pa.table(cols | {c: pa.array(found[:, i].astype(np.int32)) for i, c in enumerate("xywh")})

    kind = pixels.schema["frame_id"].dataType.simpleString()
    return pixels.select("frame_id", "x", "y").groupBy("frame_id").applyInArrow(boxes, f"frame_id {kind}, box_no int, x int, y int, w int, h int")
