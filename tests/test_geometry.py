"""Geometry against plain Python, on generated rectangles with ties, zero sizes and exact halves."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lumenframe.functions import geometry as G

f = np.float32


def away(v):
    return int(math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1))


def py_scale(x, y, w, h, mw, mh, ow, oh):
    gain = min(f(mh) / f(oh), f(mw) / f(ow))
    px, py = away(f(f(mw) - f(f(ow) * gain)) / f(2)), away(f(f(mh) - f(f(oh) * gain)) / f(2))
    x, y, w, h = away(f(f(x - px) / gain)), away(f(f(y - py) / gain)), away(f(f(w) / gain)), away(f(f(h) / gain))
    x, y = max(0, min(x, ow)), max(0, min(y, oh))
    return x, y, max(0, min(w, ow - x)), max(0, min(h, oh - y))


def test_scale_coords(spark):
    rnd = random.Random(4)
    rows = [tuple(rnd.choice([-5, 0, 1, 7, 100, 639]) for _ in range(4)) + (640, 480, rnd.choice([1, 33, 640, 1280, 1921]), rnd.choice([1, 47, 480, 961])) for _ in range(300)]
    df = spark.createDataFrame(rows, "x int, y int, w int, h int, mw int, mh int, ow int, oh int")
    r = F.struct("x", "y", "w", "h")
    got = df.select("*", G.scale_coords(r, *(F.col(c) for c in ("mw", "mh", "ow", "oh"))).alias("b")).collect()
    for row in got:
        assert tuple(row.b) == py_scale(*row[:8]), row


def test_rounding_rules(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 1.5, 2.5, -0.5, -1.5, -2.5, -2.7)], "v float")
    got = df.select(G.half_even(F.col("v")), G.away(F.col("v")), G.int_of(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(0, 1, 0), (2, 2, 1), (2, 3, 2), (0, -1, 0), (-2, -2, -1), (-2, -3, -2), (-3, -3, -2)]


def test_overlap_of_empty_boxes(spark):
    rows = [((0, 0, 0, 0), (5, 5, 0, 0)), ((0, 0, 2, 2), (0, 0, 0, 0)), ((0, 0, 2, 2), (1, 1, 2, 2)), ((0, 0, 2, 2), (9, 9, 2, 2))]
    df = spark.createDataFrame(rows, "a struct<x: int, y: int, w: int, h: int>, b struct<x: int, y: int, w: int, h: int>")
    got = [tuple(r) for r in df.select(G.iou(F.col("a"), F.col("b")), G.hull_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [(1.0, None), (0.0, 0.0), (1 / 7, 1 / 9), (0.0, 0.0)]


def test_pad_and_letterbox(spark):
    df = spark.createDataFrame([(100, 50), (64, 32), (1, 1)], "w int, h int")
    t = df.select(G.detection_target(F.col("w"), F.col("h")).alias("t")).select("t.*").collect()
    assert tuple(t[0]) == (128, 64, 128, 64, 0, 0)
    assert tuple(t[1]) == (64, 32, 64, 32, 0, 0)
    assert tuple(t[2]) == (32, 32, 32, 32, 0, 0)
