"""Rectangle and resize geometry as Columns. Decisions are made in single precision, as the models give it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("float")


def int_of(c: Column) -> Column:
    """Toward zero, as a C cast does."""
    return c.cast("int")


def away(c: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.round(c).cast("int")


def half_even(c: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.bround(c).cast("int")


def rect(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def corner_from_center(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Float rectangle with its corner half a size from the centre."""
    return rect(f32(f32(cx) - f32(w) * f32(0.5)), f32(f32(cy) - f32(h) * f32(0.5)), f32(w), f32(h))


def int_rect(r: Column) -> Column:
    """A float rectangle's fields to integers, halves to even."""
    return rect(*(half_even(r[c]) for c in "xywh"))


def scale_coords(r: Column, model_w: Column, model_h: Column, orig_w: Column, orig_h: Column, clip: bool = True) -> Column:
    """From letterboxed model coordinates back to the image: one gain for both axes, padding off, halves away from zero."""
    gain = F.least(f32(model_h) / f32(orig_h), f32(model_w) / f32(orig_w)).cast("float")
    pad_x = away(f32(f32(f32(model_w) - f32(f32(orig_w) * gain)) / f32(2.0)))
    pad_y = away(f32(f32(f32(model_h) - f32(f32(orig_h) * gain)) / f32(2.0)))
    x, y = away(f32(f32(r["x"] - pad_x) / gain)), away(f32(f32(r["y"] - pad_y) / gain))
    w, h = away(f32(f32(r["w"]) / gain)), away(f32(f32(r["h"]) / gain))
    return clip_rect(rect(x, y, w, h), orig_w, orig_h) if clip else rect(x, y, w, h)


def clip_rect(r: Column, width: Column, height: Column) -> Column:
    """Corner into the image first, then the size into what is left from there."""
    x = F.greatest(F.lit(0), F.least(r["x"], width))
    y = F.greatest(F.lit(0), F.least(r["y"], height))
    return rect(x, y, F.greatest(F.lit(0), F.least(r["w"], width - x)), F.greatest(F.lit(0), F.least(r["h"], height - y)))


def unscale_by_axis(left: Column, top: Column, right: Column, bottom: Column, model_w: Column, model_h: Column, orig_w: Column, orig_h: Column) -> Column:
    """Corners to the image with a scale for each axis; truncated, not clipped. The padding is zero but for rounding."""
    sx, sy = f32(f32(model_w) / f32(orig_w)), f32(f32(model_h) / f32(orig_h))
    pad_x = int_of((model_w - int_of(f32(f32(orig_w) * sx))) / 2)
    pad_y = int_of((model_h - int_of(f32(f32(orig_h) * sy))) / 2)
    x0, y0 = f32(f32(f32(left) - f32(pad_x)) / sx), f32(f32(f32(top) - f32(pad_y)) / sy)
    x1, y1 = f32(f32(f32(right) - f32(pad_x)) / sx), f32(f32(f32(bottom) - f32(pad_y)) / sy)
    return rect(int_of(x0), int_of(y0), int_of(f32(x1 - x0)), int_of(f32(y1 - y0)))


def pad_length(n: Column, pad: int = 32) -> Column:
    """Up to the next multiple."""
    return (n + F.pmod(F.lit(pad) - n % pad, F.lit(pad))).cast("int")


def letterbox(width: Column, height: Column, target_w: Column, target_h: Column) -> Column:
    """struct<new_w, new_h, left, top>: the smaller ratio scales both sides, sizes truncate, the rest is halved."""
    scale = F.least(f32(target_w) / f32(width), f32(target_h) / f32(height)).cast("float")
    nw, nh = int_of(f32(f32(width) * scale)), int_of(f32(f32(height) * scale))
    return F.struct(nw.alias("new_w"), nh.alias("new_h"), int_of((target_w - nw) / 2).alias("left"), int_of((target_h - nh) / 2).alias("top"))


def detection_target(width: Column, height: Column) -> Column:
    """Text detection's input: sides padded to 32, then letterboxed, which may enlarge the image."""
    tw, th = pad_length(width), pad_length(height)
    box = letterbox(width, height, tw, th)
    return F.struct(tw.alias("target_w"), th.alias("target_h"), *(box[c].alias(c) for c in ("new_w", "new_h", "left", "top")))


def recognition_target(r: Column, fixed_height: int = 48) -> Column:
    """Width and height that a text crop is stretched to."""
    scale = f32(f32(fixed_height) / f32(r["h"]))
    return F.struct(pad_length(int_of(f32(scale * f32(r["w"]))), fixed_height).alias("width"), F.lit(fixed_height).alias("height"))


def scale_rect(r: Column, by_w: float, by_h: float) -> Column:
    """Grow about the centre with integer halves."""
    nw, nh = int_of(r["w"].cast("double") * F.lit(by_w)), int_of(r["h"].cast("double") * F.lit(by_h))
    cx, cy = r["x"] + int_of(r["w"] / 2), r["y"] + int_of(r["h"] / 2)
    return rect(cx - int_of(nw / 2), cy - int_of(nh / 2), nw, nh)


def area(r: Column) -> Column:
    return r["w"].cast("double") * r["h"].cast("double")


def intersection_area(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0)).cast("double") * F.greatest(h, F.lit(0)).cast("double")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; two empty rectangles are the same one."""
    inter, both = intersection_area(a, b), area(a) + area(b)
    return F.when(both <= 0, F.lit(1.0)).otherwise(F.try_divide(inter, both - inter))


def hull_ratio(a: Column, b: Column) -> Column:
    """Intersection over the area of the bounding hull; an empty rectangle's hull with another is the other. NULL for 0/0."""
    empty_a, empty_b = (a["w"] <= 0) | (a["h"] <= 0), (b["w"] <= 0) | (b["h"] <= 0)
    w = F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - F.least(a["x"], b["x"])
    h = F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - F.least(a["y"], b["y"])
    hull = F.when(empty_a, area(b)).when(empty_b, area(a)).otherwise(w.cast("double") * h.cast("double"))
    return F.try_divide(intersection_area(a, b), hull)
