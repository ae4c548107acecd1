"""Lookups: class names, characters, registry rows, crops and positional pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.text import class_names
from lumenframe.schema import OCR_VERSIONS, YOLO_VERSIONS


def names_table(rows: DataFrame, metadata: str = "names") -> DataFrame:
    """(class_id, class_name) from a model's metadata, which is one row."""
    return rows.select(F.posexplode(class_names(F.col(metadata))).alias("class_id", "class_name"))


def with_class_name(rows: DataFrame, names: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Names are as many as a model has classes: a bounded side. An unknown class drops the row, or stays with NULL."""
    return rows.join(F.broadcast(names), "class_id", "left" if keep_unknown else "inner")


def character(idx: Column, dictionary: Column) -> Column:
    """Character behind a class index, which is one above the dictionary's; a missing one is the empty string."""
    return F.coalesce(F.try_element_at(dictionary, idx - 1), F.lit(""))


def with_character(steps: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same as a join; a dictionary has some thousands of lines and is broadcast."""
    d = dictionary.select((F.col("idx") + 1).alias("idx"), "ch")
    return steps.join(F.broadcast(d), "idx", "left").withColumn("ch", F.coalesce("ch", F.lit("")))


def first_match(registry: DataFrame, position: str = "pos") -> DataFrame:
    """One row of each (kind, name): the first in the file."""
    w = Window.partitionBy("kind", "name").orderBy(position)
    return registry.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve(requests: DataFrame, registry: DataFrame, kind: str) -> DataFrame:
    """Requests with their model's row, and an error where the name or its version is unknown."""
    known = YOLO_VERSIONS if kind == "yolo" else OCR_VERSIONS
    model = F.broadcast(first_match(registry.where(F.col("kind") == kind)).select(F.col("name").alias("model"), "version", "path"))
    out = requests.join(model, "model", "left")  # a registry is a small file
    absent, other = F.col("version").isNull(), ~F.col("version").isin(known)
    code = F.lit("kModelError" if kind == "yolo" else "kParameterError")
    message = F.when(absent, F.concat(F.lit("the registry has no model "), "model")).when(other, F.concat("version", F.lit(f" is no version of a {kind} model")))
    return out.withColumns({"error_code": F.when(absent, F.lit("kModelError")).when(other, code), "error_message": message})


def with_frame(boxes: DataFrame, frames: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Each box with its frame, for cropping."""
    return boxes.join(frames, frame)


def pair_by_position(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """Boxes and recognised lines, one to one by (frame_id, box_no)."""
    return boxes.join(lines, ["frame_id", "box_no"])
