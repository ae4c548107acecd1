"""Detections, anchors, steps, maps, frames, requests and registries derived from the driver's tables, for Spark and as SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.cluster import ship
from lumenframe.sources.images import encode_png
from lumenframe.sources.registry import read_registry

CLASS_METADATA = "{0: 'view', 1: 'signup', 2: 'error', 3: 'click', 4: 'purchase'}"
CHARACTERS = ["a", "b", "c", "d", "e"]
REGISTRY_YAML = """
yolo:
  - {name: alpha, version: kV11, path: models/alpha.onnx}
  - {name: beta, version: kV10, path: models/beta.onnx}
  - {name: alpha, version: kV10, path: models/alpha-old.onnx}
  - {name: gamma, version: kV99, path: models/gamma.onnx}
ocr:
  - {name: reader, version: kPPOCRv4, det_path: models/det.onnx, rec_path: models/rec.onnx, char_dict_path: models/keys.txt}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str, least: int = 16) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.selectExpr(
        "event_id div 50 AS frame_id", "event_id AS det_no", "CAST((event_id * 7919) % 640 AS INT) AS x", "CAST((event_id * 104729) % 480 AS INT) AS y",
        f"CAST({least} + (event_id * 31) % 96 AS INT) AS w", f"CAST({least} + (event_id * 17) % 96 AS INT) AS h", "CAST(event_id % 5 AS INT) AS class_id",
        "least(value / 20.0D, 1.0D) AS confidence",
    )


def detections_sql(least: int = 16) -> str:
    return (
        "SELECT event_id // 50 AS frame_id, event_id AS det_no, CAST((event_id * 7919) % 640 AS INT) AS x, CAST((event_id * 104729) % 480 AS INT) AS y, "
        f"CAST({least} + (event_id * 31) % 96 AS INT) AS w, CAST({least} + (event_id * 17) % 96 AS INT) AS h, CAST(event_id % 5 AS INT) AS class_id, "
        "least(value / CAST(20.0 AS DOUBLE), CAST(1.0 AS DOUBLE)) AS confidence FROM events"
    )


SIDES = ["CAST(320 + (frame_id * 37) % 1600 AS INT) AS orig_w", "CAST(240 + (frame_id * 53) % 840 AS INT) AS orig_h"]
SIZES = ", ".join(SIDES)


def sized(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("*", *SIDES)


def as_anchors(embeddings: DataFrame) -> DataFrame:
    e = embeddings.selectExpr(
        "vec_id div 50 AS frame_id", "vec_id AS det_no", *(f"CAST(abs(embedding[{i}]) * CAST(640 AS FLOAT) AS FLOAT) AS {c}" for i, c in enumerate(("cx", "cy", "bw", "bh"))),
        "slice(embedding, 5, 60) AS scores", "640 AS model_w", "640 AS model_h",
    )
    return sized(e)


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_anchors(table(spark, sf_dir, "embeddings"))


def anchors_sql() -> str:
    box = ", ".join(f"abs(embedding[{i + 1}]) * CAST(640 AS FLOAT) AS {c}" for i, c in enumerate(("cx", "cy", "bw", "bh")))
    return f"SELECT *, {SIZES} FROM (SELECT vec_id // 50 AS frame_id, vec_id AS det_no, {box}, embedding[5:64] AS scores FROM embeddings)"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8))).alias("steps"))


def pixel_maps(spark: SparkSession, sf_dir: str, threshold: float = 0.15) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("p", "v"))
    t = F.lit(threshold).cast("float")
    return e.select("frame_id", (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("v") > t).cast("int").alias("m"))


def pixel_maps_sql(threshold: float = 0.15) -> str:
    return (
        "SELECT vec_id AS frame_id, CAST((i - 1) % 8 AS INT) AS x, CAST((i - 1) // 8 AS INT) AS y, "
        f"CAST(embedding[i] > CAST({threshold} AS FLOAT) AS INT) AS m FROM embeddings, range(1, 65) AS t(i)"
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id", "CAST(320 + event_id % 1600 AS INT) AS width", "CAST(240 + event_id % 840 AS INT) AS height")


FRAMES_SQL = "SELECT event_id, ts, user_id, CAST(320 + event_id % 1600 AS INT) AS width, CAST(240 + event_id % 840 AS INT) AS height FROM events"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh body is cut short, and every fifth names an image that is no base64."""
    d = table(spark, sf_dir, "documents")
    image = F.when(F.col("doc_id") % 5 == 0, F.lit("@@@")).otherwise(F.translate(F.base64(F.col("text").cast("binary")), "\r\n", ""))
    body = F.to_json(F.struct(F.coalesce("lang", F.lit("none")).alias("model"), F.array(image).alias("images")))
    cut = F.when(F.col("doc_id") % 7 == 0, F.substring(body, 1, 9)).otherwise(body)
    return d.select(F.col("doc_id").alias("request_id"), "lang", "text", cut.alias("body"))


def registry(spark: SparkSession) -> DataFrame:
    return read_registry(spark, REGISTRY_YAML)


REGISTRY_SQL = (
    "SELECT * FROM (VALUES (0, 'yolo', 'alpha', 'kV11', 'models/alpha.onnx'), (1, 'yolo', 'beta', 'kV10', 'models/beta.onnx'), "
    "(2, 'yolo', 'alpha', 'kV10', 'models/alpha-old.onnx'), (3, 'yolo', 'gamma', 'kV99', 'models/gamma.onnx'), "
    "(4, 'ocr', 'reader', 'kPPOCRv4', NULL)) AS r(pos, kind, name, version, path)"
)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, px): an 8 x 8 image of each vector, three bytes for each element."""
    shades = F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 1000).cast("int") % 256)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.flatten(F.transform(shades, lambda v: F.array(v, v * 7 % 256, v * 13 % 256))).alias("px"))


PIXELS_SQL = (
    "SELECT vec_id, flatten(list_transform(shades, lambda v: [v, v * 7 % 256, v * 13 % 256])) AS px FROM ("
    "SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(abs(CAST(e AS DOUBLE)) * 1000) AS INT) % 256) AS shades FROM embeddings)"
)


def pngs(rows: DataFrame, side: int = 8) -> DataFrame:
    """Rows with ``px``, a square image, to rows with ``content``, its PNG file."""
    ship(rows.sparkSession)
    rest = [c for c in rows.columns if c != "px"]

    def pack(batches):
        for b in batches:
            blobs = [encode_png(np.array(p, np.uint8).reshape(side, side, 3)) for p in b.column("px").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(blobs, pa.binary())], [*rest, "content"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest)
    return rows.select(*rest, "px").mapInArrow(pack, f"{kinds}, content binary")
