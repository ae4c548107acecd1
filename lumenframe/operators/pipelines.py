"""Entry points that join the steps: images to detections or to text, with pluggable models, and requests to answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.lookup import resolve, with_frame
from lumenframe.operators.ocr import detect_boxes, first_line, read_line
from lumenframe.operators.requests import ocr_response, parse_requests, request_images, to_body, yolo_response
from lumenframe.operators.score import float_lists
from lumenframe.operators.yolo import decoder_of
from lumenframe.schema import HTTP_THRESHOLD
from lumenframe.cluster import ship
from lumenframe.sources.images import decode_images, guard_empty, input_tensor, letterboxed, resize

Scorer = Callable[[np.ndarray], np.ndarray]


def usable(images: DataFrame) -> DataFrame:
    """Frames without an error that have pixels."""
    return images.where("error IS NULL AND height > 0 AND width > 0").select("frame_id", "height", "width", "data")


def _pixels(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Frame, and its pixels as rows of blue, green and red."""
    for f, h, w, data in zip(*(batch.column(c).to_pylist() for c in ("frame_id", "height", "width", "data")), strict=True):
        yield f, np.frombuffer(data, np.uint8).reshape(h, w, 3)


def infer_yolo(images: DataFrame, scorer: Scorer, version: str, model_w: int, model_h: int, threshold: float = HTTP_THRESHOLD) -> DataFrame:
    """(frame_id, height, width, data, error) to detections; frames with an error or without pixels give none.

    ``scorer`` takes one [1, 3, h, w] tensor: version 11 gives [1, 4 + classes, anchors], version 10 [1, rows, 6].
    """
    decoder = decoder_of(version)
    ship(images.sparkSession)
    kind = images.schema["frame_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, px in _pixels(batch):
                y = np.asarray(scorer(input_tensor(letterboxed(px, model_w, model_h))[None]), np.float32)[0]
                y = np.ascontiguousarray(y.T if decoder.transposed else y)
                n = len(y)
                cols = {"frame_id": pa.array([f] * n, batch.schema.field("frame_id").type), "det_no": pa.array(range(n), pa.int32()), "values": float_lists(list(y))}
                cols["orig_w"], cols["orig_h"] = pa.array([px.shape[1]] * n, pa.int32()), pa.array([px.shape[0]] * n, pa.int32())
                yield pa.RecordBatch.from_pydict(cols)

    rows = usable(images).mapInArrow(run, f"frame_id {kind}, det_no int, values array<float>, orig_w int, orig_h int")
    rows = rows.withColumns({"model_w": F.lit(model_w), "model_h": F.lit(model_h)})
    return decoder.decode(decoder.columns(rows).drop("values"), threshold)


def infer_ocr(images: DataFrame, detector: Scorer, recognizer: Scorer, dictionary: DataFrame, threshold: float = HTTP_THRESHOLD) -> DataFrame:
    """(frame_id, height, width, data, error) to (frame_id, box_no, x, y, w, h, line, confidence), one row for each text box.

    ``detector`` takes [1, 3, h, w] and gives [1, 1, h, w]; ``recognizer`` takes [1, 3, 48, w] and gives [lines, steps, characters], of which the first
    line counts. Each of them sees an image or a box once.
    """
    ship(images.sparkSession)
    kind = images.schema["frame_id"].dataType.simpleString()
    good = usable(images)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, px in _pixels(batch):
                h, w = px.shape[:2]
                p = np.asarray(detector(input_tensor(letterboxed(px, -(-w // 32) * 32, -(-h // 32) * 32))[None]), np.float32)
                p = p.reshape(p.shape[-2:])
                sizes = {"width": p.shape[1], "height": p.shape[0], "orig_w": w, "orig_h": h}
                yield pa.RecordBatch.from_pydict({"frame_id": pa.array([f], batch.schema.field("frame_id").type), "probs": float_lists([p])} | {k: pa.array([v], pa.int32()) for k, v in sizes.items()})

    found = detect_boxes(good.mapInArrow(maps, f"frame_id {kind}, probs array<float>, width int, height int, orig_w int, orig_h int"))
    crops = with_frame(found, good.select("frame_id", F.col("height").alias("fh"), F.col("width").alias("fw"), "data"))
    names = ["frame_id", "box_no", "x", "y", "w", "h"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for x, y, w, h, fh, fw, data in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "w", "h", "fh", "fw", "data")), strict=True):
                crop = np.frombuffer(data, np.uint8).reshape(fh, fw, 3)[y : y + h, x : x + w]
                if not crop.size:
                    lines.append(np.zeros((0, 0, 0), np.float32))
                    continue
                width = -(-int(np.float32(48) / np.float32(h) * np.float32(w)) // 48) * 48
                planes = (input_tensor(resize(crop, max(width, 48), 48)) - np.float32(0.5)) / np.float32(0.5)
                lines.append(np.asarray(recognizer(planes[None]), np.float32))
            steps = float_lists([s for x in lines for s in x.reshape(-1, x.shape[-1])] if any(x.size for x in lines) else [])
            each = [x.shape[1] for x in lines for _ in range(x.shape[0])]
            by_line = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32)), steps)
            by_box = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int32)), by_line)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), by_box], [*names, "lines"])

    scored = crops.select(*names, "fh", "fw", "data").mapInArrow(read, f"frame_id {kind}, box_no int, x int, y int, w int, h int, lines array<array<array<float>>>")
    chars = dictionary.agg(F.map_from_entries(F.collect_list(F.struct("idx", "ch"))).alias("chars"))  # a dictionary: thousands of lines
    lines = scored.crossJoin(F.broadcast(chars)).withColumn("_l", first_line(F.transform("lines", lambda s: read_line(s, F.col("chars"), threshold))))  # one row on the right
    return lines.select(*names, F.coalesce("_l.line", F.lit("")).alias("line"), F.coalesce("_l.confidence", F.lit(0).cast("float")).alias("confidence"))


@dataclass
class YoloModel:
    """What answers requests for a detection model: its scorer, input size and class names."""

    scorer: Scorer
    width: int
    height: int
    names: list[str]


def _frames(requests: DataFrame, decoder: Callable[[bytes], np.ndarray] | None) -> DataFrame:
    """A frame for each image of the requests: frame_id (request and place), pixels, error and error_code."""
    content = request_images(requests)
    rows = guard_empty(decode_images(content.withColumnRenamed("error_code", "_code"), decoder=decoder))
    code = F.coalesce("_code", F.when(F.col("error").isNotNull(), F.lit("kParameterError")))
    return rows.select(F.struct("request_id", "image_no").alias("frame_id"), "request_id", "image_no", "height", "width", "data", "error", code.alias("error_code"))


def _refused(requests: DataFrame) -> DataFrame:
    return requests.where("error_code IS NOT NULL").select("request_id", F.lit(400).alias("status"), F.coalesce("error_message", "error_code").alias("body"))


def answer_yolo(rows: DataFrame, registry: DataFrame, models: dict[str, YoloModel], *, threshold: float = HTTP_THRESHOLD, keep_errors: bool = False, decoder: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """Requests (request_id, body) to answers (request_id, status, body): parse, find the model, decode, score, respond.

    ``models`` gives a scorer for each name of the registry that can be asked for: a handful, one plan each.
    """
    parsed = parse_requests(rows)
    known = resolve(parsed.where("error_code IS NULL").drop("error_code"), registry, "yolo")
    refused = _refused(parsed.where("error_code IS NOT NULL").withColumn("error_message", F.lit("the request cannot be read"))).unionByName(_refused(known))
    versions = {r["name"]: r["version"] for r in registry.where("kind = 'yolo'").orderBy(F.desc("pos")).select("name", "version").collect()}  # a registry is a small file
    out = refused
    for name, model in models.items():
        asked = known.where((F.col("model") == name) & F.col("error_code").isNull())
        frames = _frames(asked, decoder)
        found = infer_yolo(frames, model.scorer, versions[name], model.width, model.height, threshold)
        results = found.select("frame_id.request_id", "frame_id.image_no", F.struct(-F.col("confidence"), "det_no").alias("rank"), "class_id", F.col("confidence").cast("float").alias("confidence"), *"xywh")
        out = out.unionByName(to_body(yolo_response(results, model.names, frames=frames.select("request_id", "image_no", "error_code"), keep_errors=keep_errors, keys=asked)))
    return out


def answer_ocr(rows: DataFrame, registry: DataFrame, models: dict[str, tuple[Scorer, Scorer, DataFrame]], *, threshold: float = HTTP_THRESHOLD, keep_errors: bool = False, decoder: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """As ``answer_yolo``, for text: ``models`` gives a detector, a recognizer and a dictionary for each name."""
    parsed = parse_requests(rows)
    known = resolve(parsed.where("error_code IS NULL").drop("error_code"), registry, "ocr")
    out = _refused(parsed.where("error_code IS NOT NULL").withColumn("error_message", F.lit("the request cannot be read"))).unionByName(_refused(known))
    for name, (detector, recognizer, dictionary) in models.items():
        asked = known.where((F.col("model") == name) & F.col("error_code").isNull())
        frames = _frames(asked, decoder)
        found = infer_ocr(frames, detector, recognizer, dictionary, threshold)
        results = found.select("frame_id.request_id", "frame_id.image_no", F.col("box_no").alias("rank"), "line", "confidence", *"xywh")
        out = out.unionByName(to_body(ocr_response(results, frames=frames.select("request_id", "image_no", "error_code"), keep_errors=keep_errors, keys=asked)))
    return out
