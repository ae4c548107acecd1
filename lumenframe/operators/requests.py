"""Requests and responses as rows: parse, decode, score per image, answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.schema import REQUEST


def parse_requests(rows: DataFrame, body: str = "body") -> DataFrame:
    """Adds model, images and error_code: malformed JSON is a parameter error."""
    parsed = F.from_json(F.col(body), f"{REQUEST}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = rows.withColumn("_q", parsed)
    bad = F.col(body).isNull() | F.col("_q._bad").isNotNull() | F.col("_q.model").isNull() | F.col("_q.images").isNull()
    return out.select(*rows.columns, F.when(~bad, F.col("_q.model")).alias("model"), F.when(~bad, F.col("_q.images")).alias("images"), F.when(bad, F.lit("kParameterError")).alias("error_code"))


def request_images(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, model, image_no, content, error_code): each image's bytes; base64 that does not decode is an error of its row."""
    each = requests.where("error_code IS NULL").select(key, "model", F.posexplode("images").alias("image_no", "image"))
    content = F.try_to_binary("image", F.lit("base64"))
    return each.select(key, "model", "image_no", content.alias("content"), F.when(content.isNull(), F.lit("kParameterError")).alias("error_code"))


def yolo_response(results: DataFrame, names: list[str] | None = None, *, key: str = "request_id", frames: DataFrame | None = None, keep_errors: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """Rows (key, image_no, rank, class_id, confidence, x, y, w, h) to (key, class_names, results).

    ``frames`` (key, image_no, error_code) says which images were scored: one without detections gives an empty
    list, a failed one vanishes, so that places no longer match the images, or stays empty with ``keep_errors``.
    ``keys`` are all that are answered: one without frames gets no results.
    """
    item = F.struct("rank", F.struct("class_id", "confidence", F.array("x", "y", "w", "h").alias("bbox")).alias("v"))
    return _nested(results, item, F.array(*(F.lit(n) for n in names or [])).cast("array<string>"), key, frames, keep_errors, keys)


def ocr_response(results: DataFrame, *, key: str = "request_id", frames: DataFrame | None = None, keep_errors: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """Rows (key, image_no, rank, line, confidence, x, y, w, h) to (key, results)."""
    item = F.struct("rank", F.struct("line", "confidence", F.array("x", "y", "w", "h").alias("bbox")).alias("v"))
    return _nested(results, item, None, key, frames, keep_errors, keys)


def _nested(results: DataFrame, item, names, key: str, frames: DataFrame | None, keep_errors: bool, keys: DataFrame | None) -> DataFrame:
    per = results.groupBy(key, "image_no").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("objects"))
    if frames is not None:
        wanted = frames if keep_errors else frames.where("error_code IS NULL")
        per = wanted.select(key, "image_no").join(per, [key, "image_no"], "left")
        per = per.withColumn("objects", F.coalesce("objects", F.array().cast(per.schema["objects"].dataType)))
    out = per.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("image_no", "objects"))), lambda x: x["objects"]).alias("results"))
    if keys is not None:
        out = keys.select(key).join(out, key, "left").withColumn("results", F.coalesce("results", F.array().cast(out.schema["results"].dataType)))
    return out if names is None else out.select(key, names.alias("class_names"), "results")


def to_body(responses: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, status, body): the response's JSON. JSON has no numbers that are not finite: a response with one cannot be written and is an error 400."""
    fields = [c for c in responses.columns if c != key]
    finite = ~F.exists(F.flatten("results"), lambda r: F.isnan(r["confidence"]) | (F.abs(r["confidence"]) == F.lit(float("inf"))))
    body = F.when(F.coalesce(finite, F.lit(True)), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    return responses.select(key, F.when(body.isNotNull(), F.lit(200)).otherwise(F.lit(400)).alias("status"), F.coalesce(body, F.lit("the response cannot be written as JSON")).alias("body"))
