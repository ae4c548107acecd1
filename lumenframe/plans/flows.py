"""Registered queries that cross several operators: files, end-to-end inference, requests to answers, and streams; each with SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.cluster import scratch
from lumenframe.functions import text as X
from lumenframe.operators import lookup, ocr, pipelines, requests, score, suppress, yolo
from lumenframe.plans import fixtures as D
from lumenframe.plans.queries import ANCHORS, BEST, DET, NMS_ORDER, NMS_OVER, PIXELS, QUERIES, SQL, V11_BOXES, greedy, query, scale_sql
from lumenframe.schema import FRAMEWORKS, PROVIDERS, SUPPORTED, VIDEO_THRESHOLD, YOLO_RESPONSE
from lumenframe.sources import files, images, registry
from lumenframe.streaming import frames as stream

__all__ = ["QUERIES", "SQL"]

# --- files --------------------------------------------------------------------------------


def _written(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """A folder with one text file for each row (key, value), below a folder named after its key."""
    path = scratch(spark, name)
    rows.select("key", "value").repartition("key").write.partitionBy("key").text(path)
    return f"{path}/key=*/*.txt"


def _key(path: str = "path"):
    return F.regexp_extract(path, "/key=([0-9]+)/", 1).cast("int").alias("key")


@query("SELECT r_regionkey AS key, strlen(r_name) + 1 AS length, md5(r_name || chr(10)) AS digest, true AS ok, CAST(NULL AS VARCHAR) AS error_code FROM region")
def file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, D.table(spark, sf_dir, "region").selectExpr("r_regionkey AS key", "r_name AS value"), "files")
    return files.read_files(spark, path).select(_key(), "length", F.md5("content").alias("digest"), "ok", "error_code")


@query("SELECT n_nationkey AS key, n_name || chr(10) || n_regionkey || chr(10) AS text FROM nation")
def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS key", "concat(n_name, '\\r\\n', n_regionkey, '\\r') AS value")
    return files.read_texts(spark, _written(spark, rows, "texts")).select(_key(), "text")


NATIONS = "SELECT n_regionkey AS key, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS line_no, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS line FROM nation"


def _nation_files(spark: SparkSession, sf_dir: str) -> str:
    line = F.when(F.col("n_nationkey") % 3 == 0, F.lit("")).otherwise(F.col("n_name"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda r: r["line"])
    return _written(spark, D.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(F.array_join(ordered, "\r\n").alias("value")), "lines")


@query(NATIONS)
def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_lines(spark, _nation_files(spark, sf_dir)).select(_key(), "line_no", "line")


@query(f"SELECT line_no AS idx, line AS ch FROM ({NATIONS}) WHERE key = 2")
def dictionary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_dictionary(spark, _nation_files(spark, sf_dir).replace("key=*", "key=2"))


@query("SELECT n_nationkey AS key, 3 AS height, 4 AS width, 3 AS n_channels, repeat(upper(lpad(hex(n_nationkey * 7 % 256), 2, '0')) || upper(lpad(hex(n_nationkey * 11 % 256), 2, '0')) || upper(lpad(hex(n_nationkey * 5 % 256), 2, '0')), 12) AS pixels FROM nation")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyarrow import fs

    path = scratch(spark, "images")
    where, root = fs.FileSystem.from_uri(path)
    where.create_dir(root)
    for r in D.table(spark, sf_dir, "nation").select("n_nationkey").collect():  # 25 rows
        k = r["n_nationkey"]
        with where.open_output_stream(f"{root}/key={k}.png") as f:
            f.write(images.encode_png(np.full((3, 4, 3), (k * 7 % 256, k * 11 % 256, k * 5 % 256), np.uint8)))
    rows = images.read_images(spark, path)
    return rows.select(F.regexp_extract("origin", "key=([0-9]+)", 1).cast("int").alias("key"), "height", "width", F.col("nChannels").alias("n_channels"), F.hex("data").alias("pixels"))


# --- configuration ------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('host', '127.0.0.1'), ('infer_device', '1'), ('infer_ep', 'kCPU'), ('infer_framework', 'kONNXRUNTIME'), ('port', '11451'), ('static_path', 'assets/static')) AS v(name, value)")
def server_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = registry.ServerConfig.parse("host: 127.0.0.1\noptions: {infer_device: 1}")
    for name in ("static_path", "infer_framework", "infer_ep", "infer_device"):
        config.option(name)
    return spark.createDataFrame([("host", config.host), ("port", str(config.port)), *config.options.items()], "name string, value string")


ENGINES = [(a, b) for a in [*FRAMEWORKS, "other"] for b in [*PROVIDERS, "other"]]


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query(
    f"SELECT framework, ep, CASE WHEN framework NOT IN ({_quoted(FRAMEWORKS)}) OR ep NOT IN ({_quoted(PROVIDERS)}) THEN 'kParameterError' WHEN framework || '/' || ep NOT IN ({_quoted(f'{a}/{b}' for a, b in SUPPORTED)}) THEN 'kModelError' END AS error_code "
    "FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ENGINES) + ") AS v(framework, ep)"
)
def engine_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    def code(framework: str, provider: str) -> str | None:
        try:
            registry.check_engine(framework, provider)
        except ValueError as e:
            return str(e).partition(":")[0]

    return spark.createDataFrame([(a, b, code(a, b)) for a, b in ENGINES], "framework string, ep string, error_code string")


# --- boxes, crops and lines ---------------------------------------------------------------

FRAME_SIZES = "SELECT DISTINCT frame_id, CAST(320 + frame_id % 1600 AS INT) AS width, CAST(240 + frame_id % 840 AS INT) AS height FROM"


@query(f"SELECT d.det_no, f.width, f.height, d.x + d.w <= f.width AND d.y + d.h <= f.height AS inside FROM ({DET}) d JOIN ({FRAME_SIZES} ({DET})) f USING (frame_id) WHERE f.frame_id % 3 <> 0")
def crops_with_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = D.detections(spark, sf_dir)
    found = boxes.select("frame_id").distinct().selectExpr("frame_id", "CAST(320 + frame_id % 1600 AS INT) AS width", "CAST(240 + frame_id % 840 AS INT) AS height").where("frame_id % 3 <> 0")
    return lookup.with_frame(boxes, found).selectExpr("det_no", "width", "height", "x + w <= width AND y + h <= height AS inside")


@query(f"SELECT frame_id, d.det_no AS box_no, x, y, event_type AS line FROM ({DET}) d JOIN (SELECT event_id, event_type FROM events WHERE event_id % 4 <> 1) e ON e.event_id = d.det_no")
def lines_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = D.detections(spark, sf_dir).selectExpr("frame_id", "det_no AS box_no", "x", "y")
    lines = D.table(spark, sf_dir, "events").where("event_id % 4 <> 1").selectExpr("event_id div 50 AS frame_id", "event_id AS box_no", "event_type AS line")
    return lookup.pair_by_position(boxes, lines)


@query(f"""SELECT e.vec_id, coalesce(line, '') AS line, CAST(coalesce(mean, 0) AS FLOAT) AS confidence FROM embeddings e LEFT JOIN (
 SELECT vec_id, string_agg(coalesce(['a', 'b', 'c', 'd', 'e'][idx], ''), '' ORDER BY step) AS line, sum(CAST(score AS DOUBLE) ORDER BY step) / count(*) AS mean FROM ({BEST})
 WHERE step % 2 = 0 AND idx <> 0 AND score > CAST(0.1 AS FLOAT) GROUP BY vec_id) USING (vec_id)""")
def first_line_of_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even steps are the first line and odd ones the second, which does not count."""
    chars = F.map_from_arrays(F.array(*[F.lit(i) for i in range(len(D.CHARACTERS))]), F.array(*[F.lit(c) for c in D.CHARACTERS]))
    lines = F.array(F.filter("steps", lambda s, i: i % 2 == 0), F.filter("steps", lambda s, i: i % 2 == 1))
    first = ocr.first_line(F.transform(lines, lambda s: ocr.read_line(s, chars, 0.1)))
    return D.steps(spark, sf_dir).select("vec_id", first.alias("r")).select("vec_id", "r.line", "r.confidence")


@query(f"SELECT det_no, x || ' ' || y || ' ' || w || ' ' || h || ' ' || CASE WHEN confidence = 1 THEN '1.0' ELSE CAST(confidence AS VARCHAR) END || ' ' || event_type AS line FROM (SELECT det_no, x, y, w, h, class_id / CAST(4 AS DOUBLE) AS confidence FROM ({DET})) JOIN events ON event_id = det_no")
def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.detections(spark, sf_dir).join(D.table(spark, sf_dir, "events").select(F.col("event_id").alias("det_no"), "event_type"), "det_no")
    return rows.select("det_no", X.text_line(F.struct("x", "y", "w", "h"), F.col("class_id") / F.lit(4.0), F.col("event_type")).alias("line"))


# --- models -------------------------------------------------------------------------------


@query("SELECT vec_id, CAST(i - 1 AS INT) AS pos, CAST(greatest(CAST(round(CAST(embedding[i] AS DOUBLE) * 100) AS INT), 0) AS FLOAT) AS v FROM embeddings, range(1, 65) AS t(i)")
def model_score_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers below 2048 are exact in half precision."""
    model = score.OnnxModel(score.elementwise_model("Relu", 64, half=True))
    whole = F.transform("embedding", lambda e: F.round(e.cast("double") * 100).cast("float"))
    out = score.score(D.table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("data")), model)
    return out.select("vec_id", F.posexplode("output.data").alias("pos", "v"))


def _half(v: np.ndarray) -> np.ndarray:
    return np.rint(v.astype(np.float64) * 255).astype(np.int64)


def corner_scorer(x: np.ndarray) -> np.ndarray:
    """A stand-in for a version 10 model: two boxes that follow from the sum of all pixels."""
    total = int(_half(x[0]).sum())
    left, top, w, h = total % 3, total % 2, 2 + total % 4, 3 + total % 3
    return np.array([[[left, top, left + w, top + h, (1 + total % 100) / 128, total % 4], [left, top, left + w + total % 2 * 2, top + h, (1 + total % 50) / 128, 4]]], np.float32)


TOTALS = f"SELECT vec_id AS frame_id, list_sum(px) AS t FROM ({PIXELS})"


def corners_sql(source: str) -> str:
    """What ``corner_scorer`` finds from t in ``source`` (frame_id, t), above a threshold of 0.125."""
    box = "CAST(t % 3 AS INT) AS x, CAST(t % 2 AS INT) AS y"
    return f"""SELECT * FROM (
 SELECT frame_id, CAST(0 AS BIGINT) AS det_no, CAST(t % 4 AS INT) AS class_id, {box}, CAST(2 + t % 4 AS INT) AS w, CAST(3 + t % 3 AS INT) AS h, CAST((1 + t % 100) / CAST(128 AS DOUBLE) AS FLOAT) AS confidence FROM ({source})
 UNION ALL SELECT frame_id, 1, 4, {box}, CAST(2 + t % 4 + t % 2 * 2 AS INT), CAST(3 + t % 3 AS INT), CAST((1 + t % 50) / CAST(128 AS DOUBLE) AS FLOAT) FROM ({source})) WHERE confidence >= 0.125"""


def _vector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.decode_images(D.pngs(D.pixels(spark, sf_dir)).withColumnRenamed("vec_id", "frame_id")).drop("content")


CORNERS = f"WITH RECURSIVE {greedy(corners_sql(TOTALS), NMS_ORDER, NMS_OVER)} SELECT frame_id, CAST(det_no AS INT) AS det_no, class_id, x, y, w, h, confidence FROM kept"


@query(CORNERS)
def infer_yolo_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG bytes to pixels, letterbox, tensor, score, decoding and suppression."""
    return pipelines.infer_yolo(_vector_frames(spark, sf_dir), corner_scorer, "kV10", 8, 8)


@query(CORNERS.replace("FROM kept", "FROM kept WHERE class_id <> 4"))
def custom_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version of one's own, registered by name: as version 10, without the last class."""
    yolo.register_decoder("kVCustom", yolo.Decoder(False, yolo.corner_columns, lambda rows, t: yolo.decode_v10(rows, t).where("class_id <> 4")))
    return pipelines.infer_yolo(_vector_frames(spark, sf_dir), corner_scorer, "kVCustom", 8, 8)


RECTS = "SELECT vec_id AS frame_id, CAST(2 + vec_id % 8 AS INT) AS x, CAST(2 + vec_id % 5 AS INT) AS y, CAST(9 + vec_id % 7 AS INT) AS w, CAST(7 + vec_id % 6 AS INT) AS h FROM embeddings"


def map_detector(x: np.ndarray) -> np.ndarray:
    return x[:, :1]


def width_recognizer(x: np.ndarray) -> np.ndarray:
    """Three steps whose character follows from the crop's width, and a second line that does not count."""
    k = x.shape[3] // 48
    out = np.zeros((2, 3, 6), np.float32)
    out[0, 0, k], out[0, 1, 0], out[0, 2, k] = 0.75, 0.9, 0.5
    out[1, :, 5] = 1.0
    return out


@query(f"""SELECT frame_id, CAST(0 AS INT) AS box_no, x, y, w, h, repeat(['a', 'b', 'c', 'd', 'e'][k], 2) AS line, CAST(0.625 AS FLOAT) AS confidence FROM (
 SELECT *, CAST(ceil(trunc(CAST(48 AS FLOAT) / CAST(h AS FLOAT) * CAST(w AS FLOAT)) / 48.0) AS INT) AS k FROM ({RECTS})) WHERE w * h > 64""")
def infer_ocr_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bright rectangle for each vector, three pixels smaller than the box that dilation makes of it; detection, crops, recognition and reading."""
    rects = D.table(spark, sf_dir, "embeddings").selectExpr("vec_id AS frame_id", "2 + vec_id % 8 AS x", "2 + vec_id % 5 AS y", "6 + vec_id % 7 AS w", "4 + vec_id % 6 AS h")
    at = F.sequence(F.lit(0), F.lit(32 * 32 - 1))
    bright = lambda p: (p % 32 >= F.col("x")) & (p % 32 < F.col("x") + F.col("w")) & (F.floor(p / 32) >= F.col("y")) & (F.floor(p / 32) < F.col("y") + F.col("h"))
    px = F.flatten(F.transform(at, lambda p: F.when(bright(p), F.array(*[F.lit(255)] * 3)).otherwise(F.array(*[F.lit(0)] * 3))))
    frames = images.decode_images(D.pngs(rects.select("frame_id", px.alias("px")), 32)).drop("content")
    dictionary = spark.createDataFrame(list(enumerate(D.CHARACTERS)), "idx int, ch string")
    return pipelines.infer_ocr(frames, map_detector, width_recognizer, dictionary)


# --- answers ------------------------------------------------------------------------------

FLAWED = f"SELECT frame_id AS request_id, det_no, det_no % 11 = 0 AS bad FROM ({DET}) WHERE det_no % 5 = 0"


@query(f"SELECT request_id, CASE WHEN bool_or(bad) THEN 400 ELSE 200 END AS status, bool_or(bad) AS refused FROM ({FLAWED}) GROUP BY request_id")
def response_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confidence that is not a number cannot be written as JSON."""
    confidence = F.when(F.col("det_no") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("confidence")).cast("float").alias("confidence")
    rows = D.detections(spark, sf_dir).where("det_no % 5 = 0").select(F.col("frame_id").alias("request_id"), F.lit(0).alias("image_no"), F.col("det_no").alias("rank"), "class_id", confidence, "x", "y", "w", "h")
    bodies = requests.to_body(requests.yolo_response(rows, ["a"]))
    return bodies.select("request_id", "status", (~F.col("body").startswith("{")).alias("refused"))


PLACES = "SELECT event_id // 6 AS request_id, event_id % 6 AS image_no, event_id % 5 = 0 AS failed, event_id % 3 = 0 AS found FROM events"


@query(f"""SELECT request_id, keep_errors, CAST(count(*) AS INT) AS n_results, string_agg(CASE WHEN found AND NOT failed THEN '1' ELSE '0' END, '' ORDER BY image_no) AS sizes
 FROM ({PLACES}), (VALUES (true), (false)) AS v(keep_errors) WHERE keep_errors OR NOT failed GROUP BY ALL""")
def failed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed images vanish from the answer, or stay as empty lists."""
    e = D.table(spark, sf_dir, "events").selectExpr("event_id div 6 AS request_id", "CAST(event_id % 6 AS INT) AS image_no", "CASE WHEN event_id % 5 = 0 THEN 'kParameterError' END AS error_code", "event_id % 3 = 0 AS found")
    rows = e.where("found AND error_code IS NULL").selectExpr("request_id", "image_no", "0 AS rank", "'x' AS line", "CAST(1 AS FLOAT) AS confidence", "1 AS x", "1 AS y", "1 AS w", "1 AS h")
    out = [requests.ocr_response(rows, frames=e, keep_errors=k).withColumn("keep_errors", F.lit(k)) for k in (True, False)]
    sizes = F.array_join(F.transform("results", lambda r: F.size(r).cast("string")), "")
    return out[0].unionByName(out[1]).select("request_id", "keep_errors", F.size("results").alias("n_results"), sizes.alias("sizes"))


ASKED = f"""SELECT vec_id AS request_id, ['beta', 'alpha', 'gamma', 'nobody'][1 + vec_id % 4] AS model, vec_id % 9 = 0 AS cut, vec_id % 7 = 0 AS spoilt, t FROM (
 SELECT vec_id, list_sum(px) AS t FROM ({PIXELS}))"""
SCORED = f"SELECT request_id AS frame_id, t FROM ({ASKED}) WHERE model = 'beta' AND NOT cut AND NOT spoilt"
_BOX = "'{\"class_id\":' || class_id || ',\"confidence\":' || CAST(confidence AS VARCHAR) || ',\"bbox\":[' || x || ',' || y || ',' || w || ',' || h || ']}'"


@query(f"""WITH RECURSIVE {greedy(corners_sql(SCORED), NMS_ORDER, NMS_OVER)},
found AS (SELECT frame_id AS request_id, count(*) AS n, arg_max(class_id, -det_no) AS c, sum(x + 10 * y + 100 * w + 1000 * h) AS boxes FROM kept GROUP BY 1)
SELECT a.request_id, CASE WHEN cut OR model IN ('nobody', 'gamma') THEN 400 ELSE 200 END AS status,
  CASE WHEN cut THEN 'the request cannot be read' WHEN model = 'nobody' THEN 'the registry has no model nobody' WHEN model = 'gamma' THEN 'kV99 is no version of a yolo model' END AS refusal,
  CASE WHEN NOT cut AND model IN ('alpha', 'beta') THEN CASE WHEN spoilt THEN 0 ELSE 1 END END::INT AS n_images,
  CASE WHEN NOT cut AND model IN ('alpha', 'beta') THEN CASE WHEN model = 'beta' AND NOT spoilt THEN coalesce(n, 0) ELSE 0 END END::INT AS n_boxes,
  CASE WHEN NOT cut AND model IN ('alpha', 'beta') THEN CASE WHEN model = 'beta' AND NOT spoilt THEN coalesce(boxes, 0) ELSE 0 END END::BIGINT AS boxes
FROM ({ASKED}) a LEFT JOIN found USING (request_id)""")
def answer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies to answers in one call: parse, find the model, decode base64 and PNG, score, suppress, respond; errors where they belong."""
    shots = D.pngs(D.pixels(spark, sf_dir))
    names = F.array(*[F.lit(n) for n in ("beta", "alpha", "gamma", "nobody")])
    image = F.when(F.col("vec_id") % 7 == 0, F.lit("@@@")).otherwise(F.translate(F.base64("content"), "\r\n", ""))
    body = F.to_json(F.struct(F.get(names, (F.col("vec_id") % 4).cast("int")).alias("model"), F.array(image).alias("images")))
    rows = shots.select(F.col("vec_id").alias("request_id"), F.when(F.col("vec_id") % 9 == 0, F.substring(body, 1, 9)).otherwise(body).alias("body"))
    blind = lambda x: np.zeros((1, 6, 3), np.float32)  # noqa: E731  finds nothing
    models = {"beta": pipelines.YoloModel(corner_scorer, 8, 8, ["a", "b"]), "alpha": pipelines.YoloModel(blind, 8, 8, ["a", "b"])}
    answers = pipelines.answer_yolo(rows, D.registry(spark), models)
    back = answers.withColumn("b", F.when(F.col("status") == 200, F.from_json("body", YOLO_RESPONSE)))
    flat = F.flatten("b.results")
    boxes = F.aggregate(flat, F.lit(0).cast("long"), lambda acc, r: acc + r["bbox"][0] + 10 * r["bbox"][1] + 100 * r["bbox"][2] + 1000 * r["bbox"][3])
    size = lambda c: F.when(F.col("status") == 200, F.size(c))
    return back.select("request_id", "status", F.when(F.col("status") != 200, F.col("body")).alias("refusal"), size("b.results").alias("n_images"), size(flat).alias("n_boxes"), F.when(F.col("status") == 200, boxes).alias("boxes"))


# --- streams ------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A table as a stream; the bracket makes the path a pattern, which file streams ask for."""
    return stream.read_frames(spark, f"{sf_dir}/{name}.parque[t]", D.table(spark, sf_dir, name).schema, files_per_batch)


def _appended(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """All that a stream gives, as the files that its sink wrote."""
    path = scratch(spark, name)
    query = rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT user_id, CAST(1 AS BIGINT) AS rn, t AS seen, t AS since, CAST(1 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS rate FROM e WHERE rn = 1
 UNION ALL SELECT e.user_id, e.rn, e.t, CASE WHEN e.t - w.since < 3600 THEN w.since ELSE e.t END, CASE WHEN e.t - w.since < 3600 THEN w.n + 1 ELSE 0 END,
  CASE WHEN e.t - w.since < 3600 THEN NULL ELSE (w.n + 1) / (e.t - w.since) END
 FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT user_id, seen AS at, rate AS frames_per_second FROM w WHERE rate IS NOT NULL""")
def stream_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame counter as a stateful stream."""
    rows = _stream(spark, sf_dir, "events").select("user_id", "ts")
    path = scratch(spark, "rates")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    rates = stream.frame_rate(rows, "user_id", window=3600.0)
    rates.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rates.schema).parquet(f"{path}/rows").selectExpr("k AS user_id", "at", "frames_per_second")


@query(f"WITH RECURSIVE {greedy(scale_sql(V11_BOXES.replace('0.125', str(VIDEO_THRESHOLD))), NMS_ORDER, NMS_OVER)} SELECT frame_id, det_no, class_id, x, y, w, h, confidence FROM kept")
def stream_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors as a stream whose batches are decoded. A frame's boxes may come in several files and so in several batches, and one that comes late may
    suppress one that came before: frames are suppressed when they are whole, at the end of the stream."""
    boxes = yolo.decode_v11(D.as_anchors(_stream(spark, sf_dir, "embeddings")), VIDEO_THRESHOLD, suppress=False)
    return suppress.nms(_appended(spark, boxes, "detections"), carry=yolo.BOX)


@query("SELECT event_id, least(value / CAST(20.0 AS DOUBLE), CAST(1.0 AS DOUBLE)) AS confidence FROM events WHERE least(value / CAST(20.0 AS DOUBLE), CAST(1.0 AS DOUBLE)) > 0.5")
def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir, "events").selectExpr("event_id", "least(value / 20.0D, 1.0D) AS confidence")
    return _appended(spark, yolo.confident(rows, 0.5), "filtered")


@query("SELECT arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events")
def stream_shown_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window shows the newest frame of a batch, and drops the others; the table is one batch."""
    path = scratch(spark, "shown")
    rows = _stream(spark, sf_dir, "events").select("event_id", "ts")
    query = stream.show_latest(rows, lambda df: df.write.mode("overwrite").parquet(f"{path}/rows"), None, "ts", ["event_id", "ts"], f"{path}/state")
    stream.run_to_end(query)
    return spark.read.parquet(f"{path}/rows")
