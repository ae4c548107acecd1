"""Registered queries over the operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import arrays as A
from lumenframe.functions import geometry as G
from lumenframe.functions import text as X
from lumenframe.operators import lookup, ocr, requests, score, suppress, yolo
from lumenframe.operators.components import component_boxes
from lumenframe.plans import fixtures as D
from lumenframe.schema import OCR_RESPONSE, SUPPORTED, YOLO_RESPONSE
from lumenframe.sources import images, registry
from lumenframe.streaming import frames as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL text shared by several queries -------------------------------------------------------

DET, DET0 = D.detections_sql(), D.detections_sql(0)
INTER = (
    "(CAST(greatest(least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x), 0) AS DOUBLE) * "
    "CAST(greatest(least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y), 0) AS DOUBLE))"
)
BOTH = "(CAST(k.w AS DOUBLE) * k.h + CAST(b.w AS DOUBLE) * b.h)"
IOU = f"CASE WHEN {BOTH} <= 0 THEN 1.0 ELSE {INTER} / ({BOTH} - {INTER}) END"
HULL = (
    "(CASE WHEN k.w <= 0 OR k.h <= 0 THEN CAST(b.w AS DOUBLE) * b.h WHEN b.w <= 0 OR b.h <= 0 THEN CAST(k.w AS DOUBLE) * k.h "
    "ELSE CAST(greatest(k.x + k.w, b.x + b.w) - least(k.x, b.x) AS DOUBLE) * (greatest(k.y + k.h, b.y + b.h) - least(k.y, b.y)) END)"
)
HULL_RATIO = f"coalesce({INTER} / nullif({HULL}, 0) > 0.3, false)"


def greedy(source: str, order: str, overlaps: str) -> str:
    """Rows of ``source`` (frame_id, det_no, x, y, w, h, ...) that a greedy pass in this order keeps, as a recursive CTE named ``kept``."""
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY {order}) AS rn FROM ({source})),
pass AS (
  SELECT DISTINCT frame_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(det_no BIGINT, x INT, y INT, w INT, h INT)[]) AS held FROM ranked
  UNION ALL
  SELECT p.frame_id, b.rn, CASE WHEN len(list_filter(p.held, lambda k: {overlaps})) > 0 THEN p.held
    ELSE list_append(p.held, {{'det_no': b.det_no, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}}) END
  FROM pass p JOIN ranked b ON b.frame_id = p.frame_id AND b.rn = p.rn + 1),
final AS (SELECT frame_id, arg_max(held, rn) AS held FROM pass GROUP BY frame_id),
names AS (SELECT frame_id, unnest(held).det_no AS det_no FROM final),
kept AS (SELECT r.* EXCLUDE (rn) FROM ranked r JOIN names n USING (frame_id, det_no))"""


NMS_ORDER = "confidence DESC, det_no"
NMS_OVER = f"({IOU}) > 0.3"


def scale_sql(source: str, mw: str = "640", mh: str = "640") -> str:
    """Int boxes x, y, w, h of ``source`` scaled to orig_w x orig_h with clipping."""
    return f"""
SELECT * EXCLUDE (x, y, w, h, gain, px, py, x1, y1, w1, h1), x1 AS x, y1 AS y, greatest(0, least(w1, orig_w - x1)) AS w, greatest(0, least(h1, orig_h - y1)) AS h FROM (
 SELECT *, greatest(0, least(CAST(round(CAST(x - px AS FLOAT) / gain) AS INT), orig_w)) AS x1, greatest(0, least(CAST(round(CAST(y - py AS FLOAT) / gain) AS INT), orig_h)) AS y1,
  CAST(round(CAST(w AS FLOAT) / gain) AS INT) AS w1, CAST(round(CAST(h AS FLOAT) / gain) AS INT) AS h1 FROM (
  SELECT *, CAST(round((CAST({mw} AS FLOAT) - CAST(orig_w AS FLOAT) * gain) / CAST(2 AS FLOAT)) AS INT) AS px, CAST(round((CAST({mh} AS FLOAT) - CAST(orig_h AS FLOAT) * gain) / CAST(2 AS FLOAT)) AS INT) AS py FROM (
   SELECT *, least(CAST({mh} AS FLOAT) / CAST(orig_h AS FLOAT), CAST({mw} AS FLOAT) / CAST(orig_w AS FLOAT)) AS gain FROM ({source}))))"""


# --- filters ------------------------------------------------------------------------------


@query(f"SELECT frame_id, det_no, confidence FROM ({DET}) WHERE confidence > 0.5")
def conf_filter_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yolo.confident(D.detections(spark, sf_dir), 0.5).select("frame_id", "det_no", "confidence")


@query(f"SELECT frame_id, det_no, confidence FROM ({DET}) WHERE confidence >= 1.0")
def conf_filter_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yolo.confident(D.detections(spark, sf_dir), 1.0, strict=False).select("frame_id", "det_no", "confidence")


@query(f"SELECT frame_id, det_no, x, y, w, h FROM ({DET0}) WHERE w * h > 64")
def min_rect_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.large_enough(D.detections(spark, sf_dir, 0), 64).select("frame_id", "det_no", "x", "y", "w", "h")


@query(f"SELECT event_id, CASE WHEN width <= 0 OR height - 240 <= 0 THEN 'kParameterError: empty image' END AS error FROM ({D.FRAMES_SQL})")
def empty_image_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.frames(spark, sf_dir).withColumn("height", F.col("height") - 240).withColumn("error", F.lit(None).cast("string"))
    return images.guard_empty(rows).select("event_id", "error")


# --- suppression --------------------------------------------------------------------------


@query(f"WITH RECURSIVE {greedy(f'SELECT * FROM ({DET}) WHERE confidence > 0.125', NMS_ORDER, NMS_OVER)} SELECT frame_id, det_no, class_id, x, y, w, h, confidence FROM kept")
def nms_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = yolo.confident(D.detections(spark, sf_dir), 0.125)
    return suppress.nms(rows).select("frame_id", "det_no", "class_id", "x", "y", "w", "h", "confidence")


@query(SQL["nms_fold"])
def nms_dense_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = yolo.confident(D.detections(spark, sf_dir), 0.125)
    return suppress.nms_dense(rows).select("frame_id", "det_no", "class_id", "x", "y", "w", "h", "confidence")


@query(f"WITH RECURSIVE {greedy(DET0, 'det_no', HULL_RATIO)} SELECT frame_id, det_no, x, y, w, h FROM kept")
def hull_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.hull_dedupe(D.detections(spark, sf_dir, 0), order="det_no", min_area=None).select("frame_id", "det_no", "x", "y", "w", "h")


PAIRS_SQL = f"FROM ({DET0}) k JOIN ({DET0}) b ON b.frame_id = k.frame_id AND b.det_no = k.det_no + 1"


@query(f"SELECT k.det_no, {IOU} AS iou, {INTER} / nullif({HULL}, 0) AS hull_ratio {PAIRS_SQL}")
def overlap_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.detections(spark, sf_dir, 0).select("frame_id", "det_no", F.struct("x", "y", "w", "h").alias("r"))
    nxt = d.select("frame_id", (F.col("det_no") - 1).alias("det_no"), F.col("r").alias("s"))
    return d.join(nxt, ["frame_id", "det_no"]).select("det_no", G.iou(F.col("r"), F.col("s")).alias("iou"), G.hull_ratio(F.col("r"), F.col("s")).alias("hull_ratio"))


# --- decoding -----------------------------------------------------------------------------

ANCHORS = D.anchors_sql()


@query(f"SELECT det_no, CAST(list_position(scores, list_max(scores)) - 1 AS INT) AS class_id, list_max(scores) AS confidence FROM ({ANCHORS})")
def class_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = D.anchors(spark, sf_dir).withColumn("b", yolo.best_class(F.col("scores")))
    return best.select("det_no", F.col("b.idx").alias("class_id"), F.col("b.score").alias("confidence"))


V11_BOXES = f"""SELECT frame_id, det_no, orig_w, orig_h, CAST(list_position(scores, list_max(scores)) - 1 AS INT) AS class_id, list_max(scores) AS confidence,
  CAST(round_even(cx - bw * CAST(0.5 AS FLOAT), 0) AS INT) AS x, CAST(round_even(cy - bh * CAST(0.5 AS FLOAT), 0) AS INT) AS y, CAST(round_even(bw, 0) AS INT) AS w, CAST(round_even(bh, 0) AS INT) AS h
  FROM ({ANCHORS}) WHERE list_max(scores) > CAST(0.125 AS FLOAT)"""


@query(f"WITH RECURSIVE {greedy(scale_sql(V11_BOXES), NMS_ORDER, NMS_OVER)} SELECT frame_id, det_no, class_id, x, y, w, h, confidence FROM kept")
def v11_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yolo.decode(D.anchors(spark, sf_dir), "kV11")


V10_ROWS = f"SELECT *, {D.SIZES} FROM ({DET})"
V10_BOXES = f"""SELECT frame_id, det_no, class_id, confidence, CAST(trunc(x0) AS INT) AS x, CAST(trunc(y0) AS INT) AS y, CAST(trunc(x1 - x0) AS INT) AS w, CAST(trunc(y1 - y0) AS INT) AS h FROM (
 SELECT *, (CAST(x AS FLOAT) - px) / sx AS x0, (CAST(y AS FLOAT) - py) / sy AS y0, (CAST(x + w AS FLOAT) - px) / sx AS x1, (CAST(y + h AS FLOAT) - py) / sy AS y1 FROM (
  SELECT * EXCLUDE (confidence), CAST(confidence AS FLOAT) AS confidence,
   CAST(CAST(trunc((640 - CAST(trunc(CAST(orig_w AS FLOAT) * sx) AS INT)) / 2) AS INT) AS FLOAT) AS px, CAST(CAST(trunc((640 - CAST(trunc(CAST(orig_h AS FLOAT) * sy) AS INT)) / 2) AS INT) AS FLOAT) AS py FROM (
   SELECT *, CAST(640 AS FLOAT) / CAST(orig_w AS FLOAT) AS sx, CAST(640 AS FLOAT) / CAST(orig_h AS FLOAT) AS sy FROM ({V10_ROWS})))) WHERE confidence >= CAST(0.5 AS FLOAT)"""


@query(f"WITH RECURSIVE {greedy(V10_BOXES, NMS_ORDER, NMS_OVER)} SELECT frame_id, det_no, class_id, x, y, w, h, confidence FROM kept")
def v10_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.sized(D.detections(spark, sf_dir))
    rows = d.selectExpr(
        "frame_id", "det_no", "CAST(x AS FLOAT) AS left", "CAST(y AS FLOAT) AS top", "CAST(x + w AS FLOAT) AS right", "CAST(y + h AS FLOAT) AS bottom",
        "CAST(confidence AS FLOAT) AS confidence", "class_id", "640 AS model_w", "640 AS model_h", "orig_w", "orig_h",
    )
    return yolo.decode_v10(rows, 0.5)


# --- geometry -----------------------------------------------------------------------------

LETTERBOX = f"""SELECT event_id, new_w, new_h, CAST(trunc((640 - new_w) / 2) AS INT) AS "left", CAST(trunc((480 - new_h) / 2) AS INT) AS top FROM (
 SELECT event_id, CAST(trunc(CAST(width AS FLOAT) * s) AS INT) AS new_w, CAST(trunc(CAST(height AS FLOAT) * s) AS INT) AS new_h FROM (
  SELECT *, least(CAST(640 AS FLOAT) / CAST(width AS FLOAT), CAST(480 AS FLOAT) / CAST(height AS FLOAT)) AS s FROM ({D.FRAMES_SQL})))"""


@query(LETTERBOX)
def letterbox_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.frames(spark, sf_dir).withColumn("b", G.letterbox(F.col("width"), F.col("height"), F.lit(640), F.lit(480)))
    return rows.select("event_id", "b.*")


@query(f"SELECT det_no, x, y, w, h FROM ({scale_sql(f'SELECT *, {D.SIZES} FROM ({DET})', '640', '480')})")
def scale_coords_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.sized(D.detections(spark, sf_dir)).withColumn("r", F.struct("x", "y", "w", "h"))
    return d.select("det_no", G.scale_coords(F.col("r"), F.lit(640), F.lit(480), F.col("orig_w"), F.col("orig_h")).alias("b")).select("det_no", "b.*")


@query(f"SELECT event_id, CAST(ceil(width / 32.0) * 32 AS INT) AS padded_w, CAST(ceil(height / 48.0) * 48 AS INT) AS padded_h FROM ({D.FRAMES_SQL})")
def pad_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.frames(spark, sf_dir).select("event_id", G.pad_length(F.col("width")).alias("padded_w"), G.pad_length(F.col("height"), 48).alias("padded_h"))


@query(f"""SELECT event_id, tw AS target_w, th AS target_h, nw AS new_w, nh AS new_h, CAST(trunc((tw - nw) / 2) AS INT) AS "left", CAST(trunc((th - nh) / 2) AS INT) AS top FROM (
 SELECT *, CAST(trunc(CAST(width AS FLOAT) * s) AS INT) AS nw, CAST(trunc(CAST(height AS FLOAT) * s) AS INT) AS nh FROM (
  SELECT *, least(CAST(tw AS FLOAT) / CAST(width AS FLOAT), CAST(th AS FLOAT) / CAST(height AS FLOAT)) AS s FROM (
   SELECT *, CAST(ceil(width / 32.0) * 32 AS INT) AS tw, CAST(ceil(height / 32.0) * 32 AS INT) AS th FROM ({D.FRAMES_SQL}))))""")
def detection_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.frames(spark, sf_dir).select("event_id", G.detection_target(F.col("width"), F.col("height")).alias("t")).select("event_id", "t.*")


@query(f"SELECT det_no, CAST(ceil(trunc(CAST(48 AS FLOAT) / CAST(h AS FLOAT) * CAST(w AS FLOAT)) / 48.0) * 48 AS INT) AS width, 48 AS height FROM ({DET})")
def rec_crop_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.detections(spark, sf_dir).withColumn("r", F.struct("x", "y", "w", "h"))
    return d.select("det_no", G.recognition_target(F.col("r")).alias("t")).select("det_no", "t.*")


@query(f"""SELECT det_no, CAST(x + w // 2 - nw // 2 AS INT) AS x, CAST(y + h // 2 - nh // 2 AS INT) AS y, nw AS w, nh AS h FROM (
 SELECT *, CAST(trunc(CAST(w AS DOUBLE) * 1.5) AS INT) AS nw, CAST(trunc(CAST(h AS DOUBLE) * 2.0) AS INT) AS nh FROM ({DET}))""")
def scale_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.detections(spark, sf_dir).withColumn("r", F.struct("x", "y", "w", "h"))
    return d.select("det_no", G.scale_rect(F.col("r"), 1.5, 2.0).alias("b")).select("det_no", "b.*")


# --- lookups ------------------------------------------------------------------------------

NAMES = "SELECT unnest(['view', 'signup', 'error', 'click', 'purchase']) AS class_name, unnest([0, 1, 2, 3, 4]) AS class_id"


@query("SELECT CAST(i - 1 AS INT) AS class_id, n[i] AS class_name FROM (SELECT regexp_extract_all('" + D.CLASS_METADATA.replace("'", "''") + "', '''([^'']+)''', 1) AS n), range(1, 6) AS t(i)")
def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.names_table(spark.createDataFrame([(D.CLASS_METADATA,)], "names string"))


@query(f"SELECT d.det_no, d.class_id, n.class_name FROM ({DET}) d JOIN ({NAMES}) n USING (class_id)")
def class_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lookup.names_table(spark.createDataFrame([(D.CLASS_METADATA,)], "names string"))
    return lookup.with_class_name(D.detections(spark, sf_dir), names).select("det_no", "class_id", "class_name")


@query(f"SELECT d.det_no, n.class_name || ' (' || printf('%.6f', d.confidence * 100) || '%)' AS label FROM ({DET}) d JOIN ({NAMES}) n USING (class_id)")
def box_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lookup.names_table(spark.createDataFrame([(D.CLASS_METADATA,)], "names string"))
    rows = lookup.with_class_name(D.detections(spark, sf_dir), names)
    return rows.select("det_no", X.label(F.col("class_name"), F.col("confidence")).alias("label"))


# --- text recognition ---------------------------------------------------------------------

STEPS = "SELECT vec_id, CAST(s AS INT) AS step, embedding[s * 8 + 1 : s * 8 + 8] AS e FROM embeddings, range(0, 8) AS t(s)"
BEST = f"SELECT vec_id, step, list_max(e) AS score, CAST(list_position(e, list_max(e)) - 1 AS INT) AS idx FROM ({STEPS})"


@query(BEST)
def ocr_argmax_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = D.steps(spark, sf_dir).select("vec_id", F.posexplode(ocr.best_steps(F.col("steps"))).alias("step", "b"))
    return best.select("vec_id", "step", "b.score", "b.idx")


@query(f"""SELECT e.vec_id, coalesce(line, '') AS line, CAST(coalesce(mean, 0) AS FLOAT) AS confidence FROM embeddings e LEFT JOIN (
 SELECT vec_id, string_agg(coalesce(['a', 'b', 'c', 'd', 'e'][idx], ''), '' ORDER BY step) AS line, sum(CAST(score AS DOUBLE) ORDER BY step) / count(*) AS mean FROM ({BEST})
 WHERE idx <> 0 AND score > CAST(0.1 AS FLOAT) GROUP BY vec_id) USING (vec_id)""")
def ocr_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.map_from_arrays(F.array(*[F.lit(i) for i in range(len(D.CHARACTERS))]), F.array(*[F.lit(c) for c in D.CHARACTERS]))
    return D.steps(spark, sf_dir).select("vec_id", ocr.read_line(F.col("steps"), chars, 0.1).alias("r")).select("vec_id", "r.line", "r.confidence")


@query(f"SELECT vec_id, step, coalesce(['a', 'b', 'c', 'd', 'e'][idx], '') AS ch FROM ({BEST}) WHERE idx <> 0")
def char_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = D.steps(spark, sf_dir).select("vec_id", F.posexplode(ocr.best_steps(F.col("steps"))).alias("step", "b")).select("vec_id", "step", "b.idx").where("idx <> 0")
    return lookup.with_character(best, spark.createDataFrame(list(enumerate(D.CHARACTERS)), "idx int, ch string")).select("vec_id", "step", "ch")


# --- text detection -----------------------------------------------------------------------

MAPS = D.pixel_maps_sql()
DILATED = f"""SELECT frame_id, x, y, max(m) OVER (PARTITION BY frame_id, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM (
 SELECT frame_id, x, y, max(m) OVER (PARTITION BY frame_id, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM ({MAPS}))"""


def components_sql(source: str) -> str:
    """Boxes of eight-connected set pixels of maps up to 8 x 8 in ``source``, by spreading the least pixel number."""
    return f"""px AS (SELECT frame_id, x, y, y * 8 + x AS p FROM ({source}) WHERE m = 1),
reach AS (
  SELECT frame_id, p, p AS root FROM px
  UNION
  SELECT r.frame_id, b.p, r.root FROM reach r JOIN px a ON a.frame_id = r.frame_id AND a.p = r.p
   JOIN px b ON b.frame_id = a.frame_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 AND b.p > r.root),
roots AS (SELECT frame_id, p, min(root) AS root FROM reach GROUP BY frame_id, p),
boxes AS (SELECT r.frame_id, root, min(x) AS x, min(y) AS y, CAST(max(x) - min(x) + 1 AS INT) AS w, CAST(max(y) - min(y) + 1 AS INT) AS h FROM roots r JOIN px USING (frame_id, p) GROUP BY r.frame_id, root),
numbered AS (SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY root) - 1 AS INT) AS box_no, x, y, w, h FROM boxes)"""


@query("SELECT vec_id, CAST(sum(CAST(round_even(CAST(v AS DOUBLE), 0) AS INT)) AS BIGINT) AS nonzero FROM (SELECT vec_id, unnest(list_transform(embedding, lambda e: abs(e) * CAST(3 AS FLOAT))) AS v FROM embeddings) GROUP BY vec_id")
def prob_binarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.transform("embedding", lambda e: (F.abs(e) * F.lit(3).cast("float")).cast("float"))).alias("v"))
    return rows.groupBy("vec_id").agg(F.sum(A.is_text_pixel(F.col("v"))).alias("nonzero"))


@query(DILATED)
def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lit(0.15).cast("float")
    maps = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.transform("embedding", lambda v: (v > t).cast("int")).alias("m"))
    each = maps.select("frame_id", F.posexplode(ocr.dilate(F.col("m"), F.lit(8))).alias("p", "m"))
    return each.select("frame_id", (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), "m")


@query(f"WITH RECURSIVE {components_sql(MAPS)} SELECT * FROM numbered")
def component_boxes_of_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_boxes(D.pixel_maps(spark, sf_dir).where("m = 1"))


HIGH = D.pixel_maps_sql(0.25)
HIGH_DILATED = DILATED.replace(MAPS, HIGH)
DETECTED = f"SELECT frame_id, CAST(box_no AS BIGINT) AS det_no, x, y, w, h, {D.SIZES} FROM numbered WHERE w * h > 4"


@query(f"WITH RECURSIVE {components_sql(HIGH_DILATED)}, {greedy(DETECTED, 'det_no', HULL_RATIO)} SELECT frame_id, CAST(det_no AS INT) AS box_no, x, y, w, h FROM ({scale_sql('SELECT * FROM kept', '8', '8')})")
def text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "embeddings")
    t = F.lit(0.25).cast("float")
    maps = D.sized(e.select(F.col("vec_id").alias("frame_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("embedding", lambda v: (v > t).cast("float")).alias("probs")))
    return ocr.detect_boxes(maps, min_area=4)


# --- pixels and tensors -------------------------------------------------------------------

PIXELS = D.PIXELS_SQL
_pixels = D.pixels


@query(f"SELECT vec_id, CAST(i - 1 AS INT) AS pos, CAST(CAST(px[i] AS FLOAT) / CAST(255 AS FLOAT) AS FLOAT) AS unit, CAST((px[i] / CAST(255.0 AS DOUBLE) - CAST(0.5 AS DOUBLE)) / CAST(0.5 AS DOUBLE) AS FLOAT) AS centered FROM ({PIXELS}), range(1, 193) AS t(i)")
def normalise_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pixels(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip(A.unit_pixels(F.col("px")).alias("u"), A.centered_pixels(F.col("px")).alias("c"))).alias("pos", "v"))
    return rows.select("vec_id", "pos", F.col("v.u").alias("unit"), F.col("v.c").alias("centered"))


@query(f"SELECT vec_id, CAST(c * 64 + p AS INT) AS pos, px[p * 3 + (2 - c) + 1] AS v FROM ({PIXELS}), range(0, 3) AS t(c), range(0, 64) AS u(p)")
def hwc_to_chw(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = A.planes_from_pixels(F.col("px"), F.lit(8), F.lit(8))
    return _pixels(spark, sf_dir).select("vec_id", F.posexplode(planes).alias("pos", "v"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 3 * CAST(l_quantity AS BIGINT) AS BIGINT) AS size FROM lineitem")
def shape_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.array(F.col("l_linenumber").cast("long"), F.lit(3).cast("long"), F.col("l_quantity").cast("long"))
    return D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", A.shape_size(shape).alias("size"))


HEX = "array_to_string(list_transform(px, lambda p: upper(lpad(hex(p), 2, '0'))), '')"


@query(f"SELECT vec_id, {HEX} AS pixels, 8 AS height, 8 AS width FROM ({PIXELS})")
def png_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images.decode_images(D.pngs(_pixels(spark, sf_dir)))
    return rows.select("vec_id", F.hex("data").alias("pixels"), "height", "width")


@query("SELECT vec_id, CAST(i - 1 AS INT) AS pos, greatest(embedding[i], CAST(0 AS FLOAT)) AS v FROM embeddings, range(1, 65) AS t(i)")
def model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = score.OnnxModel(score.elementwise_model("Relu", 64))
    out = score.score(D.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), model, "embedding")
    return out.select("vec_id", F.posexplode("output.data").alias("pos", "v"))


# --- requests and responses ---------------------------------------------------------------

REQUESTS = "SELECT doc_id AS request_id, coalesce(lang, 'none') AS model, text, doc_id % 7 = 0 AS cut, doc_id % 5 = 0 AS bad FROM documents"


@query(f"SELECT request_id, CASE WHEN NOT cut THEN model END AS model, CASE WHEN cut THEN 'kParameterError' END AS error_code, CAST(CASE WHEN cut THEN 0 ELSE 1 END AS INT) AS n_images FROM ({REQUESTS})")
def request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests.parse_requests(D.requests(spark, sf_dir))
    return rows.select("request_id", "model", "error_code", F.coalesce(F.size("images"), F.lit(0)).alias("n_images"))


@query(f"SELECT request_id, CAST(0 AS INT) AS image_no, CASE WHEN NOT bad THEN CAST(strlen(text) AS BIGINT) END AS n_bytes, CASE WHEN NOT bad THEN md5(text) END AS digest, CASE WHEN bad THEN 'kParameterError' END AS error_code FROM ({REQUESTS}) WHERE NOT cut")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests.request_images(requests.parse_requests(D.requests(spark, sf_dir)))
    return rows.select("request_id", "image_no", F.length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"), "error_code")


RESPONSES = f"SELECT frame_id // 4 AS request_id, CAST(frame_id % 4 AS INT) AS image_no, * FROM ({DET}) WHERE confidence > 0.9"


@query(f"""SELECT request_id, CAST(pos AS INT) AS pos, CAST(rank AS INT) AS rank, class_id, confidence, x, y, w, h FROM (
 SELECT request_id, dense_rank() OVER (PARTITION BY request_id ORDER BY image_no) - 1 AS pos, row_number() OVER (PARTITION BY request_id, image_no ORDER BY det_no) - 1 AS rank, class_id, CAST(confidence AS FLOAT) AS confidence, x, y, w, h FROM ({RESPONSES}))""")
def yolo_response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = yolo.confident(D.detections(spark, sf_dir), 0.9)
    rows = d.selectExpr("frame_id div 4 AS request_id", "CAST(frame_id % 4 AS INT) AS image_no", "det_no AS rank", "class_id", "CAST(confidence AS FLOAT) AS confidence", "x", "y", "w", "h")
    bodies = requests.to_body(requests.yolo_response(rows, ["view", "signup", "error", "click", "purchase"]))
    back = bodies.select("request_id", F.from_json("body", YOLO_RESPONSE).alias("b")).select("request_id", F.posexplode("b.results").alias("pos", "objects"))
    each = back.select("request_id", "pos", F.posexplode("objects").alias("rank", "o"))
    return each.select("request_id", "pos", "rank", "o.class_id", "o.confidence", *(F.col("o.bbox")[i].alias(c) for i, c in enumerate("xywh")))


LINES = f"SELECT vec_id // 4 AS request_id, vec_id % 4 AS image_no, step, idx, score FROM ({BEST}) WHERE idx <> 0"


@query(f"""SELECT request_id, CAST(image_no AS INT) AS image_no, CAST(row_number() OVER (PARTITION BY request_id, image_no ORDER BY step) - 1 AS INT) AS rank,
  coalesce(['a', 'b', 'c', 'd', 'e'][idx], '') AS line, score AS confidence, step AS x, idx AS y, CAST(step + idx AS INT) AS w, CAST(step * idx AS INT) AS h FROM ({LINES})""")
def ocr_response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step of an image that is no blank answers as a line of its own; images without one answer with an empty list."""
    best = D.steps(spark, sf_dir).select("vec_id", F.posexplode(ocr.best_steps(F.col("steps"))).alias("step", "b")).select("vec_id", "step", "b.score", "b.idx").where("idx <> 0")
    lines = lookup.with_character(best, spark.createDataFrame(list(enumerate(D.CHARACTERS)), "idx int, ch string"))
    rows = lines.selectExpr("vec_id div 4 AS request_id", "CAST(vec_id % 4 AS INT) AS image_no", "step AS rank", "ch AS line", "score AS confidence", "step AS x", "idx AS y", "step + idx AS w", "step * idx AS h")
    frames = D.table(spark, sf_dir, "embeddings").selectExpr("vec_id div 4 AS request_id", "CAST(vec_id % 4 AS INT) AS image_no", "CAST(NULL AS STRING) AS error_code")
    back = requests.to_body(requests.ocr_response(rows, frames=frames)).where("status = 200").select("request_id", F.posexplode(F.from_json("body", OCR_RESPONSE)["results"]).alias("image_no", "objects"))
    each = back.select("request_id", "image_no", F.posexplode("objects").alias("rank", "o"))
    return each.select("request_id", "image_no", "rank", "o.line", "o.confidence", *(F.col("o.bbox")[i].alias(c) for i, c in enumerate("xywh")))


# --- registry and options -----------------------------------------------------------------


@query(f"SELECT k AS kind, coalesce(names, '') AS names FROM (SELECT unnest(['ocr', 'yolo']) AS k) LEFT JOIN (SELECT kind AS k, string_agg(name, ',' ORDER BY pos) AS names FROM ({D.REGISTRY_SQL}) GROUP BY kind) USING (k)")
def model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.model_list(D.registry(spark)).select("kind", F.array_join("names", ",").alias("names"))


ASKED = "SELECT doc_id AS request_id, ['alpha', 'beta', 'gamma', 'delta'][1 + doc_id % 4] AS model FROM documents"


@query(f"""SELECT a.request_id, a.model, r.version, r.path, CASE WHEN r.name IS NULL OR r.version NOT IN ('kVCustom', 'kV10', 'kV11') THEN 'kModelError' END AS error_code FROM ({ASKED}) a LEFT JOIN (
 SELECT * FROM ({D.REGISTRY_SQL}) WHERE kind = 'yolo' QUALIFY row_number() OVER (PARTITION BY name ORDER BY pos) = 1) r ON r.name = a.model""")
def model_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("alpha", "beta", "gamma", "delta")])
    asked = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.get(names, (F.col("doc_id") % 4).cast("int")).alias("model"))
    return lookup.resolve(asked, D.registry(spark), "yolo").select("request_id", "model", "version", "path", "error_code")


PROVIDER_ROWS = [(f, p) for f in ("kONNXRUNTIME", "kTVM") for p in ("kCPU", "kDML", "kCUDA", "kTensorRT", "kRKNPU")]


@query("SELECT framework, ep, (framework, ep) IN (" + ", ".join(f"('{a}', '{b}')" for a, b in SUPPORTED) + ") AS supported FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PROVIDER_ROWS) + ") AS v(framework, ep)")
def ep_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.supported(spark.createDataFrame(PROVIDER_ROWS, "framework string, ep string"))


OPTIONS = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) || 'x' WHEN event_id % 3 = 1 THEN 'x' END AS device FROM events"


@query(f"SELECT event_id, coalesce(device, '0') AS device, try_cast(nullif(regexp_extract(coalesce(device, '0'), '^\\s*([+-]?\\d+)', 1), '') AS INT) AS device_id, CAST(1 + (event_id % 2 = 0)::INT AS INT) AS n_options FROM ({OPTIONS})")
def option_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    device = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("user_id").cast("string"), F.lit("x"))).when(F.col("event_id") % 3 == 1, F.lit("x"))
    given = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("infer_ep"), F.lit("kCPU"))).otherwise(F.create_map().cast("map<string,string>"))
    options = F.when(device.isNotNull(), F.map_concat(given, F.create_map(F.lit("infer_device"), device))).otherwise(given)
    rows = D.table(spark, sf_dir, "events").select("event_id", X.with_option(options, "infer_device", "0").alias("o"))
    value = X.option(F.col("o"), "infer_device", "0")
    return rows.select("event_id", value.alias("device"), X.leading_int(value).alias("device_id"), F.size("o").alias("n_options"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS kind FROM events")
def enum_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "events").select("event_id", X.one_of(F.col("event_type"), ["view", "click"]).alias("kind"))


@query("SELECT doc_id, CAST(length(replace(text, chr(13), '')) AS INT) AS n_clean, md5(replace(replace(text, chr(13), ''), chr(10), '')) AS one_line FROM documents")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(X.without_cr(F.col("text"))).alias("n_clean"), F.md5(X.one_line(F.col("text")).cast("binary")).alias("one_line"))


@query("SELECT event_id, 'user-' || user_id || ':' || (event_id % 65536) || ' -> ' || event_type AS line FROM events")
def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events")
    return e.select("event_id", X.access_line(F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.col("event_id") % 65536, F.col("event_type")).alias("line"))


# --- frames -------------------------------------------------------------------------------


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS at, user_id, count(*) AS frames FROM events GROUP BY 1, 2")
def frame_rate_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream.aligned_rate(D.frames(spark, sf_dir), key="user_id", width="1 hour")
    return rows.select(F.unix_timestamp("window_start").alias("at"), "user_id", "frames")


@query(f"SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(width, event_id) AS width, arg_max(height, event_id) AS height FROM ({D.FRAMES_SQL}) GROUP BY user_id")
def latest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.latest(D.frames(spark, sf_dir), "user_id", "event_id", ["event_id", "width", "height"])
