"""Images, models, requests, registries, dictionaries and end-to-end pipelines."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import text as X
from lumenframe.operators import requests as R
from lumenframe.operators.components import component_boxes
from lumenframe.operators.pipelines import infer_ocr, infer_yolo
from lumenframe.operators.score import OnnxModel, elementwise_model, score
from lumenframe.sources import files, images, registry


def test_png_round_trip_and_errors(spark):
    rng = np.random.default_rng(0)
    px = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    rows = [(0, images.encode_png(px)), (1, b"nonsense"), (2, None), (3, b""), (4, images.encode_png(px)[:40])]
    got = images.decode_images(spark.createDataFrame(rows, "frame_id int, content binary")).orderBy("frame_id").collect()
    assert (got[0].height, got[0].width, bytes(got[0].data), got[0].error) == (5, 7, px.tobytes(), None)
    assert all(r.height == -1 and r.error for r in got[1:])


def test_letterbox_and_tensor():
    px = np.full((50, 100, 3), 200, np.uint8)
    out = images.letterboxed(px, 64, 64)
    assert out.shape == (64, 64, 3) and out[:16].max() == 0 and out[16:48].min() == 200 and out[48:].max() == 0
    t = images.input_tensor(np.dstack([np.full((2, 2), v, np.uint8) for v in (10, 20, 255)]))
    assert t.shape == (3, 2, 2) and t[0, 0, 0] == 1.0 and abs(t[2, 0, 0] - 10 / 255) < 1e-7
    assert images.input_tensor(px, half=True).dtype == np.float16


def test_onnx_model(spark):
    m = OnnxModel(elementwise_model("Relu", 4, "{0: 'x', 1: 'y z'}"))
    assert m.names() == "{0: 'x', 1: 'y z'}"
    df = spark.createDataFrame([(1, [1.0, -2.0, 3.0, -4.0]), (2, None)], "i int, data array<float>")
    got = {r.i: r.output for r in score(df, m).collect()}
    assert list(got[1].data) == [1, 0, 3, 0] and list(got[1].shape) == [4] and got[2] is None
    with pytest.raises(ValueError, match="kModelError"):
        OnnxModel(b"", "kRKNPU")


def test_requests(spark):
    ok = json.dumps({"model": "m", "images": [base64.b64encode(b"abc").decode(), "@@@"]})
    rows = [(1, ok), (2, '{"model": '), (3, None), (4, '{"model": "m"}'), (5, '{"model": "m", "images": []}')]
    parsed = R.parse_requests(spark.createDataFrame(rows, "request_id int, body string"))
    got = {r.request_id: r for r in parsed.collect()}
    assert got[1].model == "m" and got[1].error_code is None and got[5].error_code is None
    assert [got[i].error_code for i in (2, 3, 4)] == ["kParameterError"] * 3
    each = {(r.request_id, r.image_no): r for r in R.request_images(parsed).collect()}
    assert bytes(each[1, 0].content) == b"abc" and each[1, 1].error_code == "kParameterError"


def test_all_codes_are_known_ones(spark):
    from lumenframe.operators.lookup import resolve
    from lumenframe.schema import ERROR_CODES

    r = registry.read_registry(spark, "yolo:\n- {name: a, version: kV99, path: p}\nocr:\n- {name: o, version: x, det_path: p, rec_path: p, char_dict_path: p}\n")
    asked = spark.createDataFrame([(m,) for m in ("a", "o", "none")], "model string")
    codes = {x.error_code for kind in ("yolo", "ocr") for x in resolve(asked, r, kind).collect()}
    assert codes == {"kModelError", "kParameterError"} and codes < set(ERROR_CODES)


def test_answers_for_text(spark):
    from lumenframe.operators.pipelines import answer_ocr
    from lumenframe.plans.flows import map_detector, width_recognizer

    px = np.zeros((32, 32, 3), np.uint8)
    px[4:12, 4:14] = 255
    code = lambda b: base64.b64encode(b).decode()
    ok = json.dumps({"model": "o", "images": [code(images.encode_png(px)), code(b"no image"), code(images.encode_png(px * 0))]})
    rows = [(1, ok), (2, json.dumps({"model": "o", "images": []})), (3, "{"), (4, json.dumps({"model": "p", "images": []}))]
    r = registry.read_registry(spark, "ocr:\n- {name: o, version: kPPOCRv4, det_path: p, rec_path: p, char_dict_path: p}\n")
    dictionary = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, ch string")
    asked = spark.createDataFrame(rows, "request_id int, body string")
    got = {x.request_id: x for x in answer_ocr(asked, r, {"o": (map_detector, width_recognizer, dictionary)}).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == [200, 200, 400, 400]
    line = {"line": "bb", "confidence": 0.625, "bbox": [4, 4, 13, 11]}
    assert json.loads(got[1].body) == {"results": [[line], []]} and json.loads(got[2].body) == {"results": []}
    kept = {x.request_id: x for x in answer_ocr(asked, r, {"o": (map_detector, width_recognizer, dictionary)}, keep_errors=True).collect()}
    assert json.loads(kept[1].body) == {"results": [[line], [], []]}


def test_failed_frames_vanish_or_stay(spark):
    rows = spark.createDataFrame([(1, 2, 0, 7, 0.5, 1, 2, 3, 4)], "request_id int, image_no int, rank int, class_id int, confidence float, x int, y int, w int, h int")
    frames = spark.createDataFrame([(1, 0, "kParameterError"), (1, 1, None), (1, 2, None)], "request_id int, image_no int, error_code string")
    got = R.to_body(R.yolo_response(rows, ["a"], frames=frames)).first()
    assert json.loads(got.body) == {"class_names": ["a"], "results": [[], [{"class_id": 7, "confidence": 0.5, "bbox": [1, 2, 3, 4]}]]}
    assert len(json.loads(R.to_body(R.yolo_response(rows, ["a"], frames=frames, keep_errors=True)).first().body)["results"]) == 3


def test_files(spark, tmp_path):
    (tmp_path / "d.txt").write_bytes(b"a\r\n\r\nb\rc\nlast")
    (tmp_path / "e.txt").write_bytes(b"")
    p = str(tmp_path / "d.txt")
    assert [(r.line_no, r.line) for r in files.read_lines(spark, p).orderBy("line_no").collect()] == [(0, "a"), (1, ""), (2, "bc"), (3, "last")]
    assert files.read_texts(spark, p).first().text == "a\n\nbc\nlast\n"
    assert files.read_dictionary(spark, p).count() == 4
    assert files.file_bytes(spark, p).startswith(b"a\r\n")
    with pytest.raises(OSError, match="kIOError"):
        files.file_bytes(spark, str(tmp_path / "e.txt"))


def test_registry(spark):
    text = "yolo:\n- {name: a, version: kV11, path: p}\nocr: []\n"
    r = registry.read_registry(spark, text)
    assert json.loads(registry.model_list_json(r).first().body) == {"ocr": [], "yolo": ["a"]}
    with pytest.raises(RuntimeError, match="kRuntimeError"):
        registry.registry_rows("a: [")
    with pytest.raises(RuntimeError):
        registry.registry_rows("yolo:\n- {name: a}\n")
    c = registry.ServerConfig.parse("port: 1\noptions: {infer_ep: kCPU}")
    assert (c.port, c.option("infer_ep"), c.option("infer_device"), c.options["infer_device"]) == (1, "kCPU", "0", "0")
    registry.check_engine("kONNXRUNTIME", "kDML")
    for bad in (("kONNXRUNTIME", "kRKNPU"), ("kTVM", "kCPU"), ("x", "kCPU")):
        with pytest.raises(ValueError):
            registry.check_engine(*bad)


def test_leading_int(spark):
    df = spark.createDataFrame([(" 12x",), ("-3",), ("x1",), ("",), (None,), ("99999999999",)], "s string")
    assert [r[0] for r in df.select(X.leading_int(F.col("s"))).collect()] == [12, -3, None, None, None, None]


def test_components_touch_at_corners(spark):
    px = [(0, 0, 0), (0, 1, 1), (0, 5, 0), (0, 4, 1), (0, 3, 0), (0, 9, 9)]
    got = component_boxes(spark.createDataFrame(px, "frame_id int, x int, y int")).orderBy("box_no").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 0, 2, 2), (0, 1, 3, 0, 3, 2), (0, 2, 9, 9, 1, 1)]


def test_infer_yolo(spark):
    px = np.zeros((64, 64, 3), np.uint8)
    rows = images.decode_images(spark.createDataFrame([(1, images.encode_png(px)), (2, b"bad")], "frame_id long, content binary")).drop("content")

    def v11(x):
        out = np.zeros((1, 6, 3), np.float32)
        out[0, :, 0], out[0, :, 1], out[0, :, 2] = (32, 32, 20, 20, 0.1, 0.9), (33, 32, 20, 20, 0.1, 0.8), (10, 10, 4, 4, 0.7, 0.2)
        return out

    got = sorted((r.class_id, r.x, r.y, r.w, r.h) for r in infer_yolo(rows, v11, "kV11", 64, 64).collect())
    assert got == [(0, 8, 8, 4, 4), (1, 22, 22, 20, 20)]
    v10 = lambda x: np.array([[[1, 2, 11, 12, 0.125, 1], [0, 0, 5, 5, 0.1, 0]]], np.float32)
    assert [(r.class_id, r.x, r.y, r.w, r.h) for r in infer_yolo(rows, v10, "kV10", 64, 64).collect()] == [(1, 1, 2, 10, 10)]
    with pytest.raises(ValueError, match="kParameterError"):
        infer_yolo(rows, v10, "kV12", 64, 64)


def test_infer_ocr(spark):
    px = np.zeros((32, 64, 3), np.uint8)
    rows = images.decode_images(spark.createDataFrame([(1, images.encode_png(px))], "frame_id long, content binary")).drop("content")

    def det(x):
        p = np.zeros((1, 1, *x.shape[2:]), np.float32)
        p[0, 0, 4:20, 8:40] = 0.9
        return p

    def rec(x):
        assert x.shape[1:3] == (3, 48) and x.shape[3] % 48 == 0 and float(x.max()) == -1.0
        return np.array([[[0.1, 0.9, 0], [0.1, 0.8, 0], [0.9, 0, 0], [0, 0, 0.7]]], np.float32)

    chars = spark.createDataFrame([(0, "a"), (1, "b")], "idx int, ch string")
    got = infer_ocr(rows, det, rec, chars).collect()
    assert [(r.line, r.x, r.y, r.w, r.h) for r in got] == [("aab", 8, 4, 35, 19)]  # repeats stay; three pixels of dilation
    assert abs(got[0].confidence - 0.8) < 1e-6
