"""What workers and executors need from the driver."""

import os
import subprocess
import sys

import numpy as np
import pytest

from lumenframe.operators.components import dilated, mask_boxes
from lumenframe.operators.pipelines import infer_ocr
from lumenframe.sources import images

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ALONE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from lumenframe.operators import components, ocr, score, suppress
from lumenframe.sources import images
maps = spark.range(2).select(F.col("id").alias("frame_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.array_repeat(F.lit(1.0).cast("float"), 64).alias("probs"), F.lit(8).alias("orig_w"), F.lit(8).alias("orig_h"))
boxes = ocr.detect_boxes(maps, min_area=4)
assert boxes.count() == 2
assert components.component_boxes(spark.range(3).selectExpr("id AS frame_id", "1 AS x", "2 AS y")).count() == 3
assert suppress.nms_dense(boxes.selectExpr("*", "box_no AS det_no", "1.0D AS confidence")).count() == 2
assert images.decode_images(spark.range(1).selectExpr("id", "CAST('x' AS binary) AS content")).first().height == -1
assert score.score(maps.select("frame_id", "probs"), lambda x: x, "probs").count() == 2
from lumenframe.cluster import scratch
try:
    scratch(spark, "x")
except RuntimeError as e:
    assert "spark.checkpoint.dir" in str(e)
    print("FINE")
spark.stop()
"""


def test_workers_get_the_package_from_the_driver(tmp_path):
    """The package is importable on the driver alone, and executors are processes of their own."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS", "SPARK_ENV_LOADED")} | {"SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    (tmp_path / "alone.py").write_text(ALONE)
    (tmp_path / "conf").mkdir()  # a session without this machine's defaults
    env["SPARK_CONF_DIR"] = str(tmp_path / "conf")
    done = subprocess.run([sys.executable, "alone.py", ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "FINE" in done.stdout, done.stderr[-2000:]


def test_a_detector_sees_an_image_once(spark):
    rows = images.decode_images(spark.createDataFrame([(1, images.encode_png(np.zeros((8, 8, 3), np.uint8)))], "frame_id long, content binary")).drop("content")
    out = infer_ocr(rows, lambda x: x[:, :1], lambda x: np.zeros((1, 1, 2), np.float32), spark.createDataFrame([(0, "a")], "idx int, ch string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("maps(") == 1 and plan.count("label(") == 1


def naive_boxes(mask):
    seen, out = np.zeros_like(mask), []
    for y, x in np.argwhere(mask):
        if seen[y, x]:
            continue
        todo, seen[y, x], found = [(y, x)], True, []
        while todo:
            a, b = todo.pop()
            found.append((a, b))
            for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                    if mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
        ys, xs = zip(*found)
        out.append([min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1])
    return out


@pytest.mark.parametrize("share", [0.05, 0.3, 0.45, 0.6, 1.0, 0.0])
def test_regions_equal_flood_fill(share):
    rng = np.random.default_rng(int(share * 100))
    for h, w in ((1, 1), (1, 9), (9, 1), (17, 23), (40, 40)):
        mask = rng.random((h, w)) < share
        assert mask_boxes(mask).tolist() == naive_boxes(mask)
        wide = dilated(mask)
        assert all(wide[y, x] == mask[max(0, y - 3) : y + 1, max(0, x - 3) : x + 1].any() for y in range(h) for x in range(w))
