"""Greedy suppression against plain Python, with ties and exact thresholds."""

import random

from lumenframe.operators.suppress import hull_dedupe, nms, nms_dense


def iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter, both = max(w, 0) * max(h, 0), a[2] * a[3] + b[2] * b[3]
    return 1.0 if both <= 0 else inter / (both - inter)


def greedy(boxes, overlaps):
    kept = []
    for n, b in boxes:
        if not any(overlaps(k, b) for _, k in kept):
            kept.append((n, b))
    return {n for n, _ in kept}


def rows(seed=1):
    rnd = random.Random(seed)
    out = []
    for frame in range(6):
        for n in range(40):
            out.append((frame, n, rnd.randrange(60), rnd.randrange(60), rnd.choice([0, 1, 20, 30]), rnd.choice([0, 10, 30]), rnd.choice([-0.5, 0.0, 0.2, 0.5, 0.9, 0.9])))
    return out


KIND = "frame_id long, det_no int, x int, y int, w int, h int, confidence double"


def test_nms_fold_and_dense(spark):
    data = rows()
    want = set()
    for frame in range(6):
        own = sorted(((-c, n, (x, y, w, h)) for f, n, x, y, w, h, c in data if f == frame and c > 0))
        want |= {(frame, n) for n in greedy([(n, b) for _, n, b in own], lambda k, b: iou(k, b) > 0.3)}
    df = spark.createDataFrame(data, KIND)
    assert {(r.frame_id, r.det_no) for r in nms(df).collect()} == want
    assert {(r.frame_id, r.det_no) for r in nms_dense(df).collect()} == want


def test_nms_properties(spark):
    df = spark.createDataFrame(rows(2), KIND)
    once = nms(df).cache()
    kept = once.collect()
    for a in kept:
        for b in kept:
            if a.frame_id == b.frame_id and a.det_no < b.det_no:
                assert iou(a[2:6], b[2:6]) <= 0.3
    assert sorted(map(tuple, nms(once).collect())) == sorted(map(tuple, kept))  # idempotent
    best = {}
    for r in df.where("confidence > 0").collect():
        best[r.frame_id] = max(best.get(r.frame_id, (0, 0)), (r.confidence, -r.det_no))
    assert {(f, -n) for f, (_, n) in best.items()} <= {(r.frame_id, r.det_no) for r in kept}


def test_exact_threshold_is_kept(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 13, 10, 0.9), (0, 1, 7, 0, 13, 10, 0.8)], KIND)  # 60 / 200 = 0.3
    assert nms(df).count() == 2


def test_one_box_does_not_suppress_after_being_suppressed(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 20, 10, 0.9), (0, 1, 8, 0, 20, 10, 0.8), (0, 2, 16, 0, 20, 10, 0.7)], KIND)
    assert sorted(r.det_no for r in nms(df).collect()) == [0, 2]


def test_hull_dedupe_keeps_input_order(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 10, 10, 0.1), (0, 1, 1, 1, 10, 10, 0.9), (0, 2, 0, 0, 2, 2, 0.9)], KIND)
    assert [r.det_no for r in hull_dedupe(df, order="det_no").collect()] == [0]
