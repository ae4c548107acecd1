"""Streams give what batches give, and the frame counter follows its clock."""

import pytest

from lumenframe.streaming import frames as S


def test_frame_rate_counter():
    c = S.FrameRate(0.0)
    assert [c.update(t) for t in (0.4, 0.9, 1.25, 1.5, 3.25)] == [None, None, 3 / 1.25, None, 1.0]


def test_stream_rate_equals_batch(spark, tmp_path):
    rows = [(u, float(t) * 0.375 + u * 0.125) for u in range(3) for t in range(20)]
    df = spark.createDataFrame(rows, "user_id long, s double").selectExpr("user_id", "timestamp_seconds(s) AS ts")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    live = S.read_frames(spark, str(tmp_path / "in"), "user_id long, ts timestamp")
    q = S.frame_rate(live, "user_id").writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    S.run_to_end(q)
    got = sorted((r.k, round(r.at, 6), round(r.frames_per_second, 9)) for r in spark.table("rates").collect())
    want = []
    for u in range(3):
        times = sorted(round(s, 6) for k, s in rows if k == u)
        c = S.FrameRate(times[0])
        for t in times:
            r = c.update(t)
            if r is not None:
                want.append((u, t, r))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-6)


def test_latest(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c")], "k int, seq int, f string")
    assert sorted(map(tuple, S.latest(df, "k", "seq", ["seq", "f"]).collect())) == [(1, 9, "b"), (2, 1, "c")]
    assert [tuple(r) for r in S.latest(df, None, "seq", ["f"]).collect()] == [("b",)]


def test_show_latest(spark, tmp_path):
    spark.createDataFrame([(1, 5), (1, 9)], "k int, seq int").repartition(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = S.show_latest(S.read_frames(spark, str(tmp_path / "in"), "k int, seq int"), lambda d: seen.extend(map(tuple, d.collect())), None, "seq", ["seq"], str(tmp_path / "c"))
    S.run_to_end(q)
    assert seen == [(9,)]


def test_listener_and_console(spark, tmp_path, caplog, capfd):
    import logging
    import time

    from lumenframe.logs import ProgressListener, logger, write

    spark.createDataFrame([(1, 5)], "k int, seq int").repartition(1).write.parquet(str(tmp_path / "in"))
    listener = ProgressListener()
    spark.streams.addListener(listener)
    try:
        with caplog.at_level(logging.DEBUG, logger="lumenframe"):
            S.run_to_end(S.to_console(S.read_frames(spark, str(tmp_path / "in"), "k int, seq int"), str(tmp_path / "c")))
            for _ in range(100):
                if any("ended" in r.getMessage() for r in caplog.records):
                    break
                time.sleep(0.1)
            write("io", "fatal", "two\r\nlines")
    finally:
        spark.streams.removeListener(listener)
    said = [(r.name, r.getMessage()) for r in caplog.records]
    assert any(n == "lumenframe.stream" and m.startswith("started") for n, m in said) and any(m.endswith("1 rows") for _, m in said) and ("lumenframe.io", "twolines") in said
    assert logger("io") is logger("io")


def test_state_of_silent_keys_can_go(spark, tmp_path):
    """With a time limit the stream goes on by itself and its state empties."""
    import time

    spark.createDataFrame([(1, 0.0), (2, 0.0)], "k int, s double").selectExpr("k", "timestamp_seconds(s) AS ts").repartition(1).write.parquet(str(tmp_path / "in"))
    live = S.read_frames(spark, str(tmp_path / "in"), "k int, ts timestamp")
    q = S.frame_rate(live, "k", forget_ms=500).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        left = None
        for _ in range(300):
            states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
            left = states[-1] if states else left
            if left == 0 and max(states) == 2:
                break
            time.sleep(0.2)
        assert left == 0
    finally:
        q.stop()


def test_frames_may_come_in_several_files(spark, tmp_path):
    """A frame's boxes in two batches, the surer one in the second, are suppressed together, as in SQL."""
    import duckdb
    import numpy as np

    from lumenframe.plans.flows import QUERIES, SQL

    rnd = np.random.default_rng(5)
    rows = [(i, [0.5, 0.5, 0.25 + 0.01 * (i % 3), 0.25] + (rnd.random(60) * (0.5 + 0.004 * i)).tolist(), 0) for i in range(120)]
    schema = "vec_id long, embedding array<float>, label int"
    for part in (range(0, 30), range(30, 70), range(70, 120)):  # files end within frames of 50
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["stream_detections"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL['stream_detections']})").fetchall()
    assert len(want) == 3 and sorted(map(tuple, got.collect())) == sorted(want)
