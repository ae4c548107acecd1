"""Frame streams: bounded intake, frame rates, latest frames and batch sinks."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenframe.cluster import ship

log = logging.getLogger("lumenframe")


def read_frames(spark: SparkSession, path: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    """A stream over Parquet files; a bounded number of them for each batch, oldest first, none lost."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def aligned_rate(frames: DataFrame, time: str = "ts", key: str | None = None, width: str = "1 second") -> DataFrame:
    """Frames for each aligned window; the aligned form of the frame counter."""
    keys = [F.window(F.col(time).cast("timestamp"), width).alias("w"), *([F.col(key)] if key else [])]
    return frames.groupBy(*keys).agg(F.count("*").alias("frames")).select(F.col("w.start").alias("window_start"), *([key] if key else []), "frames")


class FrameRate:
    """Counts frames; the first frame at least ``window`` seconds after the window began closes it and starts the next.

    Windows are neither aligned nor of one length; the rate is the count over the time that passed.
    """

    def __init__(self, start: float, window: float = 1.0):
        self.start, self.window, self.count, self.rate = start, window, 0, 0.0

    def update(self, now: float) -> float | None:
        self.count += 1
        passed = now - self.start
        if passed < self.window:
            return None
        self.rate, self.start, self.count = self.count / passed, now, 0
        return self.rate


def frame_rate(frames: DataFrame, key: str, time: str = "ts", window: float = 1.0, forget_ms: int | None = None) -> DataFrame:
    """Stream of (key, at, frames_per_second), a row whenever a key's window closes. The clock is the column ``time``, in seconds.

    With ``forget_ms`` a key without frames for so long, by processing time, loses its state and starts afresh with its next frame; such a
    stream runs batches without data too, so it never ends by itself under availableNow.
    A batch's frames of a key are sorted together: the intake bounds a batch.
    """
    ship(frames.sparkSession)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = np.sort(np.concatenate([p["t"].to_numpy() for p in parts]))
        counter = FrameRate(float(times[0]), window)
        if state.exists:
            counter.start, counter.count = state.get
        out = []
        for t in times.tolist():
            rate = counter.update(t)
            if rate is not None:
                out.append((k[0], t, rate))
        state.update((float(counter.start), int(counter.count)))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        if out:
            yield pd.DataFrame(out, columns=["k", "at", "frames_per_second"])

    keyed = frames.select(F.col(key).alias("k"), F.col(time).cast("timestamp").cast("double").alias("t"))
    kind = keyed.schema["k"].dataType.simpleString()
    return keyed.groupBy("k").applyInPandasWithState(step, f"k {kind}, at double, frames_per_second double", "start double, count long", "append", GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def latest(frames: DataFrame, key: str | None, order: str, carry: list[str]) -> DataFrame:
    """The newest frame (of each key): the others are dropped."""
    best = F.max_by(F.struct(*carry), F.col(order)).alias("f")
    return (frames.groupBy(key) if key else frames.groupBy()).agg(best).select(*([key] if key else []), "f.*")


def show_latest(frames: DataFrame, show: Callable[[DataFrame], None], key: str | None, order: str, carry: list[str], checkpoint: str) -> StreamingQuery:
    """Each batch shows its newest frame alone."""
    return frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: show(latest(df, key, order, carry))).start()


def to_console(frames: DataFrame, checkpoint: str) -> StreamingQuery:
    return frames.writeStream.format("console").option("checkpointLocation", checkpoint).start()


def run_to_end(query: StreamingQuery) -> None:
    query.processAllAvailable()
    query.stop()
