"""Model scoring: a pluggable forward pass over Arrow batches, one session for each Python worker.

A scorer maps a float32 array to float32 arrays. ``OnnxModel`` runs ONNX bytes, which travel in the task closure,
with one thread to a task; ``PROVIDERS_OF`` names the execution provider to ask for.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenframe.functions.text import class_names  # noqa: F401  (names come from the metadata by the same rule)
from lumenframe.cluster import ship
from lumenframe.schema import TENSOR

# Execution provider names.
PROVIDERS_OF = {
    "kCPU": "CPUExecutionProvider", "kDML": "DmlExecutionProvider", "kCUDA": "CUDAExecutionProvider", "kTensorRT": "TensorrtExecutionProvider",
}
_SESSIONS: dict[tuple, object] = {}


class OnnxModel:
    """A model's bytes; its session is made on first use and kept by the worker."""

    def __init__(self, blob: bytes, provider: str = "kCPU"):
        if provider not in PROVIDERS_OF:
            raise ValueError(f"kModelError: unsupported execution provider {provider}")
        self.blob, self.provider = blob, provider

    def session(self):
        key = (zlib.crc32(self.blob), len(self.blob), self.provider)
        if key not in _SESSIONS:
            import onnxruntime as ort

            options = ort.SessionOptions()
            options.intra_op_num_threads = options.inter_op_num_threads = 1
            options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
            _SESSIONS[key] = ort.InferenceSession(self.blob, options, providers=[PROVIDERS_OF[self.provider]])
        return _SESSIONS[key]

    def names(self) -> str | None:
        return self.session().get_modelmeta().custom_metadata_map.get("names")

    def signature(self) -> dict[str, list]:
        s = self.session()
        return {"inputs": [(i.name, i.type, i.shape) for i in s.get_inputs()], "outputs": [(o.name, o.type, o.shape) for o in s.get_outputs()]}

    def __call__(self, x: np.ndarray) -> np.ndarray:
        s = self.session()
        first = s.get_inputs()[0]
        kinds = {"tensor(float)": np.float32, "tensor(float16)": np.float16}
        if first.type not in kinds:
            raise ValueError(f"kModelError: unsupported tensor type {first.type}")
        return np.asarray(s.run(None, {first.name: x.astype(kinds[first.type])})[0], np.float32)


def float_rows(column: pa.Array) -> list[np.ndarray | None]:
    """The arrays of a list column as views of its values."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    missing = column.is_null().to_pylist()
    return [None if m else np.asarray(values[a:b], np.float32) for m, a, b in zip(missing, at, at[1:], strict=False)]


def float_lists(rows: list[np.ndarray | None]) -> pa.ListArray:
    """A list column from arrays; None is NULL."""
    at = np.concatenate([[0], np.cumsum([0 if r is None else r.size for r in rows])]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.float32), *(np.asarray(r, np.float32).ravel() for r in rows if r is not None)])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values), mask=pa.array([r is None for r in rows], pa.bool_()))


def score(rows: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], column: str = "data", into: str = "output", batched: bool = True) -> DataFrame:
    """Adds ``into`` (shape, data) for each row's float array; rows of one length go together when ``batched``."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = float_rows(batch.column(column))
            out: list[np.ndarray | None] = [None] * len(values)
            for n in sorted({len(v) for v in values if v is not None}):
                at = [i for i, v in enumerate(values) if v is not None and len(v) == n]
                for part in [at] if batched else [[i] for i in at]:
                    for i, r in zip(part, scorer(np.stack([values[i] for i in part])), strict=True):
                        out[i] = np.asarray(r, np.float32)
            shape = pa.array([None if r is None else list(r.shape) for r in out], pa.list_(pa.int64()))
            both = pa.StructArray.from_arrays([shape, float_lists(out)], ["shape", "data"], mask=pa.array([r is None for r in out], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, both], [*batch.schema.names, into])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, {into} {TENSOR}")


def _field(number: int, wire: int, body: bytes | int) -> bytes:
    def varint(n: int) -> bytes:
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    head = varint(number << 3 | wire)
    return head + (varint(body) if wire == 0 else varint(len(body)) + body)


def elementwise_model(op: str = "Relu", width: int = 64, names: str = "{0: 'a'}", half: bool = False) -> bytes:
    """A one-node ONNX model over [batch, width] floats, or half floats, written field by field: a stand-in where no model is shipped."""
    text = lambda n, s: _field(n, 2, s.encode())

    def value(name: str) -> bytes:
        dims = _field(1, 2, _field(2, 2, b"n")) + _field(1, 2, _field(1, 0, width))
        return text(1, name) + _field(2, 2, _field(1, 2, _field(1, 0, 10 if half else 1) + _field(2, 2, dims)))

    node = text(1, "x") + text(2, "y") + text(4, op)
    graph = _field(1, 2, node) + text(2, "g") + _field(11, 2, value("x")) + _field(12, 2, value("y"))
    return _field(1, 0, 8) + _field(7, 2, graph) + _field(8, 2, _field(2, 0, 13)) + _field(14, 2, text(1, "names") + text(2, names))
