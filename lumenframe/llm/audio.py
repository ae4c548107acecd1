"""Audio features of 8-bit mono WAV columns: log-mel tensors over energetic time spans.

``store_wav`` keeps payload bytes losslessly as the samples of 8-bit PCM WAV files in a table
column; ``features`` reads such a column back. Samples are resampled by a polyphase filter (a
windowed-sinc low-pass split into phases, evaluated at the output rate only), cut into overlapped Hann
frames and turned into log-mel energies. Frame energy with two thresholds (hysteresis) marks segments,
and the whole clip, then each segment, becomes one fixed-shape tensor ``time_bins x mels`` of pooled log-mels, quantized to
sixteenths, with its time span. ``write_tensors`` stores them in Arrow IPC files, in columns of Arrow's fixed-shape tensor type
beside their time spans, and ``read_tensors`` reads these files back; the query's features are those read back.

Nulls and empties: a null payload is empty; padding makes every stored payload at least one unit
long. A clip is padded with silence to one frame and whole hops behind it, so its last samples are in a frame. Silence has the whole clip alone. Every
row is computed alone in fixed steps, so equal payloads give equal values. Null ids and repeated rows are kept, each with its own result.
An empty table gives no rows and no files. Texts are stored whole; a task holds one batch of clips. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._common import lean, read_all, saved, scratch, ship, small_batches, write_committed


@dataclass(frozen=True)
class Settings:
    rate: int = 16_000
    up: int = 3
    down: int = 4
    taps: int = 32
    frame: int = 256
    hop: int = 128
    mels: int = 24
    time_bins: int = 8
    rise: float = 0.5
    fall: float = -0.25
    least_frames: int = 3
    filter: np.ndarray = field(init=False, repr=False, compare=False)
    window: np.ndarray = field(init=False, repr=False, compare=False)
    bank: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        n = self.taps * self.up + 1
        x = np.arange(n) - (n - 1) / 2
        cut = 1.0 / max(self.up, self.down)
        h = np.sinc(x * cut) * cut * np.hamming(n)
        object.__setattr__(self, "filter", (h / h.sum() * self.up).astype(np.float64))
        object.__setattr__(self, "window", np.hanning(self.frame + 1)[:-1].astype(np.float32))
        object.__setattr__(self, "bank", mel_bank(self.mels, self.frame, self.rate * self.up / self.down).astype(np.float32))


def mel_bank(mels: int, frame: int, rate: float) -> np.ndarray:
    """Triangular filters, equally spaced in mel, over the bins of a real FFT."""
    mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(0.0, mel(rate / 2), mels + 2) / 2595.0) - 1.0)
    f = np.linspace(0.0, rate / 2, frame // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0.0, np.minimum(up, down))


def wav_bytes(samples: bytes, rate: int) -> bytes:
    """A RIFF file with one channel of unsigned 8-bit samples; an odd length gets RIFF's pad byte."""
    pad = b"\0" * (len(samples) % 2)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(samples) + len(pad), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + pad


def wav_samples(blob: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit mono PCM WAV file."""
    if blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], int.from_bytes(blob[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", blob[at + 8 : at + 24])
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return blob[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def resample(x: np.ndarray, s: Settings) -> np.ndarray:
    """Output n is the sum over the phase of the filter that meets input samples: no work on inserted zeros or dropped outputs."""
    n_out = -(-len(x) * s.up // s.down)
    half = (len(s.filter) - 1) // 2
    phases = -(-len(s.filter) // s.up)
    padded = np.concatenate([np.zeros(phases + 1), x, np.zeros(phases + 1)])
    out = np.empty(n_out)
    cycle = s.up // np.gcd(s.up, s.down)
    for k in range(cycle):  # outputs k, k+cycle, ... use one phase
        m = np.arange(k, n_out, cycle)
        if not len(m):
            continue
        pos = k * s.down + half
        phase, first = pos % s.up, pos // s.up
        taps = s.filter[phase :: s.up]
        step = cycle * s.down // s.up
        begin = first + phases + 1
        total = np.zeros(len(m))
        for j, h in enumerate(taps):
            at = begin - j
            seg = padded[max(at, 0) : at + step * (len(m) - 1) + 1 : step]
            total[len(m) - len(seg) :] += h * seg
        out[k::cycle] = total
    return out


def log_mels(x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies in dB (frames x mels) and frame energies in dB, in steps of a fixed number of frames."""
    hops = max(0, -(-(len(x) - s.frame) // s.hop))  # behind the first frame
    x = np.concatenate([x, np.zeros(s.frame + hops * s.hop - len(x))])
    frames = np.lib.stride_tricks.sliding_window_view(x.astype(np.float32), s.frame)[:: s.hop]
    mels, energy = [], []
    for at in range(0, len(frames), 2048):
        f = frames[at : at + 2048] * s.window
        spectrum = np.fft.rfft(f, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mels.append(10.0 * np.log10(power @ s.bank + np.float32(1e-6)))
        energy.append(10.0 * np.log10((f * f).sum(1) + 1e-6))
    return np.concatenate(mels), np.concatenate(energy)


def hysteresis(energy: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """Frame ranges that begin above the mean plus ``rise`` standard deviations and last while energy stays above it plus ``fall`` of them."""
    e = np.round(energy, 2)
    level, spread = np.round(e.mean(), 2), np.round(e.std(), 2)
    state = np.where(e >= level + s.rise * spread, 1, np.where(e < level + s.fall * spread, 0, -1))
    known = np.where(state >= 0, np.arange(len(e)), -1)
    at = np.maximum.accumulate(known)
    on = (at >= 0) & (state[np.maximum(at, 0)] == 1)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True) if b - a >= s.least_frames and e[a] > -50]


def segment_tensors(samples: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Spans in milliseconds (n x 2, int64) and tensors (n x time_bins x mels, int16 sixteenths of a dB) of a clip."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128.0) / 128.0
    x -= x.mean()
    mels, energy = log_mels(resample(x, s), s)
    found = [(0, len(energy)), *hysteresis(energy, s)]
    spans = np.array(found, np.int64)
    cut = spans[:, :1] + (np.arange(s.time_bins) * (spans[:, 1:] - spans[:, :1])) // s.time_bins  # first frame of each bin
    end = np.maximum(cut + 1, np.concatenate([cut[:, 1:], spans[:, 1:]], 1))
    sums = np.zeros((len(mels) + 1, s.mels))
    np.cumsum(mels, axis=0, out=sums[1:], dtype=np.float64)
    pooled = (sums[end] - sums[cut]) / (end - cut)[:, :, None]
    ms = 1000.0 * s.down / (s.rate * s.up)
    times = np.stack([spans[:, 0] * s.hop * ms, ((spans[:, 1] - 1) * s.hop + s.frame) * ms], 1)
    return np.rint(times).astype(np.int64), np.rint(pooled * 16).astype(np.int16)


def store_wav(rows: DataFrame, *, unit: int = 192, pad: int = 32, rate: int = 16_000) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, media): UTF-8 padded with ``pad`` to a positive multiple of ``unit``, as WAV bytes, in a saved table."""
    ship(rows.sparkSession)
    small_batches(rows.sparkSession)

    def to_wav(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, media = [], []
            for raw in batch.column("raw").to_pylist():
                raw = raw or b""
                size = max(unit, -(-len(raw) // unit) * unit)
                n.append(len(raw))
                media.append(wav_bytes(raw.ljust(size, bytes([pad])), rate))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    raw = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return saved(raw.mapInArrow(lean(to_wav), "doc_id long, n_bytes long, media binary"), "wav")


def features(media: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Spans and tensors of each row of a stored table: doc_id, n_bytes, media, spans array<array<long>>, tensors array<array<short>>."""
    ship(media.sparkSession)
    s = settings or Settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, tensors = [], []
            for blob in batch.column("media").to_pylist():
                t, x = segment_tensors(wav_samples(blob)[0], s)
                spans.append(t.tolist())
                tensors.append(x.reshape(len(x), -1).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(tensors, pa.list_(pa.list_(pa.int16())))], [*batch.schema.names, "spans", "tensors"])

    return media.mapInArrow(lean(run), "doc_id long, n_bytes long, media binary, spans array<array<long>>, tensors array<array<short>>")


def tensor_array(tensors: np.ndarray) -> pa.FixedShapeTensorArray:
    """Arrow's fixed-shape tensor type; its first dimension is the row."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))


CLIPS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
_CLIP = pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])


def write_tensors(media: DataFrame, path: str, settings: Settings | None = None) -> DataFrame:
    """Read stored WAV bytes and write Arrow IPC files with a row per segment: clip (its place in the file's list), start_ms, end_ms, tensor.

    Returns the saved manifest (file, segments, clips: what was read of each clip, in order). Files are named by task and batch and taken by
    rename, so a retried task replaces its files with equal ones.
    """
    ship(media.sparkSession)
    small_batches(media.sparkSession)
    s = settings or Settings()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for k, batch in enumerate(batches):
            if not len(batch):
                continue
            clips, of, spans, tensors = [], [], [], []
            for i, (doc, n, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True)):
                samples, _ = wav_samples(blob)
                t, x = segment_tensors(samples, s)
                of += [i] * len(t)
                spans.append(t)
                tensors.append(x)
                clips.append({"doc_id": doc, "n_bytes": n, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-16:]), "media_bytes": len(blob), "media_sha256": hashlib.sha256(blob).hexdigest()})
            times = np.concatenate(spans)
            table = pa.table({"clip": pa.array(of, pa.int32()), "start_ms": times[:, 0], "end_ms": times[:, 1], "tensor": tensor_array(np.concatenate(tensors))})
            sink = io.BytesIO()
            with pa.ipc.new_file(sink, table.schema) as f:
                f.write_table(table)
            name = f"{path}/tensors-{TaskContext.get().partitionId():06d}-{k:05d}.arrow"
            write_committed(name, sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(of)], pa.int64()), pa.array([clips], pa.list_(_CLIP))], ["file", "segments", "clips"])

    return saved(media.select("doc_id", "n_bytes", "media").mapInArrow(lean(write), f"file string, segments long, clips array<struct<{CLIPS.replace(' ', ':').replace(',:', ',')}>>"), "tensor-manifest")


def read_tensors(manifest: DataFrame) -> DataFrame:
    """A row per clip of the manifest's files, read back: the clip's columns, spans array<array<long>>, tensors array<array<short>> and their shape."""
    spark = manifest.sparkSession
    ship(spark)
    small_batches(spark, rows=16)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, segments, clips in zip(*(batch.column(c) for c in ("file", "segments", "clips")), strict=True):
                table = pa.ipc.open_file(pa.BufferReader(read_all(name.as_py()))).read_all()
                if len(table) != segments.as_py():
                    raise ValueError(f"{name} is not the file of the manifest")
                own = clips.values
                shape = list(table.column("tensor").type.shape)
                values = pa.concat_arrays([c.storage for c in table.column("tensor").chunks]).flatten()
                at = np.searchsorted(table.column("clip").to_numpy(), np.arange(len(own) + 1)).astype(np.int32)
                rows = np.arange(len(table) + 1, dtype=np.int32)
                pairs = np.stack([table.column("start_ms").to_numpy(), table.column("end_ms").to_numpy()], 1).ravel()
                spans = pa.ListArray.from_arrays(pa.array(at), pa.ListArray.from_arrays(pa.array(2 * rows), pa.array(pairs)))
                tensors = pa.ListArray.from_arrays(pa.array(at), pa.ListArray.from_arrays(pa.array(int(np.prod(shape)) * rows), values))
                yield pa.RecordBatch.from_arrays([*own.flatten(), spans, tensors, pa.array([shape] * len(own), pa.list_(pa.int32()))], [*(f.name for f in _CLIP), "spans", "tensors", "shape"])

    tasks = manifest.repartition(max(1, min(spark.sparkContext.defaultParallelism * 4, 4096)), "file")
    return tasks.mapInArrow(lean(read), f"{CLIPS}, spans array<array<long>>, tensors array<array<short>>, shape array<int>")


def audio_query(docs: DataFrame) -> DataFrame:
    """Store whole texts as WAV, read the bytes back, store their tensors with time spans, read these back and digest them."""
    spark, s = docs.sparkSession, Settings()
    manifest = write_tensors(store_wav(docs.select("doc_id", "text")), scratch(spark, "tensors"), s)
    clips = read_tensors(manifest)
    lengths = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    digest = F.substring(F.sha2(F.concat_ws(";", F.transform("spans", lambda x: F.array_join(x, ",")), F.transform("tensors", lambda x: F.array_join(x, ","))).cast("binary"), 256), 1, 16)
    feature = F.concat(F.lit(f"rate={s.rate * s.up // s.down};segments="), F.size("spans"), F.lit(";ms="), lengths, F.lit(";shape="), F.array_join("shape", "x"), F.lit(";sha256="), digest)
    return clips.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
