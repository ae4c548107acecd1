"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

``write_token_files`` range-shuffles the texts once by ``doc_id``, encodes each shard in ascending
order and writes one or more files per shard. A file is self-contained:

    8 bytes   magic
    8 bytes   length of a JSON header, little-endian
    header    {documents, tokens, ranks, control, data}
    int64     doc_id of each document (its null mask: one byte each), int64 ids of each document
    uint32    rank table: the file's ids by falling frequency, ties by id
    bytes     control bytes, four values each: two bits hold a value's byte length less one
    bytes     the ranks' significant bytes, little-endian

A rank is an id's place in the table, so frequent ids take one byte. ``read_token_files`` decodes
by table lookup: a control byte gives four lengths and offsets at once.

Nulls and empties: a null text is the empty text and holds the end id alone; null ids sort first.
Repeated rows are kept, each with its own place. An empty table gives no files. Texts are encoded whole; ties of
id go by text. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm._common import by_shard, clamp, lean, open_fs, pieces, read_all, saved, scratch, shard_of, shard_starts, ship, small_batches, write_committed
from lumenframe.llm.bpe import encoder

MAGIC = b"LFTOK\x00\x00\x01"
#: Per control byte: the four byte lengths, their offsets within the group and the group's length.
LENGTHS = np.stack([(np.arange(256) >> (2 * i) & 3) + 1 for i in range(4)], 1).astype(np.uint8)
OFFSETS = (np.cumsum(LENGTHS, 1) - LENGTHS).astype(np.uint8)
TOTALS = LENGTHS.sum(1).astype(np.uint8)


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    control, data = [], []
    for at in range(0, max(len(values), 1), 1 << 20):
        v = np.ascontiguousarray(values[at : at + (1 << 20)], "<u4")
        lens = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
        padded = np.ones(-(-len(v) // 4) * 4, np.uint8)
        padded[: len(v)] = lens
        g = padded.reshape(-1, 4) - 1
        control.append((g[:, 0] | g[:, 1] << 2 | g[:, 2] << 4 | g[:, 3] << 6).astype(np.uint8).tobytes())
        data.append(v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < lens[:, None]].tobytes())
    return b"".join(control), b"".join(data)


def unpack_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Inverse of pack_values, by table lookup and gather."""
    out = np.empty(n, np.uint32)
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    done = 0
    for at in range(0, len(control), 1 << 18):
        c = control[at : at + (1 << 18)]
        totals = TOTALS[c].astype(np.int64)
        m = min(4 * len(c), n - 4 * at)
        first = done + np.cumsum(totals) - totals
        where = (first[:, None] + OFFSETS[c]).ravel()[:m]
        lens = LENGTHS[c].ravel()[:m]
        done = int(first[-1] + totals[-1])  # the last group of a file is padded with one-byte lengths that hold no data
        v = padded[where].astype(np.uint32)
        for k in (1, 2, 3):
            more = np.flatnonzero(lens > k)
            v[more] |= padded[where[more] + k].astype(np.uint32) << np.uint32(8 * k)
        out[4 * at : 4 * at + m] = v
    return out


def encode_file(doc_ids: list[int | None], counts: np.ndarray, ids: list[np.ndarray]) -> bytes:
    """A file's bytes; the ids may come in several arrays, which are not joined."""
    freq = np.zeros(1 + max((int(x.max()) for x in ids if len(x)), default=-1), np.int64)
    for x in ids:
        freq += np.bincount(x, minlength=len(freq))
    table = np.lexsort((np.arange(len(freq)), -freq))[: int((freq > 0).sum())].astype("<u4")
    rank = np.zeros(len(freq), np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    control, data, tokens = [], [], 0
    rest = np.zeros(0, np.uint32)
    for x in ids:  # four values share a control byte, so what is over goes with the next array
        rest = np.concatenate([rest, rank[x]])
        tokens += len(x)
        whole = len(rest) // 4 * 4
        for into, packed in zip((control, data), pack_values(rest[:whole]), strict=True):
            into.append(packed)
        rest = rest[whole:]
    if len(rest) or not tokens:
        for into, packed in zip((control, data), pack_values(rest), strict=True):
            into.append(packed)
    sizes = {"control": sum(map(len, control)), "data": sum(map(len, data))}
    header = json.dumps({"documents": len(doc_ids), "tokens": tokens, "ranks": len(table), **sizes}).encode()
    null = bytes(d is None for d in doc_ids)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, keys.tobytes(), null, counts.astype("<i8").tobytes(), table.tobytes(), *control, *data])


def decode_file(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    if blob[:8] != MAGIC:
        raise ValueError("not a token file")
    size = int.from_bytes(blob[8:16], "little")
    h = json.loads(blob[16 : 16 + size])
    raw, at = np.frombuffer(blob, np.uint8), 16 + size
    n = h["documents"]
    sizes = (8 * n, n, 8 * n, 4 * h["ranks"], h["control"], h["data"])
    if at + sum(sizes) != len(raw):
        raise ValueError("token file of the wrong length")
    parts = []
    for s in sizes:
        parts.append(raw[at : at + s])
        at += s
    keys, null, counts = parts[0].view("<i8") if parts[0].ctypes.data % 8 == 0 else np.frombuffer(parts[0].tobytes(), "<i8"), parts[1], np.frombuffer(parts[2].tobytes(), "<i8")
    table = np.frombuffer(parts[3].tobytes(), "<u4")
    ids = table[unpack_values(parts[4], parts[5], h["tokens"])] if h["tokens"] else np.zeros(0, np.uint32)
    return [None if m else int(k) for k, m in zip(keys, null, strict=True)], counts, ids


def write_token_files(
    docs: DataFrame, vocabulary: str, path: str, *, end_id: int = 0, shard_bytes: int | None = None, file_tokens: int | None = None
) -> DataFrame:
    """Write the files below ``path``; returns the manifest (shard, seq, file, documents, tokens, bytes), saved beside them.

    A shard holds about ``shard_bytes`` of text, and a file is closed at ``file_tokens`` ids, which bounds a task's memory. Unless they are given, a shard
    has a 64th of all text, but 16 MiB at least and 1 GiB at most, and a file has 2 Mi ids at least and 32 Mi at most, an 8th of the shard's bytes between these. Names follow from shard and sequence alone and are taken by rename, so a retried
    task replaces its files with equal ones.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    starts, total = shard_starts(rows, "doc_id", F.octet_length("text") + F.lit(64), lambda n: shard_bytes or clamp(n // 64, 16 << 20, 1 << 30))
    file_tokens = file_tokens or clamp((shard_bytes or clamp(total // 64, 16 << 20, 1 << 30)) // 8, 2 << 20, 32 << 20)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, end_id)
        keys: list = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        shard, seq, tokens = None, 0, 0

        def close() -> pa.RecordBatch:
            n = np.concatenate(counts)
            blob = encode_file(keys, n, parts)
            name = f"{path}/shard-{shard:06d}-{seq:04d}.tok"
            write_committed(name, blob)
            row = {"shard": [shard], "seq": [seq], "file": [name], "documents": [len(keys)], "tokens": [int(n.sum())], "bytes": [len(blob)]}
            return pa.RecordBatch.from_pydict(row, schema=MANIFEST)

        for batch in batches:
            of = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                text = batch.column("text").slice(a, b - a)
                for x, y in pieces(text):
                    if keys and (shard != of[a] or tokens >= file_tokens):
                        yield close()
                        seq = seq + 1 if shard == of[a] else 0
                        keys, counts, parts, tokens = [], [], [], 0
                    shard = int(of[a])
                    ids, offsets = enc.encode(text.slice(x, y - x))
                    keys += batch.column("doc_id").slice(a + x, y - x).to_pylist()
                    counts.append(np.diff(offsets))
                    parts.append(ids)
                    tokens += len(ids)
        if keys:
            yield close()

    sharded = by_shard(rows.withColumn("shard", shard_of("doc_id", starts)), "shard", len(starts), "doc_id", "text")
    written = sharded.mapInArrow(lean(write, keep=True), "shard int, seq int, file string, documents long, tokens long, bytes long")
    return saved(written, "token-manifest")


MANIFEST = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])


def read_token_files(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the manifest's files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` counts the ids of all documents before: a running sum over the manifest, one row per file.
    """
    ship(spark)
    small_batches(spark)
    before = Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("base"))
    tasks = files.repartition(max(1, min(spark.sparkContext.defaultParallelism * 4, 4096)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                keys, counts, ids = decode_file(read_all(name))
                ends = np.cumsum(counts)
                for a in range(0, len(keys), 5000):
                    b = min(len(keys), a + 5000)
                    own = [np.ascontiguousarray(ids[e - c : e], "<u4") for e, c in zip(ends[a:b], counts[a:b], strict=True)]
                    out = [
                        pa.array(keys[a:b], pa.int64()), pa.array(base + ends[a:b] - counts[a:b]), pa.array(counts[a:b]),
                        pa.array([zlib.crc32(x) for x in own], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        out.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(out, names)

    return tasks.mapInArrow(lean(read, keep=True), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_files_query(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write ``docs`` as token files in the shared scratch folder and read every document back."""
    spark = docs.sparkSession
    manifest = write_token_files(docs, vocabulary, scratch(spark, "token-files"))
    return read_token_files(spark, manifest)


def total_bytes(path: str) -> int:
    from pyarrow import fs as pafs

    fs, p = open_fs(path)
    return sum(f.size or 0 for f in fs.get_file_info(pafs.FileSelector(p)))
