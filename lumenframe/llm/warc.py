"""Deterministic sharded WARC files of pages, and their reader.

Records are dealt to shards by exact ranges of page_id and sorted within them; a file is rolled as soon as
its compressed size has reached ``roll_bytes``. Of records with equal payloads the one with the largest
page_id is the response and the others are revisits that name it: an aggregate over digests finds the
largest id, and these narrow decisions travel to the same shard as their page, so payloads are shuffled
once. Headers and digests are made anew from the payload. Every record is a gzip member of its own without
time stamps; a file is written under a temporary name and renamed; the manifest, a table of the files
that count, is committed last. Equal rows give equal files, whatever the partitioning and however often
tasks are retried.

Nulls and empties: a null html is an empty payload; a null url leaves out the target; a null page_id
sorts first, is written as ``null`` and never is what a revisit names. Repeated rows: the first in
order is the response and the others revisit it. An empty table gives an empty manifest. Other columns are
not read, whatever their names. Payloads are written whole, however long.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm._common import by_shard, clamp, lean, read_all, saved, scratch, shard_of, shard_starts, ship, small_batches, write_committed

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """One gzip member, without a time stamp or name."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def page_record(page_id: int | None, nth: int, url: str | None, payload: bytes, refers_to: int | None, nth_of: int, date: str) -> bytes:
    revisit = refers_to is not None
    name = lambda p, n: f"<urn:page:{'null' if p is None else p}{f':{n}' if n else ''}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id, nth)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]|")))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to, nth_of))]
    headers += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return record(headers, block)


def write_warc(
    pages: DataFrame, path: str, *, roll_bytes: int | None = None, shard_bytes: int | None = None, revisit_from: int = 0, level: int = 6, date: str = "2000-01-01T00:00:00Z"
) -> DataFrame:
    """Write (page_id, url, html) below ``path``; returns the saved manifest.

    Unless they are given, a shard has a 64th of all payload bytes, but 12 MiB at least and 1 GiB at most, and a file is rolled at a 16th
    of that, compressed: so files are rolled within shards at any size, and grow to 64 MiB.
    """
    ship(pages.sparkSession)
    small_batches(pages.sparkSession, rows=500)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha1("html"))
    starts, total = shard_starts(rows, "page_id", F.octet_length("html") + F.lit(256), lambda n: shard_bytes or clamp(n // 64, 12 << 20, 1 << 30))
    roll_bytes = roll_bytes or (shard_bytes or clamp(total // 64, 12 << 20, 1 << 30)) // 16
    keys = rows.where(F.octet_length("html") >= revisit_from).select("page_id", "digest")
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 AND keeper IS NOT NULL").drop("n")
    decided = keys.join(groups, "digest").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "digest", "keeper")
    both = rows.withColumn("keeper", F.lit(None).cast("long")).unionByName(decided).withColumn("is_page", F.col("keeper").isNull().cast("int"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        shard, seq, size, records = None, 0, 0, 0
        keeper, last, nth, seen = None, None, 0, set()

        def start() -> None:
            nonlocal parts, size, records
            info = b"software: lumenframe\r\nformat: WARC File Format 1.1\r\n"
            headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{shard:06d}-{seq:04d}>"), ("WARC-Date", date), ("WARC-Filename", f"shard-{shard:06d}-{seq:04d}.warc.gz"), ("Content-Type", "application/warc-fields")]
            parts = [member(record(headers, info), level)]
            size, records = len(parts[0]), 0

        def close() -> pa.RecordBatch:
            blob, name = b"".join(parts), f"{path}/shard-{shard:06d}-{seq:04d}.warc.gz"
            write_committed(name, blob)
            row = {"shard": [shard], "seq": [seq], "file": [name], "records": [records], "bytes": [len(blob)], "sha256": [hashlib.sha256(blob).hexdigest()]}
            return pa.RecordBatch.from_pydict(row, schema=MANIFEST)

        for batch in batches:
            for s, page_id, url, payload, digest, k, is_page in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "html", "digest", "keeper", "is_page")), strict=True):
                if (page_id, digest) != last:
                    keeper = None
                    if last is None or last[0] != page_id:
                        nth, seen = 0, set()
                    last = (page_id, digest)
                if not is_page:
                    keeper = k
                    continue
                if s != shard or size >= roll_bytes:
                    if records:
                        yield close()
                    seq = seq + 1 if s == shard else 0
                    shard = s
                    start()
                refers = keeper if keeper is not None and (keeper != page_id or digest in seen) else None
                if digest not in seen and refers is None:
                    seen.add(digest)
                parts.append(member(page_record(page_id, nth, url, payload, refers, 0, date), level))
                nth += 1
                size += len(parts[-1])
                records += 1
        if records:
            yield close()

    sharded = by_shard(both.withColumn("shard", shard_of("page_id", starts)), "shard", len(starts), "page_id", "digest", "is_page", "url")
    return saved(sharded.mapInArrow(lean(write), "shard int, seq int, file string, records long, bytes long, sha256 string"), "warc-manifest")


def members(blob: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """Contents of the gzip members of a file, one after the other."""
    view, at = memoryview(blob), 0
    while at < len(blob):
        d = zlib.decompressobj(31)
        out = []
        while not d.eof:
            if at >= len(blob):
                raise ValueError("truncated gzip member")
            out.append(d.decompress(view[at : at + step]))
            at += step
        at = min(at, len(blob)) - len(d.unused_data)
        yield b"".join(out)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record of the wrong length")
    return headers, rest[:size]


def _page(name: str) -> int | None:
    p = name.strip("<>").split(":")[2]
    return None if p == "null" else int(p)


def read_warc(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per page record: page_id, payload_bytes, payload_digest, record_type, refers_to; digests of blocks and payloads are checked."""
    ship(spark)
    small_batches(spark, rows=500)
    tasks = manifest.select("file", "sha256").repartition(max(1, min(spark.sparkContext.defaultParallelism * 4, 4096)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sha in zip(batch.column("file").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                blob = read_all(name)
                if hashlib.sha256(blob).hexdigest() != sha:
                    raise ValueError(f"{name} is not the file of the manifest")
                rows: list[list] = [[] for _ in range(6)]
                for data in members(blob):
                    h, block = parse_record(data)
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    if h["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                        raise ValueError(f"a damaged block in {name}")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = h["WARC-Type"] == "revisit"
                    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError(f"a damaged payload in {name}")
                    row = (_page(h["WARC-Record-ID"]), size, digest, h["WARC-Type"], _page(h["WARC-Refers-To"]) if revisit else None, None if revisit else payload)
                    for c, v in zip(rows, row, strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                n = 6 if with_payload else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows[:n], kinds[:n], strict=True)], names[:n])

    return tasks.mapInArrow(lean(read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def warc_query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    return read_warc(spark, write_warc(pages, scratch(spark, "warc")))
