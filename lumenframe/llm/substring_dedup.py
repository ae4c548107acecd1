"""Substring dedup: words covered by a window that occurs anywhere else are removed.

Every window of ``window`` consecutive words gets a Rabin-Karp hash modulo 2**61 - 1 over its words' keyed hashes, and 19 bits of
another polynomial beside it. Documents are dealt to blocks of bounded size. A block sends each distinct hash once, with a bit for
"more than once in here", to the bucket of its leading bits, so a passage that a third of all
documents share reaches its bucket once per block. A bucket counts: a hash from two blocks, or
one with its bit set, is repeated. The answer goes back as one bit per hash sent, the block hashes its texts
again, and overlapping repeated windows merge into maximal intervals of removed words. Buckets hold about
``bucket_windows``; a task reads several of them in order, one at a time, and there are ``most_tasks`` tasks at most.

The removed intervals are cut out of the text; a text that loses nothing stays as it is.

Nulls and empties: a null text has no words and stays null; texts under ``window`` words lose nothing.
Rows that repeat both id and text count as documents of their own, so their long passages
repeat and go; one of them stands for all in its block. Null ids are allowed. An empty table gives no rows. Other columns pass
through untouched, whatever their names, unless these are the names that ``remove_repeats`` adds, which it replaces.
Windows are compared by 80 bits; two different ones agree in these with a chance of about 2**-74 (2**-61 times the window's length, and
2**-19). Words are told apart by 64 bits with a key, for which no family of colliding words is known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm._common import WORD_BASE, lean, packed, rolling_hashes, saved, ship, small_batches, span_hashes, text_bytes, unpacked, word_hashes, word_spans


def window_hashes(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Word starts and ends, word offsets by text, first words of all windows, and their hashes: 64 bits and 16 more."""
    starts, ends, at = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    count = np.maximum(np.diff(at) - window + 1, 0)
    first = at[:-1][np.repeat(np.arange(len(count)), count)] + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    other = span_hashes(words, first, first + window, WORD_BASE)
    main = rolling_hashes(words, window)[first] if len(first) else other
    return starts, ends, at, first, main << np.uint64(3) | other >> np.uint64(61), (other >> np.uint64(45)).astype(np.uint16)


def distinct(hashes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the hashes by both parts, and where in it a new one begins."""
    order = np.argsort(hashes, kind="stable")
    h, m = hashes[order], more[order]
    same = h[1:] == h[:-1]
    if (same & (m[1:] != m[:-1])).any():
        order = np.lexsort((more, hashes))
        h, m = hashes[order], more[order]
        same = h[1:] == h[:-1]
    begin = np.ones(len(h), bool)
    begin[1:] = ~same | (m[1:] != m[:-1])
    return order, begin


def to_planes(hashes: np.ndarray, more: np.ndarray) -> bytes:
    """Bytes by place, the highest first: leading bytes of sorted hashes are alike and compress in the shuffle."""
    return b"".join([hashes.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes(), more.astype(">u2").view(np.uint8).reshape(-1, 2).T.tobytes()])


def from_planes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(raw, np.uint8).reshape(10, -1)
    return np.ascontiguousarray(planes[:8].T).view(">u8").ravel(), np.ascontiguousarray(planes[8:].T).view(">u2").ravel()


def _text(group: pa.Table) -> pa.Array:
    text = group.column("text").combine_chunks()
    return pa.concat_arrays(text.chunks) if isinstance(text, pa.ChunkedArray) else text


def _once(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows with _lf_twin false, and one of each group of rows that repeat both id and text with it true; and all rows of such groups, if any."""
    key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    work = docs.withColumn("_lf_key", key)
    often = saved(work.where("text IS NOT NULL").groupBy("doc_id", "_lf_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_lf_id"), F.col("_lf_key").alias("_lf_of")), "repeated-rows")
    if often.isEmpty():
        return docs.withColumn("_lf_twin", F.lit(False)), None
    marked = work.join(often, (F.col("_lf_key") == F.col("_lf_of")) & F.col("doc_id").eqNullSafe(F.col("_lf_id")) & F.col("text").isNotNull(), "left")
    twins = marked.where("_lf_of IS NOT NULL")
    one = twins.dropDuplicates(["_lf_of", "_lf_id"])
    names = docs.columns
    return marked.where("_lf_of IS NULL").select(*names, F.lit(False).alias("_lf_twin")).unionByName(one.select(*names, F.lit(True).alias("_lf_twin"))), twins.select(*names)


def _cut(text: pa.Array, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, gone: np.ndarray) -> list[pa.Array]:
    """Of each text: what is left of it, its number of words, how many are gone, and the digest of the kept ones."""
    data, offsets = text_bytes(text)
    removed, shas, texts = [], [], []
    for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        g = gone[a:b]
        raw = data[offsets[i] : offsets[i + 1]]
        base = offsets[i]
        kept = [raw[x - base : y - base].tobytes() for x, y in zip(starts[a:b][~g], ends[a:b][~g], strict=True)] if g.any() else raw.tobytes().split()
        removed.append(int(g.sum()))
        shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        texts.append(_without(raw, starts[a:b] - base, ends[a:b] - base, g).decode() if removed[-1] else None)
    left = pa.compute.coalesce(pa.array(texts, pa.string()), text.cast(pa.string()))
    return [left, pa.array(np.diff(at).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]


ADDED = ["_lf_n_words", "_lf_n_removed", "_lf_kept_sha256"]


def remove_repeats(docs: DataFrame, *, window: int = 35, block_bytes: int = 1 << 20, bucket_windows: int = 1_000_000, most_tasks: int = 1 << 14) -> DataFrame:
    """``docs`` with ``text`` cut, and n_words, n_removed, kept_sha256 (kept words joined by one space) added as _lf_ columns."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark, rows=10_000)
    columns = [c for c in docs.columns if c not in ADDED]
    rows = packed(docs.select(*(F.col(f"`{c}`") for c in columns)), "doc_id", "text")
    single, twins = _once(rows)
    total = single.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    blocked = single.withColumn("_lf_block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    bits = max(0, (total // 5 // bucket_windows)).bit_length()
    limits = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)

    def send(group: pa.Table) -> pa.Table:
        _, _, at, first, hashes, more = window_hashes(*text_bytes(_text(group)), window)
        order, begin = distinct(hashes, more)
        run = np.cumsum(begin) - 1
        twin = group.column("_lf_twin").to_numpy()[np.searchsorted(at, first, side="right") - 1]
        several = np.bincount(run, 1 + twin[order]) > 1
        hashes, more = hashes[order][begin], more[order][begin]
        cuts = np.concatenate([[0], np.searchsorted(hashes, limits), [len(hashes)]])
        found = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        block = group.column("_lf_block")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array([k for k, _, _ in found], pa.int32()),
                "block": pa.array([block] * len(found), pa.int32()),
                "hashes": pa.array([to_planes(hashes[a:b], more[a:b]) for _, a, b in found], pa.binary()),
                "several": pa.array([np.packbits(several[a:b]).tobytes() for _, a, b in found], pa.binary()),
            }
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bucket = None

        def answer() -> pa.RecordBatch:
            chunks = [from_planes(h) for _, h, _ in held]
            sizes = np.array([len(h) for h, _ in chunks])
            hashes, more = (np.concatenate([c[k] for c in chunks]) for k in (0, 1))
            several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=n) for (_, _, s), n in zip(held, sizes, strict=True)])
            order, begin = distinct(hashes.astype(np.uint64), more)
            run = np.cumsum(begin) - 1
            repeated = (np.bincount(run) > 1) | (np.bincount(run, several[order]) > 0)
            flags = np.empty(len(hashes), bool)
            flags[order] = repeated[run]
            ends = np.cumsum(sizes)
            back = [np.packbits(flags[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _, _ in held], pa.int32()), pa.array([bucket] * len(held), pa.int32()), pa.array(sizes.astype(np.int32)), pa.array(back, pa.binary())],
                ["block", "bucket", "n", "flags"],
            )

        for batch in batches:
            for k, b, h, s in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "hashes", "several")), strict=True):
                if held and k != bucket:
                    yield answer()
                    held = []
                bucket = k
                held.append((b, h, s))
        if held:
            yield answer()

    def cut(group: pa.Table, flags: pa.Table) -> pa.Table:
        text = _text(group)
        starts, ends, at, first, hashes, more = window_hashes(*text_bytes(text), window)
        order, begin = distinct(hashes, more)
        found = sorted(zip(flags.column("bucket").to_pylist(), flags.column("n").to_pylist(), flags.column("flags").to_pylist(), strict=True))
        bit = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for _, n, f in found] or [np.zeros(0, np.uint8)]).astype(bool)
        hit = first[order[bit[np.cumsum(begin) - 1]]] if len(order) else first
        left = _cut(text, starts, ends, at, _covered(hit, len(starts), window))
        out = {c: group.column(c) for c in group.column_names if c not in ("_lf_block", "_lf_twin", "text")} | dict(zip(["text", *ADDED], left, strict=True))
        table = pa.table({c: out[c] for c in [*(c for c in group.column_names if c not in ("_lf_block", "_lf_twin")), *ADDED]})
        return table.filter(pa.compute.invert(group.column("_lf_twin")))

    def all_gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, at = word_spans(*text_bytes(batch.column("text")))
            left = _cut(batch.column("text"), starts, ends, at, np.repeat(np.diff(at) >= window, np.diff(at)))
            out = dict(zip(batch.schema.names, batch.columns, strict=True)) | dict(zip(["text", *ADDED], left, strict=True))
            yield pa.RecordBatch.from_arrays([out[c] for c in [*batch.schema.names, *ADDED]], [*batch.schema.names, *ADDED])

    sent = blocked.groupBy("_lf_block").applyInArrow(send, "bucket int, block int, hashes binary, several binary")
    tasks = min(1 << bits, most_tasks)
    dealt = sent.repartitionById(tasks, F.floor(F.col("bucket") * F.lit(tasks) / F.lit(1 << bits)).cast("int")).sortWithinPartitions("bucket", "block")
    flags = dealt.mapInArrow(lean(count), "block int, bucket int, n int, flags binary")
    schema = T.StructType([*rows.schema.fields, T.StructField(ADDED[0], T.LongType()), T.StructField(ADDED[1], T.LongType()), T.StructField(ADDED[2], T.StringType())])
    done = blocked.groupBy("_lf_block").cogroup(flags.groupBy("block")).applyInArrow(cut, schema)
    if twins is not None:
        done = done.unionByName(twins.mapInArrow(lean(all_gone), schema))
    return unpacked(done, [*columns, *ADDED], "doc_id", "text", *ADDED)


def _covered(hit: np.ndarray, words: int, window: int) -> np.ndarray:
    """Which words lie in a window that begins at one of ``hit``."""
    delta = np.zeros(words + window + 1, np.int32)
    np.add.at(delta, hit, 1)
    np.add.at(delta, hit + window, -1)
    return np.cumsum(delta)[:words] > 0


def _without(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without its removed intervals; each takes the white space behind its words along, the last one that before."""
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - 1
    out, at = [], 0
    for a, b in zip(first, last, strict=True):
        to_end = b + 1 == len(starts)
        out.append(raw[at : (ends[a - 1] if a else 0) if to_end else starts[a]].tobytes())
        at = len(raw) if to_end else int(starts[b + 1])
    out.append(raw[at:].tobytes())
    return b"".join(out)


def substring_query(docs: DataFrame) -> DataFrame:
    done = remove_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return done.select("doc_id", *(F.col(f"_lf_{c}").alias(c) for c in ("n_words", "n_removed", "kept_sha256")))


def substring_stage(docs: DataFrame) -> DataFrame:
    """Documents with repeated passages cut; n_chars follows the text where there is such a column."""
    done = remove_repeats(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("_lf_n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)
