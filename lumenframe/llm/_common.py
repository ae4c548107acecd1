"""What the operators of this subpackage share: saved tables, shards, file access, word and window hashes, and bounded worker memory."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.cluster import scratch, ship  # noqa: F401  (for the operators beside this module)


def packed(df: DataFrame, *keep: str) -> DataFrame:
    """``df`` with the columns ``keep`` and all others in one struct, ``_lf_row``, so that no name can clash with an operator's own."""
    rest = [c for c in df.columns if c not in keep]
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c in keep), F.struct(*(F.col(f"`{c}`") for c in rest) if rest else [F.lit(0).alias("none")]).alias("_lf_row"))


def unpacked(df: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """The columns that ``packed`` had, in their order; those of ``own`` are columns of ``df``, the others are in its struct."""
    return df.select(*(F.col(f"`{c}`") if c in own else F.col("_lf_row")[c].alias(c) for c in columns))


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bound the Arrow batches that Python workers hold, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


_HELD: list[tuple] = []


def give_back() -> None:
    """Hand memory that this worker's allocators keep for later back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def held(key: tuple, make: Callable):
    """What a worker keeps from task to task: one object, so that an operator finds the memory of the one before it free."""
    if not _HELD or _HELD[0] != key:
        _HELD.clear()
        give_back()
        _HELD[:] = [key, make()]
    return _HELD[1]


def lean(run: Callable, keep: bool = False) -> Callable:
    """A function for mapInArrow whose worker begins without other operators' memory and ends with its own handed back."""

    def bounded(batches: Iterator) -> Iterator:
        if not keep:
            _HELD.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return bounded


def busiest(uses: np.ndarray, most: int) -> np.ndarray:
    """Codes that were used more than once, in ascending order; of more than ``most`` those used most."""
    codes = np.flatnonzero(uses > 1)
    if len(codes) > most:
        codes = np.sort(codes[np.argsort(-uses[codes], kind="stable")[:most]])
    return codes


def open_fs(uri: str):
    """pyarrow file system and path of a URI (file, hdfs, s3, gs: whatever pyarrow speaks)."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        return fs.LocalFileSystem(), uri[5:]
    return fs.FileSystem.from_uri(uri)


def write_committed(uri: str, blob: bytes) -> None:
    """Write under a temporary name, then rename: a reader or a retry never sees half a file."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temp = f"{os.path.dirname(path)}/_temporary-{uuid.uuid4().hex}-{os.path.basename(path)}"
    with fs.open_output_stream(temp, compression=None) as f:
        f.write(blob)
    fs.move(temp, path)


def read_all(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def shard_starts(df: DataFrame, key: str, weight: Column, target: Callable[[int], int]) -> tuple[list[int], int]:
    """Ascending first keys of contiguous shards of an integer key, and the total weight; ``target`` gives a shard's weight from the total.

    One pass weighs the keys into a narrow table sorted by range; a running sum over it, with a base for each of its partitions, puts a key
    into the shard in which its weight begins. So the number of jobs is the same for any weights and keys, one row for each partition
    and one for each shard reach the driver, and the shards depend on the rows alone, so any retry or rerun gives the same. A key is never split.
    Null keys belong to the first shard.
    """
    spark = df.sparkSession
    each = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(F.sum(weight.cast("long")).alias("w"))
    table = saved(each.repartitionByRange("k").sortWithinPartitions("k").withColumn("part", F.spark_partition_id()), "weights")
    parts = sorted((r["first"], r["part"], r["w"]) for r in table.groupBy("part").agg(F.min("k").alias("first"), F.sum("w").alias("w")).collect())
    bases, total = [], 0
    for _, part, w in parts:
        bases.append((part, total))
        total += w
    if not parts:
        return [-(2**63)], 0
    before = F.coalesce(F.sum("w").over(Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = table.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")
    shard = F.floor((F.col("base") + before) / F.lit(max(1, target(total)))).alias("shard")
    return sorted(r["first"] for r in based.select("k", shard).groupBy("shard").agg(F.min("k").alias("first")).collect()), total


def shard_of(key: str, starts: list[int]) -> Column:
    """Column with the shard of a key: a binary search over the starts, which are one constant array."""
    if len(starts) == 1:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    steps = F.sequence(F.lit(1), F.lit((len(starts) - 1).bit_length()))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"] + 1, 1)
        right = F.get(array, middle) <= F.col(key)
        return F.struct(F.when(right, middle).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(F.greatest(acc["lo"], middle - 1)).alias("hi"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(starts) - 1).alias("hi")), halve, lambda acc: acc["lo"])
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(found).cast("int")


def by_shard(df: DataFrame, shard: str, n: int, *order: str) -> DataFrame:
    """Rows of a shard in one partition, sorted; every shard has a partition of its own."""
    return df.repartitionById(n, F.col(shard)).sortWithinPartitions(shard, *order)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def concat_ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices ``starts[0]..starts[0]+lens[0]-1, starts[1]..`` in one array."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lens) - lens
    return np.repeat(starts - first, lens) + np.arange(total, dtype=np.int64)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and its n+1 offsets; nulls are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return data[lo:hi], offsets - lo


#: Bytes that end a word: 9 to 13 and 32.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` (or what ``space`` leaves) and the n+1 word offsets of the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 1, bool)
    np.logical_not(space[data], out=inside[:n])
    begin = inside[:n].copy()
    begin[1:] &= ~inside[: n - 1]
    cut = offsets[:-1][offsets[:-1] < n]
    begin[cut] = inside[cut]  # a text that starts right after another one starts a word
    end = inside[:n].copy()
    end &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(1, n), np.uint64)
    out[0] = 1
    k = 1
    step = np.uint64(base)
    with np.errstate(over="ignore"):
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * step
            k += m
            step = out[k - 1] * np.uint64(base)
    return out


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = _powers(base, max(n, 1 << 16))
    return _POWERS[base][:n]


WORD_BASE = 0xD1342543DE82EF95
INVERSE = {WORD_BASE: pow(WORD_BASE, -1, 2**64)}


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of ``values[start:end]`` from one prefix sum, then mixed."""
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=prefix[1:])
        out = prefix[ends] - prefix[starts]
        out *= powers(INVERSE[base], len(values) + 1)[starts]
        out += (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix64(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keyed hashes (SipHash) of the words that ``word_spans`` found, each distinct word hashed once.

    No family of words collides by construction, as those of a polynomial modulo a power of two do.
    """
    import pyarrow as pa
    from pandas.util import hash_array

    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])
    letters = data[~_SPACE[data]]
    words = pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(bounds), pa.py_buffer(letters)).dictionary_encode()
    return hash_array(words.dictionary.to_numpy(zero_copy_only=False), categorize=False)[words.indices.to_numpy()]


#: The Mersenne prime 2**61 - 1, and the base of the window hashes modulo it.
PRIME, WINDOW_BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)


def _times(a: np.ndarray, factor: int) -> np.ndarray:
    """a * factor modulo PRIME, for a below PRIME, in 64-bit arithmetic on halves of 30 and 31 bits."""
    high, low = np.uint64(factor >> 31), np.uint64(factor & 0x7FFFFFFF)
    a_high, a_low = a >> np.uint64(31), a & np.uint64(0x7FFFFFFF)
    middle = a_high * low + a_low * high
    total = (a_high * high) * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64(0x3FFFFFFF)) << np.uint64(31)) + a_low * low
    total = (total & np.uint64(PRIME)) + (total >> np.uint64(61))
    return np.where(total >= PRIME, total - np.uint64(PRIME), total)


def rolling_hashes(values: np.ndarray, window: int, base: int = WINDOW_BASE) -> np.ndarray:
    """Rabin-Karp hashes modulo PRIME of all windows of ``window`` values; windows double in length, log(window) steps in all.

    Of n values there are n - window + 1 hashes; two different windows agree with a chance of about window * 2**-61.
    """
    n = len(values) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    whole = values % np.uint64(PRIME)  # hashes of windows of ``size``
    out: np.ndarray | None = None
    size, done = 1, 0

    def join(left: np.ndarray, right: np.ndarray, factor: int) -> np.ndarray:
        total = _times(left, factor) + right
        return np.where(total >= PRIME, total - np.uint64(PRIME), total)

    while True:
        if window & size:
            out = whole if out is None else join(whole[: len(out) - size], out[size:], pow(base, done, PRIME))
            done += size
        if done == window:
            return out[:n]
        whole = join(whole[:-size], whole[size:], pow(base, size, PRIME))
        size *= 2


def pieces(column, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string column with about ``limit`` bytes each, to bound working arrays."""
    _, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, len(column))
        at = min(to, len(column))
