"""Best-fit packing of token sequences by exact-complement hashing.

Lengths are bounded by the sequence size, so how many pieces have each length is a table of at
most ``size`` rows whatever the corpus. The plan is made from that table alone: from the longest
length down, its gap is looked up among the sums of one, two and three available lengths
(hash tables from a sum to the combination), and a combination that fills the gap exactly is consumed
as many times as the available counts allow. What finds no exact complement goes best-fit: the largest
available length that fits the gap, again with multiplicities. The plan is a list of patterns with a
repeat count, of a length that depends on ``size`` and not on the corpus; Spark then numbers the
pieces of each length and looks their numbers up in the plan.

Nulls and empties: a null text is the empty text and takes one token, its end id. Repeated rows are
packed each on its own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm._common import lean, pieces, saved, ship, small_batches
from lumenframe.llm.bpe import encoder


def _single(avail: np.ndarray, gap: int) -> tuple[int, ...] | None:
    return (gap,) if gap < len(avail) and avail[gap] else None


class _Sums:
    """Index of the sums of two available lengths; sums of three are a length and a pair's sum."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.width = 1 << (2 * len(counts)).bit_length()
        self.refresh()

    def refresh(self) -> None:
        """After a count has changed: the available lengths, and how many pairs of them have each sum."""
        here = self.counts > 0
        self.lengths = np.flatnonzero(here)[::-1]
        spectrum = np.fft.rfft(here.astype(np.float64), self.width)
        self.pairs = np.rint(np.fft.irfft(spectrum * spectrum, self.width)).astype(np.int64)

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Two available lengths with this sum, the longest first: short ones are easier to place later."""
        if self.pairs[gap] <= 0:
            return None
        a = self.lengths[(self.lengths < gap) & (self.lengths >= (gap + 1) // 2)]
        ok = (self.counts[a] > 0) & (self.counts[gap - a] > 0) & ((gap - a != a) | (self.counts[a] > 1))
        at = np.flatnonzero(ok)
        return (int(a[at[0]]), int(gap - a[at[0]])) if len(at) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        a = self.lengths[(self.lengths < gap - 1) & (self.lengths >= (gap + 2) // 3)]
        for x in a[(self.counts[a] > 0) & (self.pairs[gap - a] > 0)].tolist():
            self.counts[x] -= 1
            rest = self.pair(gap - x)
            self.counts[x] += 1
            if rest:
                return (x, *rest)
        return None


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with how many sequences follow it; together they use every piece once.

    Every step uses up at least one length's count, so there are at most a few thousand steps.
    """
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= size:
            raise ValueError(f"a length of {length} does not fit {size}")
        counts[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    sums = _Sums(counts)

    def consume(pattern: tuple[int, ...]) -> None:
        times = min(int(counts[x]) // pattern.count(x) for x in set(pattern))
        for x in pattern:
            counts[x] -= times
        out.append((pattern, times))
        sums.refresh()

    while counts.any():
        first = int(sums.lengths[0])
        gap = size - first
        if not gap:
            consume((first,))
            continue
        counts[first] -= 1
        found = _single(counts, gap) or sums.pair(gap) or sums.triple(gap)
        pattern = (first, *found) if found else None
        if pattern is None:  # best fit: the longest that fits the gap, with the gap left looked up exactly each time
            chosen, left = [first], gap
            while left:
                found = _single(counts, left) or sums.pair(left) or sums.triple(left)
                if found:
                    chosen += found
                    for x in found:
                        counts[x] -= 1
                    break
                fits = sums.lengths[(sums.lengths <= left) & (counts[sums.lengths] > 0)]
                if not len(fits):
                    break
                chosen.append(int(fits[0]))
                counts[fits[0]] -= 1
                left -= int(fits[0])
            pattern = tuple(chosen)
            for x in chosen[1:]:
                counts[x] += 1
        counts[first] += 1
        consume(pattern)
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length: pieces number ``rank .. rank + times*per`` of a length go to sequences from ``sequence`` at ``offset``."""
    used: dict[int, int] = {}
    sequence = 0
    rows = []
    for pattern, times in patterns:
        at = 0
        for x in pattern:
            rows.append((x, used.get(x, 0), times, sequence, at))
            used[x] = used.get(x, 0) + times
            at += x
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "times", "sequence", "offset"), cols, strict=True))


def token_pieces(docs: DataFrame, vocabulary: str, *, size: int = 2048, end_id: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of every document's ids: doc_id, piece, start, length, ids_crc32, and the columns ``carry`` of the document. Only longer documents are cut; the first piece is the short one."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, end_id)
        for batch in batches:
            for x, y in pieces(batch.column("text")):
                ids, offsets = enc.encode(batch.column("text").slice(x, y - x))
                n = np.diff(offsets)
                count = -(-n // size)
                row = np.repeat(np.arange(y - x), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                head = n - (count - 1) * size
                start = np.where(piece > 0, head[row] + (piece - 1) * size, 0)
                length = np.where(piece > 0, size, head[row])
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                at = offsets[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                of = lambda c: batch.column(c).slice(x, y - x).take(pa.array(row))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [of("doc_id"), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), *map(of, carry)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", *carry],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *carry)
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(lean(cut, keep=True), f"doc_id long, piece int, start long, length long, ids_crc32 long{kinds}")


def pack(parts: DataFrame, *, size: int = 2048, per_group: int = 2_000) -> DataFrame:
    """Add sequence_id and offset to rows that have ``length``; ``parts`` must be a saved table, as it is read thrice.

    Pieces of a length are numbered in two levels: within (length, bucket) by a window, and buckets
    of a length by a running sum over their counts, so a length with a third of all pieces has many groups.
    """
    keyed = parts.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32"))
    total = parts.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``size`` rows
    table = slots(plan({r["length"]: r["n"] for r in total}, size))
    buckets = max([1, *(-(-r["n"] // per_group) for r in total)])
    keyed = keyed.withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_b").orderBy("_h", "doc_id", "piece")
    ranked = keyed.withColumn("_r", F.row_number().over(own) - 1).join(bases, ["length", "_b"])
    ranked = ranked.withColumn("_rank", F.col("_r") + F.col("_base")).drop("_h", "_b", "_r", "_base")
    names = [c for c in ranked.columns if c != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: dict[int, tuple[int, int]] = {}
        for x in np.unique(table["length"]):
            starts[int(x)] = (int(np.searchsorted(table["length"], x)), int(np.searchsorted(table["length"], x, side="right")))
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                a, b = starts[int(x)]
                rows = np.flatnonzero(length == x)
                at = a + np.searchsorted(table["rank"][a:b], rank[rows], side="right") - 1
                sequence[rows] = table["sequence"][at] + rank[rows] - table["rank"][at]
                offset[rows] = table["offset"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def packed_query(docs: DataFrame, vocabulary: str, *, size: int = 2048, carry: tuple[str, ...] = ()) -> DataFrame:
    """Tokenize, cut and pack whole documents; one row per piece, with the columns ``carry`` of its document."""
    parts = saved(token_pieces(docs, vocabulary, size=size, carry=carry), "pieces")
    return pack(parts, size=size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *carry)
