"""Embedding near-dedup by NN-descent: all pairs of vectors with cosine >= threshold, as link counts and components.

Equal vectors (after normalization) are one node with a multiplicity. Neighbour lists of ``k`` start
from sign-hash buckets of bounded size; rounds of neighbours-of-neighbours joins then compare each node's
neighbours and reverse neighbours with one another and keep what betters a list, until few entries
change. List entries at the threshold are verified in double precision and become links.

A list whose ``k`` entries all are links is saturated: it may hide more. Saturated nodes of one component get
their lists enlarged to all of that component's saturated nodes, compared in blocks of bounded size that give
back counts and no pairs. Blocks of different components are compared in the same way wherever their centres and
radii allow a link, and components that turn out to be linked become one. A pair that is missing from lists can only be
one between two saturated nodes, or one that the search missed; the latter is audited: a bounded set of nodes that are not
saturated is compared with all others, and if on average fewer than ``recall`` of such a node's links were found, the search
goes on from more tables, ``more`` times at most. If that is not enough, it raises. The number of tables grows with the number of bits, so
that a pair at the threshold shares no bucket with a chance of ``miss`` at most, whatever the number of nodes.

Reverse neighbours used in the joins are the closest ``2 k`` of a node; this bounds the search alone, never the links.

Nulls and empties: a vector that is null, empty, zero, or holds null or non-finite components links with nothing, and
so does one without an id; vectors of different lengths do not link. Repeated rows link with each other.
An empty table gives no rows. Labels and other columns are not read, whatever their names.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm._common import saved, ship, small_batches
from lumenframe.llm._graph import components

log = logging.getLogger("lumenframe.llm.vectors")


def normalized(rows: DataFrame) -> DataFrame:
    """(vec_id, v binary: unit vector of doubles, or null)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, i in zip(batch.column("embedding").to_pylist(), batch.column("vec_id").to_pylist(), strict=True):
                v = np.array(x, np.float64) if x and i is not None and None not in x else np.zeros(0)
                top = np.abs(v).max() if len(v) else 0.0
                if not np.isfinite(top) or top == 0:
                    out.append(None)
                    continue
                v = v / top
                out.append((v / np.sqrt((v * v).sum()) + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "v"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, v binary")


def _matrix(column: pa.Array, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def sign_tables(nodes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(key, id) for each table: signs against ``bits`` random directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dim = np.array([len(x) // 8 for x in batch.column("v").to_pylist()])
            for d in np.unique(dim).tolist():
                rows = np.flatnonzero(dim == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).normal(size=(d, bits * tables))
                x = _matrix(batch.column("v").take(pa.array(rows)), np.float64)
                code = ((x @ planes[d]) > 0).reshape(len(rows), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                key = (code + (np.arange(tables) << bits)) * 100_003 + d
                ids = batch.column("id").take(pa.array(np.repeat(rows, tables)))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), ids], ["key", "id"])

    return nodes.select("id", "v").mapInArrow(run, "key long, id long")


def _vectors32(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.frombuffer(x, np.float64).astype(np.float32).tobytes() for x in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(v, pa.binary())], ["id", "v"])

    return nodes.select("id", "v").mapInArrow(run, "id long, v binary")


def _by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key; groups are of bounded size, several go together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch.column(key).to_numpy()
        last = int(np.searchsorted(k, k[-1]))  # the last group may go on in the next batch
        if last:
            held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held)
            held = []
        elif held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _compare_groups(table: pa.Table, key: str, id_col: str, floors: np.ndarray | None, top: int | None) -> pa.RecordBatch:
    """Within each group, who is closer than a floor, or among the ``top`` closest: (id, nbr, sim). Groups of like size step together.

    A group's vectors have one length; the groups of a table may differ.
    """
    dim = pa.compute.binary_length(table.column("v")).to_numpy()
    if len(dim) and (dim != dim[0]).any():
        parts = []
        for d in np.unique(dim):
            keep = dim == d
            parts.append(_compare_groups(table.filter(pa.array(keep)), key, id_col, None if floors is None else floors[keep], top))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(map(len, parts)) else parts[0]
    k = table.column(key).to_numpy()
    ids = table.column(id_col).to_numpy()
    raw = table.column("v").combine_chunks()
    raw = pa.concat_arrays(raw.chunks) if isinstance(raw, pa.ChunkedArray) else raw
    x = _matrix(raw)
    cut = np.concatenate([np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), [len(k)]])
    size = np.diff(cut)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    width = 1
    while width < (size.max() if len(size) else 0) or width == 1:
        width *= 2
        some = np.flatnonzero((size > width // 2) & (size <= width)) if width > 2 else np.flatnonzero((size > 1) & (size <= 2))
        step = max(1, (1 << 20) // (width * width))
        for a in range(0, len(some), step):
            g = some[a : a + step]
            at = cut[g][:, None] + np.arange(width)
            real = np.arange(width) < size[g][:, None]
            at = np.where(real, at, cut[g][:, None])
            m = x[at]
            sim = np.matmul(m, m.transpose(0, 2, 1))
            sim[~(real[:, :, None] & real[:, None, :])] = -2
            own = ids[at]
            sim[own[:, :, None] == own[:, None, :]] = -2
            if floors is not None:
                hit = np.nonzero(sim > floors[at][:, :, None])
            elif width > top:
                floor = np.partition(sim, width - top, axis=2)[:, :, width - top, None]
                hit = np.nonzero((sim >= floor) & (sim > -2))
            else:
                hit = np.nonzero(sim > -2)
            out.append((own[hit[0], hit[1]], own[hit[0], hit[2]], sim[hit]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
    found = pa.table({"id": cols[0], "nbr": cols[1], "sim": pa.array(cols[2], pa.float32())}).group_by(["id", "nbr"]).aggregate([("sim", "max")])
    return pa.RecordBatch.from_arrays([found.column(c).combine_chunks() if not isinstance(found.column(c).combine_chunks(), pa.ChunkedArray) else pa.concat_arrays(found.column(c).chunks) for c in ("id", "nbr", "sim_max")], ["id", "nbr", "sim"])


EDGE = "id long, nbr long, sim float"


def best_lists(edges: DataFrame, k: int) -> DataFrame:
    """The k closest neighbours of each node, with their rank and the list's last similarity if it is full."""
    once = edges.groupBy("id", "nbr").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "nbr")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def seed_bits(n: int) -> int:
    """Signs in a bucket's key: buckets of about 96 nodes if these were spread evenly."""
    return max(2, int(np.ceil(np.log2(max(n, 2) / 96))))


def seed_tables(n: int, threshold: float, least: int, miss: float) -> int:
    """How many tables leave a pair at the threshold in no common bucket with a chance of ``miss`` at most, but not fewer than ``least``."""
    shared = (1 - np.arccos(threshold) / np.pi) ** seed_bits(n)
    return max(least, int(np.ceil(np.log(miss) / np.log1p(-shared))))


def seed_edges(nodes: DataFrame, v32: DataFrame, n: int, k: int, tables: int, seed: int, group: int = 384) -> DataFrame:
    """Each node's k closest in its buckets; a larger bucket is dealt at random into groups of bounded size."""
    bits = seed_bits(n)
    keyed = sign_tables(nodes, bits, tables, seed)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"))
    dealt = keyed.join(sizes, "key").withColumn("part", F.xxhash64("key", F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("n") / group)))).select("part", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, "part"):
            yield _compare_groups(table, "part", "id", None, k)

    return dealt.join(v32, "id").repartition("part").sortWithinPartitions("part").mapInArrow(run, EDGE)


def descend(lists: DataFrame, v32: DataFrame, k: int) -> DataFrame:
    """Better neighbours found by comparing every node's neighbours and reverse neighbours with one another."""
    floor = lists.groupBy("id").agg(F.min("sim").alias("low"), F.count("*").alias("n")).select(F.col("id").alias("member"), F.when(F.col("n") < k, F.lit(-1.5)).otherwise(F.col("low")).cast("float").alias("low"))
    back = lists.select(F.col("nbr").alias("center"), F.col("id").alias("member"), "sim")
    nth = F.row_number().over(Window.partitionBy("center").orderBy(F.desc("sim"), "member"))
    back = back.withColumn("r", nth).where(F.col("r") <= 2 * k).select("center", "member")
    forth = lists.select(F.col("id").alias("center"), F.col("nbr").alias("member"))
    own = lists.select(F.col("id").alias("center"), F.col("id").alias("member"))
    members = forth.unionByName(back).unionByName(own).distinct()
    full = members.join(floor, "member", "left").withColumn("low", F.coalesce("low", F.lit(-1.5).cast("float")))
    full = full.join(v32.withColumnRenamed("id", "member"), "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, "center"):
            yield _compare_groups(table, "center", "member", table.column("low").to_numpy(), None)

    return full.repartition("center").sortWithinPartitions("center").mapInArrow(run, EDGE)


def exact_links(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Undirected list entries (a < b) whose cosine in double precision reaches the threshold."""
    near = lists.where(F.col("sim") >= threshold - 1e-3).select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()
    both = near.join(nodes.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(nodes.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ok = [len(x) == len(y) and float(np.dot(np.frombuffer(x), np.frombuffer(y))) >= threshold for x, y in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), strict=True)]
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def in_blocks(dense: DataFrame, block: int) -> DataFrame:
    """Saturated nodes with their component's number of blocks and their own, b."""
    sizes = dense.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return dense.join(sizes, "component").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def block_counts(dense: DataFrame, threshold: float, block: int = 256) -> DataFrame:
    """(id, linked): how many rows a saturated node links with among its component's other saturated nodes (component, id, v, mult)."""
    mine = in_blocks(dense, block)
    spread = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("component", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "id", "v", "mult")

    def run(t: pa.Table) -> pa.Table:
        raw = t.column("v").combine_chunks()
        x = _matrix(pa.concat_arrays(raw.chunks) if isinstance(raw, pa.ChunkedArray) else raw, np.float64)
        side, ids, mult = t.column("b").to_numpy(), t.column("id").to_numpy(), t.column("mult").to_numpy().astype(np.float64)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        near = (x[left] @ x[right].T >= threshold) & (ids[left][:, None] != ids[right][None, :])
        a = near @ mult[right]
        found = [(ids[left], a)] + ([(ids[right], near.T @ mult[left])] if i != j else [])
        return pa.table({"id": np.concatenate([f[0] for f in found]), "linked": np.concatenate([f[1] for f in found]).astype(np.int64)})

    return spread.groupBy("component", "i", "j").applyInArrow(run, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))


def close_blocks(mine: DataFrame, threshold: float, group: int = 8192) -> DataFrame:
    """Pairs of blocks (c1, b1, c2, b2) of different components, c1 < c2, that can hold a link.

    A block's vectors lie within an angle of its centre; two blocks are apart if their centres' angle, less both of these, is over the
    threshold's. Blocks are dealt into groups of bounded size, and groups are compared in pairs.
    """

    def ball(t: pa.Table) -> pa.Table:
        x = _matrix(pa.concat_arrays(t.column("v").chunks), np.float64)
        c = x.sum(0)
        size = np.sqrt((c * c).sum())
        c = c / size if size else x[0]
        angle = float(np.arccos(np.clip(x @ c, -1.0, 1.0)).max())
        return pa.table({"component": t.column("component")[:1], "b": t.column("b")[:1], "v": pa.array([c.tobytes()], pa.binary()), "angle": [angle]})

    balls = saved(mine.select("component", "b", "v").groupBy("component", "b").applyInArrow(ball, "component long, b int, v binary, angle double"), "balls")
    groups = -(-balls.count() // group)
    dealt = balls.withColumn("g", F.pmod(F.xxhash64("component", "b"), F.lit(max(1, groups))).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(0, groups - 1)))))
    dealt = dealt.select(F.least("g", "other").alias("i"), F.greatest("g", "other").alias("j"), F.octet_length("v").alias("dim"), "g", "component", "b", "v", "angle")
    limit = float(np.arccos(threshold)) + 1e-6

    def run(t: pa.Table) -> pa.Table:
        x = _matrix(pa.concat_arrays(t.column("v").chunks), np.float64)
        g, comp, b, angle = (t.column(c).to_numpy() for c in ("g", "component", "b", "angle"))
        left, right = np.flatnonzero(g == t.column("i")[0].as_py()), np.flatnonzero(g == t.column("j")[0].as_py())
        found = []
        for at in range(0, len(left), 512):
            some = left[at : at + 512]
            apart = np.arccos(np.clip(x[some] @ x[right].T, -1.0, 1.0)) - angle[some][:, None] - angle[right][None, :]
            p, q = np.nonzero((apart <= limit) & (comp[some][:, None] != comp[right][None, :]))
            p, q = some[p], right[q]
            swap = comp[p] > comp[q]
            found.append((np.where(swap, q, p), np.where(swap, p, q)))
        p, q = (np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"c1": comp[p], "b1": b[p], "c2": comp[q], "b2": b[q]})

    return dealt.groupBy("dim", "i", "j").applyInArrow(run, "c1 long, b1 int, c2 long, b2 int").distinct()


def cross_counts(dense: DataFrame, threshold: float, block: int = 256) -> DataFrame:
    """(id, linked, component, other): how many rows a saturated node links with among the saturated nodes of another component."""
    mine = saved(in_blocks(dense, block), "blocks")
    pairs = saved(close_blocks(mine, threshold), "block-pairs")
    one = pairs.join(mine.withColumnsRenamed({"component": "c1", "b": "b1"}), ["c1", "b1"]).withColumn("first", F.lit(True))
    two = pairs.join(mine.withColumnsRenamed({"component": "c2", "b": "b2"}), ["c2", "b2"]).withColumn("first", F.lit(False))
    names = ["c1", "b1", "c2", "b2", "first", "id", "v", "mult"]

    def run(t: pa.Table) -> pa.Table:
        x = _matrix(pa.concat_arrays(t.column("v").chunks), np.float64)
        first, ids, mult = t.column("first").to_numpy(), t.column("id").to_numpy(), t.column("mult").to_numpy()
        c1, c2 = t.column("c1")[0].as_py(), t.column("c2")[0].as_py()
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        near = x[left] @ x[right].T >= threshold
        linked = np.concatenate([near @ mult[right], near.T @ mult[left]]).astype(np.int64)
        mine, other = np.repeat([c1, c2], [len(left), len(right)]), np.repeat([c2, c1], [len(left), len(right)])
        return pa.table({"id": ids[np.concatenate([left, right])], "linked": linked, "component": mine, "other": other}).filter(pa.array(linked > 0))

    return one.select(*names).unionByName(two.select(*names)).groupBy("c1", "b1", "c2", "b2").applyInArrow(run, "id long, linked long, component long, other long")


def near_vectors(rows: DataFrame, *, threshold: float = 0.9, k: int = 10, tables: int = 12, rounds: int = 3, audit: int = 1024, recall: float = 0.98, more: int = 6, settled: float = 0.002, miss: float = 0.05) -> DataFrame:
    """(vec_id, n_links, component_id) for every row."""
    spark = rows.sparkSession
    small_batches(spark, rows=8000)
    flat = saved(normalized(rows).withColumn("h", F.unhex(F.md5("v"))), "vectors")
    grouped = flat.where("v IS NOT NULL").groupBy("h").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult"), F.first("v").alias("v"))
    nodes = saved(grouped, "nodes")
    n = nodes.count()
    v32 = saved(_vectors32(nodes), "vectors32")
    tables = seed_tables(n, threshold, tables, miss)
    lists = None
    for attempt in range(1 + more):
        edges = seed_edges(nodes, v32, n, k, tables, attempt)
        lists = saved(best_lists(edges if lists is None else edges.unionByName(lists.select("id", "nbr", "sim")), k), "lists")
        for _ in range(rounds):
            better = saved(best_lists(lists.select("id", "nbr", "sim").unionByName(descend(lists, v32, k)), k), "lists")
            changed = better.join(lists, ["id", "nbr"], "left_anti").count()
            lists = better
            if changed <= settled * n * k:
                break
        dense, labels, degree = _degrees(lists, nodes, k, threshold)
        found = _audit(nodes, dense, degree, threshold, audit)
        log.info("NN-descent attempt %d: audited recall %.4f", attempt, found)
        if found >= recall:
            break
    else:
        raise RuntimeError(f"audited recall {found:.4f} is below {recall} after {1 + more} attempts with {tables} tables each")
    node_of = flat.select("vec_id", "h").join(nodes.select("h", "id", "mult"), "h", "left")
    out = node_of.join(degree.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").join(labels.select(F.col("node").alias("at"), "component"), F.col("id") == F.col("at"), "left")
    alone = F.coalesce(F.col("mult") - 1, F.lit(0))
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + alone).cast("long").alias("n_links"), F.coalesce("component", "id", "vec_id").alias("component_id"))


def _degrees(lists: DataFrame, nodes: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saturated nodes, component labels and (id, links) from the lists, saturated ones enlarged to all saturated nodes."""
    links = saved(exact_links(lists, nodes, threshold), "links")
    labels = saved(components(links), "labels")
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("nbr")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("nbr")))
    kept = lists.join(ends, ["id", "nbr"], "left_semi").groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("id")
    dense = saved(kept.join(labels.select(F.col("node").alias("id"), "component"), "id").join(nodes.select("id", "v", "mult"), "id"), "dense")
    marks = dense.select(F.col("id").alias("m"), F.lit(True).alias("full"))
    sides = ends.join(nodes.select(F.col("id").alias("nbr"), "mult"), "nbr").join(marks.withColumnRenamed("m", "id").withColumnRenamed("full", "f1"), "id", "left").join(marks.withColumnRenamed("m", "nbr").withColumnRenamed("full", "f2"), "nbr", "left")
    listed = sides.where("f1 IS NULL OR f2 IS NULL").groupBy("id").agg(F.sum("mult").alias("linked"))
    cross = saved(cross_counts(dense, threshold), "cross")
    if not cross.isEmpty():
        merged = components(cross.select(F.col("component").alias("a"), F.col("other").alias("b")).distinct())
        merged = merged.select(F.col("node").alias("component"), F.col("component").alias("whole"))
        labels = saved(labels.join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component")), "labels")
    degree = listed.unionByName(block_counts(dense, threshold)).unionByName(cross.select("id", "linked")).groupBy("id").agg(F.sum("linked").alias("links"))
    return dense, labels, saved(degree, "degrees")


def _audit(nodes: DataFrame, dense: DataFrame, degree: DataFrame, threshold: float, audit: int) -> float:
    """Share of a node's true links that were found, on average over those with links among ``audit`` nodes; this set travels with the tasks.

    The nodes are those with the smallest hashes, as many at any size. Saturated nodes are left out: their links with one another are
    counted exactly and would hide what the search missed. A pair that it missed has an end that is not saturated. Every link counted is
    one that was verified, so counts compare as the links themselves would; and as found links are what makes components, a
    share of links as large is within components.
    """
    open_ends = nodes.join(dense.select("id"), "id", "left_anti")
    some = open_ends.orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(audit).select("id", "v").toArrow()
    if not len(some):
        return 1.0
    ids, vs = some.column("id").to_numpy(), some.column("v").to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim = {d: (np.array([i for i, v in zip(ids, vs, strict=True) if len(v) == d]), np.frombuffer(b"".join(v for v in vs if len(v) == d)).reshape(-1, d // 8)) for d in {len(v) for v in vs}}
        total = dict.fromkeys(ids.tolist(), 0)
        for batch in batches:
            raw = batch.column("v").to_pylist()
            own, mult = batch.column("id").to_numpy(), batch.column("mult").to_numpy()
            for d, (q, x) in by_dim.items():
                rows = np.array([i for i, v in enumerate(raw) if len(v) == d], np.int64)
                if not len(rows):
                    continue
                near = x @ np.frombuffer(b"".join(raw[i] for i in rows)).reshape(len(rows), -1).T >= threshold
                near &= q[:, None] != own[rows][None, :]
                for i, t in zip(q.tolist(), (near @ mult[rows]).tolist(), strict=True):
                    total[i] += t
        yield pa.RecordBatch.from_pydict({"id": list(total), "true": [int(t) for t in total.values()]})

    truth = nodes.select("id", "v", "mult").mapInArrow(run, "id long, true long").groupBy("id").agg(F.sum("true").alias("true"))
    row = truth.where(F.col("true") > 0).join(degree, "id", "left").agg(F.avg(F.least("true", F.coalesce("links", F.lit(0))) / F.col("true"))).first()
    return 1.0 if row[0] is None else row[0]


def vectors_query(rows: DataFrame) -> DataFrame:
    return near_vectors(rows).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
