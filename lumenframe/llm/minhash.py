"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the multiset of its five-word shingles; a shingle's weight is how often it occurs. The similarity
is the probability Jaccard of the weights (for sets the plain Jaccard). ProbMinHash estimates it: each
shingle is a Poisson process of arrivals with its weight as rate, seeded by its hash, so equal shingles
arrive alike in all documents; each arrival picks one of ``components`` registers, a register keeps
the shingle that arrives first, and a process stops once it is later than all registers of its document.

Equal texts are one node. Nodes that agree on all registers of a band share a bucket. In a bucket every node is compared
exactly with one hub, the node that shares buckets with most others, so that a group of copies hangs together
after few comparisons; ``hub_rounds`` times, each time without the hubs before, whose comparisons are complete, and only
where nodes of several components are left. What is still apart is compared in blocks of bounded size: a block, or two
blocks of a bucket, go to one task, which bounds all their pairs at once by a product of matrices and gives back
links alone, no pairs, and no link within a component. The bound is exact: with U the share of a text's weight on shingles that the other does not
have, the probability Jaccard is at most (1 - U)(1 - V) / (1 - U V), and equal to that for texts without
repeated shingles. So all pairs that share a bucket are decided exactly, whatever their similarity, and
banding alone can miss a pair: at exactly 0.8 with a chance below 1e-4. A class is a connected component of the links.

Shingles are told apart by 64-bit hashes of their words' 64-bit keyed hashes.

Nulls and empties: a null text counts as empty; texts without words are alike only to each other. One to four words
are one shingle. Null ids are allowed (a class is named by its smallest id that is not null). Repeated rows
are equal texts; of rows with equal id and text the stage keeps any one. An empty table gives no rows. Texts are read whole; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._common import WORD_BASE, lean, mix64, packed, pieces, saved, ship, small_batches, span_hashes, text_bytes, unpacked, word_hashes, word_spans
from lumenframe.llm._graph import components as connected

SHINGLE, COMPONENTS, ROWS = 5, 120, 5


def shingle_weights(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, their counts, and the n+1 offsets by text."""
    data, offsets = text_bytes(column)
    starts, ends, at = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    first = at[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    hashes = span_hashes(words, first, first + np.minimum(size, n)[doc], WORD_BASE)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    weight = np.diff(np.concatenate([begin, [len(doc)]]))
    return hashes[begin], weight, np.searchsorted(doc[begin], np.arange(len(n) + 1))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((mix64(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(hashes: np.ndarray, weight: np.ndarray, at: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """ProbMinHash registers (texts x m) with the winning shingle's hash; a text without shingles has zeros.

    All processes step together: the r-th step draws each live process's r-th waiting time and register.
    """
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    time = np.zeros(len(hashes))
    first = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    live = np.arange(len(hashes))
    limit = np.full(n, np.inf)
    r = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(live):
            r += np.uint64(1)
            e, d = hashes[live], doc[live]
            seed = mix64(e + r * np.uint64(0x9E3779B97F4A7C15))
            t = time[live] - np.log(_uniform(seed)) / weight[live]
            ok = t < limit[d]
            live, e, d, t, seed = live[ok], e[ok], d[ok], t[ok], seed[ok]
            time[live] = t
            slot = d * m + (mix64(seed ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(first, slot, t)
            won = first[slot] == t
            winner[slot[won]] = e[won]
            touched = np.unique(d[won]) if len(d) < 4 * n else np.arange(n)
            limit[touched] = first.reshape(n, m)[touched].max(1)
    return winner.reshape(n, m)


def probability_jaccard(xh: np.ndarray, xw: np.ndarray, yh: np.ndarray, yw: np.ndarray) -> float:
    """Sum over common i of 1 / sum over j of max(x_j/x_i, y_j/y_i), from sorted hashes, by prefix sums over x/y."""
    if not len(xh) or not len(yh):
        return float(len(xh) == len(yh))
    _, i, j = np.intersect1d(xh, yh, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = xw[i].astype(np.float64), yw[j].astype(np.float64)
    x_rest, y_rest = xw.sum() - x.sum(), yw.sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above = x.sum() - np.cumsum(x) + x_rest  # x_j where x_j/y_j ranks above
    below = np.cumsum(y) + y_rest
    return float((1.0 / (above / x + below / y)).sum())


def _node(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def band_table(docs: DataFrame, *, size: int = SHINGLE, m: int = COMPONENTS, rows: int = ROWS) -> DataFrame:
    """(node, bands array<long>) of each distinct text with words; equal texts may come more than once."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession, rows=4000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(m // rows, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            keep = pa.array(list({k: i for i, k in reversed(list(enumerate(nodes)))}.values()))
            text, node = batch.column("text").take(keep), batch.column("node").take(keep)
            for x, y in pieces(text, 4 << 20):
                hashes, weight, at = shingle_weights(text.slice(x, y - x), size)
                sig = signatures(hashes, weight, at, m)
                full = np.flatnonzero(np.diff(at) > 0)
                sig = sig[full]
                key = np.zeros((len(full), m // rows), np.uint64) + band
                with np.errstate(over="ignore"):
                    for k in range(rows):
                        key = mix64(key.ravel() * np.uint64(0x9E3779B97F4A7C15) + sig[:, k::rows].ravel()).reshape(key.shape)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * (m // rows)), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([node.slice(x, y - x).take(pa.array(full)), flat], ["node", "bands"])

    return docs.select("node", "text").mapInArrow(lean(run), "node binary, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, *, size: int = SHINGLE, per_group: int = 64) -> DataFrame:
    """Exact similarity of pairs (a, hub): (a, hub, sim). Texts is one row (node, text) for each node.

    A hub's partners are dealt to groups of about ``per_group``; a task reads a group as a stream, the hub first, and holds
    the hub and one slice of its partners.
    """
    counts = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    salted = pairs.join(counts, "hub").select("a", "hub", F.pmod(F.xxhash64("a", F.lit("salt")), F.ceil(F.col("n") / per_group)).cast("int").alias("salt"))
    hubs = salted.select("hub", "salt").distinct()
    left = salted.join(texts.select(F.col("node").alias("a"), "text"), "a").select("hub", "salt", "a", "text")
    right = hubs.join(texts.select(F.col("node").alias("hub"), "text"), "hub").select("hub", "salt", F.lit(None).cast("binary").alias("a"), "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            for x, y in pieces(batch.column("text")):
                some = batch.slice(x, y - x)
                hashes, weight, at = shingle_weights(some.column("text"), size)
                names, rows, sims = some.column("a").to_pylist(), [], []
                for i, a in enumerate(names):
                    own = hashes[at[i] : at[i + 1]], weight[at[i] : at[i + 1]]
                    if a is None:
                        hub = own[0].copy(), own[1].copy()
                    else:
                        rows.append(i)
                        sims.append(probability_jaccard(*own, *hub))
                yield pa.RecordBatch.from_arrays([some.column(c).take(pa.array(rows, pa.int64())) for c in ("a", "hub")] + [pa.array(sims, pa.float64())], ["a", "hub", "sim"])

    return left.unionByName(right).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "a").mapInArrow(lean(compare), "a binary, hub binary, sim double")


def bounds(sets: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray, columns: int = 2048) -> np.ndarray:
    """Upper bounds of the probability Jaccard of each text of ``left`` with each of ``right``, from (hashes, weights) of all."""
    sizes = np.array([len(h) for h, _ in sets])
    hashes = np.concatenate([h for h, _ in sets])
    mass = np.concatenate([w / w.sum() for _, w in sets]).astype(np.float32)
    of = np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(hashes, return_inverse=True, return_counts=True)
    keep = count[code] > 1  # a shingle of one text alone is common to no pair
    order = np.argsort(code[keep], kind="stable")
    code, of, mass = code[keep][order], of[keep][order], mass[keep][order]
    column = np.cumsum(np.concatenate([[0], np.diff(code) != 0])) if len(code) else code
    own, other = np.zeros((2, len(left), len(right)), np.float32)  # the left one's weight on the right one's shingles, and vice versa
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [first, first + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[of[a:b], column[a:b] - first] = mass[a:b]
        has = (part > 0).astype(np.float32)
        own += part[left] @ has[right].T
        other += has[left] @ part[right].T
    return own * other / np.maximum(own + other - own * other, np.float32(1e-9))


def residual_links(members: DataFrame, shingles: DataFrame, threshold: float, block: int = 256, block_bytes: int = 2 << 20) -> DataFrame:
    """Links (a, b) between nodes of different labels that share a bucket; members is (key, band, node, label), shingles (node, bands, hashes, weights).

    A bucket's nodes are dealt to blocks of about ``block`` nodes or ``block_bytes``; every two blocks meet in one group. A pair is
    decided in the first band in which it agrees.
    """
    rows = members.join(shingles, "node")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("hashes") + F.octet_length("weights")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    dealt = rows.join(sizes.select("key", blocks.alias("blocks")), "key").withColumn("b", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("g", F.xxhash64("key", F.least("b", "other"), F.greatest("b", "other"))).withColumn("side", (F.col("b") > F.col("other")).cast("int"))
    names = ["g", "key", "band", "b", "other", "side", "node", "label", "bands", "hashes", "weights"]

    def links_of(t: list[dict]) -> list[tuple[bytes, bytes]]:
        """The links of a group that its labels do not imply, and no more than its nodes."""
        band = t[0]["band"]
        side = np.array([r["side"] for r in t])
        inside = t[0]["b"] == t[0]["other"]
        left = np.arange(len(t)) if inside else np.flatnonzero(side == 0)
        right = left if inside else np.flatnonzero(side == 1)
        if len(t) < 2 or not len(left) or not len(right):
            return []
        index = {x: i for i, x in enumerate(dict.fromkeys(r["label"] for r in t))}
        label = np.array([index[r["label"]] for r in t])
        keys = np.array([r["bands"] for r in t])
        open_ = label[left][:, None] != label[right][None, :]
        for k in range(band):
            open_ &= keys[left, k][:, None] != keys[right, k][None, :]
        if inside:
            open_ &= left[:, None] < right[None, :]
        if not open_.any():
            return []
        use = np.zeros(len(t), bool)
        use[left[open_.any(1)]] = use[right[open_.any(0)]] = True
        at = np.cumsum(use) - 1
        sets = [(np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["weights"], np.int64)) for r, u in zip(t, use, strict=True) if u]
        x, y = left[use[left]], right[use[right]]
        near = bounds(sets, at[x], at[y]) >= threshold - 1e-4
        found: list[tuple[bytes, bytes]] = []
        for i, j in np.argwhere(near & open_[np.ix_(use[left], use[right])]).tolist():
            p, q = label[x[i]], label[y[j]]
            if p != q and probability_jaccard(*sets[at[x[i]]], *sets[at[y[j]]]) >= threshold:
                label[label == max(p, q)] = min(p, q)
                found.append((t[x[i]]["node"], t[y[j]]["node"]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for row in batch.to_pylist():
                if group and (row["g"], row["key"]) != (group[0]["g"], group[0]["key"]):
                    found += links_of(group)
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], ["a", "b"])
        found = links_of(group) if group else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], ["a", "b"])

    return dealt.select(*names).repartition("g").sortWithinPartitions("g", "key", "node").mapInArrow(lean(run), "a binary, b binary").distinct()


def shingle_table(texts: DataFrame, size: int) -> DataFrame:
    """(node, hashes, weights) of (node, text): a text's distinct shingles and their counts, as little-endian 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in pieces(batch.column("text")):
                hashes, weight, at = shingle_weights(batch.column("text").slice(x, y - x), size)
                cut = [(hashes[a:b].tobytes(), weight[a:b].astype("<i8").tobytes()) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(x, y - x), *(pa.array([c[k] for c in cut], pa.binary()) for k in (0, 1))], ["node", "hashes", "weights"])

    return texts.select("node", "text").mapInArrow(lean(run), "node binary, hashes binary, weights binary")


def _several(members: DataFrame) -> DataFrame:
    """Members of the buckets in which nodes of several labels are left."""
    keys = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    return members.join(keys, "key", "left_semi")


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, size: int = SHINGLE, m: int = COMPONENTS, rows: int = ROWS, hub_rounds: int = 2) -> DataFrame:
    """(node, component) of the texts that have a near-duplicate; ``docs`` has doc_id, text and node."""
    bands = saved(band_table(docs, size=size, m=m, rows=rows), "bands")
    each = bands.select(F.posexplode("bands").alias("band", "key"), "node")
    shared = each.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("key")
    members = saved(each.join(shared, "key").distinct(), "members")
    # one text of each node that shares a bucket
    wanted = members.select("node").distinct()
    first = docs.groupBy("node").agg(F.min("doc_id").alias("rep")).join(wanted, "node").select(F.col("node").alias("of"), "rep")
    own = docs.join(first, (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    texts = saved(own.dropDuplicates(["node", "doc_id"]).select("node", "text"), "texts")
    left = members.withColumn("label", F.col("node"))
    links: DataFrame | None = None
    labels: DataFrame | None = None
    for k in range(hub_rounds):
        crowd = left.groupBy("key").agg(F.count("*").alias("n"))
        central = left.join(crowd, "key").groupBy("node").agg(F.sum("n").alias("central"))
        pick = F.struct("central", F.xxhash64("node", F.lit(k)).alias("h"), "node", "label")
        hubs = saved(left.join(central, "node").groupBy("key").agg(F.max(pick).alias("hub")).select("key", F.col("hub.node").alias("hub"), F.col("hub.label").alias("hub_label")), "hubs")
        met = left.join(hubs, "key")
        pairs = saved(met.where("label != hub_label").select(F.col("node").alias("a"), "hub").distinct(), "pairs")
        found = verify(pairs, texts, size=size).where(F.col("sim") >= threshold).select("a", F.col("hub").alias("b"))
        links = saved(found if links is None else found.unionByName(links), "links")
        labels = saved(connected(links), "labels")
        apart = met.where("node != hub").select("key", "band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        left = saved(_several(apart), "left")
        if left.isEmpty():
            return labels
    nodes = left.select("node").distinct()
    shingles = shingle_table(texts.join(nodes, "node", "left_semi"), size)
    shingles = saved(shingles.join(bands.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "node"), "shingles")
    more = saved(residual_links(left, shingles, threshold), "residual-links")
    return labels if more.isEmpty() else saved(connected(links.unionByName(more)), "labels")


def classes(docs: DataFrame, **kw) -> DataFrame:
    """(node, class_id, keeper, n_class) of the texts of (doc_id, text): a class is named by its smallest id, which the node ``keeper`` holds."""
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), _node().alias("node"))
    labels = near_duplicates(work, **kw)
    reps = work.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("rep").isNull().alias("a"), F.col("rep").alias("b"), F.col("node").alias("c"))
    best = reps.groupBy("component").agg(F.min(order).alias("k"), F.sum("n").alias("n_class"))
    return reps.join(best, "component").select("node", F.col("k.b").alias("class_id"), F.col("k.c").alias("keeper"), "n_class")


def minhash_query(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept and the number of documents in the class."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _node().alias("node")).join(classes(docs), "node")
    return out.select("doc_id", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("keeper"))).alias("kept"), F.col("n_class").cast("long").alias("n_in_class"))


def minhash_stage(docs: DataFrame) -> DataFrame:
    """One document of each class: the one with the smallest id."""
    found = classes(docs)
    keep = saved(found.where(F.col("node") == F.col("keeper")).select(F.col("node").alias("_lf_keep"), F.col("class_id").alias("_lf_id")), "kept")
    own = packed(docs, "doc_id", "text").withColumn("_lf_node", _node()).join(keep, (F.col("_lf_node") == F.col("_lf_keep")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_lf_id")))
    return unpacked(own.dropDuplicates(["_lf_keep"]), docs.columns, "doc_id", "text")
