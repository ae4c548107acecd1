"""N-best segmentation of whole texts into pieces of a SentencePiece vocabulary, and decoding.

The piece lattice of a text is scored as a unigram model: a path's score is the sum of its pieces' scores.
Forward Viterbi gives the best score from the start to every position; those scores are exact
heuristics for an A-star search backward from the end, which therefore pops complete paths in falling
score. Ties go to the hypothesis made first, which depends on the text alone.

White space that no piece holds behind another character cuts the lattice of a text into a chain of the
lattices of its chunks (white space and the word behind it). Each distinct chunk is searched once per
worker, and the N best of the chain follow exactly: a path among the N best differs from the best one only by
some of the N-1 cheapest single deviations. Where a vocabulary leaves no such white space, a text is one chunk. Chunks of more than 200 characters
are cut further, between any two characters that no piece holds side by side, so texts without white space need no lattice of their whole length.

Characters outside the vocabulary cost the lowest score less ten and become byte pieces. Decoding joins the
pieces' bytes, turns space marks into spaces and drops the one put in front; so a text that
itself holds U+2581 comes back with spaces there.

Nulls and empties: null and empty texts have no pieces, score 0, and themselves as their only
segmentation. Repeated rows and null ids are kept. Fewer than N segmentations: as many as there are. An empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._common import concat_ranges, lean, pieces, ship, small_batches, text_bytes, word_spans

MARK = "▁"


@dataclass
class Vocabulary:
    """What a model file says: normal pieces with scores, and the ids of the 256 byte pieces."""

    ids: dict[str, int]
    scores: list[float]
    byte_ids: list[int]
    texts: list[bytes]
    longest: int
    unknown: float
    breaks: list[int]  # bytes of white space that no piece holds behind another character
    pairs: set[str]  # characters that stand side by side in a piece
    table: dict[str, tuple[int, float]]  # pieces with id and score, and their beginnings with -1

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names, scores = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        ids = {names[i]: i for i in range(n) if not special[i]}
        byte_ids = [0] * 256
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[int(names[i][3:5], 16)] = i
        texts = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else names[i].replace(MARK, " ").encode() for i in range(n)]
        held = {c for p in ids if len(p) > 1 for c in p.lstrip(MARK)}
        breaks = [b for b in (9, 10, 11, 12, 13, 32) if (MARK if b == 32 else chr(b)) not in held]
        return cls(ids, scores, byte_ids, texts, max(map(len, ids)), min(scores[i] for i in ids.values()) - 10.0, breaks, {p[i : i + 2] for p in ids for i in range(len(p) - 1)}, {**{p[:j]: (-1, 0.0) for p in ids for j in range(1, len(p))}, **{p: (i, scores[i]) for p, i in ids.items()}})


def lattice(text: str, v: Vocabulary) -> tuple[list[list[tuple[int, int, float]]], list[float], list[tuple]]:
    """Edges by their end (start, id or -1 for byte pieces, score), the best score to every position, and the edge it came by."""
    size, table = len(text), v.table
    alpha = [-1e300] * (size + 1)
    alpha[0] = 0.0
    by: list[tuple] = [()] * (size + 1)
    into: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
    for i in range(size):
        base = alpha[i]
        j = i
        while j < size:
            j += 1
            found = table.get(text[i:j])
            if found is None:  # no piece, and none goes on from here
                break
            k, s = found
            if k < 0:
                if j == i + 1:
                    into[j].append((i, -1, v.unknown))
                    if base + v.unknown > alpha[j]:
                        alpha[j], by[j] = base + v.unknown, (i, -1, v.unknown)
                continue
            edge = (i, k, s)
            into[j].append(edge)
            s += base
            if s > alpha[j]:
                alpha[j], by[j] = s, edge
        if found is None and j == i + 1:
            into[j].append((i, -1, v.unknown))
            if base + v.unknown > alpha[j]:
                alpha[j], by[j] = base + v.unknown, (i, -1, v.unknown)
    return into, alpha, by


def _ids(path: list[tuple[int, int, int]], text: str, v: Vocabulary) -> list[int]:
    out: list[int] = []
    for i, j, k in path:
        out += (k,) if k >= 0 else [v.byte_ids[b] for b in text[i:j].encode()]
    return out


def best_path(by: list[tuple], size: int) -> list[tuple[int, int, int]]:
    path, at = [], size
    while at:
        i, k, _ = by[at]
        path.append((i, at, k))
        at = i
    return path[::-1]


def best_and_gap(text: str, v: Vocabulary) -> tuple[float, list[int], float]:
    """Score and ids of the best path, and how much less the second best scores: the best path through each other edge decides."""
    into, alpha, by = lattice(text, v)
    size = len(text)
    beta = [-1e300] * size + [0.0]
    path = best_path(by, size)
    on = {(i, j) for i, j, _ in path}
    second = -1e300
    for j in range(size, 0, -1):
        ahead = beta[j]
        for i, _, s in into[j]:
            s += ahead
            if s > beta[i]:
                beta[i] = s
            s += alpha[i]
            if s > second and (i, j) not in on:  # no two edges join the same two positions
                second = s
    return alpha[size], _ids(path, text, v), max(0.0, alpha[size] - second) if second > -1e299 else np.inf


def n_best(text: str, v: Vocabulary, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a chunk with spaces already marked, best first: A-star backward over the lattice."""
    size = len(text)
    if not size:
        return [(0.0, [])]
    into, alpha, by = lattice(text, v)
    first = tuple(best_path(by, size))
    out: list[tuple[float, tuple]] = []
    heap: list[tuple] = [(-alpha[size], 0, size, 0.0, None)]
    made = 0
    while heap and len(out) < n:
        _, _, at, score, path = heapq.heappop(heap)
        if not at:
            found = []
            while path is not None:
                edge, path = path
                found.append(edge)
            out.append((score, tuple(found)))
            continue
        for i, k, s in into[at]:
            made += 1
            heapq.heappush(heap, (-(score + s + alpha[i]), made, i, score + s, ((i, at, k), path)))
    # of equally good paths, Viterbi's own comes first
    out = [(alpha[size], first), *(x for x in out if x[1] != first)][:n]
    return [(score, _ids(list(path), text, v)) for score, path in out]


class Segmenter:
    """Chunks met so far: ids and score of the best path, and what the second best costs more; bounded by ``max_chunks``."""

    def __init__(self, v: Vocabulary, n: int, max_chunks: int = 1_500_000):
        self.v, self.n, self.max_chunks = v, n, max_chunks
        lens = np.array([len(t) for t in v.texts], np.int64)
        self.text_data, self.text_lens, self.text_at = np.frombuffer(b"".join(v.texts), np.uint8), lens, np.cumsum(lens) - lens
        self.space = np.zeros(256, bool)
        self.space[v.breaks] = True
        self._reset()

    def _reset(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.ends, self.scores, self.costs = array("i"), array("q"), array("d"), array("d")
        self.others: dict[str, list[tuple[float, np.ndarray]]] = {}

    def _learn(self, fresh: list[str]) -> None:
        collecting = gc.isenabled()
        gc.disable()
        try:
            for text in fresh:
                if text not in self.codes:
                    self._learn_one(text)
        finally:
            if collecting:
                gc.enable()

    def _learn_one(self, text: str) -> int:
        """Code of a new chunk; where no piece joins its last two characters, the last one stands alone."""
        codes, ends, flat = self.codes, self.ends, self.flat
        if 2 < len(text) <= 40 and text[-2:] not in self.v.pairs:
            parts = [codes[t] if t in codes else self._learn_one(t) for t in (text[:-1], text[-1])]
            for c in parts:
                flat.extend(flat[ends[c - 1] if c else 0 : ends[c]])
            score, gap = self.scores[parts[0]] + self.scores[parts[1]], min(self.costs[parts[0]], self.costs[parts[1]])
        else:
            score, ids, gap = best_and_gap(text, self.v)
            flat.extend(ids)
        codes[text] = len(ends)
        ends.append(len(flat))
        self.scores.append(score)
        self.costs.append(gap)
        return codes[text]

    def chunks(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct marked chunks, the code of each chunk of the batch, and chunk offsets by text."""
        data, offsets = text_bytes(column)
        _, word_ends, _ = word_spans(data, offsets, self.space)
        last = np.searchsorted(word_ends, offsets[1:], side="right") - 1
        bare = (np.where(last >= 0, word_ends[last] if len(word_ends) else 0, 0) < offsets[1:]) & (offsets[1:] > offsets[:-1])
        cuts = np.insert(word_ends, last[bare] + 1, offsets[1:][bare])
        at = np.concatenate([[0], np.searchsorted(cuts, offsets[1:], side="right")])
        if not len(cuts):
            return [], np.zeros(0, np.int64), at
        bounds = np.concatenate([np.zeros(1, np.int64), cuts])
        coded = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        raw = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = coded.indices.to_numpy().astype(np.int64)
        marked = [r.replace(" ", MARK) for r in raw]
        first = at[:-1][at[1:] > at[:-1]]  # the first chunk of a text gets the mark put in front
        names = dict.fromkeys(code[first].tolist())
        for k, c in enumerate(names):
            names[c] = len(marked) + k
        marked += [MARK + marked[c] for c in names]
        code[first] = [names[c] for c in code[first].tolist()]
        return self._cut_long(marked, code, at)

    def _cut_long(self, marked: list[str], code: np.ndarray, at: np.ndarray, most: int = 200) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Chunks of more than ``most`` characters cut wherever no piece holds the two characters that meet: their lattices are chains too."""
        long = [k for k in set(code.tolist()) if len(marked[k]) > most]
        if not long:
            return marked, code, at
        parts: dict[int, np.ndarray] = {}
        for k in long:
            t = marked[k]
            cuts = [0, *(i for i in range(1, len(t)) if t[i - 1 : i + 1] not in self.v.pairs), len(t)]
            parts[k] = np.arange(len(marked), len(marked) + len(cuts) - 1)
            marked += [t[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        count = np.ones(len(marked), np.int64)
        count[long] = [len(parts[k]) for k in long]
        lens = count[code]
        ends = np.concatenate([[0], np.cumsum(lens)])
        out = np.repeat(code, lens)
        for i in np.flatnonzero(lens > 1).tolist():
            out[ends[i] : ends[i + 1]] = parts[int(code[i])]
        return marked, out, ends[at]

    def codes_of(self, distinct: list[str], used: np.ndarray) -> np.ndarray:
        if len(self.codes) > self.max_chunks:
            self._reset()
        need = np.zeros(len(distinct), bool)
        need[used] = True
        self._learn(list(dict.fromkeys(d for d, x in zip(distinct, need.tolist(), strict=True) if x and d not in self.codes)))
        return np.array([self.codes.get(d, -1) for d in distinct], np.int64)

    def segment(self, column: pa.Array) -> Iterator[list[tuple[float, np.ndarray]]]:
        """Per text, its n best segmentations."""
        distinct, index, at = self.chunks(column)
        code = self.codes_of(distinct, index)[index] if len(index) else np.zeros(0, np.int64)
        if len(code):  # views of the growing arrays, gone before these grow again
            last = np.frombuffer(self.ends, np.int64)[code]
            first = np.where(code > 0, np.frombuffer(self.ends, np.int64)[code - 1], 0)
            ids = np.frombuffer(self.flat, np.int32)[concat_ranges(first, last - first)] if self.flat else np.zeros(0, np.int32)
            best, gaps, lens = np.frombuffer(self.scores)[code], np.frombuffer(self.costs)[code], last - first
        else:
            ids, best, gaps, lens = np.zeros(0, np.int32), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(lens)])
        for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
            own = ids[ends[a] : ends[b]]
            yield self._chain(float(best[a:b].sum()), gaps[a:b], own, ends[a : b + 1] - ends[a], (distinct, index[a:b]))

    def _chain(self, best: float, gaps: np.ndarray, ids: np.ndarray, ends: np.ndarray, names: tuple) -> list[tuple[float, np.ndarray]]:
        out = [(best, ids)]
        if self.n < 2 or not len(gaps):
            return out
        m = self.n - 1
        # the m cheapest deviations are among all those at the m positions with the cheapest first one
        at = np.flatnonzero(gaps <= np.partition(gaps, m - 1)[m - 1]) if len(gaps) > m else np.arange(len(gaps))
        at = at[np.lexsort((at, gaps[at]))][:m]
        singles = sorted((cost, p, alt) for p in at.tolist() if gaps[p] < np.inf for alt, (cost, _) in enumerate(self._others(names, p)))[:m]
        options = []
        for k in range(1, len(singles) + 1):
            for some in combinations(range(len(singles)), k):
                if len({singles[i][1] for i in some}) == k:
                    options.append((sum(singles[i][0] for i in some), k, some))
        for cost, _, some in sorted(options)[:m]:
            swap = sorted((singles[i][1], singles[i][2]) for i in some)
            parts, at = [], 0
            for pos, alt in swap:
                parts += [ids[at : ends[pos]], self._others(names, pos)[alt][1]]
                at = ends[pos + 1]
            out.append((best - cost, np.concatenate([*parts, ids[at:]])))
        return out

    def _others(self, names: tuple, position: int) -> list[tuple[float, np.ndarray]]:
        """The next best paths of a chunk: what each costs more, and its ids."""
        text = names[0][names[1][position]]
        if text not in self.others:
            if len(self.others) > self.max_chunks // 8:
                self.others.clear()
            found = n_best(text, self.v, self.n)
            self.others[text] = [(found[0][0] - s, np.array(ids, np.int32)) for s, ids in found[1:]]
        return self.others[text]

    def decode(self, ids: np.ndarray) -> bytes:
        raw = self.text_data[concat_ranges(self.text_at[ids], self.text_lens[ids])].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


def encode_pieces(docs: DataFrame, v: Vocabulary, *, n: int = 4, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, score, decoded_sha256 (of the text decoded from the best ids) and the n best; with_ids adds the best ids."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession, rows=4000)
    held: list[Segmenter] = []
    each = pa.struct([("score", pa.float64()), ("n_pieces", pa.int32()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Segmenter(v, n))
        seg = held[0]
        for batch in batches:
            for x, y in pieces(batch.column("text")):
                best, shas, lists = [], [], []
                for found in seg.segment(batch.column("text").slice(x, y - x)):
                    shas.append(hashlib.sha256(seg.decode(found[0][1])).hexdigest())
                    lists.append([{"score": s, "n_pieces": len(i), "ids_crc32": zlib.crc32(np.ascontiguousarray(i, "<u4"))} for s, i in found])
                    best.append(found[0][1])
                out = [
                    batch.column("doc_id").slice(x, y - x), pa.array([len(b) for b in best], pa.int32()), pa.array([r[0]["ids_crc32"] for r in lists], pa.int64()),
                    pa.array([r[0]["score"] for r in lists], pa.float64()), pa.array(shas, pa.string()), pa.array(lists, pa.list_(each)),
                ]
                names = ["doc_id", "n_pieces", "ids_crc32", "score", "decoded_sha256", "nbest"]
                if with_ids:
                    out.append(pa.array([b.tolist() for b in best], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kinds = "doc_id long, n_pieces int, ids_crc32 long, score double, decoded_sha256 string, nbest array<struct<score: double, n_pieces: int, ids_crc32: long>>"
    return rows.mapInArrow(lean(run), kinds + ", ids array<int>" * with_ids)


def pieces_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_pieces(docs, Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model")))
