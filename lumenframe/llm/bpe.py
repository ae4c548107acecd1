"""Byte-level BPE ids of whole texts, chunk by chunk through the tokenizers library.

A chunk is a run of white space with the word behind it. The vocabulary's own pattern never lets
a token cross from a non-space character into white space, so chunks can be encoded alone and
remembered: Arrow finds the distinct chunks of a batch, the library encodes those not seen before, and
numpy lays the ids out. A text with white space beyond ASCII or with an added token goes to the
library whole. Either way the ids are the library's.
"""

from __future__ import annotations

import gc
import json
import zlib
from array import array
from codecs import charmap_decode

import numpy as np
import pyarrow as pa

from lumenframe.llm._common import busiest, concat_ranges, held, text_bytes, word_spans

#: Byte -> character of a byte-level vocabulary: printable bytes stand for themselves, the others
#: follow in order from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_BYTE_CHARS = "".join(_OTHERS.get(b, chr(b)) for b in range(256))
_MARKS = frozenset(".,;:!?")


class BpeEncoder:
    """Encode batches of texts. The memory of chunks holds ``max_words`` and those of one batch; when it is full, chunks used once are forgotten."""

    def __init__(self, vocabulary: str, end_id: int = 0, max_words: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.merge = self.tokenizer.model.tokenize
        spec = json.loads(vocabulary)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_chunk = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and not any(a.split() != [a] for a in self.added)
        )
        self.end_id, self.max_words = end_id, max_words
        self._reset()

    def _reset(self) -> None:
        self.codes: dict[str, int] = {}
        self.units: dict[str, list[int]] = {}
        self.flat = array("I", [self.end_id])  # code 0 is the end of a document
        self.ends = array("q", [1])
        self.odd: set[int] = set()
        self.uses = np.zeros(1, np.int64)

    def _shed(self) -> None:
        """Keep the chunks used more than once, at most half of ``max_words``, and forget the others."""
        stay = busiest(self.uses[: len(self.ends)], self.max_words // 2)
        stay = stay[stay > 0]
        codes, flat, ends, odd, uses = self.codes, np.frombuffer(self.flat, np.uint32), np.frombuffer(self.ends, np.int64), self.odd, self.uses
        self._reset()
        new = np.zeros(len(ends), np.int64)
        new[stay] = np.arange(1, len(stay) + 1)
        lens = ends[stay] - ends[stay - 1]
        self.flat.frombytes(flat[concat_ranges(ends[stay] - lens, lens)].tobytes())
        self.ends.frombytes((1 + np.cumsum(lens)).tobytes())
        self.uses = np.concatenate([np.zeros(1, np.int64), uses[stay] // 2])
        self.odd = {int(new[k]) for k in odd if new[k]}
        to = new.tolist()
        self.codes = {c: to[k] for c, k in codes.items() if to[k]}

    def _unit(self, text: str) -> list[int]:
        """Ids of one unit of the pattern, by the library's model."""
        return [t.id for t in self.merge(charmap_decode(text.encode(), "strict", _BYTE_CHARS)[0])]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, chunk: str) -> int:
        """Letters only are one unit of the pattern; a closing mark or a line feed beside them is another."""
        code = len(self.ends)
        stem = chunk[1:] if chunk[0] in " \n" else chunk
        tail = stem[-1:] if stem[-1:] in _MARKS else ""
        stem = stem[:-1] if tail else stem
        flat = self.flat
        if stem.isalpha():
            if chunk[0] == "\n":
                flat.extend(self._unit("\n"))
                flat.extend(self._unit(stem))
            else:
                flat.extend(self._unit(" " + stem if chunk[0] == " " else stem))
            if tail:
                flat.extend(self._unit(tail))
        else:
            flat.extend(self._whole(chunk))
            if len(chunk.split()) != bool(chunk.strip()) or not chunk.isascii() and chunk.lstrip(" \t\n\v\f\r").split() != [chunk.lstrip(" \t\n\v\f\r")] or any(a in chunk for a in self.added):
                self.odd.add(code)
        self.ends.append(len(flat))
        self.codes[chunk] = code
        return code

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, each with the end id behind it, and their n+1 offsets."""
        n = len(column)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        data, offsets = text_bytes(column)
        if not self.by_chunk:
            return self._all_whole(data, offsets)
        if len(self.codes) > self.max_words:
            self._shed()
        _, word_ends, _ = word_spans(data, offsets)
        # a chunk ends with its word; white space behind the last word of a text is a chunk too
        at = np.searchsorted(word_ends, offsets[1:], side="right") - 1
        bare = (np.where(at >= 0, word_ends[at] if len(word_ends) else 0, 0) < offsets[1:]) & (offsets[1:] > offsets[:-1])
        cuts = np.insert(word_ends, at[bare] + 1, offsets[1:][bare])
        bounds = np.concatenate([np.zeros(1, np.int64), cuts])
        chunks = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        coded = chunks.dictionary_encode()
        known, learn = self.codes, self._learn
        collecting = gc.isenabled()
        gc.disable()
        try:
            new = coded.dictionary.to_numpy(zero_copy_only=False)
            found = map(known.get, new)
            table = np.fromiter((learn(c) if k is None else k for k, c in zip(found, new, strict=True)), np.int64, len(new))
        finally:
            if collecting:
                gc.enable()
        code = table[coded.indices.to_numpy()] if len(cuts) else np.zeros(0, np.int64)
        used = np.bincount(code, minlength=len(self.ends))
        used[: len(self.uses)] += self.uses
        self.uses = used
        upto = np.searchsorted(cuts, offsets[1:], side="right")  # chunks up to the end of each text
        odd = self._rows_with_odd(code, upto)
        code = np.insert(code, upto, 0)
        ends = np.frombuffer(self.ends, np.int64)
        last = ends[code]
        lens = last - np.where(code > 0, ends[code - 1], 0)
        ids = np.frombuffer(self.flat, np.uint32)[concat_ranges(last - lens, lens)]
        out = np.zeros(n + 1, np.int64)
        out[1:] = np.cumsum(lens)[upto + np.arange(n)]
        del ends
        if len(odd):
            rows = [ids[out[i] : out[i + 1]] for i in range(n)]
            for i in odd:
                rows[i] = np.array([*self._whole(bytes(data[offsets[i] : offsets[i + 1]]).decode()), self.end_id], np.uint32)
            ids = np.concatenate(rows)
            out[1:] = np.cumsum([len(r) for r in rows])
        return ids, out

    def _rows_with_odd(self, code: np.ndarray, upto: np.ndarray) -> np.ndarray:
        if not self.odd or not len(code):
            return np.zeros(0, np.int64)
        hits = np.flatnonzero(np.isin(code, np.fromiter(self.odd, np.int64, len(self.odd))))
        return np.unique(np.searchsorted(upto, hits, side="right"))

    def _all_whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.array([*self._whole(bytes(data[a:b]).decode()), self.end_id], np.uint32) for a, b in zip(offsets, offsets[1:], strict=False)]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def encoder(vocabulary: str, end_id: int) -> BpeEncoder:
    """This worker's encoder: its memory of chunks outlives a task."""
    return held(("bpe", zlib.crc32(vocabulary.encode()), end_id), lambda: BpeEncoder(vocabulary, end_id))
