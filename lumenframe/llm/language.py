"""Language identification of mixed-language text.

A word's script narrows its candidate languages to those that use the script; the candidates are scored by
character trigrams with word-boundary marks. Viterbi over a document's words, with a penalty for
every switch of language, labels spans; the document gets the language that holds most letters.

The model is learned from labelled rows: trigram counts per language in ``buckets`` hash buckets, and
letters per language and script. It is fitted on a sample of about ``sample_rows`` labelled documents, or ``least_rows`` of each
language if that is more: languages are counted over all rows, have equal shares, and one with fewer rows than its share is taken whole.
Rows are chosen by a hash of id and text, so the choice does not depend on partitioning, and each language's smallest hash
is in, so no language's sample is empty at any size. The model's size is bounded by ``most_languages`` (the most frequent
labels; labels beyond are not learned) times buckets. Letters are the characters of Unicode's category L; marks behind one belong to its word.

The stage drops documents without letters, and those wholly in scripts that no labelled row uses; these scripts
are looked up in all labelled rows, not in the sample. Where nothing is labelled all documents with letters stay.
It writes the language found into ``lang``, for unlabelled rows and over a label that was learned; a label that was not
learned stays, and so does what a row has if none of its words is in a script of a learned language.

Nulls and empties: a null text, or one without letters, is ``und`` with score 0 and no spans. A text whose
letters are all of scripts that no learned language uses gets the first language with score 0. Null ids
are allowed; repeated rows each get their label. An empty or unlabelled table teaches nothing: then
every document is ``und``. Texts are read whole. Other columns pass through, whatever their names;
``label_documents`` replaces columns that have the names it adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm._common import busiest, lean, packed, pieces, ship, small_batches, text_bytes, unpacked, word_spans

# First and last code point of the blocks of common scripts.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
NAMES = [*dict.fromkeys(n for n, _, _ in SCRIPTS), "other"]
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


@cache
def script_of(ch: str) -> int:
    c = ord(ch)
    return next((NAMES.index(n) for n, a, b in SCRIPTS if a <= c <= b), len(NAMES) - 1)


def trigrams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the boundary-marked trigrams of lower-case words, one after the other, and how many each word has."""
    code = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    h = code[:-2] * np.uint64(0x9E3779B1) + code[1:-1] * np.uint64(0x85EBCA77) + code[2:] * np.uint64(0xC2B2AE3D)
    h ^= h >> np.uint64(15)
    h *= np.uint64(0x2C1B3C6D)
    h ^= h >> np.uint64(13)
    keep = np.ones(len(code), bool)
    ends = np.cumsum(lens + 2)
    keep[ends - 1] = keep[ends - 2] = False
    return (h % np.uint64(buckets))[keep[:-2]].astype(np.int64), lens


def chunk_words(chunk: str) -> list[str]:
    word = chunk.strip().lower()
    return [word] if word.isalpha() else _LETTERS.findall(word)


def chunks_of(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the texts with the white space before them, each word's place among these, and word offsets by text."""
    data, offsets = text_bytes(column)
    starts, ends, at = word_spans(data, offsets)
    if not len(ends):
        return [], np.zeros(0, np.int64), at, starts, ends
    bounds = np.concatenate([np.zeros(1, np.int64), ends])
    coded = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), at, starts, ends


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # buckets x languages
    allowed: np.ndarray  # scripts x languages, bool

    @property
    def buckets(self) -> int:
        return len(self.logp)


def fair_share(counts: list[int], total: int, least: int) -> int:
    """Rows of each language so that all have about ``total``, the smaller ones being whole; not fewer than ``least``."""
    left, share = total, 0
    for i, n in enumerate(sorted(counts)):
        share = left // (len(counts) - i)
        if n > share:
            break
        left -= n
        share = n
    return max(share, least)


def fit(labelled: DataFrame, *, sample_rows: int = 20_000, least_rows: int = 1_000, buckets: int = 1 << 16, smoothing: float = 0.1, most_languages: int = 256) -> Model:
    """Learn from rows (doc_id, text, lang); rows with null text or lang teach nothing."""
    spark = labelled.sparkSession
    ship(spark)
    small_batches(spark)
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    ranked = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    n_of = {r["lang"]: r["n"] for r in ranked.collect()}
    most = fair_share(list(n_of.values()), sample_rows, least_rows) if sum(n_of.values()) > sample_rows else sample_rows
    h = F.xxhash64("doc_id", "text", F.lit("language sample"))
    place = F.shiftrightunsigned(h, 11) * F.lit(2.0**-53)  # even in [0, 1), in steps far below any share
    shares = F.broadcast(spark.createDataFrame([(lang, min(1.0, most / n)) for lang, n in n_of.items()], "lang string, share double"))
    known = rows.join(shares, "lang")
    firsts = F.broadcast(known.groupBy("lang").agg(F.min(h).alias("first")))
    rows = known.join(firsts, "lang").where((place < F.col("share")) | (h == F.col("first"))).select("doc_id", "text", "lang")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        letters: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                text = batch.column("text").filter(pa.array(langs == lang))
                for x, y in pieces(text):
                    distinct, code, *_ = chunks_of(text.slice(x, y - x))
                    times = np.bincount(code, minlength=len(distinct)) if len(distinct) else np.zeros(0)
                    words, weight = [], []
                    for c, t in zip(distinct, times.tolist(), strict=True):
                        for w in chunk_words(c):
                            words.append(w)
                            weight.append(t)
                    if not words:
                        continue
                    h, lens = trigrams(words, buckets)
                    w = np.array(weight, np.float64)
                    grams[lang] = grams.get(lang, 0) + np.bincount(h, np.repeat(w, lens), minlength=buckets)
                    script = np.array([script_of(x[0]) for x in words])
                    letters[lang] = letters.get(lang, 0) + np.bincount(script, w * lens, minlength=len(NAMES))
        for kind, found in (("gram", grams), ("script", letters)):
            for lang, v in found.items():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_pydict({"kind": [kind] * len(at), "lang": [lang] * len(at), "key": at.astype(np.int32), "n": v[at].astype(np.int64)})

    # at most languages x (buckets + scripts) rows reach the driver
    counts = rows.mapInArrow(lean(tally), "kind string, lang string, key int, n long").groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    index = {x: i for i, x in enumerate(langs)}
    grams, letters = np.zeros((buckets, len(langs))), np.zeros((len(NAMES), len(langs)))
    kind = np.array(counts.column("kind").to_pylist(), object)
    of = np.array([index[x] for x in counts.column("lang").to_pylist()], np.int64)
    key, num = counts.column("key").to_numpy(), counts.column("n").to_numpy()
    for name, into in (("gram", grams), ("script", letters)):
        m = kind == name
        into[key[m], of[m]] = num[m]
    logp = np.log((grams + smoothing) / (grams.sum(0) + smoothing * buckets))
    allowed = letters > 0.01 * np.maximum(letters.sum(0), 1)
    return Model(langs, logp.astype(np.float32), allowed)


class Scorer:
    """Scores and letters of words. It remembers ``max_words`` and those of one batch; when it is full, words met once are forgotten."""

    def __init__(self, model: Model, max_words: int = 400_000, cap: float = 12.0):
        self.model, self.max_words, self.cap = model, max_words, cap
        self.codes: dict[str, int] = {}
        self._tables(0)

    def _tables(self, n: int) -> None:
        self.scores = np.zeros((n, len(self.model.languages)), np.float32)
        self.letters = np.zeros(n, np.int32)
        self.known = np.zeros(n, np.int32)  # letters of words whose script some language uses
        self.uses = np.zeros(n, np.int64)

    def _shed(self) -> None:
        stay = busiest(self.uses, self.max_words // 2)
        new = np.full(len(self.uses), -1)
        new[stay] = np.arange(len(stay))
        to = new.tolist()
        self.codes = {w: to[k] for w, k in self.codes.items() if to[k] >= 0}
        self.scores, self.letters, self.known, self.uses = self.scores[stay], self.letters[stay], self.known[stay], self.uses[stay] // 2

    def lookup(self, distinct: list[str], times: np.ndarray) -> np.ndarray:
        """Codes of distinct words that occur so many times; they hold until the next call."""
        if len(self.codes) > self.max_words:
            self._shed()
        found = list(map(self.codes.get, distinct))
        fresh = [i for i, k in enumerate(found) if k is None]
        if fresh:
            first, old = len(self.codes), (self.scores, self.letters, self.known, self.uses)
            if first + len(fresh) > len(self.scores):
                self._tables(max(first + len(fresh), min(2 * len(self.scores), self.max_words)))
                for into, x in zip((self.scores, self.letters, self.known, self.uses), old, strict=True):
                    into[: len(x)] = x
            words, owner = [], []
            for j, i in enumerate(fresh):
                self.codes[distinct[i]] = found[i] = first + j
                for w in chunk_words(distinct[i]):
                    words.append(w)
                    owner.append(first + j)
            for at in range(0, len(words), 1 << 16):
                self._score(words[at : at + (1 << 16)], np.array(owner[at : at + (1 << 16)]))
        code = np.array(found, np.int64)
        self.uses[code] += times
        return code

    def _score(self, words: list[str], owner: np.ndarray) -> None:
        h, lens = trigrams(words, self.model.buckets)
        sums = np.add.reduceat(self.model.logp[h].astype(np.float64), np.cumsum(lens) - lens, axis=0)
        ok = self.model.allowed[[script_of(w[0]) for w in words]]
        known = ok.any(1)
        top = np.where(ok, sums, -np.inf).max(1, initial=-np.inf, where=ok)
        s = np.where(ok, np.maximum(sums - np.where(known, top, 0)[:, None], -self.cap), -self.cap)
        s[~known] = 0
        np.add.at(self.scores, owner, s.astype(np.float32))
        np.add.at(self.letters, owner, lens.astype(np.int32))
        np.add.at(self.known, owner, np.where(known, lens, 0).astype(np.int32))


def viterbi(scores: np.ndarray, code: np.ndarray, at: np.ndarray, penalty: float) -> np.ndarray:
    """Best state of every word: all documents step together, the longest first, so a step's rows are a prefix."""
    states = scores.shape[1]
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    lens, base = n[order], at[:-1][order]
    kind = np.min_scalar_type(max(states - 1, 0))
    label = np.zeros(len(code), kind)
    if not len(code):
        return label
    longest = int(lens[0])
    active = np.searchsorted(-lens, -np.arange(longest), side="left")  # documents with more than t words
    best_before = np.zeros(len(code), kind)
    switched = np.zeros((len(code), -(-states // 8)), np.uint8)  # a bit for each state
    v = scores[code[base[: active[0]]]].astype(np.float64)
    for t in range(1, longest):
        k = active[t]
        word = base[:k] + t
        v = v[:k]
        top = v.argmax(1)
        jump = v[np.arange(k), top] - penalty
        better = v < jump[:, None]
        best_before[word] = top
        switched[word] = np.packbits(better, axis=1, bitorder="little")
        v = np.where(better, jump[:, None], v) + scores[code[word]]
        done = slice(active[t + 1] if t + 1 < longest else 0, k)  # documents that end here
        label[word[done]] = v[done].argmax(1)
    single = slice(active[1] if longest > 1 else 0, active[0])
    label[base[single]] = scores[code[base[single]]].argmax(1)
    for t in range(longest - 1, 0, -1):
        word = base[: active[t]] + t
        now = label[word]
        label[word - 1] = np.where((switched[word, now >> 3] >> (now & 7).astype(np.uint8)) & 1, best_before[word], now)
    return label


def label_texts(column: pa.Array, scorer: Scorer | None, penalty: float, spans: bool) -> tuple:
    """Language and score of each text and, if asked for, its spans: offsets by text, first and end bytes, languages."""
    n = len(column)
    pred, score = np.full(n, "und", object), np.zeros(n)
    none = (np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object))
    if scorer is None:
        return pred, score, none
    langs = np.array(scorer.model.languages, object)
    distinct, index, at, starts, ends = chunks_of(column)
    if not distinct:
        return pred, score, none
    code = scorer.lookup(distinct, np.bincount(index, minlength=len(distinct)))[index]
    state = viterbi(scorer.scores, code, at, penalty)
    doc = np.repeat(np.arange(n), np.diff(at))
    share = np.bincount(doc * len(langs) + state, scorer.known[code], minlength=n * len(langs)).reshape(n, -1)
    total = np.bincount(doc, scorer.letters[code], minlength=n)
    best, lettered = share.argmax(1), total > 0
    pred[lettered] = langs[best[lettered]]
    score[lettered] = np.minimum(share[lettered, best[lettered]] / total[lettered], 1.0)
    if not spans:
        return pred, score, none
    new = np.ones(len(state), bool)
    new[1:] = (state[1:] != state[:-1]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(new)
    last = np.concatenate([cut[1:], [len(state)]]) - 1
    keep = lettered[doc[cut]]
    cut, last = cut[keep], last[keep]
    _, offsets = text_bytes(column)
    of = doc[cut]
    return pred, score, (np.searchsorted(of, np.arange(n + 1)), starts[cut] - offsets[of], ends[last] - offsets[of], langs[state[cut]])


def label_documents(docs: DataFrame, model: Model, *, penalty: float = 8.0, spans: bool = False) -> DataFrame:
    """``docs`` with _lf_lang, _lf_score and, if asked for, _lf_spans (first byte, end byte, language of each span of words)."""
    docs = docs.drop("_lf_lang", "_lf_score", "_lf_spans")
    ship(docs.sparkSession)
    small_batches(docs.sparkSession, rows=4000)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model.languages else None
        for batch in batches:
            for x, y in pieces(batch.column("text"), 4 << 20):
                some = batch.slice(x, y - x)
                found = label_texts(some.column("text"), scorer, penalty, spans)
                out = [*some.columns, pa.array(found[0], pa.string()), pa.array(found[1])]
                names = [*batch.schema.names, "_lf_lang", "_lf_score"]
                if spans:
                    at, start, end, lang = found[2]
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(lang, pa.string())], fields=list(span))))
                    names.append("_lf_spans")
                yield pa.RecordBatch.from_arrays(out, names)

    fields = [*docs.schema.fields, T.StructField("_lf_lang", T.StringType()), T.StructField("_lf_score", T.DoubleType())]
    if spans:
        fields.append(T.StructField("_lf_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))))
    return docs.mapInArrow(lean(label), T.StructType(fields))


def labelled_scripts(docs: DataFrame) -> list[str]:
    """Names of the scripts of all letters in the labelled rows."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            data, _ = text_bytes(batch.column("text"))
            seen.update(data[data >= 0x80].tobytes().decode("utf-8", "ignore"))  # what is not ASCII has no byte below 0x80
        scripts = {NAMES[script_of(c)] for c in seen if _LETTERS.match(c)}  # no more than there are characters
        yield pa.RecordBatch.from_pydict({"script": pa.array(sorted(scripts), pa.string())})

    wide = rows.where(F.length("text") != F.octet_length("text")).mapInArrow(lean(found), "script string").distinct()
    names = {r["script"] for r in wide.collect()}
    if "latin" not in names and not rows.where(F.col("text").rlike("[A-Za-z]")).isEmpty():
        names.add("latin")
    return [x for x in NAMES if x in names]


def in_scripts(text: str, scripts: list[str] | None) -> Column:
    """Whether a text has a letter of one of the scripts, or any letter if there are none."""
    letters = r"\p{L}"
    ranges = lambda some: "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for x, a, b in SCRIPTS if x in some)
    if not scripts:
        return F.coalesce(F.col(text).rlike(f"[{letters}]"), F.lit(False))
    parts = [f"[{letters}&&[{ranges(scripts)}]]"] if ranges(scripts) else []
    parts += [f"[{letters}&&[^{ranges(NAMES)}]]"] if NAMES[-1] in scripts else []
    return F.coalesce(F.col(text).rlike("|".join(parts)), F.lit(False))


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans (first byte, end byte and language of each)."""
    model = fit(docs.where(~is_held_out()).select("doc_id", "text", "lang"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = label_documents(rows, model, spans=True)
    return found.select("doc_id", is_held_out().alias("held_out"), F.col("_lf_lang").alias("lang_pred"), F.col("_lf_score").alias("score"), F.col("_lf_spans").alias("spans"))


def language_stage(docs: DataFrame) -> DataFrame:
    """Documents with a language, which ``lang`` then holds: those without letters, or wholly in scripts that no labelled row uses, go."""
    model = fit(docs.where(~is_held_out()).select("doc_id", "text", "lang"))
    known = (F.col("_lf_lang") != "und") & (F.col("_lf_score") > 0)
    rows = label_documents(packed(docs, "doc_id", "text", "lang"), model).where(known | in_scripts("text", labelled_scripts(docs)))
    open_to = F.col("lang").isNull() | F.col("lang").isin(model.languages)  # labels that the model knows, or none
    rows = rows.withColumn("lang", F.when(known & open_to, F.col("_lf_lang")).otherwise(F.col("lang")))
    return unpacked(rows, docs.columns, "doc_id", "text", "lang")
