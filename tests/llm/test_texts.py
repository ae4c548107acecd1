"""Token files, packing, substring dedup, language ID, pieces and audio against brute force, with nulls, empties and repeats."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import audio, language, packing, pieces, substring_dedup, token_files
from lumenframe.llm._common import scratch
from lumenframe.llm.bpe import BpeEncoder
from lumenframe.llm.queries import vocabulary

P = pytest.importorskip("public_tokenizers")
ODD = [
    None, "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a\r\nb", "x<|endoftext|>y", "é ñ 漢字 1234 it's don't\tq", "a\xa0  b", " \n b", "\x1c a", "the the",
    "ª. ʰ² x٣. l'été, ①. éx. a​b. 𝔘nicode, ﬁ.", "word " * 3000,
]


def texts(seed=0, n=40):
    rnd = random.Random(seed)
    words = ["the", "of", "tion", "ing.", "hello,", "Éa", "42", "ww", "x-y", "漢"]
    return [rnd.choice(["", "\n"]).join(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*ODD, *texts()])] + [(None, "no id", "x"), (3, "again", "x"), (3, "again", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_equals_library(tokenizer):
    enc = BpeEncoder(vocabulary(), max_words=30)  # small, so that it starts afresh
    some = [*ODD, *texts(1)]
    for _ in range(2):
        ids, at = enc.encode(pa.array(some))
        for i, t in enumerate(some):
            assert ids[at[i] : at[i + 1]].tolist() == ids_of(tokenizer, t).tolist(), t


def test_control_bytes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 4099):
        v = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_files.pack_values(v)
        assert len(control) == -(-n // 4)
        assert (token_files.unpack_values(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == v).all()
    blob = token_files.encode_file([1, None], np.array([2, 1]), [np.array([7], np.uint32), np.array([7, 0], np.uint32)])
    keys, counts, ids = token_files.decode_file(blob)
    assert keys == [1, None] and counts.tolist() == [2, 1] and ids.tolist() == [7, 7, 0]
    with pytest.raises(ValueError):
        token_files.decode_file(blob[:-1])


def test_token_files(spark, docs, tokenizer):
    manifest = token_files.write_token_files(docs, vocabulary(), scratch(spark, "t"), shard_bytes=4000, file_tokens=300)
    assert manifest.count() >= 3
    rows = token_files.read_token_files(spark, manifest, with_ids=True).collect()
    start = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    want = sorted(((d.doc_id is not None, d.doc_id or 0), ids_of(tokenizer, d.text).tolist()) for d in docs.collect())
    assert sorted(((r.doc_id is not None, r.doc_id or 0), list(r.ids)) for r in rows) == want
    assert token_files.token_files_query(docs.limit(0), vocabulary()).count() == 0


def test_packing(spark, docs, tokenizer):
    got = packing.packed_query(docs, vocabulary(), size=64).collect()
    whole = {}
    for d in docs.collect():
        whole.setdefault(d.doc_id, []).append(ids_of(tokenizer, d.text))
    sequences, cover = {}, {}
    for r in got:
        assert any(zlib.crc32(w[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for w in whole[r.doc_id])
        assert r.piece == 0 or r.length == 64
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        cover[r.doc_id] = cover.get(r.doc_id, 0) + r.length
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert cover == {d: sum(map(len, w)) for d, w in whole.items()}
    total = sum(cover.values())
    assert len(sequences) <= -(-total // 64) + 2
    assert packing.packed_query(docs.limit(0), vocabulary()).count() == 0


def first_fit(lens, size):
    """Bins that first-fit decreasing takes."""
    room = []
    for x in sorted(lens, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= x), None)
        if at is None:
            room.append(size - x)
        else:
            room[at] -= x
    return len(room)


@pytest.mark.parametrize("size", [6, 10, 17])
def test_plan_is_near_optimal_and_complete(size):
    rnd = random.Random(size)
    for _ in range(60):
        lens = [rnd.randint(1, size) for _ in range(rnd.randint(0, 40))]
        histogram = {x: lens.count(x) for x in set(lens)}
        plan = packing.plan(histogram, size)
        used = {}
        for pattern, times in plan:
            assert times > 0 and sum(pattern) <= size
            for x in pattern:
                used[x] = used.get(x, 0) + times
        assert used == histogram
        assert sum(t for _, t in plan) <= first_fit(lens, size)


def test_substring_dedup(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "a b c", "z " * 5000])]
    for i in range(30):
        w = [rnd.choice(words) for _ in range(rnd.randint(0, 120))]
        if i % 3 == 0:
            at = rnd.randint(0, len(w))
            w[at:at] = passage[rnd.randint(0, 10) : rnd.randint(45, 60)]
        rows.append((100 + i, rnd.choice(["\n", " ", "  "]).join(w)))
    rows += [(100, rows[5][1]), (None, rows[8][1])]
    window, counts, split = 35, {}, []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        split.append(w)
        for i in range(len(w) - window + 1):
            counts[tuple(w[i : i + window])] = counts.get(tuple(w[i : i + window]), 0) + 1
    want = []
    for (d, t), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want.append((str(d), len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), t if not any(gone) else None))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, block string")
    out = substring_dedup.remove_repeats(df.repartition(3), block_bytes=500, bucket_windows=100).collect()
    assert sorted((str(r.doc_id), r._lf_n_words, r._lf_n_removed, r._lf_kept_sha256) for r in out) == sorted(w[:4] for w in want)
    assert sum(w[2] for w in want) > 500
    for r in out:
        assert hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")).encode()).hexdigest() == r._lf_kept_sha256
        if not r._lf_n_removed:
            assert r.text in [t for _, t in rows]
    assert substring_dedup.substring_stage(df.limit(0)).columns == ["doc_id", "text", "block"]
    assert substring_dedup.substring_query(df.limit(0)).count() == 0


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(40):
        states, n = int(rng.integers(1, 4)), rng.integers(0, 6, 5)
        at = np.concatenate([[0], np.cumsum(n)])
        scores, code = rng.normal(size=(20, states)) * 2, rng.integers(0, 20, at[-1])
        got = language.viterbi(scores, code, at, 1.5)
        for a, b in itertools.pairwise(at.tolist()):
            value = lambda p: sum(scores[code[a + i], x] for i, x in enumerate(p)) - 1.5 * sum(x != y for x, y in itertools.pairwise(p))  # noqa: E731, B023
            assert value(got[a:b]) == pytest.approx(max(map(value, itertools.product(range(states), repeat=b - a))))


@pytest.mark.parametrize("states", [33, 40, 64, 65, 300])
def test_viterbi_with_many_states(states):
    rng = np.random.default_rng(states)
    scores, at, penalty = rng.normal(size=(60, states)) * 4, np.array([0, 20, 21, 21, 60]), 3.0
    code = rng.integers(0, 60, 60)
    label = language.viterbi(scores, code, at, penalty).astype(int)
    for a, b in zip(at, at[1:]):
        if a == b:
            continue
        v = scores[code[a]]
        for c in code[a + 1 : b]:
            v = np.maximum(v, v.max() - penalty) + scores[c]
        path = label[a:b]
        assert scores[code[a:b], path].sum() - penalty * (np.diff(path) != 0).sum() == pytest.approx(v.max())


def test_language(spark):
    rnd = random.Random(3)
    make = {"en": ["the", "and", "ing", "with", "thor"], "fr": ["être", "le", "eau", "que", "aux"], "ru": ["это", "как", "для", "него", "мир"]}
    say = lambda lang, n: " ".join("".join(rnd.choice(make[lang]) for _ in range(rnd.randint(1, 2))) for _ in range(n))
    rows = [(i, say(lang, 30), lang) for i, lang in enumerate(make) for _ in range(1)]
    rows += [(10 + i, say(lang, rnd.randint(5, 60)), lang) for i, lang in enumerate(list(make) * 30)]
    mixed = say("en", 20) + " " + say("ru", 9) + "\n" + say("fr", 20)
    odd = [(500, None), (501, ""), (502, "12 34 !"), (503, "漢字漢字"), (504, mixed), (None, say("fr", 9)), (10, say("en", 30)), (505, say("en", 30000))]
    df = spark.createDataFrame([*rows, *((d, t, None) for d, t in odd)], "doc_id long, text string, lang string")
    got = language.language_query(df).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and 10 < r.doc_id < 500]
    label = {d: lang for d, _, lang in rows}
    assert held and all(r.lang_pred == label[r.doc_id] for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    by = {r.doc_id: r for r in got}
    assert [(by[d].lang_pred, by[d].score) for d in (500, 501, 502)] == [("und", 0.0)] * 3
    assert by[503].lang_pred in make and by[503].score == 0 and by[505].lang_pred == "en" and by[None].lang_pred == "fr"
    model = language.fit(df.where("lang IS NOT NULL"))
    spans = language.label_documents(df.where("doc_id = 504"), model, spans=True).first()._lf_spans
    assert [s.lang for s in spans] == ["en", "ru", "fr"] and spans[0].start == 0 and spans[-1].end == len(mixed.encode())
    kept = {r.doc_id for r in language.language_stage(df).collect()}
    assert kept == set(by) - {500, 501, 502, 503}
    assert {r.lang_pred for r in language.language_query(df.where("lang IS NULL")).collect()} == {"und"}
    assert language.language_query(df.limit(0)).count() == 0


def test_rare_languages_are_learned_and_kept(spark):
    rows = [(i, f"the thing and word {i}", "en") for i in range(24_000)]
    rare = next(i for i in range(30_000, 40_000) if zlib.crc32(str(i).encode()) % 4 != 2 and i % 7 == 0)
    held = next(i for i in range(40_000, 50_000) if zlib.crc32(str(i).encode()) % 4 == 2)
    rows += [(rare, "это как для него мир", "ru"), (held, "ქართული ენა", "ka"), (60_000, "漢字漢字", None), (60_001, "እንግሊዝኛ", None), (60_002, "12 34", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    teaching = df.where(~language.is_held_out())
    assert language.fit(teaching, sample_rows=500, least_rows=100).languages == ["en", "ru"]
    assert language.fit(teaching.withColumn("doc_id", F.lit(None).cast("long")), sample_rows=3, least_rows=1).languages == ["en", "ru"]
    got = {r.doc_id: r.lang_pred for r in language.language_query(df).collect()}
    assert got[rare] == "ru" and got[1] == "en"
    kept = {r.doc_id for r in language.language_stage(df).collect()}
    assert kept == {d for d, _, _ in rows} - {60_000, 60_001, 60_002}
    assert language.labelled_scripts(df) == ["latin", "cyrillic", "georgian"]
    unlabelled = df.where("doc_id < 5 OR doc_id >= 30000").withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in language.language_stage(unlabelled).collect()} == {0, 1, 2, 3, 4, rare, held, 60_000, 60_001}


def test_language_found_goes_on_to_the_packed_pieces(spark, tmp_path):
    """The stage writes what it found into ``lang``, and the pipeline's pieces have it."""
    import corpus_pipeline

    rnd = random.Random(8)
    make = {"en": ["the", "and", "ing", "with", "thor"], "fr": ["être", "le", "eau", "que", "aux"], "ru": ["это", "как", "для", "него", "мир"]}
    say = lambda lang, n: " ".join("".join(rnd.choice(make[lang]) for _ in range(rnd.randint(1, 2))) for _ in range(n))
    rows = [(i, say(lang, 40), lang) for i, lang in enumerate(list(make) * 20)]
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 4 == 2)  # so its label is not learned
    odd = [(100, say("fr", 40), None, "fr"), (101, say("ru", 40), "en", "ru"), (held, "ქართული ენა", "ka", "ka"), (103, say("ru", 3000), None, "ru")]
    odd += [(104, say("en", 9) + " " + say("fr", 40), "en", "fr")]
    df = spark.createDataFrame([(*r[:3], "s", len(r[1])) for r in rows + odd], "doc_id long, text string, lang string, source string, n_chars long")
    want = {d: lang for d, _, lang in rows} | {r[0]: r[3] for r in odd}
    staged = language.language_stage(df)
    assert staged.columns == df.columns and {r.doc_id: r.lang for r in staged.collect()} == want
    assert {r.doc_id: r.lang_pred for r in language.language_query(df).collect() if r.doc_id != held} == {d: x for d, x in want.items() if d != held}
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.lang) for r in got} == set(want.items()) and sum(r.doc_id == 103 for r in got) > 1
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang for r in language.language_stage(unlabelled).collect()} == {None}


def test_fair_share():
    assert language.fair_share([10, 10, 10], 30, 1) == 10 and language.fair_share([1, 100, 1000], 301, 1) == 200
    assert language.fair_share([5, 1000, 1000], 100, 60) == 60


def brute_segmentations(v, text):
    out = []

    def go(i, score, ids):
        if i == len(text):
            out.append((score, tuple(ids)))
            return
        single = False
        for j in range(i + 1, min(len(text), i + v.longest) + 1):
            k = v.ids.get(text[i:j])
            if k is not None:
                single |= j == i + 1
                go(j, score + v.scores[k], [*ids, k])
        if not single:
            go(i + 1, score + v.unknown, [*ids, *(v.byte_ids[b] for b in text[i].encode())])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_pieces(spark, docs):
    v = pieces.Vocabulary.load(P.path("piece_bpe_32k.model"))
    seg, rnd = pieces.Segmenter(v, 4, max_chunks=20), random.Random(1)
    some = ["the cat", "a b  c", "é漢 x", "on\nit", " lead", "tail ", "aaaa", "\n\n", "a;\r\nb", "\r\rx"]
    some += ["".join(rnd.choice("ab the;\r\n.") for _ in range(rnd.randint(1, 11))) for _ in range(40)]
    for t in some:
        every = brute_segmentations(v, pieces.MARK + t.replace(" ", pieces.MARK))
        got = next(iter(seg.segment(pa.array([t]))))
        assert [s for s, _ in got] == pytest.approx([s for s, _ in every[:4]])
        assert {(s, tuple(i.tolist())) for s, i in got} <= set(every) and len({tuple(i.tolist()) for _, i in got}) == len(got)
        assert seg.decode(got[0][1]).decode() == t
    rows = docs.collect()
    out = pieces.encode_pieces(docs, v).collect()
    assert sorted(r.decoded_sha256 for r in out) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows)
    assert all(len(r.nbest) >= 1 and r.nbest[0].score == r.score and [x.score for x in r.nbest] == sorted((x.score for x in r.nbest), reverse=True) for r in out)


def test_long_text_without_spaces():
    v = pieces.Vocabulary.load(P.path("piece_bpe_32k.model"))
    t = "ab,c" * 5000
    got = next(iter(pieces.Segmenter(v, 3).segment(pa.array([t]))))
    assert len(got) == 3 and pieces.Segmenter(v, 1).decode(got[0][1]).decode() == t


def test_long_chunks_are_cut_exactly():
    v, rnd = pieces.Vocabulary.load(P.path("piece_bpe_32k.model")), random.Random(2)
    for _ in range(6):
        t = "".join(rnd.choice("abé漢字,;xq") for _ in range(260))
        got = next(iter(pieces.Segmenter(v, 3).segment(pa.array([t]))))
        whole = pieces.n_best(pieces.MARK + t, v, 3)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in whole]) and got[0][1].tolist() == whole[0][1]
        assert max(len(c) for c in pieces.Segmenter(v, 3).chunks(pa.array([t]))[0][2:]) < 200


def test_resampling_equals_direct_filtering():
    x = np.random.default_rng(0).normal(size=777)
    for up, down in ((1, 2), (2, 3), (3, 2), (1, 1), (160, 441)):
        s = audio.Settings(up=up, down=down)
        z = np.zeros(len(x) * up)
        z[::up] = x
        half = (len(s.filter) - 1) // 2
        want = np.convolve(z, s.filter)[half:][::down][: -(-len(x) * up // down)]
        assert np.allclose(audio.resample(x, s)[: len(want)], want)


def test_hysteresis():
    e = np.array([0, 0, 9, 9, 4.6, 4.6, 9, 0, 0, 4.6, 4.6, 4.6, 0.0])
    s = audio.Settings(rise=0.5, fall=0.0, least_frames=2)
    assert audio.hysteresis(e, s) == [(2, 7)]  # the later rise stays below the upper threshold


@pytest.mark.parametrize("n", [192, 512, 576, 768, 960, 1152])
def test_last_samples_are_in_a_frame(n):
    s = audio.Settings()
    spans, tensors = audio.segment_tensors(bytes([128] * n), s)
    assert spans[0, 1] >= n * 1000 // s.rate and spans[0, 1] <= max(n * 1000 / s.rate + 16, 32)
    loud = bytes([128] * (n - 96)) + bytes([0, 255, 255, 0] * 24)
    mels, energy = audio.log_mels(np.concatenate([np.zeros(n // 2 - 1), [1.0]]), s)
    assert len(mels) == len(energy) == 1 + max(0, -(-(n // 2 - s.frame) // s.hop))
    assert energy[-1] > -60 and not np.array_equal(audio.segment_tensors(loud, s)[1][0], tensors[0])


def test_audio(spark, docs):
    got = audio.audio_query(docs).collect()
    rows = docs.collect()
    want = []
    for r in rows:
        b = (r.text or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192), b" ")
        w = audio.wav_bytes(p, 16000)
        assert audio.wav_samples(w) == (p, 16000)
        want.append((str(r.doc_id), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(w), hashlib.sha256(w).hexdigest()))
    assert sorted((str(r.doc_id), *r[1:7]) for r in got) == sorted(want)
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add(r.feature)
    assert all(len(f) == 1 for f in by_text.values())
    media = audio.store_wav(docs)
    manifest = audio.write_tensors(media, scratch(spark, "tensors"))
    n = 0
    for f in manifest.collect():
        t = pa.ipc.open_file(pa.memory_map(f.file.removeprefix("file://"))).read_all()
        assert t.column("tensor").type.shape == [8, 24] and min(t.column("end_ms").to_pylist()) > 0
        n += len(t)
    direct = sorted((str(r.doc_id), r.spans, r.tensors) for r in audio.features(media).collect())
    assert sorted((str(r.doc_id), r.spans, r.tensors) for r in audio.read_tensors(manifest).collect()) == direct
    assert n == sum(len(x[1]) for x in direct)
    assert audio.audio_query(docs.limit(0)).count() == 0


def test_features_equal_brute_force():
    s = audio.Settings()
    assert s.up > 1 and np.gcd(s.up, s.down) == 1  # several phases
    rnd = np.random.default_rng(3)
    raw = np.concatenate([rnd.integers(120, 136, 3000), rnd.integers(0, 256, 2500), rnd.integers(126, 130, 2660)]).astype(np.uint8)
    x = (raw - 128.0) / 128.0
    x = audio.resample(x - x.mean(), s)  # held against direct filtering elsewhere
    rate = s.rate * s.up / s.down
    frames = []
    at = 0
    while at == 0 or at + s.frame - s.hop < len(x):
        frames.append(np.concatenate([x[at : at + s.frame], np.zeros(max(0, at + s.frame - len(x)))]))
        at += s.hop
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(s.frame) / s.frame)
    hz = lambda m: 700.0 * (10.0 ** (m / 2595.0) - 1.0)
    top = 2595.0 * np.log10(1.0 + rate / 2 / 700.0)
    mels, energy = [], []
    for f in frames:
        f = f * hann
        power = [abs(sum(f * np.exp(-2j * np.pi * b * np.arange(s.frame) / s.frame))) ** 2 for b in range(s.frame // 2 + 1)]
        row = []
        for k in range(s.mels):
            lo, mid, hi = (hz(top * (k + j) / (s.mels + 1)) for j in range(3))
            total = sum(p * max(0.0, min((b * rate / s.frame - lo) / (mid - lo), (hi - b * rate / s.frame) / (hi - mid))) for b, p in enumerate(power))
            row.append(10 * np.log10(total + 1e-6))
        mels.append(row)
        energy.append(10 * np.log10((f * f).sum() + 1e-6))
    e = np.round(energy, 2)
    high, low = round(e.mean(), 2) + s.rise * round(e.std(), 2), round(e.mean(), 2) + s.fall * round(e.std(), 2)
    spans, begin = [(0, len(e))], None
    for i, v in enumerate([*e, -np.inf]):
        if begin is None and v >= high:
            begin = i
        elif begin is not None and v < low:
            if i - begin >= s.least_frames and e[begin] > -50:
                spans.append((begin, i))
            begin = None
    want = []
    for a, b in spans:
        cuts = [a + k * (b - a) // s.time_bins for k in range(s.time_bins)] + [b]
        want.append([[np.mean([mels[i][m] for i in range(c, max(c + 1, d))]) * 16 for m in range(s.mels)] for c, d in zip(cuts, cuts[1:])])
    times, tensors = audio.segment_tensors(raw.tobytes(), s)
    assert len(spans) > 1 and times.tolist() == [[round(a * s.hop * 1000 / rate), round(((b - 1) * s.hop + s.frame) * 1000 / rate)] for a, b in spans]
    assert np.abs(tensors - np.array(want)).max() <= 1.0  # a sixteenth of a dB, in single precision
