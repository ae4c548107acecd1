"""Skew, structure that breaks hashes, clashing names, nulls, repeated rows and empty tables, against brute force."""

import hashlib
import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex as re
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import audio, bpe, language, line_dedup, minhash, packing, pieces, substring_dedup, token_files, vectors, warc
from lumenframe.llm._common import rolling_hashes, scratch, word_hashes, word_spans
from lumenframe.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def union(pairs, n):
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


# --- near-dedup -------------------------------------------------------------------------------


def copies(rnd, n, edits, words=385):
    """Texts that differ from one base, which is not among them, in so many words of their own."""
    base = [f"w{rnd.randrange(4000)}" for _ in range(words)]
    out = []
    for k in range(n):
        c = list(base)
        for i in rnd.sample(range(words), edits):
            c[i] = f"x{k}-{i}"
        out.append(" ".join(c))
    return out


def exact_classes(texts, threshold=0.8):
    h, w, at = minhash.shingle_weights(pa.array(texts))
    assert (w == 1).all()
    _, code = np.unique(h, return_inverse=True)
    x = np.zeros((len(texts), code.max() + 1), np.float32)
    for i, (a, b) in enumerate(zip(at, at[1:])):
        x[i, code[a:b]] = 1
    both = x @ x.T
    size = x.sum(1)
    j = both / (size[:, None] + size[None, :] - both)
    near = j >= threshold
    np.fill_diagonal(near, False)
    return union(np.argwhere(near).tolist(), len(texts)), j


@pytest.mark.parametrize("edits", [5, 4])
def test_copies_just_below_the_threshold_are_decided_without_pairs(spark, edits):
    rnd = random.Random(11)
    texts = copies(rnd, 500, edits) + copies(rnd, 60, 3)
    of, j = exact_classes(texts)
    below = j[:500, :500][np.triu_indices(500, 1)]
    assert (below > 0.74).mean() > 0.9 and (edits == 4 or (below < 0.8).mean() > 0.9)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in minhash.minhash_query(df).collect()}
    assert [got[i] for i in range(len(texts))] == of
    work = df.select("doc_id", "text", minhash._node().alias("node"))
    bands = minhash.band_table(work)
    members = bands.select(F.posexplode("bands").alias("band", "key"), "node").withColumn("label", F.col("node"))
    shingles = minhash.shingle_table(work, 5).join(bands, "node")
    links = minhash.residual_links(members, shingles, 0.8)
    assert links.count() <= 24 * 4 * len(texts)  # no more than the nodes of each group, though there are 125,000 pairs


def test_bound_is_exact_for_sets_and_above_for_multisets():
    rnd = random.Random(5)
    sets = []
    for _ in range(30):
        h = np.sort(np.array(rnd.sample(range(60), rnd.randint(1, 40)), np.uint64))
        sets.append((h, np.array([rnd.choice([1, 1, 1, 2, 7]) for _ in h], np.int64)))
    flat = [(h, np.ones(len(h), np.int64)) for h, _ in sets]
    every = np.arange(30)
    for some, exact in ((sets, False), (flat, True)):
        bound = minhash.bounds(some, every, every, columns=16)
        for i in range(30):
            for k in range(30):
                if i != k:
                    jp = minhash.probability_jaccard(*some[i], *some[k])
                    assert bound[i, k] >= jp - 1e-5 and (not exact or abs(bound[i, k] - jp) < 1e-5)


# --- windows ----------------------------------------------------------------------------------


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_modulo_powers_of_two_stay_apart(spark):
    x = thue_morse(1024)
    y = x.translate(str.maketrans("ab", "ba"))
    assert len(set(word_hashes(*((d := np.frombuffer(f"{x} {y}".encode(), np.uint8)), *word_spans(d, np.array([0, len(d)]))[:2])).tolist())) == 2
    shared = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{shared} {x}"), (2, f"{shared} {y}")], "doc_id long, text string")
    assert {(r.n_words, r.n_removed) for r in substring_dedup.substring_query(df).collect()} == {(35, 0)}


def test_rolling_hashes():
    v = np.random.default_rng(0).integers(0, 2**63, 90).astype(np.uint64) * np.uint64(2)
    p, base = (1 << 61) - 1, 12345678901234567
    for window in (1, 2, 3, 5, 35, 64, 90, 91):
        want = [sum(int(x) % p * pow(base, window - 1 - k, p) for k, x in enumerate(v[i : i + window])) % p for i in range(len(v) - window + 1)]
        assert rolling_hashes(v, window, base).tolist() == want


def brute_cut(rows, window):
    words = [(t or "").replace("\t", " ").replace("\n", " ").split(" ") for _, t in rows]
    words = [[w for w in x if w] for x in words]
    count = {}
    for x in words:
        for i in range(len(x) - window + 1):
            count[tuple(x[i : i + window])] = count.get(tuple(x[i : i + window]), 0) + 1
    out = []
    for (d, _), x in zip(rows, words):
        gone = {i + k for i in range(len(x) - window + 1) if count[tuple(x[i : i + window])] > 1 for k in range(window)}
        kept = " ".join(w for i, w in enumerate(x) if i not in gone)
        out.append((str(d), len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_rows_that_repeat_id_and_text(spark):
    rnd = random.Random(2)
    say = lambda n: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(n))
    twin, part = say(80), say(50)
    rows = [(1, twin)] * 40 + [(2, f"{say(20)} {part} {say(9)}"), (3, f"{part} {twin[:60]}"), (None, say(60)), (None, None), (5, "a b")] + [(None, twin)] * 2 + [(6, "short one")] * 9
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, _lf_twin int").repartition(3)
    got = substring_dedup.remove_repeats(df, window=10, block_bytes=400, bucket_windows=20, most_tasks=2).collect()
    assert sorted((str(r.doc_id), r._lf_n_words, r._lf_n_removed, r._lf_kept_sha256) for r in got) == brute_cut(rows, 10)
    assert sorted(r._lf_twin for r in got) == list(range(len(rows)))


# --- lines ------------------------------------------------------------------------------------


def test_family_of_numbered_lines(spark):
    rnd = random.Random(8)
    numbers = rnd.sample(range(2_000), 700)
    line = lambda n: f"Page {n:04d} of the catalogue of all things, printed in the year of the hare"
    df = spark.createDataFrame([(i, f"{line(n)}\nother {i} " + "".join(rnd.choice("abcdefghijk") for _ in range(30))) for i, n in enumerate(numbers)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.lines_query(df).collect()}
    place = {n: i for i, n in enumerate(numbers)}
    want = {}
    for n, i in place.items():
        s = f"{n:04d}"
        near = {int(s[:a] + x + s[a + 1 : b] + y + s[b + 1 :]) for a in range(4) for b in range(a + 1, 4) for x in "0123456789" for y in "0123456789"}
        # one character out and one in at another place moves the digits between
        near |= {int(t) for a in range(4) for b in range(4) for x in "0123456789" for t in [(s[:a] + s[a + 1 :])[:b] + x + (s[:a] + s[a + 1 :])[b:]]}
        want[i] = int(any(place.get(m, i) < i for m in near))
    assert got == want


def test_line_pairs_stay_in_proportion(spark, monkeypatch):
    sizes = []
    plain = line_dedup.saved

    def counted(df, name):
        out = plain(df, name)
        if "pairs" in name:
            sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(line_dedup, "saved", counted)
    n = 500
    df = spark.createDataFrame([(i, f"Page {i:04d} of the catalogue of all things, printed in the year of the hare") for i in range(n)], "doc_id long, text string")
    line_dedup.lines_query(df).count()
    assert max(k for _, k in sizes) <= 64 * n


def test_lines_with_null_ids_and_repeated_rows(spark):
    a, b = "a line of thirty characters...", "another one, which is different"
    rows = [(None, f"{a}\n{b}"), (None, f"{a}\n{b}"), (None, a + "!"), (1, f"{b}\n{a}\nnew"), (1, f"{b}\n{a}\nnew"), (2, None), (None, None), (3, "")]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, _lf_gone int").repartition(3)
    got = {r._lf_gone: r.text for r in line_dedup.dedup_lines(df, min_equal=1).collect()}
    # null ids sort first; of texts with one id the one with the smaller hash
    first = spark.range(1).select(*(F.xxhash64(F.lit(t)).alias(k) for k, t in (("p", f"{a}\n{b}"), ("q", a + "!")))).first()
    assert got[0] == got[1] and got[3] == got[4] == "new" and got[5] is None and got[6] is None and got[7] == ""
    assert (got[0], got[2]) == ((f"{a}\n{b}", "") if first.p < first.q else (b, a + "!"))


# --- language ---------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["²", "½ ①", "Ⅷ ٣ 12", "", None, "!?", "́"])
def test_no_letter_is_und(spark, text):
    rows = [(i, "the thing and that word", "en") for i in range(20)] + [(100, text, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    r = language.language_query(df.coalesce(1)).where("doc_id = 100").first()
    assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])


def test_language_labels_equal_brute_force(spark):
    """Trigram counts, scores, the best path, letters and spans, computed plainly."""
    rnd = random.Random(4)
    said = {"en": ["the", "and", "thing", "with", "over"], "de": ["der", "und", "über", "ding", "nicht"], "ru": ["это", "как", "мир"]}
    rows = [(i, " ".join(rnd.choice(said[lang]) for _ in range(12)), lang) for i, lang in enumerate([*said] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.fit(df, buckets=1 << 16, smoothing=0.1)
    langs = sorted(said)
    counts = {x: {} for x in langs}
    for _, t, x in rows:
        for w in t.split():
            p = f"\x02{w}\x03"
            for k in range(len(p) - 2):
                counts[x][p[k : k + 3]] = counts[x].get(p[k : k + 3], 0) + 1
    total = {x: sum(counts[x].values()) for x in langs}

    def logp(g, x):
        return np.log((counts[x].get(g, 0) + 0.1) / (total[x] + 0.1 * (1 << 16)))

    scripts = {"en": {"latin"}, "de": {"latin"}, "ru": {"cyrillic"}}
    script = lambda w: language.NAMES[language.script_of(w[0])]

    def word(w):
        p = f"\x02{w}\x03"
        ok = [x for x in langs if script(w) in scripts[x]]
        sums = {x: sum(logp(p[k : k + 3], x) for k in range(len(p) - 2)) for x in langs}
        if not ok:
            return dict.fromkeys(langs, 0.0), 0
        top = max(sums[x] for x in ok)
        return {x: max(sums[x] - top, -12.0) if x in ok else -12.0 for x in langs}, len(w)

    tests = ["the thing und der ding", "это мир and the thing with the thing over the thing", "漢字 the", "und the und the", "ding"]
    got = language.label_documents(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model, penalty=3.0, spans=True).orderBy("doc_id").collect()
    for r, t in zip(got, tests):
        words = t.split()
        scored = [word(w) for w in words]
        best = max(product(langs, repeat=len(words)), key=lambda path: (sum(s[x] for (s, _), x in zip(scored, path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:]))))
        letters = {x: sum(n for (_, n), y in zip(scored, best) if y == x) for x in langs}
        share = {x: letters[x] / sum(map(len, words)) for x in langs}
        assert r._lf_score == pytest.approx(max(share.values())) and share[r._lf_lang] == max(share.values())
        want, at = [], 0
        for w, x in zip(words, best):
            size = len(w.encode())
            if want and want[-1][2] == x:
                want[-1][1] = at + size
            else:
                want.append([at, at + size, x])
            at += size + 1
        if words[0] != "漢字":  # a word of no known script costs nothing in any language: a tie
            assert [[s.start, s.end, s.lang] for s in r._lf_spans] == want


def test_memories_that_forget_change_nothing():
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["the", "a.", "x\n"]) + "".join(rnd.choice("abcdefé") for _ in range(rnd.randint(0, 6))) for _ in range(40)) for _ in range(60)] + ["", "two  spaces", " wide"]
    small, large = bpe.BpeEncoder(vocabulary(), max_words=50), bpe.BpeEncoder(vocabulary())
    model = language.Model(["a", "b", "c"], np.log(np.random.default_rng(0).random((512, 3))).astype(np.float32), np.ones((len(language.NAMES), 3), bool))
    few, many = language.Scorer(model, max_words=50), language.Scorer(model)
    for i in range(0, len(texts), 5):
        batch = pa.array(texts[i : i + 5])
        for x, y in zip(small.encode(batch), large.encode(batch)):
            assert x.tolist() == y.tolist()
        for x, y in zip(language.label_texts(batch, few, 2.0, True)[:2], language.label_texts(batch, many, 2.0, True)[:2]):
            assert x.tolist() == y.tolist()
    assert len(small.codes) < 400 < len(large.codes) and len(few.codes) < 400


# --- archives and tokens ----------------------------------------------------------------------


def test_files_roll_with_the_registered_parameters(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "u", rng.bytes(200_000).hex()) for i in range(25)]  # 10 MB, about 5 MB compressed: one shard
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    manifest = warc.write_warc(df, scratch(spark, "w")).collect()
    assert len({r.shard for r in manifest}) == 1 and len(manifest) > 2 and min(r.bytes for r in manifest if r.seq + 1 < len(manifest)) >= (12 << 20) // 16
    got = warc.warc_query(df)
    assert got.count() == 25 and got.where("record_type = 'response'").count() == 25


# --- clashing names and empty tables ----------------------------------------------------------

CLASHES = ["key", "node", "band", "bands", "label", "component", "class_id", "line", "no", "h1", "th", "block", "bucket", "_lf_row", "_lf_th", "_lf_gone", "_lf_id", "_lf_of", "_lf_node", "_lf_keep", "_lf_twin", "_lf_block", "_lf_key", "_lf_lang", "_lf_score", "_lf_spans", "hub", "a", "b", "n", "text_bytes"]


def clashing(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(2)
    for c in CLASHES:
        df = df.withColumn(c, F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return df


def some_rows():
    rnd = random.Random(3)
    say = lambda n: " ".join("".join(rnd.choice(["the", "ing", "and", "tho"]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    rows = [(i, "\n".join(say(40) for _ in range(3)), "en") for i in range(12)]
    rows += [(20, rows[0][1], "en"), (21, rows[1][1] + " extra", None), (None, say(50), "en"), (None, None, None), (22, "", "en"), (23, "12", "en"), (0, rows[0][1], "en")]
    return [(d, t, lang, None, None if t is None else len(t)) for d, t, lang in rows]


@pytest.mark.parametrize("stage", ["language_id", "line_dedup", "near_dedup", "substring_dedup"])
def test_stages_keep_columns_of_any_name(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    df = clashing(spark, some_rows())
    out = run(spark, df, "")
    assert out.columns == df.columns
    for r in out.collect():
        for c in CLASHES:
            assert r[c] == f"{c}:{'null' if r.doc_id is None else r.doc_id}"
    plain = run(spark, df.select("doc_id", "text", "lang", "source", "n_chars"), "")
    key = lambda r: (str(r.doc_id), str(r.text), str(r.n_chars))
    assert sorted(map(key, out.collect())) == sorted(map(key, plain.collect()))
    empty = run(spark, df.limit(0), "")
    assert empty.columns == df.columns and empty.count() == 0


def test_queries_take_columns_of_any_name(spark):
    df = clashing(spark, some_rows())
    v = pieces.Vocabulary.load(P.path("piece_bpe_32k.model"))
    for run in (
        lambda d: token_files.token_files_query(d, vocabulary()), language.language_query, substring_dedup.substring_query, minhash.minhash_query, line_dedup.lines_query,
        audio.audio_query, lambda d: pieces.encode_pieces(d, v), lambda d: packing.packed_query(d, vocabulary()),
    ):
        assert run(df).count() == df.count()
        assert run(df.limit(0)).count() == 0
    pages = df.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *CLASHES)
    assert warc.warc_query(pages).count() == df.count()
    vecs = df.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0).cast("float"), F.rand(1).cast("float")).alias("embedding"), *CLASHES)
    assert vectors.vectors_query(vecs).count() == df.count()


def test_whole_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts(spark):
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(50_000)}" for _ in range(120_000)]
    long = " ".join(words)
    edited = " ".join([*words[:60_000], "other", *words[60_000:]])
    df = spark.createDataFrame([(1, long, "en", None, 1), (2, edited, "en", None, 1), (3, "x" * 300_000, "en", None, 1)], DOCS)
    got = {r.doc_id: r for r in minhash.minhash_query(df).collect()}
    assert (got[1].class_id, got[2].class_id, got[3].class_id) == (1, 1, 3)
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_query(df).collect()} == {1: 120_000, 2: 120_000, 3: 0}
    assert {r.doc_id: r.lang_pred for r in language.language_query(df.withColumn("doc_id", F.col("doc_id"))).collect()} == dict.fromkeys((1, 2, 3), "en")
    crc = {r.doc_id: r.n_tokens for r in token_files.token_files_query(df, vocabulary()).collect()}
    packed = {}
    for r in packing.packed_query(df, vocabulary()).collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert crc == packed
    page = warc.warc_query(df.selectExpr("doc_id AS page_id", "source AS url", "text AS html")).collect()
    assert {r.page_id: r.payload_bytes for r in page} == {1: len(long), 2: len(edited), 3: 300_000}


# --- the whole pipeline -----------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_pipeline(rows):
    """Each stage by its definition: {doc_id: text} before packing."""
    docs = {d: t for d, t in rows if t is not None and re.search(r"\p{L}", t)}
    seen, cut = [], {}
    for d in sorted(docs):
        kept = []
        for line in docs[d].split("\n"):
            equal = line and line in seen
            near = len(line) >= 24 and any(len(m) >= 24 and abs(len(m) - len(line)) <= 2 and edit_distance(m, line) <= 2 for m in seen)
            if not equal and not near:
                kept.append(line)
            seen.append(line)
        cut[d] = "\n".join(kept)
    ids = sorted(cut)
    shingles = []
    for d in ids:
        w = cut[d].split()
        grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        shingles.append({g: grams.count(g) for g in grams})

    def jp(x, y):
        return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in set(x) | set(y)) for i in set(x) & set(y))

    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if cut[ids[i]] == cut[ids[j]] or (shingles[i] and shingles[j] and jp(shingles[i], shingles[j]) >= 0.8)]
    of = union(pairs, len(ids))
    kept = {d: cut[d] for k, d in enumerate(ids) if of[k] == k}
    spans = {d: [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for d, t in kept.items()}
    words = {d: [kept[d][a:b] for a, b in s] for d, s in spans.items()}
    count = {}
    for w in words.values():
        for i in range(len(w) - 34):
            count[tuple(w[i : i + 35])] = count.get(tuple(w[i : i + 35]), 0) + 1
    out = {}
    for d, w in words.items():
        gone = {i + k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(35)}
        text, at, i = "", 0, 0
        while i < len(w):
            if i not in gone:
                i += 1
                continue
            j = i
            while j in gone:
                j += 1
            if j == len(w):  # the last interval takes the white space before it along, and all behind
                text, at = text + kept[d][at : spans[d][i - 1][1] if i else 0], len(kept[d])
            else:
                text, at = text + kept[d][at : spans[d][i][0]], spans[d][j][0]
            i = j
        out[d] = text + kept[d][at:]
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice(["the", "ing", "and", "tho", "er", "ou"]) for _ in range(rnd.randint(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage = say(60)
    base = [[say(rnd.randint(4, 30)) for _ in range(rnd.randint(1, 8))] for _ in range(25)]
    rows = [(10 * i, "\n".join(b)) for i, b in enumerate(base)]
    rows += [(10 * i + 1, rows[i][1]) for i in range(4)]  # exact copies
    rows += [(10 * i + 2, "\n".join(x.replace("t", "d", 1) for x in rows[i][1].split("\n"))) for i in range(4, 7)]  # lines an edit away
    for i in range(7, 13):  # one long line each, with a few words of its own
        w = say(150).split()
        rows.append((10 * i + 3, " ".join(w)))
        for k in rnd.sample(range(150), 2):
            w[k] = word() + "x"
        rows.append((10 * i + 4, " ".join(w)))
    rows += [(10 * i + 5, f"{say(12)}  {passage}\t{say(9)}") for i in range(5)] + [(900, passage), (901, f"{passage} {say(3)}"), (902, f"{say(3)}\n{passage}")]
    rows += [(910, None), (911, ""), (912, "12 34"), (913, say(3)), (914, "All rights reserved.\n" + say(700)), (915, "All rights reserved.")]
    want = plain_pipeline(rows)
    spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
    assert {r.doc_id: r.text for r in now.collect()} == want
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces_ = []
    for d, t in want.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        n = -(-len(ids) // 2048)
        head = len(ids) - 2048 * (n - 1)
        cuts = [0, *(head + 2048 * k for k in range(n))]
        pieces_ += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces_)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert len(by) <= -(-sum(n for *_, n, _ in pieces_) // 2048) + 1
