"""Embedding and text near-duplicates, line dedup, WARC and the pipeline against brute force."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import line_dedup, minhash, vectors, warc
from lumenframe.llm._common import scratch, shard_of, shard_starts
from lumenframe.llm._graph import components


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


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(70)] + [(300, i) for i in range(301, 340)]
    pairs = [(a, b) for a, b in pairs if a != b]
    want = union(pairs, 400)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: want[x] for p in pairs for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shards_cover_all_keys(spark):
    ids = [-(2**62), -5, 0, 1, 2, 3, 10**6, 2**62, None, 7, 7]
    df = spark.createDataFrame([(i,) for i in ids], "k long")
    starts, total = shard_starts(df, "k", F.lit(10), lambda n: 20)
    assert total == 100 and starts == shard_starts(df.repartition(7), "k", F.lit(10), lambda n: 20)[0] and len(starts) > 3
    for r in df.withColumn("s", shard_of("k", starts)).collect():
        assert r.s == (0 if r.k is None else max(i for i, a in enumerate(starts) if a <= r.k))
    assert shard_starts(df.limit(0), "k", F.lit(10), lambda n: 20)[1] == 0
    assert shard_starts(df, "k", F.lit(10), lambda n: n)[0] == [-(2**62)]


def test_shards_take_as_many_jobs_for_any_weights(spark):
    rnd = random.Random(3)
    plain = [(i, 10) for i in range(3000)]
    odd = [(rnd.choice([i, i * 10**12, -(2**63) + i]), rnd.choice([1, 10, 100_000])) for i in range(3000)] + [(5, 10**7)]
    jobs, tracker = [], spark.sparkContext.statusTracker()
    for k, rows in enumerate((plain, odd)):
        spark.sparkContext.setJobGroup(f"shards-{k}", "")
        df = spark.createDataFrame(rows, "k long, w long")
        starts, total = shard_starts(df, "k", F.col("w"), lambda n: 4000)
        jobs.append(len(tracker.getJobIdsForGroup(f"shards-{k}")))
        of = {}
        for a, w in rows:
            of[a] = of.get(a, 0) + w
        want, at, last = [], 0, -1
        for a in sorted(of):
            if at // 4000 != last:
                want.append(a)
            last = at // 4000
            at += of[a]
        assert starts == want and total == at
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16))
    dense = rng.normal(size=16) + rng.normal(size=(90, 16)) * 0.12  # saturates lists
    x = np.concatenate([x, dense, x[:40] + rng.normal(size=(40, 16)) * 0.2, x[:30] * 3])
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]
    rows += [(1000 + i, v, 1) for i, v in enumerate(bad)] + [(0, rows[0][1], 2), (None, rows[1][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(i, v) for i, v, _ in rows if i is not None and v and None not in v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    m = np.array([v for _, v in good], np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    of = union(np.argwhere(near).tolist(), len(good))
    want = {}
    for k, (i, _) in enumerate(good):
        want[i] = (int(near[k].sum()), min(good[j][0] for j in range(len(good)) if of[j] == of[k]))
    got = vectors.vectors_query(df.repartition(3)).collect()
    assert len(got) == len(rows)
    assert all((r.n_links, r.component_id) == want[r.vec_id] for r in got if r.vec_id in want)
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id is not None and r.vec_id >= 1000)
    assert vectors.vectors_query(df.limit(0)).count() == 0


def two_dense_groups(rng, cosine, n=60, dim=64):
    """Two groups with inner cosines about 0.98 whose members all are closer to their own group than to the other."""
    a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
    b = cosine * a + np.sqrt(1 - cosine * cosine) * b
    return np.concatenate([c + rng.normal(size=(n, dim)) * 0.143 / np.sqrt(dim) for c in (a, b)])


@pytest.mark.parametrize("cosine", [0.92, 0.94])
def test_near_vectors_links_between_dense_groups(spark, cosine):
    rng = np.random.default_rng(5)
    x = np.concatenate([two_dense_groups(rng, cosine), rng.normal(size=(50, 64))])
    m = x / np.linalg.norm(x, axis=1)[:, None]
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    of = union(np.argwhere(near).tolist(), len(x))
    top = np.argsort(-(m[:120] @ m[:120].T - 2 * np.eye(120)), axis=1)[:, :10]
    assert near[:60, 60:120].sum() > 1000 and (top // 60 == np.arange(120)[:, None] // 60).all()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in vectors.vectors_query(df).collect()}
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(x))] == [(int(near[i].sum()), of[i], of[i] == i) for i in range(len(x))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_vectors_equal_brute_force_on_groups(spark, seed):
    """Groups of many sizes and widths, some close to one another, single pairs, copies and strays."""
    rng = np.random.default_rng(seed)
    parts = [two_dense_groups(rng, rng.uniform(0.88, 0.97), n=int(rng.integers(15, 60))) for _ in range(3)]
    for _ in range(6):
        parts.append(rng.normal(size=64) + rng.normal(size=(int(rng.integers(2, 40)), 64)) * rng.uniform(0.02, 0.35))
    strays = rng.normal(size=(60, 64))
    parts += [strays, strays[:20] + rng.normal(size=(20, 64)) * 0.4, parts[0][:5] * 2]
    x = np.concatenate(parts)
    m = x / np.linalg.norm(x, axis=1)[:, None]
    cosine = m @ m.T
    keep = (np.abs(cosine - 0.9) > 1e-9).all(1)  # none so close that the order of a sum decides
    x, m = x[keep], m[keep]
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    of = union(np.argwhere(near).tolist(), len(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in vectors.vectors_query(df).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(len(x))] == [(int(near[i].sum()), of[i]) for i in range(len(x))]


def test_near_vectors_audits_sparse_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 64))
    y = x + rng.normal(size=(200, 64)) * 0.4  # pairs at about 0.93, with no other links
    dense = rng.normal(size=64) + rng.normal(size=(300, 64)) * 0.1  # holds nearly all links
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y, dense]))], "vec_id long, embedding array<double>").repartition(3)
    with pytest.raises(RuntimeError, match="recall"):
        vectors.near_vectors(df, tables=1, rounds=0, more=0, miss=0.999)
    m = np.concatenate([x, y])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, tables=1, rounds=0, more=30, miss=0.999).collect()}
    assert sum(min(got[i], near[i].sum()) for i in range(400)) >= 0.95 * near.sum() > 0


def test_tables_grow_with_bits():
    for n in (100, 100_000, 1_000_000, 10_000_000, 1_000_000_000):
        tables, bits = vectors.seed_tables(n, 0.9, 12, 0.05), vectors.seed_bits(n)
        assert tables >= 12 and (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables <= 0.05
    assert [vectors.seed_tables(n, 0.9, 12, 0.05) for n in (1000, 100_000, 1_000_000)] == [12, 15, 25]


def plain_jp(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in set(x) | set(y)) for i in set(x) & set(y))


def test_probability_jaccard():
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(300)}" for _ in range(300)]
    some = [" ".join(base)]
    for edits in (3, 20, 60):
        b = list(base)
        for _ in range(edits):
            b[rnd.randrange(300)] = f"x{rnd.random()}"
        some.append(" ".join(b))
    some.append(" ".join(base[:150] * 2))
    h, w, at = minhash.shingle_weights(pa.array(some))
    sig = minhash.signatures(h, w, at, 4096)
    cut = lambda i: (h[at[i] : at[i + 1]], w[at[i] : at[i + 1]])
    for i in range(1, len(some)):
        exact = minhash.probability_jaccard(*cut(0), *cut(i))
        assert exact == pytest.approx(plain_jp(dict(zip(*map(list, cut(0)), strict=True)), dict(zip(*map(list, cut(i)), strict=True))))
        assert abs((sig[0] == sig[i]).mean() - exact) < 0.04


def near_texts():
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    bases = [[rnd.choice(words) for _ in range(rnd.randint(60, 150))] for _ in range(12)]
    out = []
    for b in bases:
        out.append(" ".join(b))
        for _ in range(rnd.randint(0, 6)):
            c = list(b)
            for _ in range(rnd.randint(0, 5)):
                c[rnd.randrange(len(c))] = rnd.choice(words)
            out.append(" ".join(c))
    return out


def test_minhash_classes(spark):
    rows = list(enumerate(near_texts()))
    rows += [(900, None), (901, ""), (902, "  \n"), (903, "one two"), (904, "one  two"), (905, "three"), (None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class_id string").repartition(3)
    h, w, at = minhash.shingle_weights(pa.array([t or "" for _, t in rows]))
    cut = lambda i: (h[at[i] : at[i + 1]], w[at[i] : at[i + 1]])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] or "") == (rows[j][1] or "") or (at[i + 1] > at[i] and minhash.probability_jaccard(*cut(i), *cut(j)) >= 0.8)]
    of = union(pairs, len(rows))
    want = {}
    for i, (d, t) in enumerate(rows):
        want[d, t] = min((rows[j][0] for j in range(len(rows)) if of[j] == of[i] and rows[j][0] is not None), default=None)
    got = minhash.minhash_query(df).collect()
    assert len(got) == len(rows)
    by = {}
    for d, t in rows:
        by.setdefault(d, set()).add(want[d, t])
    assert all(r.class_id in by[r.doc_id] for r in got)
    kept = minhash.minhash_stage(df).collect()
    assert len(kept) == len(set(of)) and sorted(r.doc_id for r in kept) == sorted(set(want.values()))
    assert minhash.minhash_query(df.limit(0)).count() == 0


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def edited(rnd, line, most):
    out = list(line)
    for _ in range(rnd.randint(0, most)):
        kind, i = rnd.random(), rnd.randrange(len(out) + 1)
        if kind < 0.4 or not out:
            out.insert(i, rnd.choice("abcé😀"))
        elif kind < 0.7:
            out.pop(min(i, len(out) - 1))
        else:
            out[min(i, len(out) - 1)] = rnd.choice("abcé")
    return "".join(out)


def test_bit_parallel_distance(spark):
    rnd = random.Random(3)
    pairs = [("", ""), ("a", ""), ("", "ab")]
    for _ in range(200):
        a = "".join(rnd.choice("abcé😀") for _ in range(rnd.randint(0, 14)))
        pairs.append((a, edited(rnd, a, 4)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in range(5):
        got = line_dedup.within_edits(df, "a", "b", k).withColumnRenamed("_lf_within", "w").collect()
        assert all(r.w == (distance(r.a, r.b) <= k) for r in got)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_line_dedup(spark, edits):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcde fgh") for _ in range(rnd.randint(24, 40))) for _ in range(12)]
    rows = [(d, "\n".join(edited(rnd, rnd.choice(base), 5) for _ in range(rnd.randint(1, 5)))) for d in range(50)]
    rows += [(60, None), (61, ""), (62, "short\nshort\n\n"), (63, base[0] + "\n" + base[0]), (64, "x" * 9000)]
    seen, gone = [], {}
    for d, t in rows:
        gone[d] = set()
        for i, line in enumerate((t or "").split("\n")):
            if len(line) >= 24:
                if any(abs(len(line) - len(m)) <= edits and distance(line, m) <= edits for m in seen):
                    gone[d].add(i)
                if line not in seen:
                    seen.append(line)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, no int").repartition(3)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, max_edits=edits).collect()}
    for d, t in rows:
        want = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
        assert (got[d].text, got[d]._lf_n_removed) == (want, len(gone[d])), d
    assert line_dedup.lines_query(df.limit(0)).count() == 0


def test_equal_short_lines_go(spark):
    long = "a line of thirty characters..."
    rows = [(1, f"All rights reserved.\n\n{long}\nx"), (2, f"x\n\n\nAll rights reserved!\nAll rights reserved."), (3, f"{long}\nAll rights reserved.\nx"), (4, "x\nx\n x")]
    want = {1: rows[0][1], 2: "\n\nAll rights reserved!", 3: "", 4: " x"}
    df = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars int").repartition(3)
    assert {r.doc_id: (r.text, r.n_chars) for r in line_dedup.lines_stage(df).collect()} == {d: (t, len(t)) for d, t in want.items()}
    got = {r.doc_id: (r.n_removed, r.kept_sha256, r.kept_chars) for r in line_dedup.lines_query(df).collect()}
    assert got == {d: (n, hashlib.sha256(want[d].encode()).hexdigest(), len(want[d])) for d, n in zip(want, (0, 2, 3, 2), strict=True)}


def test_line_dedup_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a" * 30)], "doc_id long, text string")
    plan = line_dedup.dedup_lines(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapPartitions"))


def test_warc(spark):
    big = "<p>" + "x" * 5000
    rows = [(1, "u", "a"), (2, None, "a"), (3, "x\r\ny z", "é"), (4, "u", None), (5, "u", ""), (7, "u", "a"), (7, "u", "a"), (None, "u", "zz"), (9, "u", big), (10, "u", big)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    files = [warc.write_warc(df.repartition(k), scratch(spark, "w"), shard_bytes=300, roll_bytes=200) for k in (1, 5)]
    contents = [sorted((r.shard, r.seq, r.records, r.sha256) for r in f.collect()) for f in files]
    assert contents[0] == contents[1] and len(contents[0]) > 4
    got = warc.read_warc(spark, files[1], with_payload=True).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    keeper = {"a": 7, "é": 3, "": 5, "zz": None, big: 10}
    assert len(got) == len(rows)
    for r in got:
        h = next(h or "" for p, _, h in rows if p == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), digest(h))
        if r.record_type == "response":
            assert r.refers_to is None and bytes(r.payload) == h.encode() and r.page_id == keeper[h]
        else:
            assert r.refers_to == keeper[h]
    assert sum(r.record_type == "response" for r in got) == 5
    assert warc.read_warc(spark, warc.write_warc(df.limit(0), scratch(spark, "w"))).count() == 0


def test_pipeline(spark, tmp_path):
    rnd = random.Random(9)
    say = lambda n: " ".join("".join(rnd.choice(["the", "ing", "and", "tho"]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    docs = [(i, "\n".join(say(40) for _ in range(3)), "en") for i in range(20)]
    docs += [(100, docs[0][1], "en"), (101, "12 34", "en"), (102, None, None), (103, docs[1][1] + " extra", "en")]
    rows = [(d, t, lang, "src", len(t or "")) for d, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in now.collect()})
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r.n_chars == len(r.text) for r in now.collect())
    assert kept[0] == set(range(20)) | {100, 103} and kept[1] == kept[0]
    assert kept[2] == set(range(20)) | {100, 103}  # emptied by line dedup, or left with a line of its own
    assert kept[3] == kept[4] == kept[2]
    end = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, end.collect())) == sorted(map(tuple, now.collect()))
