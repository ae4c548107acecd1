"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

A line goes if an equal line, or one within ``max_edits`` character edits, comes earlier in the order
(doc_id, text hash, line number); the first of its kind stays. Lines of ``min_equal`` characters or more are compared
for equality and those of ``min_chars`` or more for edits: the query and the stage take every line that is not
empty for the first, and ``min_equal`` is ``min_chars`` where it is not given. Shorter lines stay.

Lines are cut and hashed once, into a table of places, hashes and segment keys. Equal lines are found by an aggregate over line hashes. For the others every line is cut into ``max_edits + 1``
segments; of two lines within the limit one holds a segment of the other unchanged, and where it may
stand follows from both lengths and the edits left on either side. So a line indexes its segments under
(length, segment number, hash) and probes, for each length up to ``max_edits`` below its own, the
substrings at the few positions allowed. Keys that a second line shares are found by an aggregate of (least,
greatest) line hash; only their lines are joined, under a condition that character-class counts differ by no
more than the edits allow. What is left is verified by a banded bit-parallel automaton: one bit per diagonal of the band and number of errors, all in
one long, advanced by a character's match mask at a time.

A line needs one earlier partner only. So in a bucket of more than ``crowd`` lines, such as a family of numbered lines, every line is first
compared with ``hubs`` lines of the bucket, drawn by a hash; lines that have found an earlier partner then look for no more,
and only the rest is joined with all earlier lines of the bucket. Up to then the pairs are a constant times the lines. A family of lines that share a
segment and the counts of all classes, but are not within the limit of any earlier line, still costs a pair of lines for each two of them.

Nulls and empties: a null text stays null with no lines; an empty text has one empty line and stays. Null ids sort first.
Rows that repeat both id and text are one document and all get its result. An empty table
gives no rows. Long texts and lines are compared whole. Other columns pass through, whatever their names, unless these are
the names that ``dedup_lines`` adds, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm._common import packed, saved, unpacked

# Classes of characters whose counts bound an edit distance from below.
CLASSES = ["e", "t", "a", "n", "i", "o", "h", "r", "s", "d", "l", " ", "uvw", "cmfpg", "02", "13", "46", "57", "89", ".,;:!?"]


def _automaton(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within ``edits`` edits: a banded bit-parallel automaton.

    After j characters of b, bit k of level e says that a's first j+k-edits characters match them with at most e
    errors. A match or substitution keeps the diagonal, an extra character of b moves down one bit and a
    missing one moves up. Once no bit is left the remaining characters cost nothing.
    """
    width, full = 2 * edits + 2, (1 << (2 * edits + 1)) - 1
    mine, theirs = F.split(a, ""), F.split(b, "")

    def level(state: Column, e: int) -> Column:
        return F.shiftright(state, e * width).bitwiseAND(F.lit(full))

    def step(state: Column, m: Column) -> Column:
        new = level(state, 0).bitwiseAND(m)
        packed = new
        for e in range(1, edits + 1):
            old = level(state, e - 1)
            new = level(state, e).bitwiseAND(m).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new, 1)).bitwiseAND(F.lit(full))
            packed = packed.bitwiseOR(F.shiftleft(new, e * width))
        return packed

    def matches(c: Column) -> Column:
        """Bit k: c's character is the one of a on diagonal k; c has the character and a's characters of the band."""
        out = F.lit(0).cast("long")
        for k in range(2 * edits + 1):
            out = out + F.when(F.get(c["near"], F.lit(k)) == c["c"], F.lit(1 << k)).otherwise(F.lit(0))
        return out

    # a's characters with ``edits`` empty ones before and 2*edits behind, so that a band is a slice; texts hold no empty ones
    padded = F.concat(F.array_repeat(F.lit(""), edits), mine, F.array_repeat(F.lit(""), 2 * edits + 1))
    bands = F.transform(theirs, lambda c, j: F.struct(c.alias("c"), j.alias("j")))
    start = sum((((1 << (e + 1)) - 1) << edits & full) << (e * width) for e in range(edits + 1))
    zero = F.struct(F.lit(start).cast("long").alias("state"), padded.alias("a"))

    def advance(acc: Column, x: Column) -> Column:
        seen = F.struct(x["c"].alias("c"), F.slice(acc["a"], x["j"] + 1, F.lit(2 * edits + 1)).alias("near"))
        new = F.get(F.transform(F.array(matches(seen)), lambda m: step(acc["state"], m)), F.lit(0))
        return F.struct(F.when(acc["state"] == 0, acc["state"]).otherwise(new).alias("state"), acc["a"].alias("a"))

    last = F.when(F.length(b) == 0, F.lit(start).cast("long")).otherwise(F.aggregate(bands, zero, advance, lambda acc: acc["state"]))
    gap = F.length(a) - F.length(b)
    bit = F.shiftright(last, edits * width).bitwiseAND(F.expr("1L") * F.pow(F.lit(2), gap + edits).cast("long"))
    return (F.abs(gap) <= edits) & (bit != 0)


def within_edits(pairs: DataFrame, a: str, b: str, edits: int) -> DataFrame:
    """``pairs`` with _lf_within: whether two string columns are within ``edits`` (4 at most) edits.

    What both begin and end with is cut first, which leaves the distance as it is; the automaton runs over the rest.
    """
    if not 0 <= edits <= 4:
        raise ValueError("0 to 4 edits")

    def common(x: str, y: str) -> Column:
        """Characters that both begin with."""
        same = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.coalesce(p == q, F.lit(False)))
        first = F.array_position(same, False)
        return F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0)).when(first == 0, F.least(F.length(x), F.length(y))).otherwise(first - 1).cast("int")

    out = pairs.withColumn("_lf_p", common(a, b))
    out = out.withColumns({f"_lf_{c}": F.substring(F.col(c), F.col("_lf_p") + 1, F.length(c)) for c in (a, b)})
    out = out.withColumns({f"_lf_r{c}": F.reverse(F.col(f"_lf_{c}")) for c in (a, b)})
    out = out.withColumn("_lf_s", common(f"_lf_r{a}", f"_lf_r{b}"))
    out = out.withColumns({f"_lf_{c}": F.substring(F.col(f"_lf_{c}"), F.lit(1), F.length(f"_lf_{c}") - F.col("_lf_s")) for c in (a, b)})
    out = out.withColumn("_lf_within", _automaton(F.col(f"_lf_{a}"), F.col(f"_lf_{b}"), edits))
    return out.drop("_lf_p", "_lf_s", f"_lf_{a}", f"_lf_{b}", f"_lf_r{a}", f"_lf_r{b}")


def _segment(n: Column, i: int, parts: int) -> Column:
    """Start of the i-th of ``parts`` segments of n characters."""
    return F.floor(n * i / parts).cast("int") if i not in (0, parts) else (n if i else F.lit(0))


def segment_windows(line: Column, n: Column, edits: int) -> list[Column]:
    """For each segment, the stretch of the line that holds it and all its probes, so that keys are cut from short strings."""
    parts = edits + 1
    out = []
    for i in range(parts):
        low = F.greatest(_segment(n, i, parts) - 2 * edits, F.lit(0))
        out.append(F.substring(line, low + 1, _segment(n, i + 1, parts) + edits - low).alias(f"w{i}"))
    return out


def segment_keys(n: Column, edits: int) -> Column:
    """array<long>, from columns w0.. : first the keys of the line's own edits + 1 segments, then its probes into lengths down to n - edits.

    A probe that would reach over the line's end is NULL.
    """
    parts = edits + 1
    own, probes = [], []

    def key(length: Column, i: int, start: Column, size: Column) -> Column:
        low = F.greatest(_segment(n, i, parts) - 2 * edits, F.lit(0))
        return F.xxhash64(length, F.lit(i), F.substring(F.col(f"w{i}"), start - low + 1, size))

    for i in range(parts):
        at = _segment(n, i, parts)
        own.append(key(n, i, at, _segment(n, i + 1, parts) - at))
    for shorter in range(parts):
        length = n - shorter
        for i in range(parts):
            at = _segment(length, i, parts)
            size = _segment(length, i + 1, parts) - at
            for move in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                if shorter or move:
                    start = at + move
                    probes.append(F.when((start >= 0) & (start + size <= n), key(length, i, start, size)))
    return F.array(*own, *probes)


def line_table(docs: DataFrame, *, max_edits: int, min_chars: int, min_equal: int) -> DataFrame:
    """(doc_id, th, no, h1, h2, keys) of the lines that take part; keys is null for lines under ``min_chars``."""
    each = docs.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("n", F.length("line")).where(F.col("n") >= min(min_equal, min_chars))
    wide = each.select("doc_id", "th", "no", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), *segment_windows(F.col("line"), F.col("n"), max_edits))
    keys = F.when(F.col("n") >= min_chars, segment_keys(F.col("n"), max_edits)) if max_edits else F.lit(None).cast("array<bigint>")
    return wide.select("doc_id", "th", "no", "h1", "h2", keys.alias("keys"))


def _near(df: DataFrame, small: DataFrame, on: str, most: int = 200_000) -> DataFrame:
    """Rows of df whose key is in ``small``, a saved table of distinct keys of 8 bytes; broadcast only where their counted number is bounded."""
    return df.join(F.broadcast(small) if small.count() <= most else small, on, "left_semi")


def _fits(x: str, y: str, edits: int) -> Column:
    """What two different lines within the limit cannot fail: their lengths and class counts differ by the edits at most."""
    more = sum((F.greatest(F.col(f"{x}.c{i}") - F.col(f"{y}.c{i}"), F.lit(0)) for i in range(len(CLASSES))), F.lit(0))
    less = sum((F.greatest(F.col(f"{y}.c{i}") - F.col(f"{x}.c{i}"), F.lit(0)) for i in range(len(CLASSES))), F.lit(0))
    return (F.col(f"{x}.h1") != F.col(f"{y}.h1")) & (F.abs(F.col(f"{x}.n") - F.col(f"{y}.n")) <= edits) & (more <= edits) & (less <= edits)


def _later(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(h1, first) of the lines that come later than one of their partners in ``pairs`` (a, b) and are within the limit of it."""
    a, b = (texts.select(F.col("h1").alias(x), F.col("line").alias(f"l{x}"), F.col("first").alias(f"f{x}")) for x in "ab")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(a, "a").join(b, "b").repartition(n, "a", "b")
    near = within_edits(both, "la", "lb", edits).where("_lf_within")
    late = F.when(F.col("fa") < F.col("fb"), F.struct(F.col("b").alias("h1"), F.col("fb").alias("first"))).otherwise(F.struct(F.col("a").alias("h1"), F.col("fa").alias("first")))
    return near.select(late.alias("p")).select("p.*").distinct()


def _pairs(x: DataFrame, y: DataFrame, condition: Column) -> DataFrame:
    """Distinct pairs (a, b) of lines that share a bucket and satisfy the condition."""
    return x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & condition).select(F.least("x.h1", "y.h1").alias("a"), F.greatest("x.h1", "y.h1").alias("b")).distinct()


def removed_lines(docs: DataFrame, *, max_edits: int = 2, min_chars: int = 24, min_equal: int | None = None, crowd: int = 128, hubs: int = 48) -> DataFrame:
    """(doc_id, th, no) of the lines that go; ``docs`` has doc_id, text and th."""
    table = saved(line_table(docs, max_edits=max_edits, min_chars=min_chars, min_equal=min_chars if min_equal is None else min_equal), "lines")
    place = F.struct("doc_id", "th", "no")
    firsts = table.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    exact = table.select("doc_id", "th", "no", "h1", "h2").join(firsts.where("n > 1").drop("n"), ["h1", "h2"]).where(place != F.col("first")).select("doc_id", "th", "no")
    if not max_edits:
        return exact.distinct()
    keyed = table.where("keys IS NOT NULL").select("h1", F.posexplode("keys").alias("at", "key")).where("key IS NOT NULL").select("h1", "key", (F.col("at") <= max_edits).alias("own"))
    shared = keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("own").alias("own")).where("lo != hi AND own").select("key")
    buckets = saved(_near(keyed, saved(shared, "shared-keys"), "key").groupBy("key", "h1").agg(F.max("own").alias("own")), "buckets")
    some = saved(buckets.select("h1").distinct(), "bucket-lines")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= min_chars).withColumn("h1", F.xxhash64("line"))
    texts = _near(lines, some, "h1").groupBy("h1", F.xxhash64(F.lit(1), "line").alias("h2")).agg(F.first("line").alias("line"))
    texts = saved(texts.join(firsts, ["h1", "h2"]).select("h1", "line", "first"), "line-texts")
    counts = [(F.length("line") - F.length(F.translate("line", c, ""))).alias(f"c{i}") for i, c in enumerate(CLASSES)]
    features = texts.select("h1", "first", F.length("line").alias("n"), *counts)
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size"))
    members = saved(buckets.join(features, "h1").join(sizes, "key"), "members")
    few, many = members.where(F.col("size") <= crowd), members.where(F.col("size") > crowd)
    role = F.col("x.own") | F.col("y.own")
    pairs = saved(_pairs(few.where("own"), few, _fits("x", "y", max_edits)), "pairs")
    late = saved(_later(pairs, texts, max_edits), "late")
    if not many.isEmpty():
        nth = F.row_number().over(Window.partitionBy("key").orderBy("order"))
        chosen = saved(many.withColumn("order", F.xxhash64("h1", F.lit("hub"))).withColumn("nth", nth).where(F.col("nth") <= hubs).drop("order", "nth"), "hubs")
        open_ = many.join(late.select("h1").distinct(), "h1", "left_anti")
        found = _later(saved(_pairs(open_, chosen, role & _fits("x", "y", max_edits)), "hub-pairs"), texts, max_edits)
        late = saved(late.unionByName(found).distinct(), "late")
        open_ = many.join(late.select("h1").distinct(), "h1", "left_anti")
        rest = saved(_pairs(open_, many, role & (F.col("y.first") < F.col("x.first")) & _fits("x", "y", max_edits)), "pairs-left")
        late = saved(late.unionByName(_later(rest, texts, max_edits)).distinct(), "late")
    return exact.unionByName(late.select("first.doc_id", "first.th", "first.no")).distinct()


ADDED = ["_lf_n_lines", "_lf_n_removed"]


def dedup_lines(docs: DataFrame, *, max_edits: int = 2, min_chars: int = 24, min_equal: int | None = None, **kw) -> DataFrame:
    """``docs`` with the lines cut from ``text``, and _lf_n_lines and _lf_n_removed added."""
    columns = [c for c in docs.columns if c not in ADDED]
    th = F.xxhash64("text")
    work = docs.select("doc_id", "text", th.alias("th")).where(F.col("text").isNotNull())
    gone = removed_lines(work, max_edits=max_edits, min_chars=min_chars, min_equal=min_equal, **kw).groupBy("doc_id", "th").agg(F.collect_set("no").alias("_lf_gone"))
    gone = gone.select(F.col("doc_id").alias("_lf_id"), F.col("th").alias("_lf_of"), "_lf_gone")
    keyed = packed(docs.select(*(F.col(f"`{c}`") for c in columns)), "doc_id", "text").withColumn("_lf_th", th)
    out = keyed.join(gone, (F.col("_lf_th") == F.col("_lf_of")) & F.col("doc_id").eqNullSafe(F.col("_lf_id")), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("_lf_gone"), i))
    cut = F.when(F.col("_lf_gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    done = (
        out.withColumn(ADDED[0], F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"))
        .withColumn(ADDED[1], F.when(F.col("_lf_gone").isNull(), F.lit(0)).otherwise(F.size("_lf_gone")).cast("long"))
        .withColumn("text", cut)
    )
    return unpacked(done, [*columns, *ADDED], "doc_id", "text", *ADDED)


def lines_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of the text that is left, and its characters."""
    done = dedup_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_equal=1)
    return done.select("doc_id", F.col("_lf_n_lines").alias("n_lines"), F.col("_lf_n_removed").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.length("text").cast("long").alias("kept_chars"))


def lines_stage(docs: DataFrame) -> DataFrame:
    """Documents without their repeated lines; n_chars follows the text where there is such a column."""
    done = dedup_lines(docs, min_equal=1)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("_lf_n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)
