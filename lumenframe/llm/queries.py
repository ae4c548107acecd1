"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Contents of a public tokenizer's file; a megabyte or two, so it travels in the task closure."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.llm.token_files import token_files_query

    return token_files_query(table(spark, sf_dir, "documents"), vocabulary())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.llm.packing import packed_query

    return packed_query(table(spark, sf_dir, "documents"), vocabulary())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.llm.substring_dedup import substring_query

    return substring_query(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.llm.language import language_query

    return language_query(table(spark, sf_dir, "documents"))


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.llm.audio import audio_query

    return audio_query(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.llm.pieces import pieces_query

    return pieces_query(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.llm.warc import warc_query

    return warc_query(table(spark, sf_dir, "pages"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.llm.minhash import minhash_query

    return minhash_query(table(spark, sf_dir, "documents"))


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.llm.vectors import vectors_query

    return vectors_query(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.llm.line_dedup import lines_query

    return lines_query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op7_line_dedup": op7_line_dedup,
    "op1_near_vectors": op1_near_vectors,
    "op6_minhash": op6_minhash,
    "op2_warc": op2_warc,
    "op9_pieces": op9_pieces,
    "op8_audio": op8_audio,
    "op4_language": op4_language,
    "op5_substring_dedup": op5_substring_dedup,
    "op3_token_files": op3_token_files,
    "op10_packing": op10_packing,
}
SQL: dict[str, str] = {
    "op1_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE l.b > r.root),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(r.root, e.vec_id) AS component_id, coalesce(r.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN roots r ON r.id = e.vec_id LEFT JOIN degree d ON d.id = e.vec_id""",
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, array_to_string(list_transform(regexp_extract_all(hex, '.'), lambda c: lpad(bin(CAST('0x' || c AS INT)), 4, '0')), '') AS b FROM p),
named AS (SELECT page_id, payload, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + 16 * CAST(substr(b, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(b, i * 5 + 2, 1) AS INT) + 4 * CAST(substr(b, i * 5 + 3, 1) AS INT) + 2 * CAST(substr(b, i * 5 + 4, 1) AS INT) + CAST(substr(b, i * 5 + 5, 1) AS INT) AS BIGINT), 1)), '') AS digest FROM bits),
groups AS (SELECT payload, max(page_id) AS keeper FROM p GROUP BY payload)
SELECT n.page_id, CAST(strlen(n.payload) AS BIGINT) AS payload_bytes, n.digest AS payload_digest, CASE WHEN n.page_id = g.keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n.page_id <> g.keeper THEN g.keeper END AS refers_to
FROM named n JOIN groups g USING (payload)""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, i + k AS pos FROM (SELECT r, i, unnest(range(0, 35)) AS k FROM windows JOIN repeated USING (s))),
words AS (SELECT r, pos, w[pos] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS pos FROM d)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN covered USING (r, pos) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (r)""",
}
