"""The corpus pipeline: language ID, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as the next one's
``docs``. All but the last return the columns of documents. A stage works on all that the one before kept:

- language_id drops documents without letters or wholly in scripts that no labelled row uses, and writes the language found into ``lang``;
- line_dedup cuts lines that are equal to an earlier line or within two edits of one, and keeps every document;
- near_dedup keeps one document, the one with the smallest id, of each group of near-duplicates;
- substring_dedup cuts passages of 35 words that occur elsewhere, and keeps every document;
- packing tokenizes what is left and packs it into sequences of 2048 ids, each piece with its document's ``lang``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm._common import saved
from lumenframe.llm.language import language_stage
from lumenframe.llm.line_dedup import lines_stage
from lumenframe.llm.minhash import minhash_stage
from lumenframe.llm.packing import packed_query
from lumenframe.llm.queries import vocabulary
from lumenframe.llm.substring_dedup import substring_stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_stage(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_stage(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_stage(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_query(docs, vocabulary(), carry=("lang",))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]
#: None: language ID, near-dedup and packing cannot be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each one's result written to the shared scratch folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
