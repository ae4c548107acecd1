"""File sources: whole files, texts, lines with their numbers, and character dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.text import without_cr


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (path, content) with an outcome: an empty file is an I/O error; a missing path raises."""
    rows = spark.read.format("binaryFile").load(path)
    ok = F.col("length") > 0
    return rows.select("path", "length", "content", ok.alias("ok"), F.when(~ok, F.lit("kIOError")).alias("error_code"))


def file_bytes(spark: SparkSession, path: str) -> bytes:
    """One file on the driver, for models and configuration; raises where the file is missing or empty."""
    rows = read_files(spark, path).limit(2).collect()
    if len(rows) != 1 or not rows[0]["ok"]:
        raise OSError(f"kIOError: unable to read {path}")
    return bytes(rows[0]["content"])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) without carriage returns; a text always ends with a line feed."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), without_cr(F.col("value")).alias("text"))
    return rows.withColumn("text", F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n"))))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line): split at line feeds alone, blank lines kept, numbers from 0."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), without_cr(F.col("value")).alias("text"))
    body = F.when(F.col("text").endswith("\n"), F.substring("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))
    return rows.select("path", F.posexplode(F.split(body, "\n", -1)).alias("line_no", "line"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(idx, ch): a character for each line number."""
    return read_lines(spark, path).select(F.col("line_no").alias("idx"), F.col("line").alias("ch"))
