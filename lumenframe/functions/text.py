"""String expressions: line handling, class names from model metadata, labels and options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_cr(s: Column) -> Column:
    return F.regexp_replace(s, "\r", "")


def one_line(s: Column) -> Column:
    """For log records: neither carriage returns nor line feeds."""
    return F.translate(s, "\r\n", "")


def class_names(metadata: Column) -> Column:
    """Everything between single quotes, in order; the place in the array is the class id."""
    return F.regexp_extract_all(metadata, F.lit("'([^']+)'"), 1)


def label(name: Column, confidence: Column) -> Column:
    """Caption of a box: the name and the percentage with six decimals."""
    return F.format_string("%s (%.6f%%)", name, confidence.cast("double") * 100)


def option(options: Column, key: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(options, F.lit(key)), F.lit(default))


def with_option(options: Column, key: str, default: str) -> Column:
    """The map with the default put in where the key is missing."""
    return F.when(F.map_contains_key(options, key), options).otherwise(F.map_concat(options, F.create_map(F.lit(key), F.lit(default))))


def leading_int(s: Column) -> Column:
    """An integer at the start of a string, after white space; NULL if there is none or it does not fit."""
    return F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("int")


def one_of(s: Column, names: list[str]) -> Column:
    """The name if it is exactly one of these, else NULL."""
    return F.when(s.isin(names), s)


def access_line(ip: Column, port: Column, url: Column) -> Column:
    return F.format_string("%s:%d -> %s", ip, port, url)


def text_line(r: Column, confidence: Column, line: Column) -> Column:
    """A recognised line for the console: rectangle, confidence and text."""
    return F.concat_ws(" ", *(r[c].cast("string") for c in "xywh"), confidence.cast("string"), line)
