"""Results as an editor or a program reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, key: str = "path") -> DataFrame:
    """(path, json): one compact object a row; nulls are left out."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def nested(found: DataFrame, fields: list[str]) -> DataFrame:
    """(path, matches): each file's rows as a sorted array of structs."""
    return found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("matches"))


def compact_locations(found: DataFrame) -> DataFrame:
    """(path, line, column, hash, text, kind, name, qualified_name) of references with their symbol."""
    return found.select("path", "line", "column", "hash", "text", F.col("symbol_kind").alias("kind"), F.col("symbol_name").alias("name"), F.col("symbol_qualified_name").alias("qualified_name"))


def quickfix(found: DataFrame) -> DataFrame:
    """(entry) lines of the form path:line:column: text."""
    return found.select(F.format_string("%s:%d:%d: %s", "path", "line", "column", "text").alias("entry"))
