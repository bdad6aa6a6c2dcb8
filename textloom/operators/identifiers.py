"""Whole-identifier occurrences with byte-exact columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import line_hash
from textloom.sources.corpus import lines

_WORD = "([A-Za-z0-9_]+)"


def spans(text: Column) -> Column:
    """Array of (token, byte) of the runs of ASCII letters, digits and _ in order, bytes from 0."""
    words = F.regexp_extract_all(text, F.lit(_WORD), 1)
    gaps = F.split(text, "[A-Za-z0-9_]+", -1)
    return F.transform(words, lambda t, i: F.struct(t.alias("token"), (F.octet_length(F.array_join(F.slice(gaps, F.lit(1), i + 1), "")) + F.octet_length(F.array_join(F.slice(words, F.lit(1), i), ""))).alias("byte")))


def occurrences(files: DataFrame, name: str, hashed: bool = True) -> DataFrame:
    """(path, line, column, hash, text) of every whole occurrence of an identifier, strings and comments included.

    A file that doesn't contain the name as a substring is dropped before it is cut into lines, a line before it is
    cut into tokens, and only lines with a hit are hashed. ``column`` is the 1-based byte column."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError("an identifier has only ASCII letters, digits and _")
    hit = lambda c: F.contains(c, F.lit(name))
    rows = lines(files.where(hit(F.col("text")))).where(hit(F.col("text")))
    # the pieces between whole occurrences give the columns: running sums over the few hits of a line
    parts = F.split("text", rf"(?<![A-Za-z0-9_]){name}(?![A-Za-z0-9_])", -1)
    rows = rows.withColumn("p", parts).where(F.size("p") > 1)
    at = F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda x, i: F.octet_length(F.array_join(F.slice(F.col("p"), F.lit(1), i + 1), "")) + i * len(name.encode()) + 1).cast("array<int>")
    rows = rows.withColumn("hash", line_hash("text")) if hashed else rows
    return rows.select("path", "line", F.explode(at).alias("column"), *(["hash"] if hashed else []), "text")


def identifiers(rows: DataFrame) -> DataFrame:
    """(path, line, token) distinct tokens of each line."""
    return rows.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), 1))).alias("token"))
