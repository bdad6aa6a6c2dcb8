"""Renaming an identifier over a corpus: plan, checks, digest, application."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import line_hash
from textloom.operators.identifiers import occurrences


def plan(files: DataFrame, old: str, new: str, excluded: DataFrame | None = None) -> DataFrame:
    """(path, line, start_column, end_column, hash) of every occurrence to change, byte columns; ``excluded`` (path, line, column) are
    left alone, such as local names that only look the same."""
    if not re.fullmatch(r"[^\W\d]\w*", new) or old == new:
        raise ValueError("the new name must be another plain identifier")
    found = occurrences(files, old)
    if excluded is not None:
        found = found.join(excluded, ["path", "line", "column"], "left_anti")
    return found.select("path", "line", F.col("column").alias("start_column"), (F.col("column") + len(old.encode())).alias("end_column"), "hash")


def conflicts(edits: DataFrame, files: DataFrame, new: str) -> DataFrame:
    """(path, line, column) where the new name already stands in a file to be edited."""
    return occurrences(files, new, hashed=False).join(edits.select("path").distinct(), "path", "left_semi").select("path", "line", "column")


def totals(edits: DataFrame, clashes: DataFrame) -> DataFrame:
    e = edits.agg(F.count("*").alias("edits"), F.countDistinct("path").alias("files"))
    return e.crossJoin(clashes.agg(F.count("*").alias("conflicts")))


def plan_hash(edits: DataFrame) -> DataFrame:
    """(path, plan_hash): digest of each file's sorted edits; the digest of these in order of path is the plan's."""
    row = F.format_string("%d:%d:%d:%s", "line", "start_column", "end_column", "hash")
    return edits.groupBy("path").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "start_column", row.alias("r")))), lambda x: x.r), "\n"), 256).alias("plan_hash"))


def apply(files: DataFrame, edits: DataFrame, old: str, new: str) -> DataFrame:
    """(path, new_text) of files whose planned lines still have the planned hash; files with any other line are left out.

    ``edits`` is a plan; lines are rebuilt from byte ranges, so an excluded occurrence on the same line stays."""
    planned = edits.groupBy("path", "line").agg(F.array_sort(F.collect_list("start_column")).alias("at"), F.min("hash").alias("want"))
    pieces = F.split("text", "\n", -1)
    rows = files.join(edits.select("path").distinct(), "path", "left_semi").select("path", F.posexplode(pieces).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")
    both = rows.join(planned, ["path", "line"], "left")
    raw = F.col("text").cast("binary")
    cuts = F.transform("at", lambda a, i: F.concat(F.substring(raw, F.when(i == 0, F.lit(1)).otherwise(F.get("at", i - 1) + len(old.encode())), a - F.when(i == 0, F.lit(1)).otherwise(F.get("at", i - 1) + len(old.encode()))).cast("string"), F.lit(new)))
    tail = F.substring(raw, F.element_at("at", -1) + len(old.encode()), F.octet_length("text")).cast("string")
    changed = F.when(F.col("at").isNull(), F.col("text")).otherwise(F.concat(F.array_join(cuts, ""), tail))
    ok = F.col("want").isNull() | (line_hash("text") == F.col("want"))
    out = both.select("path", "line", changed.alias("text"), ok.alias("ok"))
    return out.groupBy("path").agg(F.bool_and("ok").alias("ok"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x.text), "\n").alias("new_text")).where("ok").drop("ok")
