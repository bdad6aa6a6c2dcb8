"""Caches keyed by content: what is new, stale or missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def update_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """(created, removed, changed, unchanged) counts between two states of (path, file_hash)."""
    both = old.select("path", F.col("file_hash").alias("a")).join(new.select("path", F.col("file_hash").alias("b")), "path", "full")
    n = F.count_if
    return both.agg(n(F.col("a").isNull()).alias("created"), n(F.col("b").isNull()).alias("removed"), n(F.col("a") != F.col("b")).alias("changed"), n(F.col("a") == F.col("b")).alias("unchanged"))


def stale(cached: DataFrame, active: DataFrame) -> DataFrame:
    """Cached rows whose content no active file has."""
    return cached.join(active.select("file_hash").distinct(), "file_hash", "left_anti")


def missing(files: DataFrame, cached: DataFrame) -> DataFrame:
    """One file of each content that the cache doesn't have."""
    return files.join(cached.select("file_hash"), "file_hash", "left_anti").dropDuplicates(["file_hash"])


def fill(cached: DataFrame, fresh: DataFrame, key: list[str], tasks: list[str]) -> DataFrame:
    """The cache with tasks that it lacks (null: not run) filled from ``fresh``; what it has stays, also if it is empty."""
    a, b = cached.alias("a"), fresh.alias("b")
    return a.join(b, key, "full").select(*key, *(F.coalesce(F.col(f"a.{t}"), F.col(f"b.{t}")).alias(t) for t in tasks))


def tasks_to_run(wanted: DataFrame, cached: DataFrame, key: list[str], tasks: list[str]) -> DataFrame:
    """(key, task) rows that a wanted key lacks; only these reach a model."""
    flat = cached.select(*key, F.explode(F.array(*(F.when(F.col(t).isNotNull(), F.lit(t)) for t in tasks))).alias("task")).where("task is not null")
    every = wanted.select(*key, F.explode(F.array(*map(F.lit, tasks))).alias("task"))
    return every.join(flat, [*key, "task"], "left_anti")
