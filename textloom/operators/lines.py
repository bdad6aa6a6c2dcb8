"""Reading, searching and windowing lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import glob_pattern, line_hash
from textloom.sources.corpus import lines


def line_starts(files: DataFrame) -> DataFrame:
    """(path, line, text, start_byte), offsets in bytes of the normalized text."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines(files).select("path", "line", "text", F.coalesce(F.sum(F.octet_length("text") + 1).over(w), F.lit(0)).cast("long").alias("start_byte"))


def read_range(files: DataFrame, start: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    """(path, line, hash, text) of lines ``start`` (1) to ``end`` or of ``limit`` lines; ``end`` beyond the file is its last line.

    A start or limit below 1 and an end before the start are errors, as is end together with limit. A file that has
    fewer lines than ``start`` gives no line; ``range_errors`` lists it."""
    if start is not None and start < 1 or limit is not None and limit < 1:
        raise ValueError("lines count from 1")
    if end is not None and limit is not None:
        raise ValueError("give an end or a limit")
    first = start or 1
    last = first + limit - 1 if limit is not None else end
    if last is not None and last < first:
        raise ValueError("the end is before the start")
    rows = lines(files).where(F.col("line") >= first)
    rows = rows if last is None else rows.where(F.col("line") <= last)
    return rows.select("path", "line", line_hash("text").alias("hash"), "text")


def range_errors(files: DataFrame, start: int) -> DataFrame:
    """(path, line_count) of files that a range from ``start`` misses."""
    n = F.size(F.split("text", "\n", -1)) - F.when(F.endswith("text", F.lit("\n")) | (F.col("text") == ""), 1).otherwise(0)
    return files.select("path", n.alias("line_count")).where(F.col("line_count") < start)


def by_hash(rows: DataFrame, digits: Column) -> DataFrame:
    """(path, line) of the first line of each file with that hash, from (path, line, hash)."""
    return rows.where(F.col("hash") == digits).groupBy("path").agg(F.min("line").alias("line"))


def line_of_byte(offsets: DataFrame, starts: DataFrame) -> DataFrame:
    """(path, byte, line, column) of (path, byte): the line whose start is the last one at or before the byte, and the
    1-based byte column. A window over both, so no range join; bytes below 0 have no line."""
    both = starts.select("path", F.col("start_byte").alias("at"), F.lit(0).alias("kind"), "line", "start_byte").unionByName(offsets.select("path", F.col("byte").alias("at"), F.lit(1).alias("kind")), allowMissingColumns=True)
    w = Window.partitionBy("path").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("path", "kind", F.col("at").alias("byte"), F.last("line", True).over(w).alias("line"), F.last("start_byte", True).over(w).alias("s"))
    return found.where("kind = 1 and line is not null").select("path", "byte", "line", (F.col("byte") - F.col("s") + 1).alias("column"))


def grep(files: DataFrame, pattern: str, literal: bool = False, ignore_case: bool = False, glob: str | None = None) -> DataFrame:
    """(path, line, text) of matching lines; the file test runs before lines are made."""
    some = files if glob is None else files.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(glob_pattern(glob)) if "/" not in glob else F.col("path").rlike(glob_pattern(glob)))
    if literal:
        hit = lambda c: F.contains(F.lower(c), F.lit(pattern.lower())) if ignore_case else F.contains(c, F.lit(pattern))
        some = some.where(hit(F.col("text")))
    else:
        hit = lambda c: c.rlike(("(?i)" if ignore_case else "") + pattern)
    return lines(some).where(hit(F.col("text")))


def first_matches(found: DataFrame, limit: int = 100) -> DataFrame:
    """The first matches by path and line: each task sends no more than ``limit`` rows."""
    return found.orderBy("path", "line").limit(limit)


def summary(found: DataFrame) -> DataFrame:
    """(path, matches, total, files): matches a file, and over all."""
    each = found.groupBy("path").agg(F.count("*").alias("matches"))
    total = each.agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("total"), F.count("*").alias("files"))
    return each.crossJoin(total)


def with_context(rows: DataFrame, n: int) -> DataFrame:
    """(path, line, text, kind, gap) of matches (``hit``) and the lines up to ``n`` around them; ``gap`` marks a line with
    lines left out before it. ``rows`` holds all lines of the files."""
    w = Window.partitionBy("path").orderBy("line")
    near = rows.withColumn("near", F.max(F.col("hit").cast("int")).over(w.rangeBetween(-n, n))).where("near = 1")
    before = F.lag("line").over(w)
    return near.select("path", "line", "text", F.when(F.col("hit"), "match").otherwise("context").alias("kind"), F.coalesce(F.col("line") - before > 1, F.lit(False)).alias("gap"))


def merge_ranges(ranges: DataFrame, gap: int) -> DataFrame:
    """(path, start_line, end_line, parts): ranges that start within ``gap`` lines of the furthest end before become one."""
    w = Window.partitionBy("path").orderBy("start_line", "end_line")
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = ranges.withColumn("new", F.when(F.col("start_line") <= F.max("end_line").over(back) + gap, 0).otherwise(1))
    island = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("path", "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("parts")).drop("island")


def capped(found: DataFrame, most: int = 10, above: int = 50) -> DataFrame:
    """(path, line, text, hidden): ``most`` matches a file once there are more than ``above`` in all; ``hidden`` are left out of the file."""
    total = found.agg(F.count("*").alias("total"))
    rows = found.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line"))).withColumn("c", F.count("*").over(Window.partitionBy("path"))).crossJoin(total)
    hidden = F.when(F.col("total") > above, F.greatest(F.lit(0), F.col("c") - most)).otherwise(0)
    return rows.where((F.col("total") <= above) | (F.col("n") <= most)).select("path", "line", "text", hidden.cast("long").alias("hidden"))


def head_budget(rows: DataFrame, max_lines: int, max_bytes: int) -> DataFrame:
    """The first lines of each file that stay within both budgets, a line break counted with each line but the first."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    used = rows.withColumn("used", F.sum(F.octet_length("text") + 1).over(w) - 1).withColumn("n", F.count("*").over(w))
    return used.where((F.col("n") <= max_lines) & (F.col("used") <= max_bytes)).select("path", "line", "text", F.col("used").cast("long").alias("used_bytes"))
