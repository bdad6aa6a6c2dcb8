"""Symbols of line-oriented languages, found with built-in expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: language -> (kind, pattern with the name as group 1)
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "markdown": [("heading", r"^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$")],
    "make": [("target", r"^([A-Za-z0-9_./%-]+)[ \t]*:(?:[^=]|$)")],
    "just": [("recipe", r"""^@?([A-Za-z_][A-Za-z0-9_-]*)(?:[ \t]+(?:[^:'"]|'[^']*'|"[^"]*")*)?:(?:[^=]|$)""")],
    "kconfig": [("config", r"^[ \t]*config[ \t]+([A-Za-z0-9_]+)"), ("menuconfig", r"^[ \t]*menuconfig[ \t]+([A-Za-z0-9_]+)"), ("menu", r'^[ \t]*menu[ \t]+"([^"]*)"')],
    "bash": [("function", r"^[ \t]*(?:function[ \t]+([A-Za-z_][A-Za-z0-9_:-]*)|([A-Za-z_][A-Za-z0-9_:-]*)[ \t]*\(\))")],
    "vimscript": [("function", r"^[ \t]*(?:export[ \t]+)?(?:fu|func|function|def)!?[ \t]+([A-Za-z_][A-Za-z0-9_:#.]*)")],
}


def symbols(rows: DataFrame, language: str) -> DataFrame:
    """(path, line, kind, name) of the declarations in (path, line, text)."""
    out = None
    for kind, pattern in PATTERNS[language]:
        groups = pattern.count("(") - pattern.count("(?") - pattern.count(r"\(")
        name = F.concat(*(F.regexp_extract("text", pattern, g) for g in range(1, groups + 1)))
        part = rows.where(F.col("text").rlike(pattern)).select("path", "line", F.lit(kind).alias("kind"), name.alias("name")).where("name <> ''")
        out = part if out is None else out.unionByName(part)
    return out


def heading_ranges(rows: DataFrame) -> DataFrame:
    """(path, line, level, name, end_line): Markdown headings to the line before the next one of the same or a higher rank."""
    pattern = PATTERNS["markdown"][0][1]
    heads = rows.where(F.col("text").rlike(pattern)).select("path", "line", F.char_length(F.regexp_extract("text", r"^ {0,3}(#{1,6})", 1)).alias("level"), F.regexp_extract("text", pattern, 1).alias("name"))
    ends = rows.groupBy("path").agg(F.max("line").alias("n"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.min(F.when(F.col("level") == k, F.col("line"))).over(w) for k in range(1, 7)]
    rows2 = heads.select("*", *(x.alias(f"next{k}") for k, x in enumerate(nexts, 1)))
    stop = F.least(F.lit(None).cast("int"), *(F.when(F.col("level") >= k, F.col(f"next{k}")) for k in range(1, 7)))
    return rows2.join(ends, "path").select("path", "line", "level", "name", F.coalesce(stop - 1, F.col("n")).alias("end_line"))
