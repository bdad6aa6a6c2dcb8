"""One request of edits on a table of files: symbols first, then anchored edits, then plain replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import anchored as A
from textloom.operators import edits as E
from textloom.operators import parsing
from textloom.operators import symbols as Y


def _take(files: DataFrame, changed: DataFrame) -> DataFrame:
    new = changed.where("new_text is not null").select("path", "new_text")
    return files.join(new, "path", "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def run(files: DataFrame, bodies: DataFrame | None = None, anchored: DataFrame | None = None, replace: tuple[str, str, bool] | None = None, syntax: str = "warn") -> DataFrame:
    """(path, new_text, warning) of files (path, text, language) that change. Anchors refer to the text after symbols were replaced; a file
    whose anchors fail keeps its text in that step. Files that end as they were aren't listed."""
    now = files
    if bodies is not None:
        now = _take(now, Y.replace(now.select("path", "text"), parsing.symbols(now), bodies))
    if anchored is not None:
        now = _take(now, A.apply(now.select("path", "text"), anchored))
    if replace is not None:
        now = _take(now, E.replace_text(now, *replace))
    changed = now.join(files.select("path", F.col("text").alias("before")), "path").where("not text <=> before")
    worse = parsing.regressions(parsing.diagnostics(files), parsing.diagnostics(changed.drop("before")))
    return E.syntax_gate(changed.select("path", F.col("text").alias("new_text")), worse, syntax)
