"""Document trees: selection, order and rendering.

Nodes have (doc_id, position, id, parent_id, kind, title, page).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import compact

def paths(nodes: DataFrame, levels: int | None = None) -> DataFrame:
    """Nodes with ``depth`` (0 for roots) and ``path``, the positions from the root down; nodes without a way to a root, those on a cycle
    among them, are dropped. With ``levels`` nodes of that depth and below are left out.

    Each level is joined on (doc_id, parent_id) with the one above alone, which is kept for that, until a level is empty."""
    level = nodes.where("parent_id is null").withColumn("depth", F.lit(0)).withColumn("path", F.array(F.col("position").cast("long"))).persist()
    out, d = level, 1
    while levels is None or d < levels:
        above = level.select("doc_id", F.col("id").alias("parent_id"), F.col("path").alias("above"))
        level = nodes.join(above, ["doc_id", "parent_id"]).select(*(F.col(c) for c in nodes.columns), F.lit(d).alias("depth"), F.concat("above", F.array(F.col("position").cast("long"))).alias("path")).persist()
        if level.isEmpty():
            level.unpersist()
            break
        out, d = out.unionByName(level), d + 1
    return out


def preorder(placed: DataFrame) -> DataFrame:
    """Adds ``number``: place in the depth-first order of the document, from 0."""
    return placed.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1)


def select(placed: DataFrame, kinds: list[str] | None = None, page: int | None = None, depth: int | None = None, outline: bool = False) -> DataFrame:
    """Nodes of some kinds, page and depth; a page leaves outline sections out unless ``outline``. A parent that isn't among them
    is null."""
    keep = F.lit(True)
    keep = keep if kinds is None else keep & F.col("kind").isin(kinds)
    keep = keep if page is None else keep & (F.col("page") == page) & (F.lit(outline) | (F.col("kind") != "section"))
    keep = keep if depth is None else keep & (F.col("depth") <= depth)
    kept = placed.where(keep)
    ids = kept.select("doc_id", F.col("id").alias("parent_id"), F.lit(True).alias("there"))
    return kept.join(ids, ["doc_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("there"), F.col("parent_id"))).drop("there")


def overview(nodes: DataFrame) -> DataFrame:
    """(doc_id, kind): what an overview of the document shows: sections, else structural sections, else pages."""
    rank = F.when(F.col("kind") == "section", 0).when(F.col("kind") == "structural_section", 1).when(F.col("kind") == "page", 2)
    best = nodes.groupBy("doc_id").agg(F.min(rank).alias("r"))
    return best.select("doc_id", F.element_at(F.array(F.lit("section"), F.lit("structural_section"), F.lit("page")), F.col("r") + 1).alias("kind")).where("kind is not null")


def subtree(placed: DataFrame, root: DataFrame) -> DataFrame:
    """Nodes at or below the nodes (doc_id, id) of ``root``."""
    top = placed.join(root, ["doc_id", "id"], "left_semi").select("doc_id", F.col("path").alias("top"))
    return placed.join(top, "doc_id").where(F.slice("path", F.lit(1), F.size("top")) == F.col("top")).drop("top").dropDuplicates(["doc_id", "id"])


def heading_parents(headings: DataFrame, levels: int = 6) -> DataFrame:
    """(doc_id, position, level, parent_position): the nearest heading before with a lower level. One ordered pass: the last place of
    each lower level, and the latest of these."""
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == n, F.col("position"))).over(w) for n in range(1, levels)]
    rows = headings.select("doc_id", "position", "level", *(x.alias(f"at{n}") for n, x in enumerate(last, 1)))
    above = F.greatest(F.lit(None).cast("int"), *(F.when(F.col("level") > n, F.col(f"at{n}")) for n in range(1, levels)))
    return rows.select("doc_id", "position", "level", above.alias("parent_position"))


def render(placed: DataFrame) -> DataFrame:
    """(doc_id, text): the titles of a document in depth-first order, two blanks a level, with their page."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), compact(F.coalesce("title", F.lit(""))), F.when(F.col("page").isNotNull(), F.concat(F.lit(" (p. "), F.col("page").cast("string"), F.lit(")"))).otherwise(""))
    return placed.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("l")))), lambda x: x.l), "\n").alias("text"))


def tagged_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text): pages in order, each behind its tag."""
    one = F.concat(F.lit("<page number=\""), F.col("page").cast("string"), F.lit("\">\n"), "text", F.lit("\n</page>"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", one.alias("t")))), lambda x: x.t), "\n").alias("text"))


def invalid_assets(assets: DataFrame) -> DataFrame:
    """Assets with an absolute path, one that climbs out, or a box that isn't whole."""
    box = [F.col(c).isNull() for c in ("x", "y", "width", "height")]
    some, whole = ~(box[0] & box[1] & box[2] & box[3]), ~(box[0] | box[1] | box[2] | box[3])
    return assets.where(F.startswith("path", F.lit("/")) | F.array_contains(F.split("path", "/"), "..") | (some & ~whole))
