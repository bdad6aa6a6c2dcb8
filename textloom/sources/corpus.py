"""Files, lines and symbols as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import normalize, split_lines


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, language) of each document, normalized."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), normalize(F.col("text")).alias("text"), F.col("lang").alias("language"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return pages.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), normalize(F.col("html")).alias("text"), F.lit("html").alias("language"))


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return turns.select(F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("path"), "turn", "role", normalize(F.col("text")).alias("text"))


def chat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each conversation: its turns in order, a line break between two."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return chat_turns(spark, sf_dir).groupBy("path").agg(F.array_join(F.transform(rows, lambda r: r.text), "\n").alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text), lines from 1."""
    cut = files.select("path", split_lines(F.col("text")).alias("l"))
    return cut.select("path", F.posexplode("l").alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")


def chat_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each turn and one for each whole conversation: (path, symbol_idx, kind, name, qualified_name, start_line, end_line)."""
    turns = chat_turns(spark, sf_dir).withColumn("n", F.size(F.split("text", "\n", -1)))
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "n")))
    packed = turns.groupBy("path").agg(rows.alias("t"))
    total = F.aggregate("t", F.lit(0), lambda a, r: a + r.n)
    ends = F.transform("t", lambda r, i: F.struct(r.turn.alias("turn"), r.role.alias("role"), r.n.alias("n"), F.aggregate(F.slice(F.col("t"), F.lit(1), i + 1), F.lit(0), lambda a, x: a + x.n).alias("e")))
    one = packed.select("path", F.lit(0).alias("symbol_idx"), F.lit("conversation").alias("kind"), F.lit("conversation").alias("name"), F.lit("conversation").alias("qualified_name"), F.lit(1).alias("start_line"), total.alias("end_line"))
    each = packed.select("path", F.posexplode(ends).alias("i", "r")).select("path", (F.col("i") + 1).alias("symbol_idx"), F.col("r.role").alias("kind"), F.concat(F.lit("turn_"), F.col("r.turn").cast("string")).alias("name"), F.concat(F.lit("conversation.turn_"), F.col("r.turn").cast("string")).alias("qualified_name"), (F.col("r.e") - F.col("r.n") + 1).alias("start_line"), F.col("r.e").alias("end_line"))
    return one.unionByName(each)


def block_symbols(files: DataFrame) -> DataFrame:
    """Nested ranges over any file: the whole, sections of ten lines, blocks of three within a section."""
    n = files.select("path", F.size(split_lines(F.col("text"))).alias("n")).where("n > 0")
    ranges = "transform(sequence(0, (n - 1) div {0}), k -> named_struct('kind', '{1}', 'start_line', k * {0} + 1, 'end_line', least(n, (k + 1) * {0})))"
    blocks = "transform(filter(sequence(0, n - 1), k -> k % 10 % 3 = 0), k -> named_struct('kind', 'block', 'start_line', k + 1, 'end_line', least(n, k + 3, (k div 10 + 1) * 10)))"
    whole = "array(named_struct('kind', 'file', 'start_line', 1, 'end_line', n))"
    out = n.select("path", F.posexplode(F.expr(f"concat({whole}, {ranges.format(10, 'section')}, {blocks})")).alias("symbol_idx", "s"))
    name = F.concat(F.col("s.kind"), F.lit("_"), F.col("s.start_line").cast("string"))
    section = F.concat(F.lit("section_"), ((F.col("s.start_line") - 1 - (F.col("s.start_line") - 1) % 10) + 1).cast("string"))
    qualified = F.when(F.col("s.kind") == "file", name).when(F.col("s.kind") == "section", F.concat(F.lit("file_1."), name)).otherwise(F.concat(F.lit("file_1."), section, F.lit("."), name))
    return out.select("path", "symbol_idx", F.col("s.kind").alias("kind"), name.alias("name"), qualified.alias("qualified_name"), F.col("s.start_line").cast("int").alias("start_line"), F.col("s.end_line").cast("int").alias("end_line"))
