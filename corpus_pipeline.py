"""A corpus pipeline of five stages over the documents table.

quality classifier -> exact dedup -> SimHash near-dedup -> mixing to target weights -> SentencePiece.
Each stage reads all that its predecessor kept, as a table, and all but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import chunks, mixing, pieces, quality, simhash
from textloom.llm.workspace import Workspace, fresh, q


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; null texts go."""
    return quality.keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The lowest doc_id of each text."""
    return chunks.drop_duplicates(docs, "doc_id", "text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs, "doc_id", "text")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in target proportions: repeated by epoch, the last one of a source cut to its budget (its first
    tokens, single blanks between, n_chars to match); documents without tokens go."""
    n, epoch, start, take = (fresh(docs, x) for x in ("mixing_tokens", "epoch", "start", "take"))
    mixed = mixing.mix(docs.withColumn(n, mixing.token_count(F.col("text"))), "source", n, "doc_id")
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([^ \t\n\r\f\x0B]+)"), 1)
    cut = q(take) < q(n)
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), q(take).cast("int")), " ")).otherwise(F.col("text"))
    out = mixed.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(q(c) for c in docs.columns))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its piece ids, their number, and whether they decode to its text."""
    return pieces.encode(docs, "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: The Gumbel noise, the fingerprints and the Viterbi search have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet in the shared folder and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = ws.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            ws.drop(before)
        before = docs
    return docs
