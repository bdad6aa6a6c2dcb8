"""Keeping the symbol cache and the definition index of a corpus up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import cache, parsing, symbols

SCHEMA_VERSION = 3  # 1 had no symbols of line-oriented languages and Ruby, 2 none of a text's second language


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def update(files: DataFrame, root: str) -> DataFrame:
    """Parses contents, texts of one language, that the last snapshot below ``root`` lacks, writes a new snapshot of their symbols and of files, rebuilds the
    index, and returns counts of created, removed, changed and unchanged files. A snapshot is a folder of its own and becomes the
    current one when its marker is written last, so a run that fails leaves the one before it. Contents that no file has any
    more aren't carried over; a snapshot of another schema version is not read."""
    spark = files.sparkSession
    hashed = files.where("text is not null").withColumn("file_hash", F.sha2("text", 256)).withColumn("content", F.concat_ws("|", "file_hash", "language"))
    number = 0
    while _exists(spark, f"{root}/{number}/done"):
        number += 1
    now, old = f"{root}/{number}", None
    current = hashed.select("path", "file_hash", "language", "content")
    if number:
        marker = spark.read.json(f"{root}/{number - 1}/done").first()
        old = f"{root}/{number - 1}" if marker.schema_version == SCHEMA_VERSION else None
    todo = hashed.dropDuplicates(["content"])
    if old is not None:
        todo = todo.join(spark.read.parquet(f"{old}/contents"), "content", "left_anti")
    todo.select("content").write.mode("overwrite").parquet(f"{now}/contents")
    fresh = parsing.symbols(todo.select(F.col("content").alias("path"), "text", "language")).withColumnRenamed("path", "content")
    fresh.write.mode("overwrite").parquet(f"{now}/symbols")
    if old is not None:
        alive = current.select("content").distinct()
        spark.read.parquet(f"{old}/contents").join(alive, "content", "left_semi").write.mode("append").parquet(f"{now}/contents")
        spark.read.parquet(f"{old}/symbols").join(alive, "content", "left_semi").write.mode("append").parquet(f"{now}/symbols")
    current.write.mode("overwrite").parquet(f"{now}/files")
    before = spark.read.parquet(f"{old}/files") if old is not None else current.limit(0)
    stats = cache.update_stats(before, spark.read.parquet(f"{now}/files"))
    symbols.write_index(symbol_table(spark, now), f"{now}/index")
    spark.createDataFrame([(SCHEMA_VERSION,)], "schema_version int").write.mode("overwrite").json(f"{now}/done")
    return stats


def symbol_table(spark: SparkSession, snapshot: str) -> DataFrame:
    return spark.read.parquet(f"{snapshot}/files").join(spark.read.parquet(f"{snapshot}/symbols"), "content").select("path", "symbol_idx", "kind", "name", "qualified_name", "start_line", "end_line")
