"""Streams: indexing new content as it comes, and what a session has seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators import cache


def index_new_content(files: DataFrame, index: str, checkpoint: str, work) -> StreamingQuery:
    """Runs ``work`` on each content (path, text) of a stream that the index doesn't have yet and appends its rows, with file_hash.

    A batch that is run again after a failure replaces its own folder, so each content is indexed once."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        hashed = df.where("text is not null").withColumn("file_hash", F.sha2("text", 256)).dropDuplicates(["file_hash"])
        known = known_hashes(spark, index, number)
        fresh = hashed if known is None else cache.missing(hashed, known)
        out = work(fresh)
        out.write.mode("overwrite").parquet(f"{index}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def known_hashes(spark: SparkSession, index: str, before: int) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(index)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [f"{index}/batch={n}" for n in range(before) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{index}/batch={n}"))]
    return spark.read.parquet(*done).select("file_hash").distinct() if done else None


def session_state(events: DataFrame) -> DataFrame:
    """(session, path, fresh): whether a session's last action on a file leaves its anchors good: a read anchors, an edit forgets."""
    w = Window.partitionBy("session", "path").orderBy(F.desc("seq"))
    last = events.withColumn("n", F.row_number().over(w)).where("n = 1")
    return last.select("session", "path", (F.col("action") == "anchor").alias("fresh"))


def session_state_stream(events: DataFrame) -> DataFrame:
    """The same over a stream: the last action by ``seq``, kept as one aggregate a key."""
    return events.groupBy("session", "path").agg((F.max_by("action", "seq") == "anchor").alias("fresh"))
