"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that one task joins; a key with more is spread over several tasks.
SALT_ROWS = 100_000
HOT_KEYS = 10_000


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset a local session gets a folder of
    its own; a cluster session without it is refused, as executors would not see the same files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = getattr(spark.sparkContext, "_textloom_shared", None)
    if root is None:
        root = spark.sparkContext._textloom_shared = "file://" + tempfile.mkdtemp(prefix="textloom-")
    return root


class Workspace:
    """Tables of one run, written once as Parquet and read back, so that a lost executor costs at most
    the tasks since the last table and no lineage grows over iterations."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables = 0
        small_batches(spark)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.tables += 1
        at = f"{self.path}/{self.tables:03d}-{name}"
        df.write.mode("overwrite").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._textloom_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for table in tables:
            remove(self.spark, table._textloom_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], ws: Workspace, how: str = "inner", counts: DataFrame | None = None, most: int = SALT_ROWS) -> DataFrame:
    """``left`` joined with ``right``, which has each key at most once, by shuffle. A key with more than ``most`` rows of ``left``, and
    more than a ten thousandth of all, is spread over salts and its row of ``right`` repeated for each, so no task takes them all. There
    are fewer than 10,000 such keys, whatever the input: only these are broadcast. ``left`` should be a stored table; ``counts`` (keys,
    n) saves counting it."""
    counts = left.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(most, total // HOT_KEYS)
    if total <= limit:
        return left.join(right, keys, how)
    hot = ws.table(counts.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("salts")), "hot-keys")
    if hot.isEmpty():
        return left.join(right, keys, how)
    salts, salt = fresh(left, "join_salts"), fresh(left, "join_salt")
    hot = F.broadcast(hot.withColumnRenamed("salts", salts))
    a = left.join(hot, keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*(q(c) for c in left.columns)), q(salts)), F.lit(0)).cast("int")).drop(salts)
    b = right.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(q(salts) - 1, F.lit(0))))).drop(salts)
    return a.join(b, [*keys, salt], how).drop(salt)


def small_batches(spark: SparkSession) -> None:
    """Lets Python workers take 2,000 rows at a time instead of Spark's 10,000, which for long texts are tens of
    megabytes on both sides of the pipe; a session that sets the number itself keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def q(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def typed(df: DataFrame, *more: str) -> str:
    """The schema of ``df`` as text, with more columns behind."""
    return ", ".join([*(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}" for c in df.columns), *more])
