"""The document store: documents, nodes and assets as tables partitioned by document."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import short_id
from textloom.operators.outline import invalid_assets

SCHEMA_VERSION = 1
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp"}


def write(documents: DataFrame, nodes: DataFrame, assets: DataFrame, root: str) -> None:
    """Replaces what the store has of the given documents (doc_id) and nothing else. Assets with a path that leaves the store or half
    a box are an error before anything is written."""
    bad = invalid_assets(assets).select("doc_id", "path").first()
    if bad is not None:
        raise ValueError(f"asset {bad.path!r} of document {bad.doc_id!r} can't be stored")
    for name, table in (("documents", documents.withColumn("schema_version", F.lit(SCHEMA_VERSION))), ("nodes", nodes), ("assets", assets)):
        table.repartition("doc_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, doc_id: str | None = None) -> dict[str, DataFrame]:
    """The three tables, of one document if asked for: then one folder of each is listed. Documents of another schema version are left out."""
    out = {n: spark.read.parquet(f"{root}/{n}") for n in ("documents", "nodes", "assets")}
    if doc_id is not None:
        out = {n: t.where(F.col("doc_id") == doc_id) for n, t in out.items()}
    out["documents"] = out["documents"].where(F.col("schema_version") == SCHEMA_VERSION)
    return out


def asset_ids(assets: DataFrame) -> DataFrame:
    """Adds ``id`` from document, page and paint order (doc_id, page, position)."""
    return assets.withColumn("id", short_id("a", F.col("doc_id"), F.col("page"), F.col("position")))


def write_files(assets: DataFrame, folder: str) -> DataFrame:
    """Writes (id, mime, content) as files named by id and returns (id, path), once each is there. A repeated task writes the same
    bytes to the same name; rows of an unknown type or no content are left out."""

    def work(batches):
        where, at = fs.FileSystem.from_uri(folder)
        where.create_dir(at, recursive=True)
        for batch in batches:
            ids, paths = [], []
            for i, mime, content in zip(*(c.to_pylist() for c in batch.columns)):
                if mime in EXTENSIONS and content is not None:
                    name = f"{i}.{EXTENSIONS[mime]}"
                    with where.open_output_stream(f"{at}/{name}", compression=None) as out:
                        out.write(content)
                    ids.append(i)
                    paths.append(name)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "path": pa.array(paths, pa.string())})

    written = assets.select("id", "mime", "content").mapInArrow(work, "id string, path string").collect()
    return assets.sparkSession.createDataFrame([(r.id, r.path) for r in written], "id string, path string")
