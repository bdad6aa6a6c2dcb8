"""Passing over the rows of one file after another, in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH = 8192


def by_file(rows: DataFrame, order: list[str], work: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """(path, *row) of ``schema`` for the rows that ``work`` makes of each file's rows (path, ...), which come sorted by ``order``; those without a path are
    left out. One shuffle; Python holds a batch of rows and what ``work`` keeps."""
    # the hash first, as it tells files apart without comparing their paths
    mine = rows.where("path is not null").repartition("path").sortWithinPartitions(F.xxhash64("path"), "path", *order)
    mine = mine.select("path", *(c for c in rows.columns if c != "path"))
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        made = []
        for path, group in groupby(each, itemgetter(0)):
            for x in work(group):
                made.append((path, *x))
                if len(made) == BATCH:
                    yield _batch(made, out_schema)
                    made = []
        if made:
            yield _batch(made, out_schema)

    return mine.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
