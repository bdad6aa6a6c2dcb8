"""A Bloom filter of bounded size, tested where rows lie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .kernel import mix64

#: 128 MiB at most, whatever the number of keys; beyond 10^8 keys more rows pass the filter, and the exact join behind it tells them apart.
MAX_BITS = 1 << 30
_U = np.uint64


def positions(keys: np.ndarray, mask: int) -> Iterator[np.ndarray]:
    """The four bits of each key."""
    a = mix64(keys.astype(np.int64).view(_U))
    b = mix64(a) | _U(1)
    for i in range(4):
        yield (a + _U(i) * b) & _U(mask)


class Bloom:
    """Keys are longs. A row that the filter lets go surely has none of them and needs no shuffle; the others go to an exact join."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.mask = len(words) * 64 - 1

    def hit(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in positions(keys, self.mask):
            out &= (self.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1
        return out

    def column(self, key: Column) -> Column:
        """Whether a row may have one of the keys; only the key goes to Python. A null hasn't."""

        def test(x: pd.Series) -> pd.Series:
            there = x.notna().to_numpy()
            return pd.Series(self.hit(x.fillna(0).to_numpy().astype(np.int64)) & there)

        return F.pandas_udf(test, BooleanType())(key)

    @staticmethod
    def of(keys: DataFrame, column: str) -> Bloom:
        """The filter of a stored table's keys: ten bits a key up to ``MAX_BITS``, set in every partition and joined by word, so the
        driver receives no more than the filter itself."""
        n = keys.count()
        size = 1 << min(MAX_BITS.bit_length() - 1, max(16, (10 * n).bit_length()))
        out, mask = np.zeros(size // 64, _U), size - 1
        if not n:
            return Bloom(out)

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = np.unique(np.concatenate(list(positions(batch.column(0).to_numpy(zero_copy_only=False), mask))))
                word, first = np.unique(bits >> _U(6), return_index=True)
                value = np.bitwise_or.reduceat(_U(1) << (bits & _U(63)), first) if len(bits) else np.zeros(0, _U)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(value.view(np.int64))], ["w", "v"])

        found = keys.select(column).where(F.col(column).isNotNull()).mapInArrow(words, "w int, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
        out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(_U)
        return Bloom(out)
