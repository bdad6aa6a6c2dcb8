"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom
from .kernel import Words, blocks, buffers, mix64, signed
from .workspace import Workspace, fresh, q, skew_join, typed

WINDOW = 48
MASK_BITS = 11
MIN_BYTES, MAX_BYTES = 512, 16384
_U = np.uint64


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the content-defined chunks of a block of texts, in order.

    A chunk ends where the hash of the last 48 bytes has 11 zero bits (2 KiB apart on average), at least
    512 and at most 16,384 bytes from its start, and at the end of its text: the cuts depend on the
    text alone. An empty text has no chunk."""
    n = len(data)
    p = Words.powers
    p.reach(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * p.up[:n], out=sums[1:])
    ends: list[int] = []
    if n >= WINDOW:
        rolled = (sums[WINDOW:] - sums[:-WINDOW]) * p.down[: n - WINDOW + 1]
        candidates = np.flatnonzero((mix64(rolled) & _U((1 << MASK_BITS) - 1)) == 0) + WINDOW
    else:
        candidates = np.zeros(0, np.int64)
    starts: list[int] = []
    low = np.searchsorted(candidates, offsets)
    cuts = candidates.tolist()
    for i in range(len(offsets) - 1):
        at, stop = int(offsets[i]), int(offsets[i + 1])
        j, last = int(low[i]), int(low[i + 1])
        first = at
        while at < stop:
            while j < last and (cuts[j] < at + MIN_BYTES or cuts[j] < first + WINDOW):
                j += 1
            end = min(stop, at + MAX_BYTES, cuts[j] if j < last else stop)
            starts.append(at)
            ends.append(end)
            at = end
    s, e = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    return s, e, mix64((sums[e] - sums[s]) * p.down[s] + (e - s).astype(_U))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets, valid = buffers(batch.column(column))
    for a, b, d, o in blocks(data, offsets):
        yield a, b, d, o, valid[a:b]


def recipe_hashes(column: pa.Array, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each text's recipe, that is of its chunks' hashes in order and their number; which texts aren't null).
    ``bits`` cuts all hashes; only tests give fewer, so that unequal contents meet."""
    low = _U((1 << bits) - 1)
    out, there = [np.zeros(0, _U)], [np.zeros(0, bool)]
    data, offsets, valid = buffers(column)
    for a, b, d, o in blocks(data, offsets):
        s, _, h = chunk_bounds(d, o)
        doc = np.searchsorted(o, s, "right") - 1
        first = np.searchsorted(doc, np.arange(len(o)))
        # order-sensitive within each text: position in the recipe scales every chunk hash
        at = np.arange(len(s)) - first[doc]
        total = np.zeros(len(o) - 1, _U)
        np.add.at(total, doc, mix64((h & low) + mix64(at.astype(_U) + _U(1))))
        out.append(mix64(total + np.diff(first).astype(_U)) & low)
        there.append(valid[a:b])
    return np.concatenate(out), np.concatenate(there)


def recipes_only(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, valid = recipe_hashes(batch.column(0), bits)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h), mask=~valid)], ["recipe"])

    return rows


def suspected(bloom: Bloom, there: bool, bits: int):
    """Rows of (..., text) whose recipe the filter may have, with the recipe in place of the last column; or the rows that it
    surely lacks, null texts among them, without it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, valid = recipe_hashes(batch.column(batch.num_columns - 1), bits)
            hit = bloom.hit(signed(h)) & valid
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(signed(h))] if there else []
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))]).filter(pa.array(hit if there else ~hit))

    return rows


def chunk_lists(bits: int):
    """Replaces the text in (row, ident, recipe, text) by the list of its chunks' hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = _U((1 << bits) - 1)
        for batch in batches:
            hashes, sizes = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
            for _, _, d, o, _ in _texts(batch, 3):
                s, _, h = chunk_bounds(d, o)
                hashes.append(signed(h & low))
                sizes.append(np.bincount(np.searchsorted(o, s, "right") - 1, minlength=len(o) - 1))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(hashes)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), lists], ["row", "ident", "recipe", "chunks"])

    return rows


def chunk_rows(bits: int):
    """(row, position, hash, content) of every chunk of (row, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = _U((1 << bits) - 1)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, d, o, _ in _texts(batch, 1):
                s, e, h = chunk_bounds(d, o)
                doc = np.searchsorted(o, s, "right") - 1
                first = np.searchsorted(doc, np.arange(len(o)))
                raw = d.tobytes()
                content = pa.array([raw[x:y] for x, y in zip(s.tolist(), e.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + doc]), pa.array((np.arange(len(s)) - first[doc]).astype(np.int32)), pa.array(signed(h & low)), content], ["row", "position", "hash", "content"])

    return rows


class Copies:
    """Rows that may be copies, and what each is a copy of.

    Step 1 hashes each text's recipe where the text lies; only the hash moves, and hashes that occur once settle their rows. Step 2:
    rows that pass a Bloom filter of the repeated hashes are stored with a row number; all others stay where they are. Step 3:
    the suspects' chunks are grouped by hash and content, so a shuffle carries each distinct chunk of a map task once. A hash with one
    content is a verified identifier; where contents meet in a hash, each gets its first place as a second part of the identifier.
    Step 4 compares the ordered lists of identifiers: equal lists are equal texts."""

    def __init__(self, df: DataFrame, ident: str, text: str, bits: int = 64) -> None:
        self.ws = ws = Workspace(df.sparkSession, "chunks")
        self.df, self.text, self.bits = df, text, bits
        self.row, self.recipe = fresh(df, "copy_row"), fresh(df, "copy_recipe")
        hashes = df.select(q(text)).mapInArrow(recipes_only(bits), "recipe long").where("recipe is not null")
        repeated = ws.table(hashes.groupBy("recipe").agg(F.count("*").alias("n")).where("n > 1").select("recipe"), "repeated-recipes")
        self.bloom = Bloom.of(repeated, "recipe")
        marked = self._scan(True).withColumn(self.row, F.monotonically_increasing_id())
        self.suspects = ws.table(marked, "suspects")
        kind = df.schema[ident].dataType.simpleString()
        lists = self.suspects.select(q(self.row).alias("row"), q(ident).alias("ident"), q(self.recipe).alias("recipe"), q(text).alias("text")).mapInArrow(chunk_lists(bits), f"row long, ident {kind}, recipe long, chunks array<long>")
        lists = self._told_apart(ws.table(lists, "recipes"))
        order = F.struct(F.col("ident").isNull().alias("void"), "ident", "row")
        # the shortest form of a group: one row a text, however many copies it has
        first = ws.table(lists.groupBy("recipe", "chunks", "apart").agg(F.min(order).alias("first"), F.count("*").alias("n")), "first-copies")
        groups = skew_join(lists, first.drop("n"), ["recipe", "chunks", "apart"], ws, counts=first.select("recipe", "chunks", "apart", "n"))
        self.groups = groups.select("row", "ident", F.col("first.row").alias("first_row"), F.col("first.ident").alias("first_ident"))

    def _scan(self, there: bool) -> DataFrame:
        df = self.df.select(*(q(c) for c in self.df.columns), q(self.text).alias(self.recipe))
        schema = typed(self.df, f"`{self.recipe}` long") if there else typed(self.df)
        return df.mapInArrow(suspected(self.bloom, there, self.bits), schema)

    def _told_apart(self, lists: DataFrame) -> DataFrame:
        """Adds ``apart``: for lists with a hash that several contents have, which of them stands where; empty for all others."""
        parts = self.suspects.select(q(self.row).alias("row"), q(self.text).alias("text")).mapInArrow(chunk_rows(self.bits), "row long, position int, hash long, content binary")
        met = parts.groupBy("hash", "content").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
        met = self.ws.table(met, "hashes-of-several")
        none = F.array().cast("array<struct<position:int,row:bigint,at:int>>")
        if met.isEmpty():
            return lists.withColumn("apart", none)
        parts = self.ws.table(parts.join(met, "hash"), "chunks-of-several")
        names = self.ws.table(parts.groupBy("hash", "content").agg(F.min(F.struct("row", "position")).alias("f"), F.count("*").alias("n")), "names")
        named = skew_join(parts, names.drop("n"), ["hash", "content"], self.ws, counts=names.select("hash", "content", "n"))
        apart = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("position", F.col("f.row").alias("row"), F.col("f.position").alias("at")))).alias("apart"))
        return self.ws.table(lists.join(apart, "row", "left").withColumn("apart", F.coalesce("apart", none)), "told-apart")

    def kept(self) -> DataFrame:
        """All rows but the further copies: those that no suspect is among stream through from the input."""
        gone = self.ws.table(self.groups.where("row <> first_row").select(F.col("row").alias(self.row)), "dropped-rows")
        stay = self.suspects.join(gone, self.row, "left_anti").select(*(q(c) for c in self.df.columns))
        return self._scan(False).unionByName(stay)


def duplicates(df: DataFrame, ident: str, text: str, bits: int = 64) -> DataFrame:
    """(doc_id, first_doc_id) of each row whose text an earlier row has byte for byte; earlier means a lower ident,
    nulls last. The first of each group isn't listed. Repeated rows of one ident are copies too and give
    a pair of equal ids. A null text is no copy of anything; empty texts are copies of each other. Very long texts are cut into
    chunks like others; other columns, whatever their names, take no part. An empty table has no copies. ``ident`` may
    have any type that can be ordered."""
    slim = df.select(q(ident).alias("doc_id"), q(text).alias("text"))
    return Copies(slim, "doc_id", "text", bits).groups.where("row <> first_row").select(F.col("ident").alias("doc_id"), F.col("first_ident").alias("first_doc_id"))


def drop_duplicates(df: DataFrame, ident: str, text: str, bits: int = 64) -> DataFrame:
    """``df`` without the rows that ``duplicates`` lists; all columns stay, null texts too."""
    return Copies(df, ident, text, bits).kept()
