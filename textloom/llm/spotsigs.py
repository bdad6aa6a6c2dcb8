"""Document fingerprints by SpotSigs: chains of content words behind common-word anchors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernel import ALNUM, Words, blocks, buffers, mix64, signed
from .workspace import Workspace, q, skew_join

#: Common words of the languages that the engine is used on, skipped within chains.
COMMON = (
    "a an and are as at be but by for from had has have he her his in is it its of on or she that the they this to was were what which will with "
    "au aux ce ces dans de des du elle en est et il la le les leur mais ne ou par pas pour que qui sa se ses son sur un une "
    "als am auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht sich sie sind und von war wie zu zum zur "
    "al como con del el ella en es esta este la las lo los más me mi no para pero por que se si sin su sus un una y ya"
).split()
#: Articles and forms of to be: the anchors.
ANCHORS = "a an the is was are le la les un une est der die das ein eine ist el los las una es".split()
CHAIN = 3
THRESHOLD = 0.5
#: Buckets of the frequency table; sets of a frequent signature that one block holds; the least set size of each partition, times 8.
BUCKETS, BLOCK, RATIO = 1 << 20, 20_000, 8
_U = np.uint64


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), ALNUM).hash


_COMMON_HASHES, _ANCHOR_HASHES = np.unique(_hash_words(COMMON)), np.unique(_hash_words(ANCHORS))


def _among(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends the sorted distinct signatures to (..., text), without the text.

    A signature is an anchor and the next ``CHAIN`` content words (not among the common ones) behind it in the lower-cased
    text; an anchor with fewer content words left has none."""
    for batch in batches:
        out = []
        keep = batch.num_columns - 1
        data, offsets, valid = buffers(pc.utf8_lower(batch.column(keep)))
        for a, b, d, o in blocks(data, offsets):
            w = Words(d, o, ALNUM)
            content = np.flatnonzero(~_among(w.hash, _COMMON_HASHES))
            spots = np.flatnonzero(_among(w.hash, _ANCHOR_HASHES))
            begin = np.searchsorted(content, spots)
            ok = begin + CHAIN <= len(content)
            spots, begin = spots[ok], begin[ok]
            ok = w.doc[content[begin + CHAIN - 1]] == w.doc[spots] if len(spots) else np.zeros(0, bool)
            spots, begin = spots[ok], begin[ok]
            h = w.hash[spots]
            for j in range(CHAIN):
                h = mix64(h * _U(0x9E3779B97F4A7C15) + w.hash[content[begin + j]])
            doc = w.doc[spots]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            fresh_ = np.ones(len(h), bool)
            fresh_[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[fresh_], doc[fresh_]
            bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(signed(h)), mask=pa.array(~valid[a:b])))
        column = pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(keep)), column], [f"c{i}" for i in range(keep + 1)])


def _bucket(sigs: np.ndarray) -> np.ndarray:
    return (sigs.view(_U) >> _U(44)).astype(np.int64)


def count_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) sums of a partition of signature sets."""
    n = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        n += np.bincount(_bucket(batch.column(0).flatten().to_numpy()), minlength=BUCKETS)
    found = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n[found])], ["bucket", "n"])


class Order:
    """One order of all signatures, rare ones first: by the frequency of their bucket, a table of a million whatever the corpus, then by value.

    Any order that all sets share is right; this one puts frequent signatures last. Frequencies are kept as quarters of their logarithm."""

    def __init__(self, counts: np.ndarray, threshold: float, block: int = BLOCK) -> None:
        self.level = np.floor(4 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
        self.threshold, self.block = threshold, block

    def postings(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(sig, part, low, high, size, set_id, pos, role) of each set's first signatures, as many as two sets of that similarity can't both do
        without: size - ceil(threshold * size) + 1.

        A posting goes to the partition of its set's length and, as a guest, to the one below if shorter sets of that can be similar. A signature of
        more than ``BLOCK`` sets is cut into blocks of sets, and each posting goes to the pairs of blocks that its own is in."""
        for batch in batches:
            sets = batch.column(1)
            flat = sets.flatten().to_numpy()
            size = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            level = self.level[_bucket(flat)]
            order = np.lexsort((flat, level, doc))
            rank = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            keep = rank < (size - np.ceil(self.threshold * size - 1e-9).astype(np.int64) + 1)[doc]
            sig, doc, pos, level = flat[order][keep], doc[keep], rank[keep], level[order][keep]
            size, ids = size[doc], batch.column(0).to_numpy()[doc]
            part = np.searchsorted(LENGTHS, size, "right") - 1
            guest = (part > 0) & (self.threshold * size < LENGTHS[part])
            who, role = np.concatenate([np.arange(len(sig)), np.flatnonzero(guest)]), np.concatenate([np.zeros(len(sig), np.int8), np.ones(guest.sum(), np.int8)])
            blocks_ = np.ceil(2.0 ** (level[who] / 4) / self.block).astype(np.int64)
            low = high = np.zeros(len(who), np.int64)
            if (blocks_ > 1).any():
                own = (mix64(ids[who].view(_U)) % blocks_.astype(_U)).astype(np.int64)
                other = np.arange(blocks_.sum()) - np.repeat(np.cumsum(blocks_) - blocks_, blocks_)
                who, role, own = (np.repeat(x, blocks_) for x in (who, role, own))
                low, high = np.minimum(own, other), np.maximum(own, other)
                role = role + np.where(own > low, 2, 0).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(sig[who]), pa.array((part[who] - role % 2).astype(np.int8)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(size[who].astype(np.int32)), pa.array(ids[who]), pa.array(pos[who].astype(np.int32)), pa.array(role)], POSTING)

    def candidates(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b) pairs of sets from postings sorted by cell and size; a cell that a batch cuts is put together first."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            cuts = np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1
            if held and len(cells[0]):
                before = [held[-1].column(i)[held[-1].num_rows - 1].as_py() for i in range(4)]
                if before != cells[:, 0].tolist():
                    yield from self._pairs(held)
                    held = []
            if len(cuts):
                yield from self._pairs([*held, batch.slice(0, int(cuts[-1]))])
                held = [batch.slice(int(cuts[-1]))]
            elif batch.num_rows:
                held.append(batch)
        if held:
            yield from self._pairs(held)

    def _pairs(self, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [np.concatenate([b.column(i).to_numpy() for b in batches]) for i in range(8)]
        sig, part, low, high, size, ids, pos, role = cells
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (part[1:] != part[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        key = np.cumsum(new) << 32
        # a set's partners are the longer ones of its cell within the ratio
        reach = np.minimum(np.floor(size / self.threshold + 1e-9).astype(np.int64), (1 << 32) - 1)
        n = np.searchsorted(key + size, key + reach, "right") - np.arange(len(sig)) - 1
        ends = np.cumsum(n)
        at = 0
        while at < len(sig):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), "right")))
            i = np.repeat(np.arange(at, to), n[at:to])
            j = i + 1 + np.arange(len(i)) - np.repeat(ends[at:to] - n[at:to] - (ends[at - 1] if at else 0), n[at:to])
            at = to
            need = np.ceil(self.threshold / (1 + self.threshold) * (size[i].astype(np.int64) + size[j]) - 1e-9)
            ok = (np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need) & (ids[i] != ids[j])
            ok &= ((role[i] & 1) == 0) | ((role[j] & 1) == 0)
            ok &= (low[i] == high[i]) | ((role[i] & 2) != (role[j] & 2))
            a, b = np.minimum(ids[i[ok]], ids[j[ok]]), np.maximum(ids[i[ok]], ids[j[ok]])
            if len(a):
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                once = np.ones(len(a), bool)
                once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], ["a", "b"])


POSTING = ["sig", "part", "low", "high", "size", "set_id", "pos", "role"]
LENGTHS = np.array([1] + [2 * RATIO**k for k in range(1, 12)])


def similar_documents(df: DataFrame, ident: str, text: str, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, class_size, copies, n_links) of every document with a partner: another one whose signature set has a Jaccard similarity of
    ``threshold`` or more. ``n_links`` counts its partners, ``copies`` the documents with its very set; a class is a component of the links,
    named by its least id.

    Sets that are equal are one vertex. Sets are partitioned by length, and a set is compared with those of its partition and the next
    shorter one that share one of its first signatures (see ``Order``), whose lengths and positions let them reach the threshold; the filters
    are exact. Only pairs of different sets that pass are formed, and verified by their whole sets.

    Documents without a signature, null texts and null ids take no part, nor do other columns. Rows of one id are documents of their own; ids may
    have any type that can be ordered. Very long texts count in full; an empty table gives no rows."""
    spark = df.sparkSession
    ws = Workspace(spark, "spotsigs")
    kind = df.schema[ident].dataType.simpleString()
    docs = df.select(q(ident).alias("doc_id"), q(text).alias("t")).where("doc_id is not null").mapInArrow(signatures, f"doc_id {kind}, sigs array<long>")
    docs = ws.table(docs.where("size(sigs) > 0"), "signatures")
    key = [F.xxhash64("sigs").alias("k1"), F.xxhash64(F.lit(1), "sigs").alias("k2")]
    # sets are told apart by their contents, not by a hash of them
    sets = docs.groupBy("sigs").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    sets = ws.table(sets.select("*", *key).withColumn("set_id", F.monotonically_increasing_id()), "sets")
    counts = np.zeros(BUCKETS, np.int64)
    found = sets.select("sigs").mapInArrow(count_signatures, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    order = Order(counts, threshold, block)
    postings = sets.select("set_id", "sigs").mapInArrow(order.postings, "sig long, part tinyint, low int, high int, size int, set_id long, pos int, role tinyint")
    cells = postings.repartition("sig", "part", "low", "high").sortWithinPartitions("sig", "part", "low", "high", "size")
    pairs = ws.table(cells.mapInArrow(order.candidates, "a long, b long").distinct(), "candidates")
    side = lambda n: sets.select(F.col("set_id").alias(n), F.col("sigs").alias(f"s{n}"), F.col("copies").alias(f"n{n}"))
    both = skew_join(pairs, side("a"), ["a"], ws)
    both = skew_join(both, side("b"), ["b"], ws, counts=pairs.groupBy("b").agg(F.count("*").alias("n")))
    shared = F.size(F.array_intersect("sa", "sb")).cast("double")
    links = ws.table(both.where(shared / (F.size("sa") + F.size("sb") - shared) >= threshold).select("a", "b", "na", "nb"), "links")
    partners = links.select(F.col("a").alias("set_id"), F.col("nb").alias("n")).unionByName(links.select(F.col("b").alias("set_id"), F.col("na").alias("n"))).groupBy("set_id").agg(F.sum("n").alias("n"))
    roots = components(links.select("a", "b"), ws).withColumnRenamed("node", "set_id")
    linked = sets.drop("sigs").join(partners, "set_id", "left").join(roots, "set_id", "left")
    linked = linked.withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1).where("n_links > 0").withColumn("root", F.coalesce("root", "set_id")).drop("n")
    linked = ws.table(linked, "linked")
    classes = ws.table(linked.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n")), "classes")
    placed = skew_join(linked, classes.drop("n"), ["root"], ws, counts=classes.select("root", "n"))
    placed = ws.table(placed.select("k1", "k2", "class_id", "class_size", "copies", "n_links"), "placed")
    rows = ws.table(docs.select("doc_id", *key), "keys")
    out = skew_join(rows, placed, ["k1", "k2"], ws, counts=placed.select("k1", "k2", F.col("copies").alias("n")))
    return out.select("doc_id", "class_id", "class_size", "copies", "n_links")
