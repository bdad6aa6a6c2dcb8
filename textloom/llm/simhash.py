"""SimHash near-deduplication with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom
from .components import components
from .kernel import ALNUM, Words, blocks, buffers, mix64, signed, windows
from .workspace import Workspace, fresh, q, skew_join

THRESHOLD = 22
RULERS = 16
#: Reference fingerprints at most in either table; fingerprints of one cell that are aimed at; the nearest ones of each table.
PIVOTS, SECOND, CELL = 1 << 14, 1 << 12, 256
PROBES, SECOND_PROBES = 8, 3
#: Words in a sequence, values in a sketch of a text's sequences, and the shared part of them that a link needs.
SEQUENCE, SKETCH, SHARED = 3, 64, 0.125
_U = np.uint64
_LOW = _U((1 << 44) - 1)


def sketches(w: Words, n: int) -> np.ndarray:
    """16-bit values of the least hash in each of 64 parts of the hash space, over a text's distinct sequences of three words; 0 where a
    part is empty. The part of equal values, among those that either text has, estimates the share of common sequences. A
    text of one or two words is one sequence."""
    out = np.zeros((n, SKETCH), np.uint16)
    h = windows(w.hash, SEQUENCE)
    inside = w.doc[: len(h)] == w.doc[SEQUENCE - 1 :] if len(h) else np.zeros(0, bool)
    size = np.bincount(w.doc, minlength=n)
    short = np.flatnonzero((size > 0) & (size < SEQUENCE))
    begin = np.cumsum(size) - size
    h = np.concatenate([h[inside], mix64(w.hash[begin[short]] * _U(3) + w.hash[begin[short] + size[short] - 1])])
    doc = np.concatenate([w.doc[: len(inside)][inside], short])
    key = np.sort((doc.astype(_U) << _U(44)) | (mix64(h) >> _U(20)))  # 6 bits of the part and 38 of the value
    cell = key >> _U(38)
    least = np.ones(len(key), bool)
    least[1:] = cell[1:] != cell[:-1]
    key, cell = key[least], cell[least]
    out[(cell >> _U(6)).astype(np.int64), (cell & _U(63)).astype(np.int64)] = np.maximum(key & _U(0xFFFF), _U(1))
    return out


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sketches (n, 64) share enough word sequences; two empty ones do."""
    union = np.count_nonzero((x != 0) | (y != 0), axis=1)
    return np.count_nonzero((x == y) & (x != 0), axis=1) >= SHARED * union


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128-bit SimHash of each text as two columns of unsigned 64-bit, and which texts are not null.

    Features are the distinct words of the lower-cased text (runs of letters and digits), each with one
    vote a bit; a bit is set by a strict majority. A text without words has fingerprint 0."""
    out, _, valid = _hashed(column)
    return out, valid


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets, valid = buffers(pc.utf8_lower(column))
    out = np.zeros((len(offsets) - 1, 2), _U)
    sketch = np.zeros((len(offsets) - 1, SKETCH), np.uint16)
    for a, b, d, o in blocks(data, offsets):
        w = Words(d, o, ALNUM)
        if not len(w.start):
            continue
        sketch[a:b] = sketches(w, b - a)
        key = np.sort((w.doc.astype(_U) << _U(44)) | (w.hash >> _U(20)))  # a block has fewer than 2^20 documents
        keep = np.ones(len(key), bool)
        keep[1:] = key[1:] != key[:-1]
        key = key[keep]
        doc = (key >> _U(44)).astype(np.int64)
        n = np.bincount(doc, minlength=b - a)
        some = n > 0
        first = (np.cumsum(n) - n)[some]
        for side in range(2):
            h = mix64((key & _LOW) * _U(2) + _U(side + 1))
            votes = np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1), first, axis=0, dtype=np.int32)
            out[a:b, side][some] = np.packbits(votes * 2 > n[some][:, None], axis=1).view(_U).ravel()
    return out, sketch, valid


def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends (lo, hi, sketch) to (..., text), without the text; null for a null text."""
    for batch in batches:
        fp, sketch, valid = _hashed(batch.column(batch.num_columns - 1))
        columns = [*(batch.column(i) for i in range(batch.num_columns - 1)), *(pa.array(signed(np.ascontiguousarray(fp[:, i])), mask=~valid) for i in range(2)), pa.array([x.tobytes() if v else None for x, v in zip(sketch, valid)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distance of (n, 2) to one or many fingerprints."""
    return np.bitwise_count(x[..., 0] ^ y[..., 0]) + np.bitwise_count(x[..., 1] ^ y[..., 1])


class Pivots:
    """Two tables of reference fingerprints taken from the data, of bounded size.

    The distance table of a fingerprint to the first table gives its cells, those of its nearest pivots. The second table cuts cells
    again where they would be larger than ``CELL`` on average, so that up to 67 million cells come from 20,480 distances a fingerprint. The
    first 16 columns travel with the fingerprint to its cells."""

    def __init__(self, nodes: np.ndarray, points: np.ndarray, sketch: np.ndarray | None, n: int, threshold: int = THRESHOLD) -> None:
        size, second = self.wanted(n)
        self.nodes, self.first, self.sketch, self.threshold = nodes[:size], points[:size], None if sketch is None else sketch[:size], threshold
        self.second = points[size : size + second]
        self.probes = min(PROBES, len(self.first)), min(SECOND_PROBES, max(1, len(self.second)))

    @staticmethod
    def wanted(n: int) -> tuple[int, int]:
        """Sizes of both tables for ``n`` fingerprints: powers of two."""
        first = 1 << min(PIVOTS.bit_length() - 1, max(4, (n * PROBES // CELL).bit_length() - 1))
        over = n * PROBES * SECOND_PROBES // (first * CELL)
        return first, 0 if over < 16 else 1 << min(SECOND.bit_length() - 1, over.bit_length() - 1)

    @staticmethod
    def _table(part: np.ndarray, points: np.ndarray) -> np.ndarray:
        out = np.empty((len(part), len(points)), np.uint8)
        for j, p in enumerate(points):
            out[:, j] = distance(part, p)
        return out

    @staticmethod
    def _nearest(table: np.ndarray, k: int) -> np.ndarray:
        return np.argpartition(table, k - 1, axis=1)[:, :k] if k < table.shape[1] else np.tile(np.arange(table.shape[1]), (len(table), 1))

    def place(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each cell of a fingerprint, with its distances to the cell's pivot and to the first 16; or one row with
        ``other``, the pivot that it is linked to (cell below 0), and that stands for it from then on."""
        for pdf in batches:
            every, nodes = pdf[["lo", "hi"]].to_numpy(np.int64).view(_U), pdf["node"].to_numpy()
            sketches_ = np.frombuffer(b"".join(pdf["sketch"]), np.uint16).reshape(len(pdf), -1)
            for at in range(0, len(every), 1024):
                part, node, sketch = (x[at : at + 1024] for x in (every, nodes, sketches_))
                table = self._table(part, self.first)
                best = table.argmin(axis=1)
                linked = (table[np.arange(len(part)), best] <= self.threshold) & ~np.isin(node, self.nodes)
                rows = np.flatnonzero(linked)
                linked[rows] = alike(sketch[rows], self.sketch[best[rows]])
                gone = pd.DataFrame({"cell": -1 - (node[linked] % 4096), "node": node[linked], "lo": 0, "hi": 0, "home": np.int16(0), "rulers": None, "sketch": None, "other": self.nodes[best[linked]]})
                left = np.flatnonzero(~linked)
                table, near = table[left], self._nearest(table[left], self.probes[0])
                cells = near.astype(np.int64)[:, :, None]
                if len(self.second):
                    cells = cells * len(self.second) + self._nearest(self._table(part[left], self.second), self.probes[1])[:, None, :]
                per = cells.shape[1] * cells.shape[2]
                who, pivot = np.repeat(np.arange(len(left)), per), np.repeat(near, cells.shape[2], axis=1).ravel()
                rulers = [bytes(x) for x in table[:, :RULERS]]
                out = pd.DataFrame({"cell": cells.ravel(), "node": node[left][who], "lo": part[left][who, 0].view(np.int64), "hi": part[left][who, 1].view(np.int64), "home": table[who, pivot].astype(np.int16), "rulers": [rulers[r] for r in who.tolist()], "sketch": pdf["sketch"].to_numpy()[at : at + 1024][left][who]})
                yield out.assign(other=np.int64(-1))
                yield gone


CELL_SCHEMA = "cell long, node long, lo long, hi long, home short, rulers binary, sketch binary, other long"


def link(threshold: int, block: int = 64):
    """Edges that tie every two linked fingerprints of a cell together, by way of others where there are such.

    In order of fingerprint, one linked to an earlier leader joins it, else it leads. Pairs are first discarded by the largest
    difference of their pivot coordinates; survivors are verified by distance and by the word sequences they share, as a fingerprint
    knows neither order nor number of words. A later one that doesn't join a leader can only be near the leader's members if it is within the
    threshold and their largest distance of the leader: those few are compared with the members. So thousands of near copies cost
    about one pass and no link of the cell is lost."""

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["cell"].iat[0] < 0:
            return pd.DataFrame({"a": pdf["other"].astype("int64"), "b": pdf["node"]})
        pdf = pdf.sort_values(["lo", "hi", "node"])
        node = pdf["node"].to_numpy()
        fp = np.ascontiguousarray(pdf[["lo", "hi"]].to_numpy().astype(np.int64)).view(_U)
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint16).reshape(len(pdf), -1)
        rulers = np.frombuffer(b"".join(pdf["rulers"]), np.uint8).reshape(len(pdf), -1)
        coords = np.ascontiguousarray(np.column_stack([pdf["home"].to_numpy().astype(np.uint8), rulers]).T)

        def pairs(heads: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Places in both lists of the pairs that are linked."""
            close = np.ones((len(heads), len(others)), bool)
            for c in coords:
                # coordinates are at most 128 and the threshold below 64: the unsigned difference wraps beyond 2 * threshold
                close &= (c[others][None, :] - (c[heads] - np.uint8(threshold))[:, None]) <= np.uint8(2 * threshold)
            i, j = np.nonzero(close)
            ok = distance(fp[heads[i]], fp[others[j]]) <= threshold
            i, j = i[ok], j[ok]
            parts = [alike(sketch[heads[i[k : k + 16384]]], sketch[others[j[k : k + 16384]]]) for k in range(0, len(i), 16384)]
            ok = np.concatenate([np.zeros(0, bool), *parts])
            return i[ok], j[ok]

        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        alive = np.arange(len(node))
        while len(alive) > 1:
            heads = alive[:block]
            i, j = pairs(heads, alive)
            free = np.ones(len(alive), bool)
            bounds = np.searchsorted(i, np.arange(len(heads) + 1))
            for h in range(len(heads)):
                mine = j[bounds[h] : bounds[h + 1]]
                joined = mine[(mine > h) & free[mine]]
                if not free[h] or not len(joined):
                    continue
                free[joined] = False
                a.append(np.full(len(joined), node[heads[h]]))
                b.append(node[alive[joined]])
                far = distance(fp[heads[h]], fp[alive[joined]]).max()
                rest = np.flatnonzero(free)
                rest = rest[rest > h]
                rest = rest[distance(fp[heads[h]], fp[alive[rest]]) <= threshold + int(far)]
                for k in range(0, len(joined), 256):
                    x, y = pairs(alive[joined[k : k + 256]], alive[rest])
                    once = np.unique(y, return_index=True)[1]
                    a.append(node[alive[joined[k : k + 256]][x[once]]])
                    b.append(node[alive[rest[y[once]]]])
            free[: len(heads)] = False
            alive = alive[free]
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return cell


#: Members up to which a posting's pairs are formed along the sorted rows; rows of a longer one that are compared with all later ones at once.
LONG, ROWS = 256, 256
_PLACES = (1 << 22) - 1


class Postings:
    """Entries (key, node, lo, hi, root) of fingerprints, so that any two that are linked have one key in common.

    A key is a place of the sketch with its value. Linked sketches share an eighth of the values that either has, so an eighth of the values of
    each; in one order of all keys they then meet within the first values of both, all but one less than that eighth. Keys that are frequent in
    a sample come last: what is found doesn't depend on the order, only the length of the postings does."""

    def __init__(self, sketch: np.ndarray) -> None:
        key, count = np.unique(self._keys(sketch)[sketch != 0], return_counts=True)
        self.key, self.count = key[count > 1], count[count > 1].astype(_U)

    @staticmethod
    def _keys(sketch: np.ndarray) -> np.ndarray:
        key = (np.arange(SKETCH, dtype=_U) << _U(16)) | sketch
        return (key * _U(0x9E3779B1)) & _U(_PLACES)  # one to one, as the factor is odd

    def entries(self, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of the entries of sketches (n, 64)."""
        key = self._keys(sketch)
        count = np.zeros(key.shape, _U)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            count = np.where(self.key[at] == key, self.count[at], _U(0))
        order = np.sort(np.where(sketch != 0, (count << _U(22)) | key, ~_U(0)), axis=1)
        size = np.count_nonzero(sketch, axis=1)
        first = size - np.ceil(SHARED * size).astype(np.int64) + 1
        row, at = np.nonzero(np.arange(SKETCH) < np.where(size > 0, first, 0)[:, None])
        return row, (order[row, at] & _U(_PLACES)).astype(np.int32)

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The entries of (node, lo, hi, root, sketch)."""
        for batch in batches:
            if not batch.num_rows:
                continue
            row, key = self.entries(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint16).reshape(-1, SKETCH))
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(i).take(rows) for i in range(4))], ["key", "node", "lo", "hi", "root"])


def close_pairs(threshold: int):
    """Pairs (a, b, ra, rb) within the threshold and of different roots that have a key in common, of entries sorted by key. All pairs of a posting are
    compared, however long it is."""

    def found(key: np.ndarray, fp: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        after = np.repeat(start + size, size) - np.arange(len(key)) - 1
        i, k = np.flatnonzero((after > 0) & (np.repeat(size, size) <= LONG)), 1
        while len(i):
            some = i[root[i] != root[i + k]]
            some = some[distance(fp[some], fp[some + k]) <= threshold]
            yield some, some + k
            k += 1
            i = i[after[i] >= k]
        for a, n in zip(start[size > LONG].tolist(), size[size > LONG].tolist()):
            for x in range(a, a + n, ROWS):
                y = min(x + ROWS, a + n)
                for z in range(x, a + n, 16384):
                    end = min(z + 16384, a + n)
                    near = np.bitwise_count(fp[x:y, None, 0] ^ fp[None, z:end, 0]) + np.bitwise_count(fp[x:y, None, 1] ^ fp[None, z:end, 1]) <= threshold
                    i, j = np.nonzero(near & (root[x:y, None] != root[None, z:end]))
                    later = i + x < j + z
                    yield i[later] + x, j[later] + z

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        held, last = 0, None

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held
            key, node, lo, hi, root = (np.concatenate(x) for x in zip(*waiting))
            end = len(key) if whole else int(np.searchsorted(key, key[-1]))  # the last posting may go on
            waiting = [[x[end:] for x in (key, node, lo, hi, root)]]
            held = len(key) - end
            fp = np.stack([lo[:end], hi[:end]], axis=1).view(_U)
            if end:
                for i, j in found(key[:end], fp, root[:end]):
                    if len(i):
                        turn = node[i] > node[j]
                        i, j = np.where(turn, j, i), np.where(turn, i, j)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[j], root[i], root[j])], ["a", "b", "ra", "rb"])

        for batch in batches:
            if batch.num_rows:
                waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                held += batch.num_rows
                if held >= 65536 and waiting[-1][0][-1] != last:
                    last = waiting[-1][0][-1]
                    yield from flush(False)
        if held:
            yield from flush(True)

    return pairs


def alike_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ra, rb) of those (ra, rb, sketch, sketch) whose sketches are alike."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SKETCH) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(alike(x, y)))


def left_out(vertex: DataFrame, order: Postings, threshold: int, ws: Workspace) -> DataFrame:
    """(a, b): pairs of roots of ``vertex`` (node, lo, hi, sketch, root) that have linked members, complete."""
    entries = vertex.select("node", "lo", "hi", "root", "sketch").mapInArrow(order.place, "key int, node long, lo long, hi long, root long")
    width = max(1, min(4096, vertex.count() // 4_000))
    near = entries.repartition(width, "key").sortWithinPartitions("key").mapInArrow(close_pairs(threshold), "a long, b long, ra long, rb long").distinct()
    near = ws.table(near, "close-pairs")
    one, two = (vertex.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    return near.join(one, "a").join(two, "b").select("ra", "rb", "sa", "sb").mapInArrow(alike_pairs, "a long, b long").distinct()


def group_rows(table: DataFrame, threshold: int, ws: Workspace) -> DataFrame:
    """The rows of ``table`` (doc_id, lo, hi, sketch, row, ...) that share their group, with group_id, group_size, kept and distance.

    Rows are one vertex where fingerprint and sketch are equal. A group is a component of all links. The cells of the pivots find most of them; then all pairs
    of vertices that share a posting and aren't in one component yet are compared, which no link escapes. The row of the least
    (doc_id, lo, hi, row) is kept, nulls last. ``distance`` is to the kept fingerprint."""
    spark = table.sparkSession
    key = ["lo", "hi", "sketch"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "row")).alias("f")
    distinct = ws.table(table.groupBy(*key).agg(F.count("*").alias("n"), first).withColumn("node", F.monotonically_increasing_id()), "distinct")
    n = distinct.count()
    points = distinct.orderBy(F.xxhash64("lo", "hi"), "lo", "hi", "sketch").select("node", *key).limit(sum(Pivots.wanted(n))).collect()
    if points:
        pivots = Pivots(np.array([r.node for r in points]), np.array([[r.lo, r.hi] for r in points], np.int64).view(_U), np.array([np.frombuffer(r.sketch, np.uint16) for r in points]), n, threshold)
        spread = distinct.select("node", *key).repartition(max(1, min(4096, n // 4_000 + 1)))
        cells = spread.mapInPandas(pivots.place, CELL_SCHEMA)
        width = max(1, min(4096, n * pivots.probes[0] * pivots.probes[1] // 20_000))
        edges = cells.repartition(width, "cell").groupBy("cell").applyInPandas(link(threshold), "a long, b long")
        roots = components(edges, ws)
    else:
        roots = spark.createDataFrame([], "node long, root long")
    vertex = ws.table(distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "vertices")
    if points:
        order = Postings(np.array([np.frombuffer(r.sketch, np.uint16) for r in points]))
        more = ws.table(left_out(vertex, order, threshold, ws), "left-out")
        if not more.isEmpty():
            joined = components(more, ws).select(F.col("node").alias("root"), F.col("root").alias("whole"))
            vertex = ws.table(vertex.join(joined, "root", "left").withColumn("root", F.coalesce("whole", "root")).drop("whole"), "whole-vertices")
    best = F.min(F.struct("f.void", "f.doc_id", "lo", "hi", "f.row")).alias("best")
    groups = ws.table(vertex.groupBy("root").agg(F.sum("n").alias("group_size"), best, F.count("*").alias("vertices")).where("group_size > 1"), "groups")
    found = skew_join(vertex.select(*key, "n", "root"), groups.drop("vertices"), ["root"], ws, counts=groups.select("root", F.col("vertices").alias("n")))
    found = ws.table(found.select(*key, "n", "group_size", "best"), "members")
    rows = skew_join(table, found.drop("n"), key, ws, counts=found.select(*key, "n"))
    bits = F.bit_count(F.col("lo").bitwiseXOR(F.col("best.lo"))) + F.bit_count(F.col("hi").bitwiseXOR(F.col("best.hi")))
    return rows.select(*table.columns, F.col("best.doc_id").alias("group_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), bits.alias("distance"))


def near_duplicates(df: DataFrame, ident: str, text: str, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, group_size, kept, distance) of every document with a near or equal partner; the others aren't
    listed. Null texts take no part; texts without words are equal to each other; repeated rows are
    partners; a null id stays null and is never the kept one if another is there. Ids may be of any type that can be ordered. Very long texts
    count in full, other columns take no part, an empty table has no groups; of equal fingerprints the least id is kept."""
    ws = Workspace(df.sparkSession, "simhash")
    kind = df.schema[ident].dataType.simpleString()
    hashed = df.select(q(ident).alias("doc_id"), q(text).alias("t")).mapInArrow(hash_texts, f"doc_id {kind}, lo long, hi long, sketch binary")
    table = ws.table(hashed.where("lo is not null").withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    return group_rows(table, threshold, ws).drop("lo", "hi", "sketch", "row").select("doc_id", "group_id", "group_size", "kept", "distance")


def keep_one(df: DataFrame, ident: str, text: str, threshold: int = THRESHOLD) -> DataFrame:
    """``df`` with one row of each group, and every row of none, null texts included; all columns stay.

    No text is stored or shuffled to decide: rows are known by two hashes of id and text. Rows that pass no Bloom filter of the
    decisions stream through; the others are joined with them. Of rows with one id and one text an arbitrary one stays if that is the kept one."""
    ws = Workspace(df.sparkSession, "simhash")
    k1, k2 = fresh(df, "simhash_k1"), fresh(df, "simhash_k2")
    marks = [F.xxhash64(q(ident), q(text)).alias(k1), F.xxhash64(F.lit(1), q(ident), q(text)).alias(k2)]
    kind = df.schema[ident].dataType.simpleString()
    hashed = df.where(q(text).isNotNull()).select(q(ident).alias("doc_id"), *(m.alias(n) for m, n in zip(marks, ("k1", "k2"))), q(text).alias("t")).mapInArrow(hash_texts, f"doc_id {kind}, k1 long, k2 long, lo long, hi long, sketch binary")
    table = ws.table(hashed.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    rows = group_rows(table, threshold, ws).groupBy("k1", "k2").agg(F.max("kept").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    decided = ws.table(rows.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("stays").alias("simhash_stays"), "n"), "decisions")
    bloom = Bloom.of(decided, k1)
    marked = df.select(*(q(c) for c in df.columns), *marks)
    hit = bloom.column(q(k1)) & q(text).isNotNull()
    stays = fresh(marked, "simhash_stays")
    some = skew_join(marked.where(hit), decided.drop("n").withColumnRenamed("simhash_stays", stays), [k1, k2], ws, "left", counts=decided.select(k1, k2, "n"))
    one = some.where(q(stays)).dropDuplicates([k1, k2])
    out = marked.where(~hit).unionByName(some.where(q(stays).isNull()).drop(stays)).unionByName(one.drop(stays))
    return out.select(*(q(c) for c in df.columns))
