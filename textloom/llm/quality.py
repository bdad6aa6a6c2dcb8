"""Quality selection by importance resampling over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import SPACE, Words, blocks, buffers, mix64
from .workspace import Workspace, fresh, q, typed

BITS = 14
KINDS = 3
SIZE = KINDS << BITS
_U = np.uint64

_CLASS = np.zeros(256, np.uint16)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[128:] = 8
for _i, _group in enumerate((".,;:'\"()-", "!?", "*&%$#@", "|_=+~^", "<>{}[]\\/`")):
    for _c in _group:
        _CLASS[ord(_c)] = 16 << _i


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of a block: words, pairs of words, and pairs of word shapes (kinds of
    characters, log length, and whether the word equals the one before), each hashed to its own 2^14 buckets."""
    w = Words(data, offsets, SPACE)
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same_doc = w.doc[1:] == w.doc[:-1]
    kinds = np.bitwise_or.reduceat(_CLASS[data], w.start).astype(_U)
    length = np.minimum(np.log2((w.end - w.start).astype(np.float64)).astype(_U), _U(7))
    repeated = np.zeros(len(w.start), bool)
    repeated[1:] = (w.hash[1:] == w.hash[:-1]) & same_doc
    shape = kinds | length << _U(16) | repeated.astype(_U) << _U(20)
    before = np.zeros(len(shape), _U)  # a document's first word follows nothing
    before[1:] = np.where(same_doc, shape[:-1] + _U(1), _U(0))
    pair = mix64(w.hash[:-1] * _U(0x9E3779B97F4A7C15) + w.hash[1:])[same_doc]
    top = _U(64 - BITS)
    buckets = [w.hash >> top, (pair >> top) + _U(1 << BITS), (mix64(mix64(shape) + before) >> top) + _U(2 << BITS)]
    return np.concatenate([w.doc, w.doc[:-1][same_doc], w.doc]), np.concatenate(buckets).astype(np.int64)


def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, raw, target) sums of a partition from (text, is_target)."""
    raw, target = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
    for batch in batches:
        data, offsets, _ = buffers(batch.column(0))
        wanted = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        for a, b, d, o in blocks(data, offsets):
            doc, bucket = features(d, o)
            raw += np.bincount(bucket, minlength=SIZE)
            if wanted[a:b].any():
                target += np.bincount(bucket[wanted[a:b][doc]], minlength=SIZE)
    found = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(found.astype(np.int32)), "raw": pa.array(raw[found]), "target": pa.array(target[found])})


def log_ratio(raw: np.ndarray, target: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw); both models are multinomials over all buckets of a kind,
    the target smoothed towards the raw model by ``smoothing`` counts a bucket on average."""
    out = np.zeros(SIZE)
    for k in range(KINDS):
        part = slice(k << BITS, (k + 1) << BITS)
        r = raw[part] + 1.0
        p = r / r.sum()
        t = target[part] + smoothing * (1 << BITS) * p
        out[part] = np.log(t / t.sum()) - np.log(p)
    return out


def draw(ident: Column, text: Column) -> Column:
    """What a row's noise is hashed from: its id, or its text where the id is null."""
    return F.when(ident.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(ident))


def gumbel(ident: np.ndarray, seed: int = 0) -> np.ndarray:
    """Standard Gumbel noise hashed from a long."""
    u = ((mix64(mix64(ident.astype(np.int64).view(_U)) + _U(seed)) >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return -np.log(-np.log(u))


class Model:
    """Both n-gram models as one table of log ratios, and the share of documents to keep."""

    def __init__(self, weights: np.ndarray, share: float, seed: int = 0) -> None:
        self.weights, self.share, self.seed = weights, share, seed

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log ratios, valid) of each text."""
        data, offsets, valid = buffers(column)
        out = np.zeros(len(offsets) - 1)
        for a, b, d, o in blocks(data, offsets):
            doc, bucket = features(d, o)
            out[a:b] = np.bincount(doc, self.weights[bucket], minlength=b - a)
        return out, valid

    def keys(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Appends (log weight, Gumbel key) to (..., draw, text), without these last two columns."""
        for batch in batches:
            score, valid = self.score(batch.column(batch.num_columns - 1))
            noise = gumbel(batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False), self.seed)
            columns = [*(batch.column(i) for i in range(batch.num_columns - 2)), pa.array(score, mask=~valid), pa.array(score + noise, mask=~valid)]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])


def fit(df: DataFrame, labels: DataFrame, ident: str, text: str, max_labelled: int = 20_000, seed: int = 0) -> Model:
    """The raw model counts the n-grams of all texts, the target model those of up to ``max_labelled`` documents
    of quality 1 (the first by hash of id), in one scan. An id labelled both 0 and 1, or null, isn't used. The share
    to keep is that of quality 1 among all usable labels, 1 if there are none."""
    kind = df.schema[ident].dataType.simpleString()
    clean = labels.select(F.col("doc_id").try_cast(kind).alias("doc_id"), "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    n, good = clean.agg(F.count("*"), F.sum("hi")).first()
    wanted = clean.where("hi = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id")
    chosen = [r.doc_id for r in wanted.collect()]
    mark = df.sparkSession.createDataFrame([(i, True) for i in chosen], f"label_id {kind}, wanted boolean")
    # bounded by max_labelled, whatever the size of the corpus
    marked = df.select(q(text).alias("text"), q(ident).alias("label_id")).join(F.broadcast(mark), "label_id", "left").select("text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    raw, target = np.zeros(SIZE), np.zeros(SIZE)
    for r in marked.mapInArrow(count_ngrams, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    weights = log_ratio(raw, target) if chosen else np.zeros(SIZE)
    return Model(weights.astype(np.float64), good / n if n else 1.0, seed)


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly, by narrowing a range of 4,096 bins; at most 4,096 values reach the driver at once."""
    lo, hi = keys.agg(F.min(column), F.max(column)).first()
    while lo < hi:
        width = (hi - lo) / 4096
        if width <= 0 or lo + width == lo:
            break
        inside = keys.where((F.col(column) >= lo) & (F.col(column) <= hi))
        bins = inside.groupBy(F.least(F.lit(4095), F.floor((F.col(column) - lo) / width)).alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for b in sorted(bins, key=lambda x: -x.b):
            if k <= b.n:
                break
            k -= b.n
        if (b.lo, b.hi) == (lo, hi):
            break
        lo, hi = b.lo, b.hi
        if b.n <= 4096:
            return sorted((r[0] for r in keys.where((F.col(column) >= lo) & (F.col(column) <= hi)).select(column).collect()), reverse=True)[k - 1]
    return hi


def select(df: DataFrame, labels: DataFrame, ident: str, text: str, max_labelled: int = 20_000, seed: int = 0) -> tuple[DataFrame, Model, float]:
    """(keys of all rows, model, cutoff). A row is kept if its key, log weight plus Gumbel noise, is among the
    ``share`` of the largest: a sample without replacement in proportion to the weights. Rows at the
    cutoff all stay. A null text has no key and is rejected; an empty one has weight 1. A row's noise is hashed from its id, so rows of one id
    share it, as do equal texts without an id; each row counts on its own. Ids may have any type, other columns take no part, a very long
    text counts all its n-grams, and an empty table gives no keys."""
    ws = Workspace(df.sparkSession, "quality")
    model = fit(df, labels, ident, text, max_labelled, seed)
    kind = df.schema[ident].dataType.simpleString()
    keys = df.select(q(ident).alias("doc_id"), draw(q(ident), q(text)).alias("i"), q(text).alias("t")).mapInArrow(model.keys, f"doc_id {kind}, log_weight double, key double")
    keys = ws.table(keys, "keys")
    n = keys.where("key is not null").count()
    k = round(n * model.share)
    return keys, model, kth_largest(keys.where("key is not null"), "key", k) if k else float("inf")


def resample(df: DataFrame, labels: DataFrame, ident: str, text: str, max_labelled: int = 20_000, seed: int = 0) -> DataFrame:
    """Every row's (doc_id, log_weight, key, kept); see ``select``."""
    keys, _, cutoff = select(df, labels, ident, text, max_labelled, seed)
    return keys.withColumn("kept", F.coalesce(F.col("key") >= cutoff, F.lit(False)))


def keep_selected(df: DataFrame, labels: DataFrame, ident: str, text: str, max_labelled: int = 20_000, seed: int = 0) -> DataFrame:
    """The kept rows of ``df`` with all their columns; scores are computed again in the scan, so no row is shuffled."""
    _, model, cutoff = select(df, labels, ident, text, max_labelled, seed)
    a, b = fresh(df, "quality_weight"), fresh(df, "quality_key")
    schema = typed(df, f"`{a}` double", f"`{b}` double")
    scored = df.select(*(q(c) for c in df.columns), draw(q(ident), q(text)).alias(a), q(text).alias(b)).mapInArrow(model.keys, schema)
    return scored.where(q(b) >= cutoff).drop(a, b)
