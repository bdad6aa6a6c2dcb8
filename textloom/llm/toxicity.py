"""Toxicity: a convolutional text classifier over hashed words, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, SparkContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import Bloom
from .kernel import ALNUM, Words, blocks, buffers, mix64
from .workspace import Workspace, q, small_batches

BUCKET_BITS = 22
WIDTHS = (1, 2, 3)
DIM, FILTERS = 12, 8
MIN_DOCUMENTS = 3
BEGINNING = 5
#: Held-out documents of other languages count as so many of a language's own where its threshold is chosen.
BORROWED = 50.0
_U = np.uint64


def word_buckets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, buckets, first word) of blocks of texts; words are lower-cased runs of letters and digits. A word has two
    buckets: that of all its bytes, and that of its first five, which words of one stem share."""
    data, offsets, _ = buffers(pc.utf8_lower(column))
    for a, b, d, o in blocks(data, offsets):
        w = Words(d, o, ALNUM)
        whole = w.hash
        w.end = np.minimum(w.end, w.start + BEGINNING)
        both = np.stack([whole, mix64(w.hashes(d) + _U(1))], axis=1)
        yield a, b, (both >> _U(64 - BUCKET_BITS)).astype(np.int32), w.first


class Net:
    """Embedding rows for the buckets that enough training documents have (row 0, all zeros, for the others), a word
    being the sum of its two; filters of 1, 2 and 3 words with ReLU; the maximum over all positions of the whole
    text; a logistic output. Texts are padded by two empty words, so even one word meets every filter."""

    def __init__(self, used: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.used, self.lookup = used, None
        self.emb = rng.standard_normal((len(used) + 1, DIM), np.float32)
        self.emb *= 0.3
        self.emb[0] = 0
        self.conv = [(rng.standard_normal((w, DIM, FILTERS)) * (1.0 / np.sqrt(w * DIM))).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.out_bias = np.float32(-1.0)

    @staticmethod
    def of(used: np.ndarray, arrays: list[np.ndarray]) -> Net:
        """The net of given ``params()``, which it may change, and the output's bias behind them."""
        net = Net(used[:0])
        k = len(WIDTHS)
        net.used, net.emb, net.conv, net.bias, net.out = used, arrays[0], arrays[1 : k + 1], arrays[k + 1 : 2 * k + 1], arrays[2 * k + 1]
        net.out_bias = np.float32(arrays[2 * k + 2][0])
        return net

    def rows(self, bucket: np.ndarray) -> np.ndarray:
        if self.lookup is None:
            self.lookup = np.zeros(1 << BUCKET_BITS, np.int32)
            self.lookup[self.used] = np.arange(1, len(self.used) + 1)
        return self.lookup[bucket]

    def params(self) -> list[np.ndarray]:
        return [self.emb, *self.conv, *self.bias, self.out]

    def spread(self, context: SparkContext) -> Broadcast:
        """The arguments of ``Net.of``. They go to executors once, by way of files, and not with each function's code."""
        return context.broadcast((self.used, [*self.params(), np.full(1, self.out_bias, np.float32)]))


def _padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with two empty words after each text, and the new bounds."""
    n = np.diff(first)
    bounds = first + 2 * np.arange(len(first))
    out = np.zeros((bounds[-1], 2), rows.dtype)
    out[np.arange(len(rows)) + 2 * np.repeat(np.arange(len(n)), n)] = rows
    return out, bounds


def _beyond(bounds: np.ndarray, j: int) -> np.ndarray:
    """Positions whose j-th next word is one of the next text."""
    return (bounds[1:-1, None] - 1 - np.arange(j)).ravel()


def forward(net: Net, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(pooled, activations by width, words); what a filter reads beyond the two empty words behind a text is nothing."""
    x = net.emb[rows[:, 0]] + net.emb[rows[:, 1]]
    pooled, acts = [], []
    for w, conv, bias in zip(WIDTHS, net.conv, net.bias):
        h = x @ conv[0]
        for j in range(1, w):
            part = x[j:] @ conv[j]
            part[_beyond(bounds, j)] = 0
            h[:-j] += part
        acts.append(h)
        pooled.append(np.maximum(np.maximum.reduceat(h, bounds[:-1], axis=0) + bias, 0))
    return np.concatenate(pooled, axis=1), acts, x


def sparse_gradients(net: Net, bias: np.ndarray, r: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Gradients of the mean weighted logistic loss of a batch: embedding rows, row 0 too, that may be there several times, what each adds, and the
    gradients of the other parameters in the order of ``net.params()``, then that of the output's bias."""
    pooled, acts, x = forward(net, r, bounds)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + bias[0], -30, 30)))
    g = ((p - y) * weight / len(y)).astype(net.out.dtype)
    grads = [np.zeros_like(q_) for q_ in [*net.params()[1:], bias]]
    grads[-2] = pooled.T @ g
    grads[-1][0] = g.sum()
    back = (g[:, None] * net.out[None, :]) * (pooled > 0)
    rows, flows = [], []
    for k, (w, h) in enumerate(zip(WIDTHS, acts)):
        gp = back[:, k * FILTERS : (k + 1) * FILTERS]
        best = np.stack([h[a:b].argmax(axis=0) + a for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
        for j in range(w):
            to, within = np.minimum(best + j, len(x) - 1), gp * (best + j < bounds[1:, None])
            grads[k][j] = np.einsum("dfe,df->ef", x[to], within)
            flow = (within[:, :, None] * net.conv[k][j].T[None]).reshape(-1, DIM)
            for side in range(2):
                rows.append(r[to.ravel(), side])
                flows.append(flow)
        grads[len(WIDTHS) + k] = gp.sum(axis=0)
    return np.concatenate(rows), np.concatenate(flows), grads


def gradients(net: Net, bias: np.ndarray, r: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Those of ``sparse_gradients`` with the whole embedding's first, in the order of ``net.params()``."""
    rows, flows, grads = sparse_gradients(net, bias, r, bounds, y, weight)
    emb = np.zeros_like(net.emb)
    np.add.at(emb, rows, flows)
    emb[0] = 0
    return [emb, *grads]


#: Passes over the training documents; tasks at most that go over their share of them at once, and documents for which there is one more; documents of a
#: step; share of buckets blanked.
EPOCHS, TASKS, SHARE, BATCH, DROP = 12, 16, 6_000, 64, 0.3
#: Length of the embedding's steps by that of the others: a row that only some steps change has no momentum in the steps between.
SPARSE = 3.0
#: Embedding rows whose changes travel together from the tasks to where they are averaged.
CHUNK = 1 << 16


def adam(q_: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, t: int, pace: float) -> None:
    m += 0.1 * (g - m)
    v += 0.001 * (g * g - v)
    q_ -= pace * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


class Trainer:
    """One task's pass: Adam on the logistic loss from given parameters, with new moments. Of the embedding a step changes only the rows that have a
    gradient, so its cost doesn't grow with the vocabulary, and only rows that were changed are sent on."""

    def __init__(self, net: Net, pace: float, rng: np.random.Generator) -> None:
        self.net, self.pace, self.rng, self.t = net, pace, rng, 0
        self.small = [*net.params()[1:], np.full(1, net.out_bias, np.float32)]
        self.moments = [[np.zeros_like(p) for p in self.small] for _ in range(2)]
        self.m, self.v = np.zeros(net.emb.shape, np.float32), np.zeros(net.emb.shape, np.float32)
        self.changed = np.zeros(len(net.emb), bool)

    def steps(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        """A step for each batch of texts in a random order. In each step every bucket is blanked with probability ``DROP``, so that no word can
        hide behind others that come with it."""
        net, order = self.net, self.rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            rows = [net.rows(texts[i]) for i in part]
            r, bounds = _padded(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])]))
            r = r * (mix64(r.astype(_U) ^ self.rng.integers(0, 1 << 63, dtype=_U)) >= _U(int(DROP * (1 << 64))))
            at_, flows, grads = sparse_gradients(net, self.small[-1], r, bounds, y[part], weight[part])
            self.t += 1
            for q_, g, m, v in zip(self.small, grads, *self.moments):
                adam(q_, g, m, v, self.t, self.pace)
            by = np.argsort(at_, kind="stable")
            row, first = np.unique(at_[by], return_index=True)
            g = np.add.reduceat(flows[by], first, axis=0)
            some = (row > 0) & g.any(axis=1)
            row, g = row[some], g[some]
            e, m, v = net.emb[row], self.m[row], self.v[row]
            adam(e, g, m, v, self.t, SPARSE * self.pace)
            net.emb[row], self.m[row], self.v[row] = e, m, v
            self.changed[row] = True

    def changes(self, before: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(chunk, rows, differences) of the embedding, in half precision, and with chunk -1 of the other parameters in single."""
        yield -1, np.zeros(1, np.int32), np.concatenate([(q_ - p).ravel() for q_, p in zip(self.small, before[1:])])
        row = np.flatnonzero(self.changed).astype(np.int32)
        bounds = np.searchsorted(row, np.arange(0, len(self.changed) + CHUNK, CHUNK))
        for chunk, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if b > a:
                yield chunk, row[a:b], (self.net.emb[row[a:b]] - before[0][row[a:b]]).astype(np.float16)


def averaged(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row of the rows (chunk, n, rows, change) of a chunk: each embedding row's mean change, by documents, over the tasks that changed it."""
    chunk = int(pdf["chunk"].iat[0])
    kind = np.float32 if chunk < 0 else np.float16
    # in a fixed order, as sums of floats depend on it
    parts = [(n, np.frombuffer(r, np.int32), np.frombuffer(c, kind)) for n, r, c in sorted(pdf[["n", "rows", "change"]].itertuples(index=False, name=None))]
    rows = np.unique(np.concatenate([r for _, r, _ in parts]))
    total, weight = np.zeros((len(rows), len(parts[0][2]) // len(parts[0][1]))), np.zeros((len(rows), 1))
    for n, r, c in parts:
        at = np.searchsorted(rows, r)
        total[at] += float(n) * c.reshape(len(r), -1).astype(np.float64)
        weight[at] += n
    return pd.DataFrame({"chunk": [chunk], "rows": [rows.tobytes()], "change": [(total / weight).astype(np.float32).tobytes()]})


def train(table: DataFrame, n: int, positive: int, seed: int = 7, rate: float = 0.01) -> Net:
    """The net of all ``n`` documents of a stored table (y, words). In each of ``EPOCHS`` passes every task goes on from the common parameters over
    its share of the documents; the tasks' changes are averaged where they lie, and the driver adds the means, a chunk's after another. Toxic documents
    weigh as much as the others together. The driver holds the parameters once, whatever the number of tasks, and no document; a task one batch of
    documents, the parameters and their moments. Up to ``SHARE`` documents are one task's; the shares of more, and so the last digits of the
    scores, depend on how the session splits files."""
    context = table.sparkSession.sparkContext
    counts = table.select("words").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCUMENTS)
    net = Net(np.sort(counts.select("bucket").toArrow().column(0).to_numpy()).astype(np.int32), seed)
    params = [*net.params(), np.full(1, net.out_bias, np.float32)]
    weights = (n / (2 * max(1, n - positive)), n / (2 * max(1, positive)))
    buckets = context.broadcast(net.used)
    for epoch in range(EPOCHS):
        pace = rate * (1 - epoch / EPOCHS) + rate * 0.05
        common = context.broadcast(params)

        def share(batches: Iterator[pa.RecordBatch], epoch: int = epoch, pace: float = pace, common: Broadcast = common) -> Iterator[pa.RecordBatch]:
            done, trainer = 0, None
            for batch in batches:
                if batch.num_rows:
                    trainer = trainer or Trainer(Net.of(buckets.value, [p.copy() for p in common.value]), pace, np.random.default_rng([seed, epoch]))
                    y = batch.column(0).to_numpy().astype(np.float32)
                    texts = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in batch.column(1).to_pylist()]
                    trainer.steps(texts, y, np.where(y > 0, weights[1], weights[0]).astype(np.float32))
                    done += len(y)
            for chunk, rows, change in trainer.changes(common.value) if trainer else ():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([done]), pa.array([rows.tobytes()]), pa.array([change.tobytes()])], ["chunk", "n", "rows", "change"])

        changes = table.select("y", "words").coalesce(min(TASKS, n // SHARE + 1)).mapInArrow(share, "chunk int, n long, rows binary, change binary")
        for r in changes.groupBy("chunk").applyInPandas(averaged, "chunk int, rows binary, change binary").toLocalIterator():
            change = np.frombuffer(r.change, np.float32)
            if r.chunk >= 0:
                params[0][np.frombuffer(r.rows, np.int32)] += change.reshape(-1, DIM)
                continue
            at = 0
            for x in params[1:]:
                x += change[at : at + x.size].reshape(x.shape)
                at += x.size
        common.destroy()
    buckets.destroy()
    net.out_bias = np.float32(params[-1][0])
    return net


class Scorer:
    """The trained net for scanning, with its thresholds."""

    def __init__(self, net: Net, thresholds: dict[str, float], default: float) -> None:
        self.net, self.thresholds, self.default = net, thresholds, default

    def score(self, column: pa.Array) -> np.ndarray:
        net, out = self.net, np.zeros(len(column), np.float64)
        for a, b, bucket, first in word_buckets(column):
            out[a:b] = forward(net, *_padded(net.rows(bucket), first))[0] @ net.out + net.out_bias
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            p = self.score(column)
            lang = batch.column(1).to_pylist()
            limit = np.array([self.thresholds.get(x, self.default) for x in lang])
            void = ~np.asarray(column.is_valid())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, mask=void), pa.array(limit), pa.array((p >= limit) & ~void)], ["doc_id", "lang", "score", "threshold", "toxic"])


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The cut of the best weighted F1, in the middle of the gap above the next lower score; 0.5 where it can't be told."""
    if not y.any() or y.all():
        return 0.5
    weight = np.ones(len(p)) if weight is None else weight
    order = np.argsort(-p, kind="stable")
    p, y, weight = p[order], y[order], weight[order]
    hit = np.cumsum(weight * y)
    f1 = 2 * hit / (np.cumsum(weight) + hit[-1])
    f1[:-1][p[:-1] == p[1:]] = -1
    i = int(f1.argmax())
    return float((p[i] + p[i + 1]) / 2) if i + 1 < len(p) else float(p[i])


def language_thresholds(p: np.ndarray, y: np.ndarray, langs: np.ndarray) -> dict[str, float]:
    """A threshold for each language with a toxic and another held-out document: the best F1 over its own, with all others' counting as
    ``BORROWED`` documents together, so that few own ones move it little and many decide it."""
    out = {}
    for x in sorted(set(langs.tolist()) - {""}):
        own = langs == x
        if y[own].any() and not y[own].all():
            out[x] = best_threshold(p, y, np.where(own, 1.0, BORROWED / max(1, int((~own).sum()))))
    return out


def labelled(df: DataFrame, labels: DataFrame, ident: str, text: str, lang: str, max_labelled: int, max_bytes: int) -> list:
    """Rows (label_id, lang, y, words) of the labelled documents that training on a sample uses, in order of id: the first ``max_labelled`` by hash of id, and
    of these, in the same order, all that fit into ``max_bytes`` of text together; whole texts. What reaches the driver is bounded by both."""
    spark = df.sparkSession
    ws = Workspace(spark, "toxicity")
    kind = df.schema[ident].dataType.simpleString()
    clean = labels.select(F.col("doc_id").try_cast(kind).alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null")
    clean = clean.groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("hi")).where("y = hi")
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id", "y").collect()
    wanted = spark.createDataFrame([(r.doc_id, int(r.y), i) for i, r in enumerate(chosen)], f"label_id {kind}, y int, n int")
    # bounded by max_labelled, whatever the size of the corpus
    found = df.select(q(ident).alias("label_id"), q(lang).cast("string").alias("lang"), q(text).alias("text")).where("text is not null").join(F.broadcast(wanted), "label_id")
    one = found.groupBy("n").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "label_id", "lang", "y", "text")).alias("r"))
    one = ws.table(one.select("n", "r.label_id", "r.lang", "r.y", "r.text"), "labelled")
    left, taken = max_bytes, []
    for r in sorted(one.select("n", F.octet_length("text").alias("size")).collect()):
        if r.size <= left:
            left -= r.size
            taken.append((r.n,))
    some = one.join(F.broadcast(spark.createDataFrame(taken, "n int")), "n", "left_semi")
    rows = some.select("label_id", "lang", "text", "y").mapInArrow(_bucketed, f"label_id {kind}, lang string, y int, words binary").collect()
    return sorted(rows, key=lambda r: r.label_id)


def words_of_all(df: DataFrame, labels: DataFrame, ident: str, text: str, lang: str, ws: Workspace) -> DataFrame:
    """Rows (label_id, lang, y, held, words) of all labelled documents, stored; of several rows of an id one. ``held`` is every third label in order of
    id, counted in each range of ids from where the ranges before end. Texts without a label stay where they are."""
    kind = df.schema[ident].dataType.simpleString()
    clean = labels.select(F.col("doc_id").try_cast(kind).alias("label_id"), "toxic").where("label_id is not null and toxic is not null")
    clean = ws.table(clean.groupBy("label_id").agg(F.min("toxic").cast("int").alias("y"), F.max("toxic").alias("hi")).where("y = hi").drop("hi").orderBy("label_id").withColumn("part", F.spark_partition_id()), "labels")
    before, offsets = 0, []
    for r in sorted(clean.groupBy("part").count().collect()):
        offsets.append((r.part, before))
        before += r["count"]
    place = F.row_number().over(Window.partitionBy("part").orderBy("label_id")) - 1 + F.col("offset")
    clean = clean.join(F.broadcast(df.sparkSession.createDataFrame(offsets, "part int, offset long")), "part").select("label_id", "y", (place % 3 == 2).alias("held"))
    bloom = Bloom.of(clean.select(F.xxhash64("label_id").alias("k")), "k")
    found = df.select(q(ident).alias("label_id"), q(lang).cast("string").alias("lang"), q(text).alias("text")).where("text is not null").where(bloom.column(F.xxhash64("label_id"))).join(clean, "label_id")
    one = found.groupBy("label_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "lang", "y", "text", "held")).alias("r"))
    words = one.select(F.struct("label_id", "r.held").alias("label_id"), "r.lang", "r.text", "r.y").mapInArrow(_bucketed, f"label_id struct<label_id:{kind},held:boolean>, lang string, y int, words binary")
    return ws.table(words.select("label_id.label_id", "lang", "y", "label_id.held", "words"), "words")


def fit(df: DataFrame, labels: DataFrame, ident: str, text: str, lang: str, max_labelled: int | None = None, max_bytes: int | None = None) -> Scorer:
    """Trains on two thirds of all labelled documents and calibrates a threshold for each language on the other third, all of it (see
    ``language_thresholds``); an unknown or null language, or one that has not both kinds, gets that of all together. With ``max_labelled`` or
    ``max_bytes`` a bounded sample is used instead (see ``labelled``). Ids labelled both ways or null aren't used, and of several rows of a labelled id
    one is. Without toxic labels nothing is toxic. Of the documents of the last third the driver gets score, label and language."""
    ws = Workspace(df.sparkSession, "toxicity")
    if max_labelled is None and max_bytes is None:
        table = words_of_all(df, labels, ident, text, lang, ws)
    else:
        rows = labelled(df, labels, ident, text, lang, 9_000 if max_labelled is None else max_labelled, 64 << 20 if max_bytes is None else max_bytes)
        kind = df.schema[ident].dataType.simpleString()
        table = ws.table(df.sparkSession.createDataFrame([(r.label_id, r.lang, r.y, i % 3 == 2, r.words) for i, r in enumerate(rows)], f"label_id {kind}, lang string, y int, held boolean, words binary"), "words")
    held = F.col("held")
    n, positive = table.where(~held).agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    net = train(table.where(~held), n, positive)
    if not positive:
        return Scorer(net, {}, 2.0)

    arrays = net.spread(df.sparkSession.sparkContext)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net.of(*arrays.value)
        for batch in batches:
            words, p = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in batch.column(2).to_pylist()], []
            for at in range(0, len(words), 64):
                part = [net.rows(t) for t in words[at : at + 64]]
                r, bounds = _padded(np.concatenate(part), np.concatenate([[0], np.cumsum([len(x) for x in part])]))
                p.append(1 / (1 + np.exp(-np.clip(forward(net, r, bounds)[0] @ net.out + net.out_bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0), *p]))], ["lang", "y", "p"])

    test = table.where(held).select("lang", "y", "words").mapInArrow(scores, "lang string, y int, p double").toArrow()
    arrays.destroy()
    y, p = test.column(1).to_numpy().astype(np.int64), test.column(2).to_numpy()
    names = test.column(0).fill_null("").combine_chunks().dictionary_encode()
    langs = np.array([*names.dictionary.to_pylist(), ""], str)[names.indices.to_numpy()]
    ws.drop(table)
    return Scorer(net, language_thresholds(p, y, langs), best_threshold(p, y) if len(y) else 0.5)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, documents) of the words of a batch."""
    for batch in batches:
        if batch.num_rows:
            bucket, n = np.unique(np.concatenate([np.unique(np.frombuffer(x, np.int32)) for x in batch.column(0).to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n)], ["bucket", "n"])


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [bucket[x:y].tobytes() for _, _, bucket, first in word_buckets(batch.column(2)) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(words, pa.binary())], ["label_id", "lang", "y", "words"])


def classify(df: DataFrame, labels: DataFrame, ident: str, text: str, lang: str, max_labelled: int | None = None) -> DataFrame:
    """(doc_id, lang, score, threshold, toxic) of every document, scored over its whole text in one scan without a
    shuffle. A null text has a null score and isn't toxic; an empty one is scored as two empty words. Every row gets its own answer,
    repeated ones and null ids too; ids may have any type; other columns take no part; an empty table gives no rows. A score at the
    threshold is toxic."""
    small_batches(df.sparkSession)
    scorer = fit(df, labels, ident, text, lang, max_labelled)
    kind = df.schema[ident].dataType.simpleString()
    arrays, thresholds, default = scorer.net.spread(df.sparkSession.sparkContext), scorer.thresholds, scorer.default

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return Scorer(Net.of(*arrays.value), thresholds, default).rows(batches)

    return df.select(q(ident).alias("doc_id"), q(lang).cast("string").alias("lang"), q(text).alias("t")).mapInArrow(rows, f"doc_id {kind}, lang string, score double, threshold double, toxic boolean")
