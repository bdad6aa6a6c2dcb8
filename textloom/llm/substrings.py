"""Repeated passages through a log-structured index of window hashes that outlives a run."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bloom import Bloom
from .kernel import SPACE, Words, blocks, buffers, mix64, releasing, signed, sliding_min, windows
from .workspace import Workspace, q, remove, skew_join

#: Words of a passage; words of a selected window, and how many neighbouring windows one is selected among: 32 + 19 - 1 = 50.
PASSAGE, WORDS, REACH = 50, 32, 19
FANOUT, BATCHES = 3, 3
#: Bytes of text that a worker cuts into words at once; its arrays take many times as much.
BLOCK = 1 << 18
#: States of an index row: a window of one document, a window of several, a whole passage.
ONE, SEVERAL, WHOLE = 0, 1, 2
_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)


def selected_windows(hashes: np.ndarray, first: np.ndarray, k: int = WORDS, w: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of the windows of ``k`` words that are least among some ``w`` neighbouring ones of the same
    document; of a run of equal hashes, as one word over and over gives, the first, every (w-1)-th and the last.
    ``first`` bounds the documents' words. Two documents that share k + w - 1 words in a row select a window
    in common there, wherever it stands."""
    h = windows(hashes, k)
    if not len(h):
        return np.zeros(0, np.int64), h
    inside = np.zeros(len(h), bool)
    group = np.zeros(len(h) + 1, bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            inside[a : b - k + 1] = True
        if b - a >= k + w - 1:
            group[a : b - k - w + 2] = True
    h = np.where(inside, h, _TOP)
    padded = np.concatenate([h, np.full(w - 1, _TOP)])
    least = np.where(group[: len(h)], sliding_min(padded, w), _U(0))
    best = ~sliding_min(~np.concatenate([np.zeros(w - 1, _U), least]), w)  # the largest minimum of the groups around each window
    chosen = inside & (best == h)
    goes_on = np.zeros(len(h), bool)
    goes_on[1:] = chosen[1:] & chosen[:-1] & (h[1:] == h[:-1])
    places = np.arange(len(h))
    step = places - np.maximum.accumulate(np.where(goes_on, 0, places))
    last = chosen.copy()
    last[:-1] &= ~goes_on[1:]
    at = np.flatnonzero(chosen & (last | (step % (w - 1) == 0)))
    return at, h[at]


@releasing
def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, batch, h, pos) of the selected windows of (doc_id, batch, text)."""
    for batch in batches:
        data, offsets, _ = buffers(batch.column(2))
        for a, _, d, o in blocks(data, offsets, BLOCK):
            w = Words(d, o, SPACE)
            at, h = selected_windows(w.hash, w.first)
            doc = w.doc[at]
            rows = pa.array(a + doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(signed(h)), pa.array((at - w.first[doc]).astype(np.int32))], ["doc_id", "batch", "h", "pos"])


@releasing
def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, pos, old) of the windows of 50 words of (doc_id, text, places, covers, hashes) that hold a selected window at one of ``places``
    or with one of ``hashes`` (these are old ones) and don't lie within one of ``covers`` (start, words)."""
    for batch in batches:
        data, offsets, _ = buffers(batch.column(1))
        places, covers, hashes = (batch.column(i).to_pylist() for i in (2, 3, 4))
        for a, b, d, o in blocks(data, offsets, BLOCK):
            w = Words(d, o, SPACE)
            selected = selected_windows(w.hash, w.first) if any(hashes[a:b]) else None
            for i in range(b - a):
                x, y = int(w.first[i]), int(w.first[i + 1])
                if y - x < PASSAGE:
                    continue
                for old in (False, True):
                    if old:
                        if not hashes[a + i]:
                            continue
                        lo, hi = np.searchsorted(selected[0], [x, y])
                        mine = selected[0][lo:hi][np.isin(signed(selected[1][lo:hi]), np.array(hashes[a + i], np.int64))] - x
                    else:
                        mine = np.array(places[a + i] or [], np.int64)
                    mine = mine[mine < y - x]
                    starts = np.zeros(y - x + 1, np.int32)
                    np.add.at(starts, np.maximum(mine - (REACH - 1), 0), 1)
                    np.add.at(starts, mine + 1, -1)
                    take = np.cumsum(starts)[: y - x - PASSAGE + 1] > 0
                    for c in [] if old else covers[a + i] or []:
                        take[c["start"] : max(c["start"], c["start"] + c["words"] - PASSAGE + 1)] = False
                    at = np.flatnonzero(take)
                    if len(at):
                        h = mix64(windows(w.hash[x:y], PASSAGE)[at] ^ _U(0x5BD1E9955BD1E995))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(at), a + i))), pa.array(signed(h)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), old))], ["doc_id", "h", "pos", "old"])


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Index:
    """Sorted immutable runs of (h, batch, doc_id, pos, state) in a folder: each hash with its first place.

    A run is bucketed and sorted by hash, so that a new batch, reduced to one row a hash and shuffled once, is merge-joined with every run
    where it lies. When a level holds ``FANOUT`` runs they are merged into one of the next level, so there are O(log batches) runs and
    a row is rewritten as often. What belongs to the index says the latest complete manifest; a run that fails leaves the one before it. The folder can
    be opened again by any session; tables in the catalog are only handles on the runs, dropped by ``close``."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint", buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = f"h BIGINT, batch INT, doc_id {kind}, pos INT, state INT"
        self.version, self.batches, self.levels = 0, 0, [[]]
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.names: dict[str, str] = {}
        folder, files = _hadoop(spark, f"{self.path}/manifest")
        if files.exists(folder):
            whole = [s.getPath().getName() for s in files.listStatus(folder) if files.exists(_hadoop(spark, f"{s.getPath()}/_SUCCESS")[0])]
            if whole:
                now = json.loads(spark.read.text(f"{self.path}/manifest/{max(whole)}").first()[0])
                if now["kind"] != kind:
                    raise ValueError(f"the index has ids of type {now['kind']}")
                self.version, self.batches, self.levels, self.buckets = int(max(whole)), now["batches"], now["levels"], now["buckets"]
        self.kind = kind

    def run(self, name: str) -> DataFrame:
        if name not in self.names:
            self.names[name] = f"textloom_{name}"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS textloom_{name} ({self.schema}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(self.names[name])

    def runs(self) -> list[DataFrame]:
        """Oldest first."""
        return [self.run(name) for level in reversed(self.levels) for name in level]

    def _write(self, df: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        self.names[name] = f"textloom_{name}"
        df.select("h", "batch", "doc_id", "pos", "state").repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(self.names[name])
        return name

    def add(self, df: DataFrame) -> None:
        """Publishes a batch: its run, and the merges that its level calls for."""
        self.levels[0].append(self._write(df))
        self.batches += 1
        old: list[str] = []
        for i in range(64):
            if len(self.levels[i]) < FANOUT:
                break
            level = self.levels[i]
            rows = self.run(level[0])
            for name in level[1:]:
                rows = rows.unionByName(self.run(name))
            place = F.min(F.struct("batch", "doc_id", "pos")).alias("p")
            merged = self._write(rows.groupBy("h").agg(place, F.max("state").alias("state")).select("h", "p.*", "state"))
            old += level
            self.levels[i] = []
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(merged)
        self.version += 1
        text = json.dumps({"kind": self.kind, "buckets": self.buckets, "batches": self.batches, "levels": self.levels})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{self.version:08d}")
        for name in old:
            self._forget(name)
            remove(self.spark, f"{self.path}/{name}")

    def _forget(self, name: str) -> None:
        if name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(name)}")

    def close(self) -> None:
        """Drops the handles; the folder stays."""
        for name in list(self.names):
            self._forget(name)

    def match(self, batch: DataFrame) -> DataFrame:
        """``batch``, one row a hash h, with ``seen`` (batch, doc_id, pos, state) where the index has it."""
        runs = self.runs()
        for i, run in enumerate(runs):
            batch = batch.join(run.select("h", F.struct("batch", "doc_id", "pos", "state").alias(f"r{i}")).hint("merge"), "h", "left")
        found = [F.col(f"r{i}") for i in range(len(runs))]
        place = F.coalesce(*found, F.lit(None).cast(f"struct<batch:int,doc_id:{self.kind},pos:int,state:int>"))
        state = F.coalesce(F.array_max(F.array(*(x.state for x in found))) if found else F.lit(None), F.lit(ONE))
        return batch.withColumn("seen", place).withColumn("state", state.cast("int")).drop(*(f"r{i}" for i in range(len(runs))))


def segments(found: DataFrame, width: int, step: int) -> DataFrame:
    """Joins windows of ``width`` words (doc_id, pos, first_doc_id, first_pos) that continue each other, at most ``step`` words apart, to spans."""
    w = Window.partitionBy("doc_id", "first_doc_id", "shift").orderBy("pos")
    rows = found.withColumn("shift", F.col("pos") - F.col("first_pos"))
    rows = rows.withColumn("head", F.when(F.col("pos") - F.lag("pos").over(w) <= step, 0).otherwise(1))
    rows = rows.withColumn("part", F.sum("head").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.groupBy("doc_id", "first_doc_id", "shift", "part").agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + width).cast("int").alias("words"))
    return spans.select("doc_id", "start", "words", "first_doc_id", (F.col("start") - F.col("shift")).alias("first_start"))


def _near(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents of ``wanted`` (a stored table, one row a doc_id) with its columns. Texts that no one wants stay where they are."""
    key = F.xxhash64("doc_id")
    bloom = Bloom.of(wanted.select(key.alias("k")), "k")
    return docs.where(bloom.column(key)).join(wanted, "doc_id")


def spans_of_batch(index: Index, occ: DataFrame, corpus: DataFrame, ws: Workspace) -> DataFrame:
    """Spans (doc_id, start, words, first_doc_id, first_start) of 50 words or more that a document of the batch shares with an earlier one; the batch
    then belongs to the index. ``occ`` (doc_id, h, pos) are the batch's selected windows, ``corpus`` (doc_id, text) has its documents and all earlier ones.

    Windows that follow each other in the first place of their hash too are a span without more ado. What sticks out at its ends, or has
    its windows' first places in several documents, is looked up by whole passages of 50 words, of which the index holds the first place
    of each near a window that several documents have. So a passage is found in whatever earlier document it stands."""
    place = F.min(F.struct("doc_id", "pos")).alias("f")
    own = occ.groupBy("h").agg(place, F.max("doc_id").alias("last"), F.count("*").alias("n"))
    met = index.match(own)
    several = (F.col("f.doc_id") != F.col("last")) | (F.col("seen").isNotNull() & ((F.col("seen.doc_id") != F.col("f.doc_id")) | (F.col("state") == SEVERAL)))
    met = ws.table(met.withColumn("several", several), "windows")
    shared = met.where("several").select("h", "n", F.coalesce("seen.doc_id", "f.doc_id").alias("first_doc_id"), F.coalesce("seen.pos", "f.pos").alias("first_pos"))
    hits = ws.table(skew_join(occ, shared.drop("n"), ["h"], ws, counts=shared.select("h", "n")).select("doc_id", "pos", "first_doc_id", "first_pos"), "hits")
    chains = ws.table(segments(hits.where("doc_id <> first_doc_id"), WORDS, REACH).where(F.col("words") >= PASSAGE), "chains")
    # what is to be looked up by whole passages: in the batch by place, in the one document that had a window so far by hash
    places = hits.groupBy("doc_id").agg(F.collect_set("pos").alias("places"))
    covers = chains.groupBy("doc_id").agg(F.collect_list(F.struct("start", "words")).alias("covers"))
    late = met.where(F.col("several") & F.col("seen").isNotNull() & (F.col("state") == ONE)).groupBy(F.col("seen.doc_id").alias("doc_id")).agg(F.collect_list("h").alias("hashes"))
    wanted = ws.table(places.join(covers, "doc_id", "left").join(late, "doc_id", "full"), "places")
    kind = index.kind
    looked = _near(corpus, wanted).select("doc_id", "text", "places", "covers", "hashes").mapInArrow(passages, f"doc_id {kind}, h long, pos int, old boolean")
    looked = ws.table(looked, "passages")
    first = looked.groupBy("h").agg(F.min(F.struct((~F.col("old")).alias("new"), "doc_id", "pos")).alias("f"), F.count("*").alias("n"))
    whole = ws.table(index.match(first), "first-passages")
    known = whole.select("h", "n", F.coalesce("seen.doc_id", "f.doc_id").alias("first_doc_id"), F.coalesce("seen.pos", "f.pos").alias("first_pos"))
    more = skew_join(looked.where("not old"), known.drop("n"), ["h"], ws, counts=known.select("h", "n")).where("doc_id <> first_doc_id")
    spans = ws.table(chains.unionByName(segments(more, PASSAGE, 1)), "spans")
    number = index.batches
    fresh_ = met.where("seen is null").select("h", F.lit(number).alias("batch"), "f.doc_id", "f.pos", F.when(F.col("several"), SEVERAL).otherwise(ONE).alias("state"))
    raised = met.where(F.col("several") & F.col("seen").isNotNull() & (F.col("state") == ONE)).select("h", "seen.batch", "seen.doc_id", "seen.pos", F.lit(SEVERAL).alias("state"))
    rows = whole.where("seen is null").select("h", F.when(F.col("f.new"), number).otherwise(-1).alias("batch"), "f.doc_id", "f.pos", F.lit(WHOLE).alias("state"))
    index.add(fresh_.unionByName(raised).unionByName(rows))
    ws.drop(met, hits, looked, whole)
    return spans


@releasing
def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, words, digest) of the wanted spans of (doc_id, text, wanted): SHA-256 of the words themselves, one blank between."""
    for batch in batches:
        wanted, texts = batch.column(2).to_pylist(), batch.column(1).to_pylist()
        rows, start, size, found = [], [], [], []
        for i, (text, spans) in enumerate(zip(texts, wanted)):
            words = [x for x in text.encode().translate(_BLANKS).split(b" ") if x]
            for s in spans:
                a, n = s["start"], s["words"]
                if a + n <= len(words):
                    rows.append(i)
                    start.append(a)
                    size.append(n)
                    found.append(hashlib.sha256(b" ".join(words[a : a + n])).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(found, pa.binary())], ["doc_id", "start", "words", "digest"])


_BLANKS = bytes(32 if i in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32) else i for i in range(256))


def verified(docs: DataFrame, spans: DataFrame, kind: str, ws: Workspace) -> DataFrame:
    """The spans whose words are those of the first place, by SHA-256 of the words."""
    mine = spans.select("doc_id", "start", "words")
    theirs = spans.groupBy(F.col("first_doc_id").alias("doc_id"), F.col("first_start").alias("start"), "words").agg(F.count("*").alias("n"))
    theirs = ws.table(theirs, "first-places")
    wanted = ws.table(mine.unionByName(theirs.drop("n")).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "words")).alias("wanted")), "wanted")
    cut = ws.table(_near(docs, wanted).select("doc_id", "text", "wanted").mapInArrow(digests, f"doc_id {kind}, start int, words int, digest binary").distinct(), "digests")
    key = ["first_doc_id", "first_start", "words"]
    first = cut.select(F.col("doc_id").alias("first_doc_id"), F.col("start").alias("first_start"), "words", F.col("digest").alias("first_digest"))
    counts = theirs.select(F.col("doc_id").alias("first_doc_id"), F.col("start").alias("first_start"), "words", "n")
    return skew_join(spans.join(cut, ["doc_id", "start", "words"]), first, key, ws, counts=counts).where("digest = first_digest")


def union_of(spans: DataFrame) -> DataFrame:
    """(doc_id, start_word, n_words): the longest runs of words of each document that its spans cover."""
    w = Window.partitionBy("doc_id").orderBy("start", "words")
    rows = spans.withColumn("end", F.col("start") + F.col("words"))
    rows = rows.withColumn("head", F.when(F.col("start") <= F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    rows = rows.withColumn("part", F.sum("head").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "part").agg(F.min("start").alias("start_word"), (F.max("end") - F.min("start")).alias("n_words")).drop("part")


def batch_number(ident: Column, batches: int) -> Column:
    """A document's batch by hash of its id."""
    return F.pmod(F.conv(F.substring(F.md5(ident.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(batches)).cast("int")


def repeated_passages(df: DataFrame, ident: str, text: str, batches: int = BATCHES, path: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, start_word, n_words): the longest runs of words that all lie in passages of 50 words (white-space separated, bytes equal)
    that an earlier document has too.

    Documents come in ``batches`` by hash of id, as they would over time; earlier means an earlier batch, then a lower id. With ``path`` the
    index in that folder is used and goes on, and ``history`` (the columns of ``df``) gives the texts that are in it already; all of it is earlier. Without,
    the index is deleted at the end. Repeats within one document aren't reported. Rows of one id are versions of one document: none is
    a repeat of another, and a run of any of them is one of the document; ids mustn't come again in a later call. Null texts and null ids take no part; texts of under 50 words never
    have a run. Ids may be of any type; other columns take no part. Passages are found by hashes and verified by SHA-256 of their words."""
    spark = df.sparkSession
    ws = Workspace(spark, "passages")
    kind = df.schema[ident].dataType.simpleString()
    some = lambda x: x.select(q(ident).alias("doc_id"), q(text).alias("text")).where("doc_id is not null and text is not null")
    docs = some(df)
    corpus = docs if history is None else docs.unionByName(some(history))
    index = Index(spark, path or f"{ws.path}/index", kind)
    numbered = docs.select("doc_id", batch_number(F.col("doc_id"), batches).alias("batch"), "text")
    occ = numbered.mapInArrow(occurrences, f"doc_id {kind}, batch int, h long, pos int")
    at = f"{ws.path}/occurrences"
    occ.write.partitionBy("batch").parquet(at)
    spans = None
    for b in range(batches):
        rows = spark.read.schema(f"doc_id {kind}, h long, pos int, batch int").parquet(at).where(F.col("batch") == b).drop("batch")
        part = spans_of_batch(index, rows, corpus, ws)
        spans = part if spans is None else spans.unionByName(part)
    out = ws.table(union_of(verified(corpus, spans, kind, ws)), "result")
    index.close()
    remove(spark, at)
    if path is None:
        remove(spark, f"{ws.path}/index")
    return out
