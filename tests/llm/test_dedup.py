"""Deduplication operators against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import chunks, kernel, simhash, spotsigs, substrings
from textloom.llm.workspace import documents

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lo string, row string, recipe string, n int, first string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, f"s{i}", "lo", "row", "recipe", 1, "first") for i, t in rows], SCHEMA)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r.doc_id, r.text) for r in documents(spark, SF).select("doc_id", "text").collect()]


EDGES = [(1, "same text here"), (2, "same text here"), (None, "same text here"), (3, None), (4, None), (5, ""), (6, ""), (7, "same text here "), (8, "x" * 200_000), (9, "x" * 200_000), (1, "same text here"), (10, "y")]


# exact


def test_exact_pairs(spark, corpus):
    got = sorted((r.doc_id, r.first_doc_id) for r in chunks.duplicates(documents(spark, SF), "doc_id", "text").collect())
    first = {}
    for i, t in sorted(corpus):
        first.setdefault(t, i)
    assert got == sorted((i, first[t]) for i, t in corpus if first[t] != i) and got


def test_exact_edges(spark):
    df = frame(spark, EDGES)
    got = sorted(((r.doc_id, r.first_doc_id) for r in chunks.duplicates(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 1), (6, 5), (9, 8)], key=str)
    kept = chunks.drop_duplicates(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), len(r.text or "")) for r in kept.collect()) == sorted([("1", 14), ("3", 0), ("4", 0), ("5", 0), ("7", 15), ("8", 200_000), ("10", 1)])
    none = df.limit(0)
    assert chunks.duplicates(none, "doc_id", "text").count() == 0 and chunks.drop_duplicates(none, "doc_id", "text").count() == 0


def test_chunks_are_content_defined():
    a = words(20_000, 1)
    b = a[:30_000] + "inserted" + a[30_000:]

    def cut(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        s, e, h = chunks.chunk_bounds(raw, np.array([0, len(raw)]))
        assert b"".join(raw[x:y].tobytes() for x, y in zip(s, e)) == t.encode()
        assert all(y - x <= chunks.MAX_BYTES for x, y in zip(s, e)) and all(y - x >= chunks.MIN_BYTES for x, y in zip(s[:-1], e[:-1]))
        return h.tolist()

    x, y = cut(a), cut(b)
    assert len(set(x) - set(y)) <= 3 < len(x)
    assert cut("") == [] and len(cut("q")) == 1
    # where a text stands in a block doesn't matter
    raw = np.frombuffer((a + b).encode(), np.uint8)
    assert chunks.chunk_bounds(raw, np.array([0, len(a), len(a) + len(b)]))[2].tolist() == x + y


@pytest.mark.parametrize("bits", [0, 2, 5])
def test_equal_hashes_are_not_trusted(spark, corpus, bits):
    """With few bits most chunks and recipes meet; contents still tell texts apart."""
    rows = [*EDGES, *((i, t) for i, t in corpus[:80]), *((i + 50_000, t) for i, t in corpus[:20]), (90, words(4000, 5)), (91, words(4000, 6)), (92, words(4000, 5))]
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if t is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(t, i)
    seen, want = set(), []
    for i, t in sorted(((i, t) for i, t in rows if t is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        if t in seen:
            want.append((i, first[t]))
        seen.add(t)
    df = frame(spark, rows)
    got = [(r.doc_id, r.first_doc_id) for r in chunks.duplicates(df, "doc_id", "text", bits).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = chunks.drop_duplicates(df, "doc_id", "text", bits).collect()
    assert len(kept) == len(rows) - len(want) and {r.text for r in kept} == {t for _, t in rows}


def test_bloom_and_skew(spark):
    from textloom.llm.bloom import Bloom
    from textloom.llm.workspace import Workspace, skew_join

    ws = Workspace(spark, "test")
    keys = ws.table(spark.range(0, 60_000, 3).selectExpr("id * 7 - 9 as k"), "keys")
    bloom = Bloom.of(keys, "k")
    inside = np.arange(0, 60_000, 3) * 7 - 9
    assert bloom.hit(inside).all() and bloom.hit(np.arange(10**9, 10**9 + 50_000)).mean() < 0.05
    df = spark.createDataFrame([(-9,), (None,), (10**12,)], "x long")
    assert [r.h for r in df.select(bloom.column(F.col("x")).alias("h")).collect()] == [True, False, False]
    assert not Bloom.of(ws.table(spark.range(0).toDF("k"), "none"), "k").hit(inside).any()
    left = ws.table(spark.range(3000).selectExpr("case when id % 3 = 0 then 5 when id % 100 = 1 then null else id end as k", "id as join_salt"), "left")
    right = ws.table(spark.range(2000).selectExpr("id as k", "id * 2 as v"), "right")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = skew_join(left, right, ["k"], ws, how, most=10), left.join(right, "k", how)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_ids_of_any_type(spark):
    rows = [("b", "same text here and there"), ("a", "same text here and there"), (None, "same text here and there"), ("c", "other")]
    df = spark.createDataFrame(rows, "key string, body string")
    assert sorted(((r.doc_id, r.first_doc_id) for r in chunks.duplicates(df, "key", "body").collect()), key=str) == [("b", "a"), (None, "a")]


# near


def slow_simhash(text):
    votes = np.zeros(128)
    seen = set(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower()))
    for w in seen:
        raw = np.frombuffer(w.encode(), np.uint8)
        h = kernel.Words(raw, np.array([0, len(raw)]), kernel.ALNUM).hash >> np.uint64(20)
        for side in range(2):
            x = kernel.mix64(h * np.uint64(2) + np.uint64(side + 1))
            votes[side * 64 : side * 64 + 64] += np.unpackbits(x.view(np.uint8))
    return np.packbits(votes * 2 > len(seen)).view(np.uint64).tolist()


def test_fingerprints(corpus):
    texts = [t for _, t in corpus[:40]] + ["", "...", "One", "one"]
    got, _ = simhash.fingerprints(pa.array(texts))
    assert got.tolist() == [slow_simhash(t) for t in texts]


def components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_near_groups_against_all_pairs(spark, corpus):
    base = [words(200, s) for s in range(12)]
    rng = random.Random(5)
    rows = list(corpus)
    for k, b in enumerate(base):
        for c in range(1 + 5 * (k % 4)):
            w = b.split()
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = words(1, rng.random())
            rows.append((10_000 + 100 * k + c, " ".join(w)))
    fp, _ = simhash.fingerprints(pa.array([t for _, t in rows]))
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if simhash.distance(fp[i], fp[j]) <= simhash.THRESHOLD]
    want = components(len(rows), pairs)
    got = {r.doc_id: (r.group_id, r.kept) for r in simhash.near_duplicates(frame(spark, rows), "doc_id", "text").collect()}
    caught = [got.get(rows[i][0], (i,))[0] == got.get(rows[j][0], (j,))[0] for i, j in pairs]
    assert len(pairs) > 100 and np.mean(caught) >= 0.9
    at = {i: n for n, (i, _) in enumerate(rows)}
    for doc, (group, kept) in got.items():
        assert want[at[doc]] == want[at[group]] and kept == (doc == group) and group <= doc


def test_a_list_of_its_words_is_no_copy(spark):
    a = words(200, 31)
    listed = " ".join(sorted(set(a.split())))
    edited = a.split()
    edited[50:53], edited[120] = ["other", "new", "words"], "changed"
    rows = [(1, listed), (2, a), (3, " ".join(edited)), (4, a.upper()), (5, "one two"), (6, "two one"), (7, "Two, one")]
    fp, _ = simhash.fingerprints(pa.array([t for _, t in rows]))
    assert (fp[0] == fp[1]).all() and simhash.distance(fp[1], fp[2]) <= simhash.THRESHOLD and (fp[4] == fp[5]).all()
    got = {(r.doc_id, r.group_id, r.group_size) for r in simhash.near_duplicates(frame(spark, rows), "doc_id", "text").collect()}
    assert got == {(2, 2, 3), (3, 2, 3), (4, 2, 3), (6, 6, 2), (7, 6, 2)}
    assert sorted(r.doc_id for r in simhash.keep_one(frame(spark, rows), "doc_id", "text").collect()) == [1, 2, 5, 6]


def test_sketches_estimate_shared_sequences():
    a = words(600, 77).split()
    share, texts = [], [" ".join(a)]
    for k in (0, 100, 300, 500, 600):
        b = words(k, 78).split() + a[k:]
        texts.append(" ".join(b))
        x, y = ({tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in (a, b))
        share.append(len(x & y) / len(x | y))
    w = kernel.Words(*kernel.buffers(pa.array(texts))[:2], kernel.ALNUM)
    s = simhash.sketches(w, len(texts))
    estimate = [np.mean(s[0] == s[k]) for k in range(1, 6)]
    assert np.abs(np.array(estimate) - share).max() < 0.2
    assert simhash.alike(s[[0] * 4], s[1:5]).tolist() == [e >= simhash.SHARED for e in estimate[:4]] and not simhash.alike(s[:1], s[5:]).any()


@pytest.mark.parametrize("second", [0, 4])
def test_link_loses_nothing_in_a_cell(second):
    import pandas as pd

    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**63, (300, 2), dtype=np.uint64)
    for i in range(60, 300):
        flips = np.zeros(128, np.uint8)
        flips[rng.choice(128, rng.integers(0, 24), replace=False)] = 1
        fp[i] = fp[i % 12] ^ np.packbits(flips).view(np.uint64)
    sketch = np.ones((300, simhash.SKETCH), np.uint16)
    sketch[rng.random(300) < 0.2] = 2
    pivots = simhash.Pivots(np.arange(16), fp[:16], sketch[:16], 300)
    pivots.second, pivots.probes = fp[16 : 16 + second], (8, min(3, max(1, second)))
    cells = pd.concat(pivots.place(iter([pd.DataFrame({"node": np.arange(300), "lo": fp[:, 0].view(np.int64), "hi": fp[:, 1].view(np.int64), "sketch": [x.tobytes() for x in sketch]})])))
    ok = lambda a, b: simhash.distance(fp[a], fp[b]) <= simhash.THRESHOLD and simhash.alike(sketch[[a]], sketch[[b]])[0]
    placed = set(cells[cells.cell >= 0].node)
    assert placed.isdisjoint(cells[cells.cell < 0].node) and len(placed) + (cells.cell < 0).sum() == 300
    for cell, c in cells.groupby("cell"):
        edges = simhash.link(simhash.THRESHOLD)(c)
        assert all(ok(a, b) for a, b in zip(edges.a, edges.b))
        if cell >= 0:
            nodes = c.node.tolist()
            at = {x: i for i, x in enumerate(nodes)}
            found = components(len(nodes), [(at[a], at[b]) for a, b in zip(edges.a, edges.b)])
            want = components(len(nodes), [(at[a], at[b]) for a, b in itertools.combinations(nodes, 2) if ok(a, b)])
            assert len(set(zip(found, want))) == len(set(found)) == len(set(want))


def test_near_groups_lose_no_link(spark):
    """Fingerprints in pairs and chains at just the threshold, sketches at just an eighth, against all pairs."""
    rng = np.random.default_rng(11)
    n = 1200
    fp = rng.integers(0, 2**63, (n, 2), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, 2), dtype=np.uint64)
    sketch = rng.integers(1, 2**16, (n, simhash.SKETCH)).astype(np.uint16)
    sketch[:, 0] = 7  # one long posting
    sketch[rng.random(n) < 0.3, 20:] = 0
    for i in range(n):
        if i % 4:
            flips = np.zeros(128, np.uint8)
            flips[rng.choice(128, rng.integers(20, 24), replace=False)] = 1
            fp[i] = fp[i - 1] ^ np.packbits(flips).view(np.uint64)
            size = max(np.count_nonzero(sketch[[i, i - 1]], axis=1))
            same = rng.choice(np.flatnonzero(sketch[i - 1]), size // 8 + rng.integers(-1, 2), replace=False)
            sketch[i, same] = sketch[i - 1, same]
    i, j = np.triu_indices(n, 1)
    near = simhash.distance(fp[i], fp[j]) <= simhash.THRESHOLD
    i, j = i[near], j[near]
    ok = simhash.alike(sketch[i], sketch[j])
    want = components(n, list(zip(i[ok].tolist(), j[ok].tolist())))
    assert 300 < ok.sum() < near.sum()
    table = spark.createDataFrame([(k, *fp[k].view(np.int64).tolist(), sketch[k].tobytes(), k) for k in range(n)], "doc_id long, lo long, hi long, sketch binary, row long")
    got = {r.doc_id: r.group_id for r in simhash.group_rows(table, simhash.THRESHOLD, simhash.Workspace(spark, "links")).collect()}
    found = [got.get(k, k) for k in range(n)]
    assert len(set(zip(found, want))) == len(set(found)) == len(set(want))


def test_near_edges(spark):
    df = frame(spark, EDGES)
    got = [(r.doc_id, r.group_id, r.kept) for r in simhash.near_duplicates(df, "doc_id", "text").collect()]
    assert {x[0] for x in got} == {1, 2, None, 5, 6, 7, 8, 9}
    assert sum(k for *_, k in got) == 3 and (1, 1, True) in got and (5, 5, True) in got and (8, 8, True) in got
    kept = simhash.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "8", "10"])
    none = df.limit(0)
    assert simhash.near_duplicates(none, "doc_id", "text").count() == 0 and simhash.keep_one(none, "doc_id", "text").count() == 0
    clash = frame(spark, [(1, words(50, 1)), (1, words(50, 2)), (None, words(50, 3)), (None, words(50, 4))])
    assert simhash.keep_one(clash, "doc_id", "text").count() == 4


def test_near_stage_of_the_pipeline_keeps_one_of_a_chain(spark):
    """Texts edited step by step, each near the one before and few others; one of each chain stays, by all pairs."""
    import corpus_pipeline

    rng, rows = random.Random(12), []
    for k in range(40):
        w = words(100, 900 + k).split()
        for c in range(8):
            rows.append((10 * k + c, " ".join(w)))
            for _ in range(7):
                w[rng.randrange(len(w))] = words(1, rng.random())
    texts = pa.array([t for _, t in rows])
    fp, sketch, _ = simhash._hashed(texts)
    i, j = np.triu_indices(len(rows), 1)
    ok = (simhash.distance(fp[i], fp[j]) <= simhash.THRESHOLD) & simhash.alike(sketch[i], sketch[j])
    want = components(len(rows), list(zip(i[ok].tolist(), j[ok].tolist())))
    least = {}
    for (doc, _), root in zip(rows, want):
        least[root] = min(least.get(root, doc), doc)
    kept = corpus_pipeline.near_stage(spark, frame(spark, rows), SF)
    assert len(least) < 200 and {r.doc_id for r in kept.collect()} == set(least.values())


# passages


def slow_passages(rows, batches, history=()):
    number = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % batches
    place = {i: (-1, i) for i, _ in history} | {i: (number(i), i) for i, _ in rows if i is not None}
    texts = [(i, re.findall(r"[^\t-\r\x1c- ]+", t)) for i, t in [*history, *rows] if i is not None and t is not None]
    first = {}
    for i, w in texts:
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            first[key] = min(first.get(key, place[i]), place[i])
    out = set()
    mine = {i for i, _ in rows}
    spans = {}
    for i, w in texts:
        if i in mine:
            spans.setdefault(i, set()).update((p, p + 50) for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] != place[i])
    for i, found in spans.items():
        at = None
        for a, b in sorted(found):
            if at and a <= at[1]:
                at[1] = b
            else:
                if at:
                    out.add((i, at[0], at[1] - at[0]))
                at = [a, b]
        if at:
            out.add((i, at[0], at[1] - at[0]))
    return out


def check_passages(spark, rows, batches=substrings.BATCHES):
    got = [tuple(r) for r in substrings.repeated_passages(frame(spark, rows), "doc_id", "text", batches).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_passages(rows, batches)
    return got


def test_passages_of_the_corpus(spark, corpus):
    assert check_passages(spark, corpus)


def test_passages_planted(spark):
    shared = [words(n, 100 + n) for n in (50, 51, 64, 120)]
    rows = [(i, words(30 + i, i) + " " + shared[i % 4] + "\n " + words(40, -i)) for i in range(24)]
    rows += [(100, words(500, 7)), (101, "a b " * 100), (102, "a b " * 70), (103, "z " * 200), (104, "z " * 60), (105, shared[3] + " " + shared[2])]
    # a passage whose halves stand in two other documents, overlapping by 30 words, and in one that is later than those
    p = words(50, 200).split()
    rows += [(200, " ".join(p[:40]) + " " + words(60, 201)), (201, words(60, 202) + " " + " ".join(p[10:])), (202, words(9, 203) + " " + " ".join(p) + " " + words(9, 204)), (203, words(20, 205) + " " + " ".join(p)), (204, words(3, 206) + " " + " ".join(p[:49]))]
    assert {r[0] for r in check_passages(spark, rows, 1)} - {105, 101, 102, 103, 104} == {*range(4, 24), 203}
    got = check_passages(spark, rows)
    assert len({r[0] for r in got} & set(range(24))) == 20 and not {100, 200, 201, 204} & {r[0] for r in got}


def test_passages_edges(spark):
    long = words(20_000, 9)
    rows = [(1, None), (2, ""), (None, long), (3, long), (4, long), (5, words(49, 1)), (6, words(49, 1) + " end"), (4, long), (7, words(70, 5)), (7, words(60, 6)), (8, words(60, 6))]
    got = check_passages(spark, rows)
    assert {r[1:] for r in got if r[0] in (3, 4)} == {(0, 20_000)}
    assert substrings.repeated_passages(frame(spark, []), "doc_id", "text").count() == 0


def test_index_goes_on_in_another_session(spark, corpus):
    """Two calls of four batches each on one folder, the second by another session, against brute force over everything."""
    shared = [words(n, 300 + n) for n in (55, 70, 90)]
    rows = [*corpus, *((5000 + i, words(20, 400 + i) + " " + shared[i % 3] + " " + words(25, 500 + i)) for i in range(40))]
    old, new = [r for r in rows if r[0] % 3], [r for r in rows if r[0] % 3 == 0]
    path = substrings.Workspace(spark, "lasting").path
    first = {tuple(r) for r in substrings.repeated_passages(frame(spark, old), "doc_id", "text", 4, path).collect()}
    assert first == slow_passages(old, 4)
    other = spark.newSession()
    later = substrings.repeated_passages(frame(other, new), "doc_id", "text", 4, path, frame(other, old))
    got = {tuple(r) for r in later.collect()}
    assert got == slow_passages(new, 4, old) and len(got) > 10
    index = substrings.Index(other, path)
    assert index.batches == 8 and [len(x) for x in index.levels] == [2, 2]
    with pytest.raises(ValueError):
        substrings.Index(other, path, "string")


def test_the_query_leaves_a_merged_index_of_all_batches(spark):
    import glob

    from textloom.llm import queries, workspace

    at = f"{workspace.shared_root(spark)}/passages-index-*".removeprefix("file://")
    before = set(glob.glob(at))
    assert queries.op2_substring_dedup(spark, SF).count()
    (path,) = set(glob.glob(at)) - before
    index = substrings.Index(spark, f"file://{path}")
    assert index.batches == substrings.BATCHES and [len(x) for x in index.levels] == [0, 1]
    assert index.runs()[0].select("batch").distinct().count() >= substrings.BATCHES
    index.close()


_WORKER = """
import random
import re
import pyarrow as pa
from textloom.llm import substrings

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

rng = random.Random(9)
words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
texts = pa.array([" ".join(rng.choices(words, k=300)) for _ in range(2000)])
ids, few = pa.array(range(2000)), pa.array([[0]] * 2000, pa.list_(pa.int32()))
covers, wanted = (pa.array([x] * 2000, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))) for x in (None, [{"start": 0, "words": 60}]))
for f, columns in ((substrings.occurrences, [ids, ids, texts]), (substrings.passages, [ids, texts, few, covers, few.cast(pa.list_(pa.int64()))]), (substrings.digests, [ids, texts, wanted])):
    batch = pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])
    list(f(iter([batch.slice(0, 2)])))
    before, most, rows = held(), 0, 0
    for x in f(iter([batch] * 3)):
        most, rows = max(most, held()), rows + len(x)
    assert rows >= 6000
    print(f.__name__, most - before, held() - before)
"""


def test_workers_take_little_memory_and_give_it_back(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    (at := tmp_path / "worker.py").write_text(_WORKER)
    root = str(Path(substrings.__file__).parents[2])
    out = subprocess.run([sys.executable, str(at)], env={"PYTHONPATH": root, "PATH": "/usr/bin:/bin", "OMP_NUM_THREADS": "1"}, capture_output=True, text=True, timeout=120)
    assert not out.returncode, out.stderr
    for name, most, after in map(str.split, out.stdout.splitlines()):
        assert float(most) < 32 and float(after) < 12, (name, most, after)


def test_selected_windows_meet():
    rng = random.Random(8)
    for _ in range(30):
        shared = [rng.randrange(50) for _ in range(50)]
        hits = []
        for side in range(2):
            w = [rng.randrange(1000, 2000) + side * 5000 for _ in range(rng.randrange(80))] + shared + [rng.randrange(3000, 4000) + side * 5000 for _ in range(rng.randrange(80))]
            at, h = substrings.selected_windows(kernel.mix64(np.array(w, np.uint64)), np.array([0, len(w)]))
            hits.append(set(h.tolist()))
        assert hits[0] & hits[1]


# SpotSigs


COMMON = set(spotsigs.COMMON)


def slow_signatures(text):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    out = set()
    for i, x in enumerate(w):
        if x in spotsigs.ANCHORS:
            chain = list(itertools.islice((y for y in itertools.islice(w, i + 1, None) if y not in COMMON), spotsigs.CHAIN))
            if len(chain) == spotsigs.CHAIN:
                out.add((x, *chain))
    return frozenset(out)


def check_spotsigs(spark, rows, block=spotsigs.BLOCK):
    got = spotsigs.similar_documents(frame(spark, rows), "doc_id", "text", block=block).collect()
    sets = [(i, slow_signatures(t)) for i, t in rows if i is not None]
    sets = [(i, s) for i, s in sets if s]
    pairs = [(x, y) for x, y in itertools.combinations(range(len(sets)), 2) if len(sets[x][1] & sets[y][1]) / len(sets[x][1] | sets[y][1]) >= spotsigs.THRESHOLD]
    root = components(len(sets), pairs)
    links = [0] * len(sets)
    for pair in pairs:
        for x in pair:
            links[x] += 1
    members = {}
    for x, r in enumerate(root):
        members.setdefault(r, []).append(x)
    want = [(sets[x][0], min(sets[y][0] for y in members[root[x]]), len(members[root[x]]), sum(s == sets[x][1] for _, s in sets), links[x]) for x in range(len(sets)) if links[x]]
    assert sorted(map(tuple, got)) == sorted(want)
    return want


@pytest.mark.parametrize("block", [spotsigs.BLOCK, 3])
def test_spotsigs_of_the_corpus(spark, corpus, block):
    assert check_spotsigs(spark, corpus, block)


@pytest.mark.parametrize("block", [spotsigs.BLOCK, 2])
def test_spotsigs_edges(spark, block):
    s = "the cat sat quickly a dog ran home an owl flew away "
    check_spotsigs(spark, [(1, s), (2, s + "the x y z"), (3, s.upper()), (4, None), (5, ""), (6, "the the the"), (None, s), (7, s * 400), (8, "le chat noir dort bien une fois encore ici"), (1, s), (1, "other words")], block)
    assert spotsigs.similar_documents(frame(spark, []), "doc_id", "text").count() == 0


@pytest.mark.parametrize("block", [spotsigs.BLOCK, 4])
def test_spotsigs_over_all_lengths(spark, block):
    """Sets of 1 to 300 signatures, many on both sides of a partition's bound, near copies of each other by cutting."""
    rng = random.Random(6)
    chains = [f"the {words(3, 900 + i)}. " for i in range(400)]
    rows = [(i, "".join(chains[k] for k in sorted(rng.sample(range(20 if n < 20 else 400), n)))) for i, n in enumerate([1, 1, 2, 2, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 17, 20, 31, 32, 60, 127, 128, 129, 200, 300] * 2)]
    for i, n in enumerate((8, 15, 16, 17, 30, 127, 128, 130, 250)):
        base = rng.sample(range(400), n)
        for k, share in enumerate((1, 0.9, 0.7, 0.52, 0.5, 0.48)):
            rows.append((1000 + 10 * i + k, "".join(chains[c] for c in base[: math.ceil(n * share)])))
    assert len(check_spotsigs(spark, rows, block)) > 50
