"""Scalar functions and edits against plain Python, on edge cases."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import edits, identifiers, lines, parsing, rename, symbols
from textloom.sources import corpus, detect


def py_lines(t):
    parts = t.split("\n")
    return parts[:-1] if parts[-1] == "" else parts


@pytest.mark.parametrize("raw,want", [("", []), ("x\n", ["x"]), ("x\n\n", ["x", ""]), ("\ufeffa\r\nb\rc", ["a", "b", "c"]), ("\n", [""])])
def test_normalize_and_split(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string").select(T.split_lines(T.normalize(F.col("t"))).alias("l"))
    assert df.first().l == want


@given(st.text(max_size=40))
@settings(max_examples=60, deadline=None)
def test_line_hash_ignores_white_space(s):
    spaced = "".join(c + random.choice(["", " ", "\t", "\u3000"]) for c in s)
    assert T.short_hash(s) == T.short_hash(spaced)


def test_identifier_occurrences(spark):
    texts = ["naïve cat, concat, cat_2, écat", "äö cat", "cat", "cat cat\ncat", "", None, "9cat cat9 cat"]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    want = set()
    for i, t in enumerate(texts):
        for n, line in enumerate(py_lines(t or ""), 1):
            for m in re.finditer(rb"(?<![A-Za-z0-9_])cat(?![A-Za-z0-9_])", line.encode()):
                want.add((str(i), n, m.start() + 1, T.short_hash(line)))
    got = {(r.path, r.line, r.column, r.hash) for r in identifiers.occurrences(files, "cat").collect()}
    assert got == want
    with pytest.raises(ValueError):
        identifiers.occurrences(files, "a.b")


def test_enclosing_against_brute_force(spark):
    rng = random.Random(3)
    syms = [("p", i, "k", f"s{i}", f"s{i}", a, a + rng.randrange(90)) for i in range(60) for a in [rng.randrange(1, 200)]] + [("p", 60, "k", "t", "t", 5, 6), ("p", 61, "k", "u", "u", 5, 6)]
    df = spark.createDataFrame(syms, "path string, symbol_idx int, kind string, name string, qualified_name string, start_line int, end_line int")
    at = spark.createDataFrame([("p", n) for n in range(1, 260)] + [("q", 1)], "path string, line int")
    got = {(r.path, r.line): r.symbol_name for r in symbols.enclosing(at, df).collect()}
    first = {(r.path, r.line): r.symbol_name for r in symbols.enclosing_first(at, df).collect()}
    for n in range(1, 260):
        inside = [s for s in syms if s[5] <= n <= s[6]]
        assert got[("p", n)] == (min(inside, key=lambda s: (s[6] - s[5], -s[5], -s[6], -s[1]))[3] if inside else None)
        assert first[("p", n)] == (min(inside, key=lambda s: (s[6] - s[5], s[5], s[3]))[3] if inside else None)
    assert got[("q", 1)] is None


def test_rename_there_and_back(spark):
    files = spark.createDataFrame([("a", "x = y; xx\ny x\n"), ("b", "é x x"), ("c", "none")], "path string, text string")
    there = rename.apply(files, rename.plan(files, "x", "zz9"), "x", "zz9").withColumnRenamed("new_text", "text")
    assert {r.path: r.text for r in there.collect()} == {"a": "zz9 = y; xx\ny zz9\n", "b": "é zz9 zz9"}
    back = rename.apply(there, rename.plan(there, "zz9", "x"), "zz9", "x")
    assert {r.path: r.new_text for r in back.collect()} == {"a": "x = y; xx\ny x\n", "b": "é x x"}
    # a stale plan leaves the file alone
    changed = files.withColumn("text", F.concat(F.lit("!"), "text"))
    assert rename.apply(changed, rename.plan(files, "x", "zz9"), "x", "zz9").count() == 0


def test_edits_match_a_plain_splice(spark):
    text = [f"line {i}" for i in range(1, 31)]
    rows = spark.createDataFrame([("f", i, T.short_hash(t), t) for i, t in enumerate(text, 1)], "path string, line int, hash string, text string")
    h = lambda i: T.short_hash(text[i - 1])
    schema = "path string, edit_idx int, op string, start_line int, start_hash string, end_line int, end_hash string, new_text string"
    es = [("f", 0, "set_line", 3, h(3), None, None, "three"), ("f", 1, "replace_lines", 5, h(5), 7, h(7), "5-7"), ("f", 2, "insert_after", 9, h(9), None, None, "after 9"), ("f", 3, "replace_lines", 12, h(12), 13, h(13), None)]
    want = text[:2] + ["three", text[3], "5-7"] + text[7:9] + ["after 9"] + text[9:11] + text[13:]
    df = spark.createDataFrame(es, schema)
    assert edits.apply(df, rows).first().new_text == "\n".join(want)
    clash = spark.createDataFrame([*es, ("f", 4, "set_line", 6, h(6), None, None, "x")], schema)
    assert [r.edit_idx for r in edits.overlaps(clash).collect()] == [4]
    assert edits.apply(clash, rows).count() == 0
    stale = spark.createDataFrame([("f", 0, "set_line", 3, "zzz", None, None, "x"), ("f", 1, "set_line", 99, "abc", None, None, "x")], schema)
    assert {r.edit_idx: r.conflict for r in edits.verify(stale, rows).collect()} == {0: "hash differs", 1: "missing line"}


def test_range_arguments(spark):
    files = spark.createDataFrame([("a", "1\n2\n3")], "path string, text string")
    assert [r.line for r in lines.read_range(files, 2, 9).orderBy("line").collect()] == [2, 3]
    for bad in ({"start": 0}, {"start": 3, "end": 2}, {"limit": 0}, {"end": 2, "limit": 1}):
        with pytest.raises(ValueError):
            lines.read_range(files, **bad)


def test_scope_and_language(spark):
    with pytest.raises(ValueError):
        detect.scoped(None, ignored=True)
    paths = {"a/Makefile": "make", "x.PY": "python", "y.hpp": "cpp", "z": "unknown", ".vimrc": "vimscript", "go.mod": "go"}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.l for r in df.select("path", detect.language(F.col("path")).alias("l")).collect()} == paths
    assert detect.parse_language("C-Sharp") == "csharp" and detect.parse_language("JS") == "javascript"
    sh = spark.createDataFrame([("run", "#!/usr/bin/env python3\n")], "path string, text string")
    assert sh.select(detect.language(F.col("path"), F.col("text")).alias("l")).first().l == "python"


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big") + b"\x08\x02\x00\x00\x00crc_\x00\x00\x00\x00acTLcrc_"
    assert detect.image_info(png) == ("png", 7, 9, True)
    frame = b"\x2c" + b"\0" * 8 + b"\0" + b"\x02\x01\x00\x00"
    assert detect.image_info(b"GIF89a\x05\x00\x06\x00\x00\x00\x00" + frame + frame) == ("gif", 5, 6, True)
    assert detect.image_info(b"GIF89a\x05\x00\x06\x00\x00\x00\x00" + frame + b";") == ("gif", 5, 6, False)
    assert detect.image_info(b"text") is None and detect.image_info(b"") is None


def test_recover_json_and_labels():
    assert detect.recover_json('x {"a": [1, {"b": 2}') == {"a": [1, {"b": 2}]}
    assert detect.recover_json('{"a": [{"b": 1}, {"c": "un') == {"a": [{"b": 1}]}
    assert detect.recover_json("none") is None
    body = b"mxfile\0%3CmxCell value=%22A%26lt;br%26gt;B%22/%3E"
    png = b"\x89PNG\r\n\x1a\n" + (len(body)).to_bytes(4, "big") + b"tEXt" + body + b"crc_"
    assert detect.diagram_labels(png) == "A\nB"


def test_pattern_search(spark):
    code = "f(1)\ng(x, x)\ng(x, y)\nif a:\n    b = a\n    c = 2\n"
    files = spark.createDataFrame([("a.py", "python", code), ("b.py", "python", "def (")], "path string, language string, text string")
    run = lambda p: [(r.start_line, r.end_line, dict(r.captures)) for r in parsing.ast_search(files, p).collect()]
    assert run("g($a, $a)") == [(2, 2, {"a": "2-2"})]
    assert [x[:2] for x in run("g($$$args)")] == [(2, 2), (3, 3)]
    assert [x[0] for x in run("$f(1)")] == [1]
    with pytest.raises(SyntaxError):
        parsing.ast_search(files, "g(")


def test_bindings_follow_scopes(spark):
    code = "x = 1\ndef f():\n    x = 2\n    return x\nclass C:\n    x = 3\n    def m(self):\n        return x\nprint(x)\n"
    files = spark.createDataFrame([("a.py", "python", code)], "path string, language string, text string")
    bound = parsing.bindings(files)
    at = spark.createDataFrame([("a.py", 1, 1)], "path string, line int, column int")
    got = {(r.line, r.occurrence) for r in parsing.scoped_references(bound, at).collect()}
    assert got == {(1, "definition"), (3, "shadowed"), (4, "shadowed"), (6, "shadowed"), (8, "reference"), (9, "reference")}


def test_index_round_trip(spark, tmp_path):
    syms = spark.createDataFrame([("a", 0, "k", "n", "m.n", 1, 2), ("b", 0, "k", "n", "n", 1, 2)], "path string, symbol_idx int, kind string, name string, qualified_name string, start_line int, end_line int")
    symbols.write_index(syms, str(tmp_path / "i"))
    assert sorted(r.path for r in symbols.read_index(spark, str(tmp_path / "i"), "n").collect()) == ["a", "b"]
    assert [r.path for r in symbols.read_index(spark, str(tmp_path / "i"), "m.n").collect()] == ["a"]


def test_empty_tables(spark):
    files = spark.createDataFrame([], "path string, text string, language string")
    assert lines.line_starts(files).count() == 0
    assert identifiers.occurrences(files, "x").count() == 0
    assert parsing.symbols(files).count() == 0
    assert corpus.block_symbols(files).count() == 0


def test_streaming_index(spark, tmp_path):
    from textloom.streaming import incremental

    src, idx = tmp_path / "in", str(tmp_path / "idx")
    files = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "one")], "path string, text string")
    files.write.parquet(str(src))
    stream = lambda: spark.readStream.schema(files.schema).parquet(str(src))
    work = lambda df: df.select("file_hash", "path", F.length("text").alias("n"))
    incremental.index_new_content(stream(), idx, str(tmp_path / "ck"), work).awaitTermination()
    assert spark.read.parquet(idx + "/batch=*").count() == 2
    spark.createDataFrame([("d", "two"), ("e", "three")], "path string, text string").write.mode("append").parquet(str(src))
    incremental.index_new_content(stream(), idx, str(tmp_path / "ck"), work).awaitTermination()
    assert spark.read.parquet(idx + "/batch=*").count() == 3
