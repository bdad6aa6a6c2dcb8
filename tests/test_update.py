"""Snapshots of the symbol cache, settings, vision tokens, ignored ranges."""

import json

import pytest

from textloom.operators import output, parsing, symbols
from textloom.plans import update
from textloom.sources import providers, settings


def test_update_reuses_contents_and_counts(spark, tmp_path):
    root = str(tmp_path / "s")
    schema = "path string, text string, language string"
    one = spark.createDataFrame([("a.py", "def f(): pass\n", "python"), ("b.py", "def g(): pass\n", "python"), ("c.py", None, "python"), ("d.py", "def f(): pass\n", "python")], schema)
    assert update.update(one, root).first().asDict() == {"created": 3, "removed": 0, "changed": 0, "unchanged": 0}
    assert spark.read.parquet(f"{root}/0/contents").count() == 2
    two = spark.createDataFrame([("a.py", "def h(): pass\n", "python"), ("d.py", "def f(): pass\n", "python"), ("e.py", "x = 1\n", "python")], schema)
    assert update.update(two, root).first().asDict() == {"created": 1, "removed": 1, "changed": 1, "unchanged": 1}
    table = {(r.path, r.name) for r in update.symbol_table(spark, f"{root}/1").collect()}
    assert table == {("a.py", "h"), ("d.py", "f")}
    assert [r.path for r in symbols.read_index(spark, f"{root}/1/index", "f").collect()] == ["d.py"]
    assert symbols.read_index(spark, f"{root}/1/index", "g").count() == 0


def test_settings(tmp_path):
    a, b, c = tmp_path / "a", tmp_path / "b", tmp_path / "c"
    a.write_text(json.dumps({"timeout_ms": 5, "grep": {"max_lines": 3, "max_bytes": -1}, "other": 1}))
    b.write_text(json.dumps({"syntax_validation": "block", "grep": {"max_bytes": 9}}))
    c.write_text("{")
    found, said = settings.load(str(a), str(b), str(c), str(tmp_path / "none"))
    assert found == {"timeout_ms": 5, "syntax_validation": "block", "grep": {"max_lines": 3, "max_bytes": 9}}
    assert len(said) == 3
    assert settings.validate([], "x")[0] == {}


def test_providers(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"one|two"))], "path string, content binary")
    with pytest.raises(LookupError):
        providers.pdf_pages(files)
    providers.register("pdf_pages", lambda raw: list(enumerate(raw.decode().split("|"), 1)))
    try:
        assert [(r.page, r.text) for r in providers.pdf_pages(files).collect()] == [(1, "one"), (2, "two")]
    finally:
        providers.PROVIDERS.clear()


def test_ignored_ranges_and_scanner(spark):
    assert parsing.ignored_ranges('a "b" // c\n', "c") == [(2, 5), (6, 10)]
    code = "namespace n {\nstruct S {\n  int f(int a) { return a; }\n};\n}\nint main() {\n  if (x) { y(); }\n}\n"
    got = [(k, q, a, b) for k, _, q, a, b in parsing.brace_symbols(code, "cpp")]
    assert ("namespace", "n", 1, 5) in got and ("struct", "n.S", 2, 4) in got and ("function", "main", 6, 8) in got
    assert not any(q.endswith("if") for _, q, _, _ in got)
    broken = spark.createDataFrame([("a.rs", "fn f() { (\n", "rust"), ("b.rs", "fn f() } \n", "rust")], "path string, text string, language string")
    assert sorted((r.path, r.kind, r.start_line) for r in parsing.diagnostics(broken).collect()) == [("a.rs", "missing", 1), ("a.rs", "missing", 1), ("b.rs", "error", 1)]


def test_json_leaves_nulls_out(spark):
    df = spark.createDataFrame([("a", 1, None)], "path string, line int, name string")
    assert output.as_json(df).first().json == '{"path":"a","line":1}'
