"""The document store and whole edit requests."""

import pytest

from textloom.functions.text import short_hash
from textloom.operators import store
from textloom.plans import edit

EDITS = "path string, edit_idx int, op string, start_line int, start_hash string, end_line int, end_hash string, new_text string"


def test_store_replaces_only_its_documents(spark, tmp_path):
    root = str(tmp_path / "s")
    docs = lambda *ids: spark.createDataFrame([(i, i + "!") for i in ids], "doc_id string, title string")
    nodes = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, position int")
    asset = "doc_id string, path string, x double, y double, width double, height double"
    assets = spark.createDataFrame([("a", "p.png", 1.0, 1.0, 1.0, 1.0)], asset)
    store.write(docs("a", "b"), nodes(("a", 0), ("a", 1), ("b", 0)), assets, root)
    store.write(docs("a"), nodes(("a", 7)), assets, root)
    got = store.read(spark, root)
    assert sorted((r.doc_id, r.position) for r in got["nodes"].collect()) == [("a", 7), ("b", 0)]
    assert store.read(spark, root, "b")["documents"].count() == 1
    for path in ("/abs", "a/../b"):
        with pytest.raises(ValueError):
            store.write(docs("a"), nodes(("a", 0)), spark.createDataFrame([("a", path, None, None, None, None)], asset), root)


def test_asset_files(spark, tmp_path):
    rows = [("d", 1, 0, "image/png", b"one"), ("d", 1, 1, "image/jpeg", b"two"), ("d", 2, 0, "text/plain", b"no"), ("d", 2, 1, "image/png", None)]
    named = store.asset_ids(spark.createDataFrame(rows, "doc_id string, page int, position int, mime string, content binary"))
    out = {r.id: r.path for r in store.write_files(named, str(tmp_path / "f")).collect()}
    assert sorted((tmp_path / "f" / p).read_bytes() for p in out.values()) == [b"one", b"two"]
    assert all(i.startswith("a_") and len(i) == 18 for i in out)


def test_edit_request(spark):
    files = spark.createDataFrame([("a.py", "class A:\n    def f(self):\n        return 1\n\nx = 1\ny = x\n", "python"), ("b.py", "x = 1\n", "python")], "path string, text string, language string")
    bodies = spark.createDataFrame([("a.py", "A.f", "def f(self):\n    a = 2\n    return a")], "path string, symbol string, body string")
    # the anchor is off by three lines once the symbol has grown, and is found by its hash
    anchored = spark.createDataFrame([("a.py", 0, "set_line", 3, short_hash("x = 1"), None, None, "x = 5")], EDITS)
    out = {r.path: (r.new_text, r.warning) for r in edit.run(files, bodies, anchored, ("y = x", "z = x", True)).collect()}
    assert out == {"a.py": ("class A:\n    def f(self):\n        a = 2\n        return a\n\nx = 5\nz = x\n", False)}
    broken = {r.path: r.warning for r in edit.run(files, replace=("x = 1", "x = (", False)).collect()}
    assert broken == {"a.py": True, "b.py": True}
    assert edit.run(files, replace=("x = 1", "x = (", False), syntax="block").count() == 0
    with pytest.raises(ValueError):
        edit.run(files, replace=("x", "y", False), syntax="maybe")
