"""Cases that tell apart readings of a rule which ordinary inputs don't."""

import random
import re

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import anchored, edits, outline, parsing, symbols
from textloom.plans import edit, update
from textloom.sources import detect

SYMBOLS = "path string, symbol_idx int, kind string, name string, qualified_name string, start_line int, end_line int"
EDITS = "path string, edit_idx int, op string, start_line int, start_hash string, end_line int, end_hash string, new_text string"


def one(spark, expression, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(expression(F.col("t"))).collect()]


def test_scalars(spark):
    assert one(spark, T.escape_controls, "\x1b\x00a\t", "a", None) == ["\\u001b\\u0000a\t", "a", None]
    assert one(spark, T.fuzzy, "a\u00a0 \x0b\n\ufe58\u2014\u3000b ", "") == ["a\n\ufe58- b", ""]
    assert one(spark, T.dedent, "    a\n      \n      b", "  \n ") == ["a\n  \n  b", "  \n "]
    assert one(spark, T.strip_copied_prefixes, "0af|x\n1bc|y", "0af|x", "+a\n++b", "", ">> 3:abc|x") == ["x\ny", "0af|x", "a\n++b", "", "x"]
    for text, column, want in [("äö cat", 6, ("cat", 6, 9)), ("ab.", 4, ("ab", 1, 3)), ("ab cd", 3, ("ab", 1, 3)), ("9a", 1, ("9a", 1, 3)), ("..", 1, None), ("", 1, None)]:
        got = one(spark, lambda c: T.identifier_span(c, F.lit(column)), text)[0]
        assert (tuple(got) if got else None) == want


def test_first_of_nested_symbols_is_nearest(spark):
    table = spark.createDataFrame([("p", 0, "k", "outer", "outer", 5, 20), ("p", 1, "k", "inner", "outer.inner", 7, 9), ("p", 2, "k", "late", "late", 30, 31), ("p", 3, "k", "twin", "twin", 30, 30)], SYMBOLS)
    at = spark.createDataFrame([("p", n) for n in (1, 8, 20, 25, 30, 99)] + [("q", 1)], "path string, line int")
    got = {r.line: (r.name, r.tier) for r in symbols.nearest(table, at).collect()}
    assert got == {1: ("outer", 1), 8: ("outer", 0), 20: ("outer", 0), 25: ("late", 1), 30: ("late", 0), 99: ("late", 2)}


def test_lookup_tiers(spark):
    table = spark.createDataFrame([("p", 0, "k", "doGetAll", "doGetAll", 1, 2), ("p", 1, "k", "A", "A", 3, 9), ("p", 2, "k", "f", "A.f", 4, 5)], SYMBOLS)
    tier = lambda q: [(r.tier, r.names) for r in symbols.lookup(table, q).collect()]
    assert tier("get") == [(6, "doGetAll")] and tier("Ge") == [(7, "doGetAll")] and tier("dog") == [(5, "doGetAll")]
    assert tier("x.A.f") == [(3, "A.f")] and tier("A.f") == [(2, "A.f")] and tier("y.x.A") == [(3, "A")] and tier("A.g") == []


def test_index_without_the_name_hides_nothing(spark):
    table = spark.createDataFrame([("a/x", 0, "k", "f", "f", 1, 2), ("b/y", 0, "k", "f", "f", 1, 2)], SYMBOLS)
    index = lambda *paths: spark.createDataFrame([("f", p) for p in paths], "name string, path string")
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(symbols.definitions(table, "f", index=index())) == ["a/x", "b/y"]
    assert paths(symbols.definitions(table, "f", "b", index("a/x"))) == ["b/y"]
    assert paths(symbols.definitions(table, "f", "", index("a/x"))) == ["a/x"]


def test_several_bodies_of_a_file_are_one_change(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    return 1\n\ndef g():\n    return 2\n", "python"), ("b.py", "class A:\n    def f(self):\n        pass\n", "python")], "path string, text string, language string")
    bodies = spark.createDataFrame([("a.py", "f", "def f():\n    return 3"), ("a.py", "g", "def g():\n    return 4"), ("b.py", "A", "class A: pass"), ("b.py", "A.f", "def f(self): 1")], "path string, symbol string, body string")
    got = {r.path: (r.new_text, r.outcome) for r in symbols.replace(files.drop("language"), parsing.symbols(files), bodies).collect()}
    assert got == {"a.py": ("def f():\n    return 3\n\ndef g():\n    return 4\n", "ok"), "b.py": (None, "overlap")}
    assert [r.path for r in edit.run(files, bodies).collect()] == ["a.py"]


def test_rename_conflicts_need_the_same_scope(spark):
    files = spark.createDataFrame([("a.py", "python", "x = 1\ndef f():\n    y = 2\n    return y\n"), ("b.py", "python", "def f():\n    y = 2\n\ndef g():\n    x = 1\n"), ("c.py", "python", "def ("), ("d.py", "python", None)], "path string, language string, text string")
    at = spark.createDataFrame([("a.py", 3, 5), ("b.py", 2, 5), ("c.py", 1, 1), ("d.py", 1, 1)], "path string, line int, column int")
    assert sorted(tuple(r) for r in parsing.rename_conflicts(files, at, "x").collect()) == [("a.py", 3, 5), ("a.py", 4, 12)]


def test_bundles_of_nested_and_repeated_symbols_without_a_join(spark):
    draw = random.Random(4)
    word = lambda: draw.choice(["a", "b", "c", "d", "e", "f_1", "\u00e9", None])
    marks = []
    for i in range(240):
        start = draw.choice([None, *range(90)])
        marks.append((f"f{i % 23}", i // 23, draw.choice(["section", "block", "file", None]), word(), None, start, draw.choice([None, (start or 0) + draw.randrange(-2, 70)])))
    marks += [("f0", 0, "section", "a", None, 1, 9), (None, 1, "section", "a", None, 1, 9)]
    rows = [(f"f{i % 23}", draw.choice([None, *range(1, 100)]), draw.choice([None, "", *(draw.choice(" .\u00e9").join(draw.choices(["a", "b", "c", "f_1", "zz"], k=3)) for _ in range(6))])) for i in range(500)]
    got = symbols.local_bundle(spark.createDataFrame(rows, "path string, line int, text string"), spark.createDataFrame(marks, SYMBOLS), "section", ["file"])
    assert "Join" not in got._jdf.queryExecution().toString()
    wanted = []
    for p in sorted({m[0] for m in marks if m[0]}):
        mine = [m for m in marks if m[0] == p]
        named = {(m[1], t) for m in mine if m[2] == "section" and None not in m[3:4] + m[5:] for q, line, text in rows if q == p and None not in (line, text) and m[5] <= line <= m[6] for t in re.findall("[A-Za-z0-9_]+", text) if t != m[3]}
        hits = [(i, t, o[1]) for i, t in named for o in mine if o[2] in ("section", "block") and o[3] == t]
        many = {h[0] for h in hits if sum(x[:2] == h[:2] for x in hits) > 1}
        wanted += [(p, i, used) for i, _, used in hits if i not in many]
    assert len(wanted) > 9
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted)


def test_tree_of_any_depth(spark):
    rows = [("d", i, str(i), str(i - 1) if i else None) for i in range(9)] + [("d", 90, "u", "v"), ("d", 91, "v", "u"), ("d", 92, "w", "none")]
    nodes = spark.createDataFrame(rows, "doc_id string, position int, id string, parent_id string")
    assert sorted((r.id, r.depth) for r in outline.paths(nodes).collect()) == [(str(i), i) for i in range(9)]
    assert outline.paths(nodes, 3).count() == 3
    assert outline.paths(nodes.limit(0)).count() == 0


def test_window_counts_all_edits_and_ties_go_to_earlier_lines(spark):
    text = ["x"] + [f"line {i}" for i in range(60)] + ["y z"] + ["y z"]
    rows = spark.createDataFrame([("f", i, T.short_hash(t), t) for i, t in enumerate(text, 1)], "path string, line int, hash string, text string")
    stale = spark.createDataFrame([("f", 0, 31, T.short_hash("x"))], "path string, edit_idx int, line int, hash string")
    many = spark.createDataFrame([("f",)] * 6, "path string")
    assert edits.relocate(stale, rows).count() == 0
    assert [r.new_line for r in edits.relocate(stale, rows, many).collect()] == [1]
    wanted = spark.createDataFrame([("f", 0, 63, "y z")], "path string, edit_idx int, line int, old_text string")
    assert [r.near_line for r in edits.similar_lines(wanted, rows).orderBy("rank").collect()][:2] == [62, 63]


def _near(spark):
    """Wanted lines and lines of files of up to 160 lines, with repeated, empty and null ones, and the similarity of all pairs within 50."""
    draw = random.Random(3)
    text = lambda: draw.choice([None, "", " \t", *(draw.choice(" \u00a0\t").join(draw.choices("abcdefgh", k=draw.randrange(1, 9))) for _ in range(9))])
    rows = [(f"f{n % 7}", i + 1, text()) for n, size in enumerate((1, 50, 51, 101, 160, 3, 3, 2)) for i in range(size)] + [(None, 1, "a b"), ("f0", None, "a b")]
    wanted = [(f"f{draw.randrange(8)}", i // 2 * 2, draw.randrange(-60, 230), text()) for i in range(600)] + [(None, 900, 1, "a b"), ("f1", 901, None, "a b")]
    found = {}
    for p, e, at, w in wanted:
        for q, line, t in rows:
            if p is not None and p == q and None not in (at, line, w, t) and abs(at - line) <= 50:
                a, b = ({x for x in re.split(r"[ \t\n\r\f\x0B]+", y) if x} for y in (w, t))
                found.setdefault((p, e), []).append((-(len(a & b) / max(len(a), len(b)) if a and b else 0.0), line))
    return spark.createDataFrame(wanted, "path string, edit_idx long, line int, old_text string"), spark.createDataFrame(rows, "path string, line int, text string"), found


def test_similar_lines_are_those_of_all_pairs_and_no_join_makes_pairs(spark):
    wanted, rows, found = _near(spark)
    got = edits.similar_lines(wanted, rows)
    assert "Join" not in got._jdf.queryExecution().toString()
    assert got.schema.simpleString() == "struct<path:string,edit_idx:bigint,rank:int,near_line:int,similarity:double>"
    best = [(*k, i + 1, line, -s) for k, v in found.items() for i, (s, line) in enumerate(sorted(x for x in v if x[0] <= -0.3)[:3])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(best)


def test_fuzzy_relocation_is_that_of_all_pairs_and_no_join_makes_pairs(spark):
    wanted, rows, found = _near(spark)
    got = edits.relocate_fuzzy(wanted, rows)
    assert "Join" not in got._jdf.queryExecution().toString()
    hits = {k: [line for s, line in v if s < -0.8] for k, v in found.items()}
    assert sorted(tuple(r) for r in got.collect()) == sorted((*k, v[0]) for k, v in hits.items() if len(v) == 1)


def test_fuzzy_replacement_keeps_the_rest(spark):
    files = spark.createDataFrame([("a", "say \u201chi\u201d \nthere\u00a0x\n\u2014"), ("b", 'say "hi"\nthere'), ("c", "none"), ("d", None)], "path string, text string")
    got = {r.path: (r.new_text, r.hits) for r in edits.replace_text(files, 'say "hi"\nthere', "bye", fuzzily=True).collect()}
    assert got == {"a": ("bye\u00a0x\n\u2014", 1), "b": ("bye", 1)}
    assert edits.replace_text(files, "", "x").count() == 0


def test_fuzzy_replacement_is_that_of_the_flat_text_and_needs_no_python(spark):
    kinds = ["a", "$", "\\", "\n", " ", "\u00a0", "\t", "\u1680", "\u2028", "'", "\u2019", "\u2013", "-", "\U0001f600"]
    draw = random.Random(5)
    texts = {str(i): "".join(draw.choices(kinds, k=draw.randrange(40))) for i in range(400)}
    files = spark.createDataFrame([*texts.items(), ("null", None)], "path string, text string")

    def flat(text):  # each character with the range of the text that it stands for
        out, at = [], 0
        for line in text.split("\n"):
            kept = line.rstrip("\t\r \u00a0\u1680\u2028")
            out += [(c.translate({0xA0: " ", 0x2019: "'", 0x2013: "-"}), at + i) for i, c in enumerate(kept)] + [("\n", at + len(line))]
            at += len(line) + 1
        return out[:-1]

    def replaced(text, old, everywhere):
        wanted, own = "".join(c for c, _ in flat(old)), flat(text)
        s, spans = "".join(c for c, _ in own), []
        at = s.find(wanted)
        while at >= 0:
            spans.append((own[at][1], own[at + len(wanted) - 1][1] + 1))
            at = s.find(wanted, at + len(wanted))
        out = text
        for a, b in reversed(spans if everywhere else spans[:1]):
            out = out[:a] + "<$1\\>" + out[b:]
        return out, len(spans)

    for old in (" a", "a", "'", "a \t\n", "\n\n", "\n a", "a\n", "-", "\ta", "$", "\\", "\U0001f600", "a\u00a0"):
        for everywhere in (False, True):
            got = edits.replace_fuzzy(files, old, "<$1\\>", everywhere)
            assert not re.search("InPandas|InArrow|EvalPython", got._jdf.queryExecution().toString())
            wanted = {p: replaced(t, old, everywhere) for p, t in texts.items() if old not in t}
            assert {r.path: (r.new_text, r.hits) for r in got.collect()} == {p: w for p, w in wanted.items() if w[1]}
    assert edits.replace_fuzzy(files, " \t", "x").count() == 0


def test_requests_change_a_file_as_a_whole_or_not(spark):
    files = spark.createDataFrame([("a", "a1\nb2\nc3\n"), ("b", ""), ("c", "a\u2010b"), ("d", None), ("e", "q")], "path string, text string")
    h = T.short_hash
    rows = [("a", 0, "set_line", 1, h("a1"), None, None, "x"), ("a", 1, "set_line", 9, "abc", None, None, "y"), ("b", 0, "insert_after", 1, h(""), None, None, "new\n"), ("c", 0, "set_line", 1, h("a\u2010b"), None, None, "a\u2010b"), ("d", 0, "set_line", 1, "abc", None, None, "x"), ("e", 0, "set_line", 1, h("q"), None, None, "q"), ("e", 1, "insert_after", 1, h("q"), None, None, None)]
    got = {r.path: (r.new_text, r.outcome, r.first_changed, r.no_ops) for r in anchored.apply(files, spark.createDataFrame(rows, EDITS)).collect()}
    assert got == {"a": (None, "missing line 9", None, []), "b": ("new", "ok", 1, []), "c": ("a-b", "ok", 1, []), "e": ("q", "no-op", None, [0, 1])}


def test_a_text_in_two_languages_has_the_symbols_of_each(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "def f(): pass\n", "python"), ("a.rs", "def f(): pass\n", "rust")], "path string, text string, language string")
    for n in range(2):
        update.update(files, str(tmp_path / "s"))
        assert [r.path for r in update.symbol_table(spark, str(tmp_path / "s" / str(n))).collect()] == ["a.py"]


def test_index_folders_are_not_read(spark, tmp_path):
    for at, content in (("a.txt", b"one"), ("b/.textloom/x.txt", b"two"), ("b/c.txt", b"three"), ("d.bin", b"\x00")):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_bytes(content)
    assert sorted(r.text for r in detect.read_files(spark, str(tmp_path)).collect()) == ["one", "three"]
