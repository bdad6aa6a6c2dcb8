"""Symbols with ranges of line-oriented languages and Ruby, alone and through the corpus update and edit requests."""

import pytest

from textloom.operators import parsing, symbols
from textloom.plans import edit, update

CASES = {
    "markdown": (
        "---\ntitle: x\n# no\n---\n# One #\ntext\n```sh\n# no\n```\nTwo\n===\n> ## Three\n- a\n---\n",
        [("heading", "One", "One", 5, 5), ("heading", "Two", "Two", 10, 11), ("heading", "Three", "Three", 12, 12)],
    ),
    "make": (
        "A := 1\nB ::= 2\nall: a.o \\\n  b.o\n\tcc\n# note\n\n\tld\n\nclean dist::\n\trm x\nprog: CFLAGS = -g\n$(OBJ): x\ndefine D\nno: x\nendef\n",
        [("target", "all", "all", 3, 8), ("target", "clean", "clean", 10, 11), ("target", "OBJ", "OBJ", 13, 13)],
    ),
    "just": ("x := 1\nbuild a='b:c':\n  cmd: x\n@t: build\n", [("recipe", "build", "build", 2, 2), ("recipe", "t", "t", 4, 4)]),
    "kconfig": (
        'menu "Top"\nconfig A\n\tbool "a"\n\thelp\n\t  menu of things\n\t  config X\n\nif A\nmenuconfig B\n\tbool\nendif\nendmenu\nconfig C\n\tint\n',
        [("menu", "Top", "Top", 1, 12), ("config", "A", "Top.A", 2, 6), ("menuconfig", "B", "Top.B", 9, 10), ("config", "C", "C", 13, 14)],
    ),
    "bash": (
        'f() {\n  echo "}" ${x#\\}} # }\n  cat <<EOF\n}\nno() {\nEOF\n  inner() ( cd / )\n}\nfunction g.h\n{\n  echo {a,b} "$(echo "}")"\n}\necho f\n',
        [("function", "f", "f", 1, 8), ("function", "inner", "f.inner", 7, 7), ("function", "g.h", "g.h", 9, 12)],
    ),
    "vimscript": (
        "function! s:one() abort\n  let x =<< trim E\nfunction no()\nE\nendfunction\nexport def Two(): number\n  return 1\nenddef\nfunc a#b(x)\nendf\n",
        [("function", "s:one", "s:one", 1, 5), ("function", "Two", "Two", 6, 8), ("function", "a#b", "a#b", 9, 10)],
    ),
    "ruby": (
        "module M\n  class A::B < C\n    def self.make(x)\n      return if x.end\n      y = if x then 1 else 2 end\n      while y do y -= 1 end\n      [1].each do |i| puts \"end #{i} end\" end\n    end\n"
        "    def ok? = true\n    class << self\n      def x=(v)\n        @x = <<~T\n          def no\n          end\n        T\n      end\n    end\n    def re; s =~ /end/ unless s; end\n    def ==(o)\n      {if: 1, end: :class}\n    end\n  end\nend\n=begin\ndef no\n=end\ndef last(a)\n  a ? a : nil # end\nend\n",
        [("module", "M", "M", 1, 23), ("class", "A::B", "M.A::B", 2, 22), ("method", "make", "M.A::B.make", 3, 8), ("method", "ok?", "M.A::B.ok?", 9, 9), ("method", "x=", "M.A::B.x=", 11, 16), ("method", "re", "M.A::B.re", 18, 18), ("method", "==", "M.A::B.==", 19, 21), ("method", "last", "last", 27, 29)],
    ),
}
SCHEMA = "path string, text string, language string"


@pytest.mark.parametrize("language", sorted(CASES))
def test_symbols_with_ranges(spark, language):
    text, want = CASES[language]
    got = parsing.symbols(spark.createDataFrame([("f", text, language)], SCHEMA)).collect()
    assert sorted((r.symbol_idx, r.kind, r.name, r.qualified_name, r.start_line, r.end_line) for r in got) == [(i, *w) for i, w in enumerate(want)]


def test_update_indexes_every_language(spark, tmp_path):
    root = str(tmp_path / "s")
    files = spark.createDataFrame([(k, v[0], k) for k, v in CASES.items()], SCHEMA)
    update.update(files, root)
    table = {(r.path, r.qualified_name) for r in update.symbol_table(spark, f"{root}/0").collect()}
    assert table == {(k, q) for k, (_, want) in CASES.items() for _, _, q, _, _ in want}
    assert [r.path for r in symbols.read_index(spark, f"{root}/0/index", "M.A::B.make").collect()] == ["ruby"]


def test_update_extracts_anew_what_an_older_version_cached(spark, tmp_path):
    root = str(tmp_path / "s")
    files = spark.createDataFrame([("a.rb", "def f\nend\n", "ruby")], SCHEMA)
    update.update(files, root)
    for part in ("symbols", "done"):  # as version 1 left them
        frame = parsing.symbols(files).withColumnRenamed("path", "file_hash").limit(0) if part == "symbols" else spark.createDataFrame([(1,)], "schema_version int")
        (frame.write.mode("overwrite").parquet if part == "symbols" else frame.write.mode("overwrite").json)(f"{root}/0/{part}")
    update.update(files, root)
    assert [r.name for r in update.symbol_table(spark, f"{root}/1").collect()] == ["f"]


@pytest.mark.parametrize("language, name, body, want", [("bash", "f", "f() { :; }", "f() { :; }\ng() { :; }\n"), ("ruby", "f", "def f = 1", "def f = 1\ng() { :; }\n")])
def test_symbol_edits(spark, language, name, body, want):
    text = {"bash": "f() {\n  x\n}\ng() { :; }\n", "ruby": "def f\n  x\nend\ng() { :; }\n"}[language]
    files = spark.createDataFrame([("a", text, language)], SCHEMA)
    assert [r.new_text for r in edit.run(files, spark.createDataFrame([("a", name, body)], "path string, symbol string, body string")).collect()] == [want]
