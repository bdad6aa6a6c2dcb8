"""Declarations of line-oriented languages."""

import pytest

from textloom.operators import line_symbols

CASES = {
    "markdown": ("# One\n## Two ##\n####### no\n#no\n   ### Three", [(1, "heading", "One"), (2, "heading", "Two"), (5, "heading", "Three")]),
    "make": ("all: x\nVAR := 1\nb.o : c\n\tcmd: no", [(1, "target", "all"), (3, "target", "b.o")]),
    "just": ("build arg='x':\n  cmd\n@test: build\nx := 1", [(1, "recipe", "build"), (3, "recipe", "test")]),
    "kconfig": ('menu "Top"\nconfig FOO\n\tbool\nmenuconfig BAR', [(1, "menu", "Top"), (2, "config", "FOO"), (4, "menuconfig", "BAR")]),
    "bash": ("function a {\n  b() {\nc () {\nif x; then", [(1, "function", "a"), (2, "function", "b"), (3, "function", "c")]),
    "vimscript": ("function! s:one() abort\nendfunction\nexport def Two()\nfu three()", [(1, "function", "s:one"), (3, "function", "Two"), (4, "function", "three")]),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_symbols(spark, language):
    text, want = CASES[language]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(text.split("\n"), 1)], "path string, line int, text string")
    assert sorted((r.line, r.kind, r.name) for r in line_symbols.symbols(rows, language).collect()) == want


def test_heading_ranges(spark):
    lines = ["# A", "x", "## B", "y", "# C", "### D", "z"]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines, 1)], "path string, line int, text string")
    assert sorted((r.line, r.level, r.name, r.end_line) for r in line_symbols.heading_ranges(rows).collect()) == [(1, 1, "A", 4), (3, 2, "B", 4), (5, 1, "C", 7), (6, 3, "D", 7)]
