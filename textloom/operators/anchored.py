"""Whole requests of anchored edits: anchors found again, texts repaired, files changed as a whole or not at all.

``edits.apply`` is the plain relational splice. Here a request is worked off as an editor does it, with guesses about what the
author of an edit meant, which need all lines of the file at once: a file and its edits are one row, and Python runs in Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import DASHES, PREFIXES, short_hash
from textloom.operators.edits import RELOCATE, SPAN, relocation_window

RESULT = "path string, new_text string, outcome string, first_changed int, no_ops array<int>, notes array<string>"
_PREFIXES = [(re.compile(p), n) for p, n in PREFIXES]
_HYPHENS = re.compile(f"[{DASHES}]")
#: What a line that goes on in the next one ends with.
_OPEN_END = re.compile(r"(?:&&|\|\||\?\?|[?:=,+\-*/.(])\s*$")


class Stale(Exception):
    """An anchor that no line answers to."""


def _squeezed(text: str) -> str:
    return "".join(text.split())


def _indent(line: str) -> str:
    return line[: len(line) - len(line.lstrip())]


def _wanted_lines(text: str | None) -> list[str]:
    """Lines of an edit's text, without prefixes copied from a listing."""
    flat = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    if not flat:
        return []
    rows = flat.removesuffix("\n").split("\n")
    filled = [r for r in rows if r]
    for pattern, least in _PREFIXES:
        if len(filled) >= least and sum(bool(pattern.match(r)) for r in filled) * 2 >= len(filled):
            return [pattern.sub("", r, count=1) for r in rows]
    return rows


def _overlap(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return len(x & y) / max(len(x), len(y)) if x and y else 0.0


def _plain(edit) -> dict:
    """An edit as it comes from Arrow, with whole numbers or None for its lines."""
    out = edit if isinstance(edit, dict) else edit.asDict()
    return out | {k: None if out[k] is None or out[k] != out[k] else int(out[k]) for k in ("edit_idx", "start_line", "end_line")}


class Request:
    """The edits of one file. Places are 0-based, first and last line included."""

    def __init__(self, text: str, edits: list[dict]) -> None:
        self.rows = text.split("\n")
        self.hashes = [short_hash(r.removesuffix("\r")) for r in self.rows]
        self.where = defaultdict(list)
        for i, h in enumerate(self.hashes):
            self.where[h].append(i)
        self.window = relocation_window(len(edits))
        self.edits, self.notes = edits, []

    def place(self, line: int, digits: str, content: str | None) -> int:
        """The line of an anchor: its own, else the only one within the window with its hash, else the only one within 50 lines that is
        like the content which stood behind the anchor."""
        if not 1 <= line <= len(self.rows):
            raise Stale(f"missing line {line}")
        at, digits = line - 1, digits.lower()
        if self.hashes[at] == digits:
            return at
        near = [i for i in self.where[digits] if abs(i - at) <= self.window]
        if len(near) != 1 and content:
            near = [i for i in range(max(0, at - SPAN), min(len(self.rows), at + SPAN + 1)) if _overlap(content, self.rows[i]) > RELOCATE]
        if len(near) != 1:
            raise Stale(f"hash differs at line {line}")
        self.notes.append(f"anchor {line}:{digits} found at line {near[0] + 1}")
        return near[0]

    def resolved(self) -> list[tuple[int, str, int, int, list[str]]]:
        """(index, kind, first, last, lines) of edits whose anchors hold; equal ones once, and of equal edits of a single line the last."""
        out: dict[tuple, tuple] = {}
        for e in self.edits:
            first = self.place(e["start_line"], e["start_hash"], e["start_text"])
            last, kind = first, "put" if e["op"] == "insert_after" else "one"
            if e["op"] == "replace_lines" and e["end_line"] is not None and e["end_line"] != e["start_line"]:
                if e["end_line"] < e["start_line"]:
                    raise Stale(f"range {e['start_line']}-{e['end_line']} runs backwards")
                last, kind = self.place(e["end_line"], e["end_hash"], e["end_text"]), "run"
                if last - first != e["end_line"] - e["start_line"]:
                    raise Stale(f"range {e['start_line']}-{e['end_line']} has changed its length")
            lines = _wanted_lines(e["new_text"])
            key = (kind, first, last, tuple(lines))
            if kind == "one":
                out.pop(key, None)
            out.setdefault(key, (e["edit_idx"], kind, first, last, lines))
        spans = sorted((f, t) for _, kind, f, t, _ in out.values() if kind != "put")
        if any(b[0] <= a[1] for a, b in zip(spans, spans[1:])):
            raise Stale("overlap")
        return list(out.values())

    def merged(self, at: int, lines: list[str], touched: set[int]) -> tuple[int, int] | None:
        """The two lines that one new line stands for, if it says what its line and an unfinished neighbour said together."""
        own = self.rows[at]
        if len(lines) != 1 or not lines[0].strip() or not own.strip():
            return None
        new = _squeezed(lines[0])
        pairs = ((at, at + 1, lambda s: s), (at - 1, at, lambda s: re.sub(r"[|&?]", "", s)))
        for (up, low, bare), other in zip(pairs, (at + 1, at - 1)):
            if not 0 <= other < len(self.rows) or other in touched:
                continue
            head, tail = _squeezed(self.rows[up]), _squeezed(self.rows[low])
            begun = _OPEN_END.sub("", head)
            if begun == head:
                continue
            a, b = bare(new).find(bare(begun)), bare(new).find(bare(tail))
            if 0 <= a < b and len(new) <= len(head) + len(tail) + 32:
                return up, low
        return None

    def repaired(self, first: int, last: int, lines: list[str]) -> list[str]:
        """New lines without neighbours that they repeat, with old lines that they only wrap, and indented as the old ones."""
        same = lambda a, b: _squeezed(a) == _squeezed(b)
        if len(lines) > max(1, last - first + 1):
            if first > 0 and same(lines[0], self.rows[first - 1]):
                lines = lines[1:]
            if lines and last + 1 < len(self.rows) and same(lines[-1], self.rows[last + 1]):
                lines = lines[:-1]
        return self.paired(self.rows[first : last + 1], self.unwrapped(self.rows[first : last + 1], lines))

    @staticmethod
    def unwrapped(old: list[str], lines: list[str]) -> list[str]:
        """Runs of two to ten lines that are one old line but for white space become that line again, where both are met once."""
        known = Counter(map(_squeezed, old))
        once = {_squeezed(o): o for o in old if known[_squeezed(o)] == 1 and len(_squeezed(o)) >= 6}
        runs = [(i, n, c) for i in range(len(lines)) for n in range(2, min(10, len(lines) - i) + 1) if all(x.strip() for x in lines[i : i + n]) and (c := _squeezed("".join(lines[i : i + n]))) in once]
        met = Counter(c for *_, c in runs)
        for i, n, c in reversed(runs):
            if met[c] == 1:
                lines = [*lines[:i], once[c], *lines[i + n :]]
        return lines

    @staticmethod
    def paired(old: list[str], lines: list[str]) -> list[str]:
        """As many lines as before take the indentation of their old ones if they have none; an edit that changes nothing but was meant for
        look-alike hyphens gets plain ones."""
        if len(old) == len(lines):
            lines = [_indent(o) + n if n and not _indent(n) else n for o, n in zip(old, lines)]
        if old == lines and any(map(_HYPHENS.search, old)):
            lines = [_HYPHENS.sub("-", x) for x in lines]
        return lines

    def run(self) -> tuple[str | None, str, int | None, list[int], list[str]]:
        try:
            edits = self.resolved()
        except Stale as e:
            return None, str(e), None, [], []
        touched = {i for _, _, f, t, _ in edits for i in range(f, t + 1)}
        out, none, changed = list(self.rows), [], []
        for idx, kind, first, last, lines in sorted(edits, key=lambda e: (-e[3], e[1] == "put", e[0])):
            if kind == "put":
                lines = lines[1:] if len(lines) > 1 and _squeezed(lines[0]) == _squeezed(self.rows[first]) else lines
                if not lines:
                    none.append(idx)
                    continue
                at = first if self.rows == [""] else first + 1
                out[at : first + 1] = lines
                changed.append(at + 1)
                continue
            both = self.merged(first, lines, touched) if kind == "one" else None
            if both:
                first, last = both
                lines = self.paired(self.rows[first : first + 1], lines)
            else:
                lines = self.repaired(first, last, lines)
            if lines == self.rows[first : last + 1]:
                none.append(idx)
                continue
            out[first : last + 1] = lines
            changed.append(first + 1)
        return "\n".join(out), "ok" if changed else "no-op", min(changed, default=None), sorted(none), self.notes


def apply(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, new_text, outcome, first_changed, no_ops, notes), a row for each file (path, text, LF line ends) with edits.

    Edits are those of ``edits.apply``, with the content that stood behind an anchor in start_text and end_text if these columns are there. outcome is ok,
    no-op, or why the file stays as it was (new_text null): a missing line, a hash that differs, a range that has
    changed or runs backwards, an overlap. Edits of a file that isn't there have no row. Files travel to their edits by
    path once; files without edits don't travel."""
    known = {"start_text", "end_text"} & set(edits.columns)
    full = edits.select("*", *(F.lit(None).cast("string").alias(c) for c in ("start_text", "end_text") if c not in known))
    fields = ["edit_idx", "op", "start_line", "start_hash", "start_text", "end_line", "end_hash", "end_text", "new_text"]
    packed = full.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("edits"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [(p, *Request(t, [_plain(e) for e in es]).run()) for p, t, es in zip(pdf["path"], pdf["text"], pdf["edits"])]
            frame = pd.DataFrame(done, columns=["path", "new_text", "outcome", "first_changed", "no_ops", "notes"])
            yield frame.astype({"first_changed": "Int32"})

    return files.where("text is not null").select("path", "text").join(packed, "path").mapInPandas(work, RESULT)
