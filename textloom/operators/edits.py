"""Anchored edits: checking, relocating and applying them to whole tables of files.

Edits have (path, edit_idx, op, start_line, start_hash, end_line, end_hash, new_text); op is set_line, replace_lines or
insert_after. Lines have (path, line, hash, text).
"""

from __future__ import annotations

import difflib
import heapq
import re
from collections import deque
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import DASHES, EDGES, QUOTES, WIDE, eol_majority
from textloom.operators.ordered import by_file

SIMILAR, RELOCATE, SPAN = 0.3, 0.8, 50


def verify(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """Each edit's (path, edit_idx, conflict): null, or ``missing line`` or ``hash differs`` for its first bad anchor."""
    marks = edits.select("path", "edit_idx", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start_line").alias("line"), F.col("start_hash").alias("want")), F.struct(F.lit(1).alias("side"), F.col("end_line").alias("line"), F.col("end_hash").alias("want")))).alias("m")).select("path", "edit_idx", "m.*").where("line is not null")
    found = marks.join(rows.select("path", "line", "hash"), ["path", "line"], "left")
    bad = F.when(F.col("hash").isNull(), "missing line").when(F.col("hash") != F.col("want"), "hash differs")
    return found.groupBy("path", "edit_idx").agg(F.min(F.when(bad.isNotNull(), F.struct("side", bad.alias("why")))).alias("b")).select("path", "edit_idx", F.col("b.why").alias("conflict"))


def relocation_window(edits_per_file: int) -> int:
    return max(20, min(100, 5 * edits_per_file))


def relocate(stale: DataFrame, rows: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """(path, edit_idx, line, new_line) for stale anchors (path, edit_idx, line, hash) whose hash is met on exactly one line within
    the window: five times the file's ``edits`` (of the stale ones if not given), 20 to 100 lines each way. An equi-join on path and hash; the
    band is the rest."""
    n = (stale if edits is None else edits).groupBy("path").agg(F.greatest(F.lit(20), F.least(F.lit(100), F.count("*") * 5)).alias("w"))
    band = stale.join(n, "path").join(rows.select("path", "hash", F.col("line").alias("new_line")), ["path", "hash"]).where(F.abs(F.col("new_line") - F.col("line")) <= F.col("w"))
    return band.groupBy("path", "edit_idx", "line").agg(F.count("*").alias("n"), F.min("new_line").alias("new_line")).where("n = 1").drop("n")


def _beside(wanted: DataFrame, rows: DataFrame, schema: str, least: float, found: Callable[[list[tuple[float, int]]], Iterable[tuple]]) -> DataFrame:
    """(path, edit_idx, *what ``found`` makes of [(similarity, near_line)]) for each of ``wanted`` (path, edit_idx, line, old_text), of the lines within 50 that
    share ``least`` of their tokens. A file's lines pass in order, cut into tokens once; at any time only those within 50 of a wanted
    one are held. Sets whose sizes alone rule ``least`` out aren't compared."""
    near = rows.where("line is not null and text is not null").select("path", "line", F.lit(0).alias("want"), F.lit(None).cast(wanted.schema["edit_idx"].dataType).alias("edit_idx"), "text")
    both = near.unionByName(wanted.where("line is not null and old_text is not null").select("path", "line", F.lit(1).alias("want"), "edit_idx", F.col("old_text").alias("text")))
    cut = re.compile(r"[^ \t\n\r\f\x0B]+").findall

    def work(group):
        lines, waiting = deque(), deque()

        def settle(before):
            while waiting and (before is None or waiting[0][0] + SPAN < before):
                line, edit_idx, want = waiting.popleft()
                while lines and lines[0][0] < line - SPAN:
                    lines.popleft()
                n, hits = len(want), []
                for at, have in lines:
                    if at > line + SPAN:
                        break
                    few, many = (n, len(have)) if n < len(have) else (len(have), n)
                    if few / many >= least and (shared := len(want & have) / many) >= least:
                        hits.append((shared, at))
                for x in found(hits):
                    yield edit_idx, *x

        for _, line, want, edit_idx, text in group:
            yield from settle(line)
            while lines and lines[0][0] < (waiting[0][0] if waiting else line) - SPAN:
                lines.popleft()
            if words := set(cut(text)):
                waiting.append((line, edit_idx, words)) if want else lines.append((line, words))
        yield from settle(None)

    return by_file(both, ["line", "want"], work, f"path string, edit_idx {wanted.schema['edit_idx'].dataType.simpleString()}, {schema}")


def relocate_fuzzy(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, edit_idx, new_line) where exactly one line within 50 shares more than 0.8 of its tokens with ``old_text``."""

    def first(hits):
        places = [at for shared, at in hits if shared > RELOCATE]
        return [(len(places), places[0])] if places else []

    hits = _beside(wanted, rows, f"n long, near_line {rows.schema['line'].dataType.simpleString()}", RELOCATE, first)
    return hits.groupBy("path", "edit_idx").agg(F.sum("n").alias("n"), F.min("near_line").alias("new_line")).where("n = 1").drop("n")


def similar_lines(wanted: DataFrame, rows: DataFrame, most: int = 3) -> DataFrame:
    """(path, edit_idx, rank, near_line, similarity): the most similar lines within 50, of 0.3 at least; earlier ones first at a tie."""

    def best(hits):
        return heapq.nsmallest(most, ((-shared, at) for shared, at in hits))

    hits = _beside(wanted, rows, f"away double, near_line {rows.schema['line'].dataType.simpleString()}", SIMILAR, best).withColumn("similarity", -F.col("away"))
    w = Window.partitionBy("path", "edit_idx").orderBy(F.desc("similarity"), "near_line")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("path", "edit_idx", "rank", "near_line", "similarity")


def overlaps(edits: DataFrame) -> DataFrame:
    """(path, edit_idx) of edits that start at or before the furthest end of those before them; insertions take no lines."""
    spans = edits.where("op <> 'insert_after'").select("path", "edit_idx", "start_line", F.coalesce("end_line", "start_line").alias("end_line"))
    w = Window.partitionBy("path").orderBy("start_line", "end_line", "edit_idx").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("before", F.max("end_line").over(w)).where(F.col("start_line") <= F.col("before")).select("path", "edit_idx")


def apply(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, new_text, changed) of every file with edits that all hold; a file with a conflict or an overlap is left out.

    Lines taken by an edit go, its text stands in the place of the first of them, inserted text behind its line, in order of
    edit_idx; the splice is one sorted aggregation a file. Equal edits count once. Lines are joined by LF and none
    follows the last, as ``rows`` don't tell whether one did."""
    unique = edits.dropDuplicates(["path", "op", "start_line", "end_line", "new_text"])
    bad = verify(unique, rows).where("conflict is not null").select("path").unionByName(overlaps(unique).select("path")).distinct()
    good = unique.join(bad, "path", "left_anti")
    mine = rows.join(good.select("path").distinct(), "path", "left_semi")
    cuts = good.where("op <> 'insert_after'").select("path", F.explode(F.sequence("start_line", F.coalesce("end_line", "start_line"))).alias("line"), F.lit(1).alias("gone")).distinct()
    kept = mine.join(cuts, ["path", "line"], "left").where("gone is null").select("path", "line", F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), "text")
    put = good.where("new_text is not null").select("path", F.col("start_line").alias("line"), F.when(F.col("op") == "insert_after", 1).otherwise(0).alias("part"), F.col("edit_idx").cast("long").alias("seq"), F.col("new_text").alias("text"))
    out = kept.unionByName(put).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part", "seq", "text"))), lambda x: x.text), "\n").alias("new_text"))
    # a file whose lines all go has no text left
    return good.select("path").distinct().join(out, "path", "left").select("path", F.coalesce("new_text", F.lit("")).alias("new_text"))


def no_ops(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose text an edit left as it was."""
    return after.join(before.select("path", F.col("text").alias("new_text")), ["path", "new_text"], "left_semi").select("path")


def classify(pairs: DataFrame) -> DataFrame:
    """(path, kind) of (path, old, new) changed lines: no-op, whitespace-only, semantic, or mixed."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\r\f\x0B]+", "")
    changed = ~F.col("old").eqNullSafe(F.col("new"))
    blank = changed & (bare(F.col("old")) == bare(F.col("new")))
    flags = pairs.groupBy("path").agg(F.bool_or(blank).alias("b"), F.bool_or(changed & ~blank).alias("s"))
    return flags.select("path", F.when(F.col("b") & F.col("s"), "mixed").when(F.col("s"), "semantic").when(F.col("b"), "whitespace-only").otherwise("no-op").alias("kind"))


def stale_report(stale: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, edit_idx, line, hash, text): the two lines on each side of a stale anchor, with fresh hashes."""
    around = stale.select("path", "edit_idx", F.explode(F.sequence(F.col("line") - 2, F.col("line") + 2)).alias("line"))
    return around.join(rows, ["path", "line"]).select("path", "edit_idx", "line", "hash", "text")


def diff(pairs: DataFrame, context: int = 4) -> DataFrame:
    """(path, seq, kind, text) line diff of (path, old, new): context, add and remove lines, ``context`` lines around changes,
    a meta line where more were left out. Runs a file at a time in Arrow batches."""

    def rows(batches):
        for pdf in batches:
            out = []
            for path, old, new in zip(pdf["path"], pdf["old"], pdf["new"]):
                a, b = (old or "").split("\n"), (new or "").split("\n")
                seq, last = 0, 0
                for group in difflib.SequenceMatcher(None, a, b, False).get_grouped_opcodes(context):
                    if group[0][1] > last:
                        out.append((path, seq, "meta", "..."))
                        seq += 1
                    for op, i1, i2, j1, j2 in group:
                        cut = [("context", x) for x in a[i1:i2]] if op == "equal" else [*(("remove", x) for x in a[i1:i2]), *(("add", x) for x in b[j1:j2])]
                        for kind, text in cut:
                            out.append((path, seq, kind, text))
                            seq += 1
                        last = i2
            yield pd.DataFrame(out, columns=["path", "seq", "kind", "text"]).astype({"seq": "int32"})

    return pairs.select("path", "old", "new").mapInPandas(rows, "path string, seq int, kind string, text string")


def diff_stats(diffs: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k)
    return diffs.groupBy("path").agg(n("add").alias("added"), n("remove").alias("removed"), n("context").alias("context"))


def inline_diff(pairs: DataFrame, least: float = 0.35, longest: int = 2000) -> DataFrame:
    """(path, old_spans, new_spans): character ranges of changed tokens of (path, old, new) lines; none if the lines share less than
    ``least`` of their tokens or are longer than ``longest``."""

    def spans(words: list[str], keep: set[int]) -> list[dict]:
        out, at = [], 0
        for i, w in enumerate(words):
            if i not in keep and w.strip():
                out.append({"start": at, "end": at + len(w)})
            at += len(w)
        return out

    def rows(batches):
        for pdf in batches:
            out = []
            for path, old, new in zip(pdf["path"], pdf["old"], pdf["new"]):
                a, b = re.findall(r"\w+|\s+|[^\w\s]", old or ""), re.findall(r"\w+|\s+|[^\w\s]", new or "")
                m = difflib.SequenceMatcher(None, a, b, False)
                if max(len(old or ""), len(new or "")) > longest or m.ratio() < least:
                    out.append((path, [], []))
                    continue
                ka = {x.a + i for x in m.get_matching_blocks() for i in range(x.size)}
                kb = {x.b + i for x in m.get_matching_blocks() for i in range(x.size)}
                out.append((path, spans(a, ka), spans(b, kb)))
            yield pd.DataFrame(out, columns=["path", "old_spans", "new_spans"])

    t = "array<struct<start:int,end:int>>"
    return pairs.select("path", "old", "new").mapInPandas(rows, f"path string, old_spans {t}, new_spans {t}")


_ASCII = str.maketrans({**dict.fromkeys(QUOTES[:4], "'"), **dict.fromkeys(QUOTES[4:], '"'), **dict.fromkeys(DASHES, "-"), **dict.fromkeys(WIDE, " ")})
_EDGES = "\t\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _fuzzy_pattern(old: str) -> str:
    """A regular expression for what ``functions.text.fuzzy`` makes equal to ``old``; empty if that leaves nothing of it. White space at the end of
    a line is passed only before a line break within ``old``: any other blank of it has more of its line behind it, so the text's has too."""
    code = lambda c: rf"\x{{{ord(c):x}}}"
    alike = {c: "[" + "".join(map(code, [c, *(chr(k) for k, v in _ASCII.items() if v == c)])) + "]" for c in "'\"- "}
    wanted = "\n".join(line.rstrip(_EDGES).translate(_ASCII) for line in old.split("\n"))
    return "".join((f"[{EDGES}]*+\n" if i else "\n") if c == "\n" else alike.get(c) or code(c) for i, c in enumerate(wanted))


def replace_fuzzy(files: DataFrame, old: str, new: str, everywhere: bool = False) -> DataFrame:
    """(path, new_text, hits) of files that don't contain ``old`` but do if white space at the ends of lines, quotes, dashes and blanks are seen as alike: what stood
    in the place of the hits, all or the first, is replaced, and nothing else in the file changes."""
    pattern = _fuzzy_pattern(old)
    text = F.col("text")
    some = files.where(~F.contains(text, F.lit(old)) & text.rlike(pattern)) if pattern else files.limit(0)
    parts = F.split(text, pattern, 2)
    # a backslash and a dollar sign are marks in what replaces a regular expression
    out = F.regexp_replace(text, F.lit(pattern), F.lit(re.sub(r"([\\$])", r"\\\1", new))) if everywhere else F.concat(F.get(parts, F.lit(0)), F.lit(new), F.get(parts, F.lit(1)))
    return some.select("path", out.alias("new_text"), F.regexp_count("text", F.lit(pattern)).cast("long").alias("hits"))


def replace_text(files: DataFrame, old: str, new: str, everywhere: bool = False, fuzzily: bool = False) -> DataFrame:
    """(path, new_text, hits) of files that contain ``old``: all hits replaced, or the first. With ``fuzzily`` files without an exact hit may have
    one by ``replace_fuzzy``. Nothing contains an empty ``old``."""
    if not old:
        return files.limit(0).select("path", F.col("text").alias("new_text"), F.lit(0).cast("long").alias("hits"))
    new = new.replace("\r\n", "\n").replace("\r", "\n")
    if fuzzily:
        return replace_text(files, old, new, everywhere).unionByName(replace_fuzzy(files, old, new, everywhere))
    size = F.char_length(F.lit(old))
    some = files.where(F.contains("text", F.lit(old)))
    hits = ((F.char_length("text") - F.char_length(F.replace("text", F.lit(old), F.lit("")))) / size).cast("long")
    at = F.instr("text", F.lit(old))
    first = F.concat(F.substring("text", F.lit(1), at - 1), F.lit(new), F.substring("text", at + size, F.char_length("text")))
    return some.select("path", (F.replace("text", F.lit(old), F.lit(new)) if everywhere else first).alias("new_text"), hits.alias("hits"))


def compare_and_swap(files: DataFrame, writes: DataFrame) -> DataFrame:
    """(path, file_hash, new_text, written): a write (path, expected, new_text) takes effect only where the content's hash is the expected one."""
    now = files.select("path", F.sha2("text", 256).alias("file_hash"))
    return writes.join(now, "path", "left").select("path", "file_hash", "new_text", F.coalesce(F.col("file_hash") == F.col("expected"), F.lit(False)).alias("written"))


def restore_line_ends(files: DataFrame, original: str, text: str) -> DataFrame:
    """Adds ``written``: ``text`` with the byte order mark and the prevailing line ends of ``original``; null where the text holds a lone
    CR or a NUL, which is refused."""
    mark = F.when(F.startswith(original, F.lit("\ufeff")), F.lit("\ufeff")).otherwise(F.lit(""))
    refused = F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x00"))
    body = F.when(eol_majority(F.col(original)) == "\r\n", F.replace(F.col(text), F.lit("\n"), F.lit("\r\n"))).otherwise(F.col(text))
    return files.withColumn("written", F.when(~refused, F.concat(mark, body)))


def fresh_only(edits: DataFrame, anchored: DataFrame) -> DataFrame:
    """Edits of files that were anchored in the same session: (session, path) semi-join."""
    return edits.join(anchored, ["session", "path"], "left_semi")




def apply_relocating(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """As ``apply``, but an edit of one line whose anchor is stale moves to the one line near it that has its hash; edits that find no
    such line, or several, keep their file from being changed."""
    single = edits.where("end_line is null")
    state = verify(single, rows).where("conflict is not null")
    stale = single.join(state, ["path", "edit_idx"], "left_semi").select("path", "edit_idx", F.col("start_line").alias("line"), F.col("start_hash").alias("hash"))
    moved = relocate(stale, rows, edits).select("path", "edit_idx", "new_line")
    out = edits.join(moved, ["path", "edit_idx"], "left").withColumn("start_line", F.coalesce("new_line", "start_line")).select(*edits.columns)
    return apply(out, rows)


def syntax_gate(applied: DataFrame, worse: DataFrame, mode: str = "warn") -> DataFrame:
    """Edited files with ``warning``; in mode ``block`` files whose syntax got worse (path) are left out, in ``off`` nothing is checked."""
    if mode not in ("warn", "block", "off"):
        raise ValueError("mode is warn, block or off")
    if mode == "off":
        return applied.withColumn("warning", F.lit(False))
    marked = applied.join(worse.select("path", F.lit(True).alias("w")).distinct(), "path", "left").withColumn("warning", F.coalesce("w", F.lit(False))).drop("w")
    return marked.where("not warning") if mode == "block" else marked
