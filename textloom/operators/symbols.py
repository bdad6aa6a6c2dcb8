"""Symbols: enclosing ranges, definitions, trees, and lookup by name.

Symbol tables have (path, symbol_idx, kind, name, qualified_name, start_line, end_line).
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import dedent, identifier_span, indentation, normalize, reindent
from textloom.operators.ordered import by_file

BUCKETS = 256
BIN = 64


def _candidates(rows: DataFrame, symbols: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with each symbol whose range holds their line: an equi-join on path and a bin of 64 lines, so that a file
    of many symbols and many lines isn't multiplied out, with the range as the rest of the condition."""
    s = symbols.select("path", *(F.col(c).alias(f"s_{c}") for c in columns), F.explode(F.sequence(F.expr(f"start_line div {BIN}"), F.expr(f"end_line div {BIN}"))).alias("bin"))
    r = rows.withColumn("bin", F.expr(f"cast(line div {BIN} as bigint)"))
    return r.join(s, ["path", "bin"]).where((F.col("line") >= F.col("s_start_line")) & (F.col("line") <= F.col("s_end_line"))).drop("bin")


def _narrowest(rows: DataFrame, symbols: DataFrame, order: Column, columns: list[str]) -> DataFrame:
    places = rows.select("path", "line").distinct()
    best = _candidates(places, symbols, ["symbol_idx", "kind", "name", "qualified_name", "start_line", "end_line"])
    best = best.groupBy("path", "line").agg(F.min_by(F.struct(*(F.col(f"s_{c}").alias(c) for c in columns)), order).alias("s"))
    return rows.join(best, ["path", "line"], "left").select(*(rows[c] for c in rows.columns), *(F.col(f"s.{c}").alias(f"symbol_{c}") for c in columns))


def enclosing(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each row and the narrowest symbol around its line (nulls if none): symbol_kind, symbol_name, symbol_qualified_name,
    symbol_start_line, symbol_end_line. Of equally narrow ones the last by (start, end, index)."""
    order = F.struct(F.col("s_end_line") - F.col("s_start_line"), -F.col("s_start_line"), -F.col("s_end_line"), -F.col("s_symbol_idx"))
    return _narrowest(rows, symbols, order, ["kind", "name", "qualified_name", "start_line", "end_line"])


def enclosing_first(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """As ``enclosing``, but of equally narrow ones the first by start, then name."""
    order = F.struct(F.col("s_end_line") - F.col("s_start_line"), F.col("s_start_line"), F.col("s_name"))
    return _narrowest(rows, symbols, order, ["kind", "name", "qualified_name", "start_line", "end_line"])


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    """Definitions of a name: unqualified ones match the name or the whole qualified name, dotted ones the qualified name."""
    match = F.col("qualified_name") == name
    return symbols.where(match if "." in name else match | (F.col("name") == name))


def distinct_definitions(found: DataFrame) -> DataFrame:
    """One of the definitions with the same path, kind, name and range: the first by index."""
    w = Window.partitionBy("path", "kind", "name", "start_line", "end_line").orderBy("symbol_idx")
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def distinct_references(found: DataFrame) -> DataFrame:
    return found.dropDuplicates(["path", "line", "column"])


def postings(symbols: DataFrame) -> DataFrame:
    """(name, paths): sorted distinct paths of every name and qualified name."""
    names = symbols.select("name", "path").unionByName(symbols.where("qualified_name <> name").select(F.col("qualified_name").alias("name"), "path"))
    return names.groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def write_index(symbols: DataFrame, path: str) -> None:
    """The definition index in 256 folders by hash of the name; folders of buckets that are gone are replaced."""
    bucket = F.pmod(F.crc32(F.col("name").cast("binary")), F.lit(BUCKETS)).cast("int")
    postings(symbols).withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "name").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark, path: str, name: str) -> DataFrame:
    """(name, path) of one name: one folder is listed, and its files are skipped by the range of names in them."""
    rows = spark.read.parquet(path).where((F.col("bucket") == zlib.crc32(name.encode()) % BUCKETS) & (F.col("name") == name))
    return rows.select("name", F.explode("paths").alias("path"))


def definitions(symbols: DataFrame, name: str, scope: str = "", index: DataFrame | None = None) -> DataFrame:
    """Definitions within a folder. With an index (name, path), files that it doesn't name are skipped; where it has no file of the name in the
    folder, all files of the folder are searched, which one look at the few index rows of the name decides beforehand."""
    within = lambda df: df if not scope else df.where((F.col("path") == scope) | F.startswith("path", F.lit(scope.rstrip("/") + "/")))
    some = within(symbols)
    if index is not None:
        named = within(index.where(F.col("name") == name)).select("path").distinct()
        some = some if named.isEmpty() else some.join(named, "path", "left_semi")
    return distinct_definitions(by_name(some, name))


def parents(symbols: DataFrame) -> DataFrame:
    """(path, symbol_idx, parent_idx): the first symbol whose qualified name is this one's without its last part; null for none."""
    s = symbols.withColumn("parent_name", F.nullif(F.regexp_extract("qualified_name", r"^(.*)\.[^.]*$", 1), F.lit("")))
    first = symbols.groupBy("path", "qualified_name").agg(F.min("symbol_idx").alias("parent_idx"))
    return s.join(first.withColumnRenamed("qualified_name", "parent_name"), ["path", "parent_name"], "left").select("path", "symbol_idx", "parent_idx")


def lookup_tier(query: str) -> tuple[Column, Column]:
    """How a symbol meets a query: 1 its name, 2 its dotted path, 3 its dotted path without leading parts of the query, 4 its name in any
    case, 5 the beginning of its name, 6 one whole camel-case or underscored word of it, 7 any part of it; null for not at all. Second, how many
    parts of the query tier 3 leaves out, 0 for the other tiers."""
    query = query.strip()
    low, parts = query.lower(), query.split(".")
    name, qualified = F.col("name"), F.col("qualified_name")
    words = F.split(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")), r"[\s_]+", -1)
    tier, left_out = F.when(name == query, 1), F.lit(0)
    if len(parts) > 1 and all(parts):
        shorter = [".".join(parts[i:]) for i in range(1, len(parts))]
        tier = tier.when(qualified == query, 2).when(qualified.isin(shorter), 3)
        left_out = F.when((name == query) | (qualified == query), 0)
        for i, x in enumerate(shorter, 1):
            left_out = left_out.when(qualified == x, i)
        left_out = left_out.otherwise(0)
    tier = tier.when(F.lower(name) == low, 4).when(F.startswith(F.lower(name), F.lit(low)), 5)
    return tier.when(F.array_contains(words, low), 6).when(F.contains(F.lower(name), F.lit(low)), 7), left_out


def lookup(symbols: DataFrame, query: str, most: int = 5) -> DataFrame:
    """(path, tier, candidates, names): in each file the best tier that meets the query, how many symbols it has, and the first of them."""
    tier, left_out = lookup_tier(query)
    found = symbols.withColumn("tier", tier).withColumn("left_out", left_out).where("tier is not null")
    each = found.groupBy("path", "tier", "left_out").agg(F.count("*").alias("candidates"), F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "symbol_idx", "qualified_name"))), lambda s: s.qualified_name), 1, most), ",").alias("names"))
    best = F.struct("tier", "left_out")
    return each.groupBy("path").agg(F.min("tier").alias("tier"), F.min_by("candidates", best).alias("candidates"), F.min_by("names", best).alias("names"))


def nearest(symbols: DataFrame, at: DataFrame) -> DataFrame:
    """(path, line, name, tier) for each (path, line) of a file with symbols: 0 the first symbol around it by index, else 1 the one that begins next at or below
    it, else 2 the one that began last above it; of several that begin on one line the first by index.

    Ranges meet lines in bins; beginnings above and below come from two ordered passes over a file's lines and beginnings."""
    spots = at.select("path", "line").distinct()
    around = _candidates(spots, symbols, ["symbol_idx", "name", "start_line", "end_line"]).groupBy("path", "line").agg(F.min_by("s_name", "s_symbol_idx").alias("around"))
    heads = symbols.groupBy("path", F.col("start_line").alias("line")).agg(F.min_by("name", "symbol_idx").alias("head"))
    both = heads.withColumn("kind", F.lit(1)).unionByName(spots.withColumn("head", F.lit(None).cast("string")).withColumn("kind", F.lit(0)))
    w = Window.partitionBy("path").orderBy("line", "kind")
    both = both.withColumn("below", F.first("head", True).over(w.rowsBetween(0, Window.unboundedFollowing))).withColumn("above", F.last("head", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = both.where("kind = 0").join(around, ["path", "line"], "left")
    tier = F.when(F.col("around").isNotNull(), 0).when(F.col("below").isNotNull(), 1).when(F.col("above").isNotNull(), 2)
    return found.select("path", "line", F.coalesce("around", "below", "above").alias("name"), tier.alias("tier")).where("tier is not null")


def identify(rows: DataFrame, at: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, column, hash, text, token, start_column, end_column, symbol_*) of each cursor (path, line, column): its line, the identifier there (null if
    none) with byte columns, and the narrowest symbol around it. ``rows`` are (path, line, hash, text). A cursor may stand one byte behind
    its line; one further out, or on a line that isn't there, has no row."""
    here = at.join(rows, ["path", "line"]).where((F.col("column") >= 1) & (F.col("column") <= F.octet_length("text") + 1))
    here = here.withColumn("t", identifier_span(F.col("text"), F.col("column")))
    here = here.select("path", "line", "column", "hash", "text", F.col("t.text").alias("token"), F.col("t.start_column").alias("start_column"), F.col("t.end_column").alias("end_column"))
    return enclosing(here, symbols)


def local_bundle(rows: DataFrame, symbols: DataFrame, kind: str, containers: list[str]) -> DataFrame:
    """(path, symbol_idx, used_idx): for each symbol of ``kind``, the other symbols of its file that its lines name. Containers don't
    count; a symbol with any name that several symbols have gets none. A file's symbols are held while its lines pass in order."""
    marks = symbols.select("path", F.lit(0).alias("part"), F.col("start_line").alias("line"), F.col("name").alias("text"), "symbol_idx", "end_line", (F.col("kind") == kind).alias("home"), (~F.col("kind").isin(containers)).alias("other"))
    both = marks.unionByName(rows.where("line is not null and text is not null").select("path", F.lit(1).alias("part"), "line", "text"), allowMissingColumns=True)
    cut = re.compile("[A-Za-z0-9_]+").findall

    def work(group):
        homes, at, inside = [], 0, []
        others, named, unsure = defaultdict(list), defaultdict(set), set()
        for _, part, line, text, symbol_idx, end_line, home, other in group:
            if part == 0:  # all symbols come before the first line
                if home and None not in (line, text, end_line):
                    homes.append((line, end_line, symbol_idx, text))
                if other and text is not None:
                    others[text].append(symbol_idx)
                continue
            while at < len(homes) and homes[at][0] <= line:
                inside.append(homes[at])
                at += 1
            inside = [h for h in inside if h[1] >= line]
            words = {t for t in cut(text) if t in others} if inside else ()
            for _, _, symbol_idx, name in inside:
                for t in words:
                    if t != name and len(others[t]) > 1:
                        unsure.add(symbol_idx)
                    elif t != name:
                        named[symbol_idx].add(t)
        for symbol_idx, words in named.items():
            if symbol_idx not in unsure:
                for t in words:
                    yield symbol_idx, others[t][0]

    of = symbols.schema["symbol_idx"].dataType.simpleString()
    return by_file(both, ["part", "line"], work, f"path string, symbol_idx {of}, used_idx {of}")


TIERS = (("full", 10), ("compact", 20), ("minimal", 25), ("outline", 50), ("truncated", 100))


def map_detail(symbols: DataFrame) -> DataFrame:
    """(path, tier, bytes): the most detailed rendering of a file's symbols that fits its budget (10, 20, 25, 50, 100 KiB).

    full: kind, qualified name and range a line; compact: name and range; minimal: name and first line; outline: symbols without a
    parent, name and first line; truncated: the outline, cut."""
    n = lambda *c: F.sum(sum((F.octet_length(x.cast("string")) for x in c), F.lit(len(c)))).cast("long")
    name, s, e = F.col("name"), F.col("start_line"), F.col("end_line")
    top = ~F.contains("qualified_name", F.lit("."))
    size = symbols.groupBy("path").agg(n(F.col("kind"), F.col("qualified_name"), s, e).alias("full"), n(name, s, e).alias("compact"), n(name, s).alias("minimal"), F.coalesce(F.sum(F.when(top, F.octet_length(name) + F.octet_length(s.cast("string")) + 2)), F.lit(0)).cast("long").alias("outline"))
    tier, used = F.lit("truncated"), F.least("outline", F.lit(TIERS[-1][1] * 1024).cast("long"))
    for t, kib in reversed(TIERS[:-1]):
        fits = F.col(t) <= kib * 1024
        tier, used = F.when(fits, t).otherwise(tier), F.when(fits, F.col(t)).otherwise(used)
    return size.select("path", tier.alias("tier"), used.alias("bytes"))


def replace(files: DataFrame, symbols: DataFrame, bodies: DataFrame) -> DataFrame:
    """(path, new_text, outcome), one row a file: the lines of its symbols replaced by new bodies (path, symbol, body), each of which takes the
    indentation of the symbol's first line. ``symbol`` is a name or qualified name. A file changes as a whole or not: outcome is ok, or the worst of its
    bodies' not-found, ambiguous and overlap (two bodies whose symbols share lines), and new_text is null but for ok."""
    hits = bodies.join(symbols, "path").where((F.col("name") == F.col("symbol")) | (F.col("qualified_name") == F.col("symbol")))
    best = hits.groupBy("path", "symbol", "body").agg(F.countDistinct("symbol_idx").alias("n"), F.min("start_line").alias("start_line"), F.min_by("end_line", "start_line").alias("end_line"))
    each = bodies.distinct().join(best, ["path", "symbol", "body"], "left")
    state = F.when(F.col("n").isNull(), 0).when(F.col("n") > 1, 1).otherwise(2)
    packed = each.groupBy("path").agg(F.min(state).alias("state"), F.array_sort(F.collect_list(F.struct("start_line", "end_line", "body"))).alias("p"))
    packed = packed.withColumn("apart", F.forall(F.transform("p", lambda x, i: (i == 0) | (x.start_line > F.get("p", i - 1).end_line)), lambda ok: F.coalesce(ok, F.lit(True))))
    rows = files.select("path", F.split("text", "\n", -1).alias("l")).join(packed, "path")
    between = lambda a, b: F.slice("l", a + 1, F.greatest(F.lit(0), b - a - 1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    body = lambda x: F.array(reindent(dedent(normalize(x.body)), indentation(F.get("l", x.start_line - 1))))
    spliced = F.aggregate("p", start, lambda a, x: F.struct(x.end_line.alias("at"), F.concat(a.out, between(a.at, x.start_line), body(x)).alias("out")), lambda a: F.concat(a.out, between(a.at, F.size("l") + 1)))
    outcome = F.when(F.col("state") == 0, "not-found").when(F.col("state") == 1, "ambiguous").when(~F.col("apart"), "overlap").otherwise("ok")
    return rows.select("path", F.when(outcome == "ok", F.array_join(spliced, "\n")).alias("new_text"), outcome.alias("outcome"))


def grep_windows(found: DataFrame, symbols: DataFrame, around: int | None = None) -> DataFrame:
    """(path, symbol_name, start_line, end_line, matches): what a search shows of each enclosing symbol: all of it, or with ``around`` the
    lines near matches, clipped to the symbol, windows that touch being one. Matches outside of symbols form windows of their own."""
    placed = enclosing_first(found, symbols)
    if around is None:
        whole = placed.withColumn("start_line", F.coalesce("symbol_start_line", "line")).withColumn("end_line", F.coalesce("symbol_end_line", "line"))
        return whole.groupBy("path", "symbol_name", "start_line", "end_line").agg(F.count("*").alias("matches"))
    low = F.greatest(F.lit(1), F.coalesce("symbol_start_line", F.lit(1)), F.col("line") - around)
    high = F.least(F.coalesce(F.col("symbol_end_line"), F.col("line") + around), F.col("line") + around)
    w = Window.partitionBy("path", "symbol_name", "symbol_start_line").orderBy("low", "line")
    rows = placed.withColumn("low", low).withColumn("high", high)
    rows = rows.withColumn("new", F.when(F.col("low") <= F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("path", "symbol_name", "symbol_start_line", "island").agg(F.min("low").alias("start_line"), F.max("high").alias("end_line"), F.count("*").alias("matches")).select("path", "symbol_name", "start_line", "end_line", "matches")


def outside(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Spans (path, byte) that no range (path, start_byte, end_byte) holds; the end is outside. Ranges don't nest or overlap, so one ordered
    pass finds the last one that began."""
    both = ranges.select("path", F.col("start_byte").alias("at"), F.lit(0).alias("kind"), F.col("end_byte")).unionByName(spans.select("path", F.col("byte").alias("at"), F.lit(1).alias("kind")), allowMissingColumns=True)
    w = Window.partitionBy("path").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("e", F.last("end_byte", True).over(w)).where((F.col("kind") == 1) & (F.col("e").isNull() | (F.col("at") >= F.col("e")))).select("path", F.col("at").alias("byte"))
