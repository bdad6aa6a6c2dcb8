"""Queries over symbols, edits, renames and parsed code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import anchored, identifiers, output, parsing, rename
from textloom.operators import edits as E
from textloom.operators import lines as L
from textloom.operators import symbols as Y
from textloom.plans import sql as S
from textloom.sources import corpus

REGISTERED: dict = {}


def query(sql: str | None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


_CHAT = f"{S.CHATS}, {S.CHAT_SYMBOLS}, {S.LINES}"
_DOC = f"{S.DOCS}, {S.LINES}, {S.BLOCKS}"


@query(f"WITH {_CHAT}, {S.enclosing('lines', S.LAST)} SELECT path, line, text, {S.SYMBOL_COLUMNS} FROM lines LEFT JOIN inside USING (path, line)")
def enclosing_symbols(spark, sf):
    return Y.enclosing(corpus.lines(corpus.chat_files(spark, sf)), corpus.chat_symbols(spark, sf))


@query(f"WITH {_DOC}, hits AS (SELECT path, line, text FROM lines WHERE contains(text, 'the')), {S.enclosing('hits', S.FIRST)} SELECT path, line, text, {S.SYMBOL_COLUMNS} FROM hits LEFT JOIN inside USING (path, line)")
def grep_in_symbols(spark, sf):
    files = corpus.document_files(spark, sf)
    return Y.enclosing_first(L.grep(files, "the", literal=True), corpus.block_symbols(files))


@query(f"""WITH {_DOC}, hits AS (SELECT path, line, text FROM lines WHERE contains(text, 'the')), {S.enclosing('hits', S.FIRST)} SELECT path, symbol_name, symbol_start_line, symbol_end_line, count(*) AS matches FROM hits LEFT JOIN inside USING (path, line) GROUP BY ALL""")
def grep_by_symbol(spark, sf):
    return grep_in_symbols(spark, sf).groupBy("path", "symbol_name", "symbol_start_line", "symbol_end_line").agg(F.count("*").alias("matches"))


@query(f"WITH {_CHAT} SELECT path, symbol_idx, kind, name, qualified_name, start_line, end_line FROM symbols WHERE name = 'turn_1' OR qualified_name = 'turn_1'")
def find_definitions(spark, sf):
    return Y.definitions(corpus.chat_symbols(spark, sf), "turn_1")


@query(f"""WITH {_CHAT} SELECT path, symbol_idx, kind, name, qualified_name, start_line, end_line FROM symbols WHERE qualified_name = 'conversation.turn_0' AND starts_with(path, 'chat/')""")
def indexed_definitions(spark, sf):
    symbols = corpus.chat_symbols(spark, sf)
    index = Y.postings(symbols).select("name", F.explode("paths").alias("path"))
    return Y.definitions(symbols, "conversation.turn_0", "chat/", index)


@query(f"""WITH {_CHAT}, n AS (SELECT name, path FROM symbols UNION SELECT qualified_name, path FROM symbols) SELECT name, count(*) AS files, min(path) AS first_path, max(path) AS last_path FROM n GROUP BY name""")
def definition_index(spark, sf):
    return Y.postings(corpus.chat_symbols(spark, sf)).select("name", F.size("paths").cast("long").alias("files"), F.col("paths")[0].alias("first_path"), F.element_at("paths", -1).alias("last_path"))


@query(f"""WITH {_DOC}, p AS (SELECT *, nullif(regexp_extract(qualified_name, '^(.*)[.][^.]*$', 1), '') AS up FROM symbols), f AS (SELECT path, qualified_name, min(symbol_idx) AS parent_idx FROM symbols GROUP BY ALL)
SELECT p.path, p.symbol_idx, f.parent_idx FROM p LEFT JOIN f ON p.path = f.path AND p.up = f.qualified_name""")
def symbol_parents(spark, sf):
    return Y.parents(corpus.block_symbols(corpus.document_files(spark, sf)))


def _lookup(wanted: str, shorter: str = "") -> str:
    low = wanted.lower()
    words = "string_split_regex(lower(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[\\s_]+')"
    tier = f"CASE WHEN name = '{wanted}' THEN 1 WHEN qualified_name = '{wanted}' THEN 2 WHEN qualified_name = '{shorter}' THEN 3 WHEN lower(name) = '{low}' THEN 4 WHEN starts_with(lower(name), '{low}') THEN 5 WHEN list_contains({words}, '{low}') THEN 6 WHEN contains(lower(name), '{low}') THEN 7 END"
    return f"""WITH {_DOC}, t AS (SELECT *, {tier} AS tier FROM symbols), k AS (SELECT path, tier, count(*) AS candidates, array_to_string(list_slice(list(qualified_name ORDER BY start_line, end_line, symbol_idx), 1, 5), ',') AS names FROM t WHERE tier IS NOT NULL GROUP BY ALL)
SELECT path, tier, candidates, names FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY tier) AS n FROM k) WHERE n = 1"""


@query(_lookup("Section_1"))
def symbol_lookup(spark, sf):
    return Y.lookup(corpus.block_symbols(corpus.document_files(spark, sf)), "Section_1")


@query(_lookup("1"))
def symbol_lookup_word(spark, sf):
    return Y.lookup(corpus.block_symbols(corpus.document_files(spark, sf)), "1")


@query(_lookup("book.file_1.section_1", "file_1.section_1"))
def symbol_lookup_suffix(spark, sf):
    return Y.lookup(corpus.block_symbols(corpus.document_files(spark, sf)), "book.file_1.section_1")


_NEAR = "CASE WHEN line BETWEEN start_line AND end_line THEN 0 WHEN start_line >= line THEN 1 ELSE 2 END"
_GAP = "CASE WHEN line BETWEEN start_line AND end_line THEN 0 ELSE abs(start_line - line) END"


@query(f"""WITH {_CHAT}, chosen AS (SELECT * FROM symbols WHERE kind = 'assistant')
SELECT path, line, name, tier FROM (SELECT lines.path, line, name, {_NEAR} AS tier, row_number() OVER (PARTITION BY lines.path, line ORDER BY {_NEAR}, {_GAP}, symbol_idx) AS n FROM lines JOIN chosen ON lines.path = chosen.path) WHERE n = 1""")
def nearest_symbol(spark, sf):
    at = corpus.lines(corpus.chat_files(spark, sf)).select("path", "line")
    return Y.nearest(corpus.chat_symbols(spark, sf).where("kind = 'assistant'"), at)


@query(f"""WITH {_CHAT}, {S.hashes('lines')}, cut AS (SELECT path, line, hash, text, length(text) // 2 + 1 AS i FROM lines JOIN hashed USING (text) WHERE text <> ''),
spot AS (SELECT *, strlen(substr(text, 1, i - 1)) + 1 AS c, regexp_extract(substr(text, 1, i - 1), '[A-Za-z0-9_]*$') AS a, regexp_extract(substr(text, i), '^[A-Za-z0-9_]*') AS b FROM cut), {S.enclosing('lines', S.LAST)}
SELECT path, line, c::int AS "column", hash, text, nullif(a || b, '') AS token, CASE WHEN a || b <> '' THEN (c - length(a))::int END AS start_column, CASE WHEN a || b <> '' THEN (c + length(b))::int END AS end_column, {S.SYMBOL_COLUMNS} FROM spot LEFT JOIN inside USING (path, line)""")
def identify(spark, sf):
    rows = _rows(spark, sf)
    half = F.expr("char_length(text) div 2").cast("int")
    at = rows.where("text <> ''").select("path", "line", (F.octet_length(F.left("text", half)) + 1).alias("column"))
    return Y.identify(rows, at, corpus.chat_symbols(spark, sf))


@query(f"""WITH {_DOC}, tok AS (SELECT DISTINCT path, line, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS token FROM lines),
named AS (SELECT * REPLACE ('w' || symbol_idx % 7 AS name) FROM symbols), words AS (SELECT path, line, CASE WHEN length(token) % 2 = 0 THEN 'w' || length(token) % 7 ELSE token END AS token FROM tok),
h AS (SELECT DISTINCT s.path, s.symbol_idx, w.token FROM named s JOIN words w ON s.path = w.path AND w.line BETWEEN s.start_line AND s.end_line WHERE s.kind = 'section' AND w.token <> s.name),
j AS (SELECT h.path, h.symbol_idx, h.token, o.symbol_idx AS used_idx FROM h JOIN named o ON h.path = o.path AND h.token = o.name WHERE o.kind NOT IN ('file')),
m AS (SELECT DISTINCT path, symbol_idx FROM (SELECT path, symbol_idx, token FROM j GROUP BY ALL HAVING count(*) > 1))
SELECT path, symbol_idx, used_idx FROM j ANTI JOIN m USING (path, symbol_idx)""")
def local_bundle(spark, sf):
    files = corpus.document_files(spark, sf)
    symbols = corpus.block_symbols(files).withColumn("name", F.concat(F.lit("w"), (F.col("symbol_idx") % 7).cast("string")))
    word = r"([A-Za-z0-9_]+)"
    # even words stand for names here, as the corpus is prose
    rows = corpus.lines(files).withColumn("text", F.array_join(F.transform(F.regexp_extract_all("text", F.lit(word), 1), lambda t: F.when(F.char_length(t) % 2 == 0, F.concat(F.lit("w"), (F.char_length(t) % 7).cast("string"))).otherwise(t)), " "))
    return Y.local_bundle(rows, symbols, "section", ["file"])


@query(f"""WITH {_DOC}, z AS (SELECT path, sum(strlen(kind) + strlen(qualified_name) + strlen(start_line::varchar) + strlen(end_line::varchar) + 4) AS f, sum(strlen(name) + strlen(start_line::varchar) + strlen(end_line::varchar) + 3) AS c, sum(strlen(name) + strlen(start_line::varchar) + 2) AS m, coalesce(sum(CASE WHEN NOT contains(qualified_name, '.') THEN strlen(name) + strlen(start_line::varchar) + 2 END), 0) AS o FROM symbols GROUP BY path)
SELECT path, CASE WHEN f <= 10240 THEN 'full' WHEN c <= 20480 THEN 'compact' WHEN m <= 25600 THEN 'minimal' WHEN o <= 51200 THEN 'outline' ELSE 'truncated' END AS tier, (CASE WHEN f <= 10240 THEN f WHEN c <= 20480 THEN c WHEN m <= 25600 THEN m WHEN o <= 51200 THEN o ELSE least(o, 102400) END)::bigint AS bytes FROM z""")
def map_detail(spark, sf):
    return Y.map_detail(corpus.block_symbols(corpus.document_files(spark, sf)))


# edits: on every fourth line of each conversation


def _rows(spark, sf):
    return L.read_range(corpus.chat_files(spark, sf))


def _edits(rows: DataFrame) -> DataFrame:
    """Line 4k + 1 is set, line 4k + 3 gets a line behind it; every seventh anchor is wrong."""
    pick = rows.where("line % 4 in (1, 3)")
    op = F.when(F.col("line") % 4 == 1, "set_line").otherwise("insert_after")
    digest = F.when(F.col("line") % 28 == 5, F.lit("zzz")).otherwise(F.col("hash"))
    return pick.select("path", F.col("line").alias("edit_idx"), op.alias("op"), F.col("line").alias("start_line"), digest.alias("start_hash"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("end_hash"), F.concat(F.lit("new "), F.col("line").cast("string")).alias("new_text"))


_EDITS = f"{S.CHATS}, {S.LINES}, {S.hashes('lines')}, rows AS (SELECT path, line, hash, text FROM lines JOIN hashed USING (text))"


@query(f"WITH {_EDITS} SELECT path, line AS edit_idx, CASE WHEN line % 28 = 5 THEN 'hash differs' END AS conflict FROM rows WHERE line % 4 IN (1, 3)")
def verify_edits(spark, sf):
    rows = _rows(spark, sf)
    return E.verify(_edits(rows), rows)


@query(f"""WITH {_EDITS}, bad AS (SELECT DISTINCT path FROM rows WHERE line % 28 = 5)
SELECT path, string_agg(CASE line % 4 WHEN 1 THEN 'new ' || line WHEN 3 THEN text || chr(10) || 'new ' || line ELSE text END, chr(10) ORDER BY line) AS new_text FROM rows r WHERE path NOT IN (SELECT path FROM bad) GROUP BY path HAVING count(*) FILTER (line % 4 IN (1, 3)) > 0""")
def apply_edits_checked(spark, sf):
    rows = _rows(spark, sf)
    return E.apply(_edits(rows), rows)


@query(f"""WITH {S.CHATS}, {S.LINES} SELECT path, string_agg(CASE line % 4 WHEN 1 THEN 'new ' || line WHEN 3 THEN text || chr(10) || 'new ' || line ELSE text END, chr(10) ORDER BY line) AS new_text FROM lines GROUP BY path""")
def apply_edits(spark, sf):
    rows = _rows(spark, sf)
    good = _edits(rows).join(rows.select("path", F.col("line").alias("edit_idx"), "hash"), ["path", "edit_idx"]).withColumn("start_hash", F.col("hash")).drop("hash")
    return E.apply(good, rows)


@query(f"""WITH {S.DOCS}, {S.LINES}, e AS (SELECT path, line AS edit_idx, line AS s, line + length(text) % 3 AS t FROM lines WHERE contains(text, 'the'))
SELECT path, edit_idx FROM (SELECT *, max(t) OVER (PARTITION BY path ORDER BY s, t, edit_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) WHERE s <= before""")
def overlapping_edits(spark, sf):
    hits = L.grep(corpus.document_files(spark, sf), "the", literal=True)
    return E.overlaps(hits.select("path", F.col("line").alias("edit_idx"), F.lit("replace_lines").alias("op"), F.col("line").alias("start_line"), (F.col("line") + F.char_length("text") % 3).alias("end_line")))


@query(f"""WITH {_EDITS}, stale AS (SELECT path, line AS edit_idx, line + 3 AS line, hash FROM rows), n AS (SELECT path, greatest(20, least(100, 5 * count(*))) AS w FROM stale GROUP BY path),
b AS (SELECT s.path, s.edit_idx, s.line, r.line AS new_line FROM stale s JOIN n USING (path) JOIN rows r ON r.path = s.path AND r.hash = s.hash AND abs(r.line - s.line) <= w)
SELECT path, edit_idx, line, min(new_line) AS new_line FROM b GROUP BY ALL HAVING count(*) = 1""".replace("GROUP BY ALL HAVING", "GROUP BY path, edit_idx, line HAVING"))
def relocate_anchors(spark, sf):
    rows = _rows(spark, sf)
    return E.relocate(rows.select("path", F.col("line").alias("edit_idx"), (F.col("line") + 3).alias("line"), "hash"), rows)


_TOK = r"list_distinct(list_filter(regexp_split_to_array({}, '[ \t\n\r\f\x0B]+'), lambda t: t <> ''))"
_BAND = f"""WITH {S.DOCS}, {S.LINES}, k AS (SELECT *, {_TOK.format('text')} AS t FROM lines), w AS (SELECT path, line AS edit_idx, line + 2 AS line, t FROM (SELECT path, line, {_TOK.format("text || ' zz'")} AS t FROM lines)),
b AS (SELECT w.path, w.edit_idx, w.line, k.line AS near_line, CASE WHEN len(w.t) > 0 AND len(k.t) > 0 THEN len(list_intersect(w.t, k.t))::double / greatest(len(w.t), len(k.t)) ELSE 0 END AS similarity FROM w JOIN k ON w.path = k.path AND abs(w.line - k.line) <= 50)"""


def _wanted(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.col("line").alias("edit_idx"), (F.col("line") + 2).alias("line"), F.concat("text", F.lit(" zz")).alias("old_text"))


@query(_BAND + " SELECT path, edit_idx, min(near_line) AS new_line FROM b WHERE similarity > 0.8 GROUP BY path, edit_idx HAVING count(*) = 1")
def relocate_fuzzy(spark, sf):
    rows = corpus.lines(corpus.document_files(spark, sf))
    return E.relocate_fuzzy(_wanted(rows), rows)


@query(_BAND + " SELECT path, edit_idx, rank::int AS rank, near_line, similarity FROM (SELECT *, row_number() OVER (PARTITION BY path, edit_idx ORDER BY similarity DESC, near_line) AS rank FROM b WHERE similarity >= 0.3) WHERE rank <= 3")
def similar_lines(spark, sf):
    rows = corpus.lines(corpus.document_files(spark, sf))
    return E.similar_lines(_wanted(rows), rows)


@query(f"""WITH {_EDITS}, around AS (SELECT path, line AS edit_idx, unnest(range(line - 2, line + 3))::int AS line FROM rows WHERE line % 28 = 5) SELECT path, edit_idx, line, hash, text FROM around JOIN rows USING (path, line)""")
def stale_report(spark, sf):
    rows = _rows(spark, sf)
    return E.stale_report(rows.where("line % 28 = 5").select("path", F.col("line").alias("edit_idx"), "line"), rows)


@query(rf"""WITH {S.DOCS}, {S.LINES}, p AS (SELECT path, text AS o, CASE line % 5 WHEN 0 THEN replace(text, ' ', '  ') WHEN 1 THEN text || CASE WHEN length(text) % 7 = 0 THEN 'x' ELSE '' END ELSE text END AS n FROM lines),
f AS (SELECT path, bool_or(o <> n AND regexp_replace(o, '[ \t\n\r\f\x0B]+', '', 'g') = regexp_replace(n, '[ \t\n\r\f\x0B]+', '', 'g')) AS b, bool_or(regexp_replace(o, '[ \t\n\r\f\x0B]+', '', 'g') <> regexp_replace(n, '[ \t\n\r\f\x0B]+', '', 'g')) AS s FROM p GROUP BY path)
SELECT path, CASE WHEN b AND s THEN 'mixed' WHEN s THEN 'semantic' WHEN b THEN 'whitespace-only' ELSE 'no-op' END AS kind FROM f""")
def classify_edits(spark, sf):
    rows = corpus.lines(corpus.document_files(spark, sf))
    new = F.when(F.col("line") % 5 == 0, F.replace("text", F.lit(" "), F.lit("  "))).when(F.col("line") % 5 == 1, F.concat("text", F.when(F.char_length("text") % 7 == 0, "x").otherwise(""))).otherwise(F.col("text"))
    return E.classify(rows.select("path", F.col("text").alias("old"), new.alias("new")))


@query(f"""WITH {S.DOCS} SELECT path, replace(text, 'the', 'THE') AS new_text, (length(text) - length(replace(text, 'the', ''))) // 3 AS hits FROM files WHERE contains(text, 'the')""")
def replace_all_text(spark, sf):
    return E.replace_text(corpus.document_files(spark, sf), "the", "THE", everywhere=True)


@query(f"""WITH {S.DOCS} SELECT path, substr(text, 1, strpos(text, 'the') - 1) || 'THE' || substr(text, strpos(text, 'the') + 3) AS new_text, (length(text) - length(replace(text, 'the', ''))) // 3 AS hits FROM files WHERE contains(text, 'the')""")
def replace_first_text(spark, sf):
    return E.replace_text(corpus.document_files(spark, sf), "the", "THE")


@query(f"""WITH {S.DOCS} SELECT path, sha256(text) AS file_hash, text || 'x' AS new_text, length(text) % 2 = 0 AS written FROM files""")
def compare_and_swap(spark, sf):
    files = corpus.document_files(spark, sf)
    writes = files.select("path", F.when(F.char_length("text") % 2 == 0, F.sha2("text", 256)).otherwise(F.lit("old")).alias("expected"), F.concat("text", F.lit("x")).alias("new_text"))
    return E.compare_and_swap(files, writes)


@query(f"""WITH {S.DOCS} SELECT path FROM files WHERE text = replace(text, 'the', 'a')""")
def no_op_edits(spark, sf):
    files = corpus.document_files(spark, sf)
    return E.no_ops(files, files.select("path", F.replace("text", F.lit("the"), F.lit("a")).alias("new_text")))


@query(f"""WITH {S.CHATS} SELECT path, count(*) AS added, count(*) AS removed FROM (SELECT path, unnest(string_split(text, chr(10))) AS t FROM files) WHERE starts_with(t, 'A') OR starts_with(t, 'E') GROUP BY path""")
def diff_stats(spark, sf):
    files = corpus.chat_files(spark, sf)
    pairs = files.select("path", F.col("text").alias("old"), F.regexp_replace("text", r"(?m)^([AE])", "\u00a7$1").alias("new"))
    return E.diff_stats(E.diff(pairs)).where("added > 0").select("path", "added", "removed")


@query(f"""WITH {S.DOCS}, odd AS (SELECT path, replace(replace(text, ' the', chr(160) || 'the'), chr(10), ' ' || chr(10)) AS text FROM files)
SELECT path, replace(text, chr(160) || 'the', ' THE') AS new_text, ((length(text) - length(replace(text, chr(160) || 'the', ''))) // 4)::bigint AS hits FROM odd WHERE contains(text, chr(160) || 'the')""")
def replace_fuzzy_text(spark, sf):
    """Hits in texts whose blanks before the word aren't plain ones and whose lines end in blanks."""
    odd = F.replace(F.replace("text", F.lit(" the"), F.lit("\u00a0the")), F.lit("\n"), F.lit(" \n"))
    return E.replace_fuzzy(corpus.document_files(spark, sf).withColumn("text", odd), " the", " THE", everywhere=True)


_REQUESTS = [  # path, text, (op, line, hash of, content, end line, hash of, new text)
    ("moved", "a1\nb2\nc3\nd4", [("set_line", 1, "c3", None, None, None, "x")], "a1\nb2\nx\nd4"),
    ("range", "n\na1\nb2\nc3", [("replace_lines", 1, "a1", None, 2, "b2", "x\ny\nz")], "n\nx\ny\nz\nc3"),
    ("like", "one two three four five six\nrest", [("set_line", 2, "gone", "one two three four five 6ix six", None, None, "x")], "x\nrest"),
    ("indent", "def f():\n    return 1", [("set_line", 2, "    return 1", None, None, None, "return 2")], "def f():\n    return 2"),
    ("echo", "a1\nb2\nc3", [("set_line", 2, "b2", None, None, None, "a1\nx\nc3"), ("insert_after", 3, "c3", None, None, None, "c3\nd4")], "a1\nx\nc3\nd4"),
    ("wrap", "call(alpha, beta)\nb2", [("replace_lines", 1, "call(alpha, beta)", None, 2, "b2", "call(alpha,\n  beta)\nx")], "call(alpha, beta)\nx"),
    ("merge", "x = a +\n    b\nc3", [("set_line", 1, "x = a +", None, None, None, "x = a + b")], "x = a + b\nc3"),
    ("copied", "a1\nb2", [("set_line", 1, "a1", None, None, None, "1:0af|x")], "x\nb2"),
    ("stale", "a1\nb2", [("set_line", 1, "zz", None, None, None, "x")], None),
    ("clash", "a1\nb2\nc3", [("replace_lines", 1, "a1", None, 2, "b2", "x"), ("set_line", 2, "b2", None, None, None, "y")], None),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', {'NULL' if new is None else 'replace(' + repr(new.replace(chr(10), '|')) + ', ' + repr('|') + ', chr(10))'})" for p, _, _, new in _REQUESTS) + ") AS t(path, new_text)")
def edit_requests(spark, sf):
    files = spark.createDataFrame([(p, t) for p, t, *_ in _REQUESTS], "path string, text string")
    digits = lambda x: None if x is None else T.short_hash(x)
    rows = [(p, i, op, line, digits(of), content, end, digits(end_of), None, new) for p, _, es, _ in _REQUESTS for i, (op, line, of, content, end, end_of, new) in enumerate(es)]
    edits = spark.createDataFrame(rows, "path string, edit_idx int, op string, start_line int, start_hash string, start_text string, end_line int, end_hash string, end_text string, new_text string")
    return anchored.apply(files, edits).select("path", "new_text")


# rename


@query(f"""WITH {S.DOCS}, {S.LINES}, {S.occurrences('that')}, {S.hashes('occ')} SELECT path, line, "column" AS start_column, "column" + 4 AS end_column, hash FROM occ JOIN hashed USING (text)""")
def rename_plan(spark, sf):
    return rename.plan(corpus.document_files(spark, sf), "that", "those")


@query(f"""WITH {S.DOCS}, {S.LINES}, {S.occurrences('that')}, e AS (SELECT count(*) AS edits, count(DISTINCT path) AS files FROM occ),
t2 AS (SELECT path, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS t FROM lines)
SELECT edits, files, (SELECT count(*) FROM t2 WHERE t = 'with' AND path IN (SELECT path FROM occ)) AS conflicts FROM e""")
def rename_totals(spark, sf):
    files = corpus.document_files(spark, sf)
    edits = rename.plan(files, "that", "with")
    return rename.totals(edits, rename.conflicts(edits, files, "with"))


@query(f"""WITH {S.DOCS}, {S.LINES}, {S.occurrences('that')}, {S.hashes('occ')} SELECT path, sha256(string_agg(line || ':' || "column" || ':' || ("column" + 4) || ':' || hash, chr(10) ORDER BY line, "column")) AS plan_hash FROM occ JOIN hashed USING (text) GROUP BY path""")
def rename_plan_hash(spark, sf):
    return rename.plan_hash(rename.plan(corpus.document_files(spark, sf), "that", "those"))


@query(f"""WITH {S.DOCS}, cut AS (SELECT path, regexp_extract_all(text, '[A-Za-z0-9_]+') AS t, regexp_split_to_array(text, '[A-Za-z0-9_]+') AS g FROM files)
SELECT path, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i > len(t) THEN '' WHEN t[i] = 'that' THEN 'those' ELSE t[i] END), '') AS new_text FROM cut WHERE list_contains(t, 'that')""")
def rename_apply(spark, sf):
    files = corpus.document_files(spark, sf)
    return rename.apply(files, rename.plan(files, "that", "those"), "that", "those")


# parsed code: small fixtures, as the tables hold prose

CODE = [
    ("a.py", "python", "import os\n\nclass A:\n    def f(self, x):\n        y = x + 1\n        return y\n\ndef g(x):\n    return A().f(x) + x\n"),
    ("b.rs", "rust", "mod m {\n    pub struct S { a: u32 }\n    impl S {\n        pub fn new(a: u32) -> S { S { a } } // fn no() {}\n    }\n}\nfn main() {\n}\n"),
    ("c.ts", "typescript", "export class K {\n  run(a: number): number {\n    return a;\n  }\n}\nconst f = (x: number) => {\n  return x;\n};\n"),
    ("d.py", "python", "def f(:\n"),
]


def _code(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODE, "path string, language string, text string")


def _values(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(v) if isinstance(v, (str, int)) else 'NULL' for v in r) + ')' for r in rows)}) AS t({columns})"


@query(_values([("a.py", 0, "class", "A", "A", 3, 6), ("a.py", 1, "method", "f", "A.f", 4, 6), ("a.py", 2, "function", "g", "g", 8, 9), ("b.rs", 0, "module", "m", "m", 1, 6), ("b.rs", 1, "struct", "S", "m.S", 2, 2), ("b.rs", 2, "impl", "S", "m.S", 3, 5), ("b.rs", 3, "method", "new", "m.S.new", 4, 4), ("b.rs", 4, "function", "main", "main", 7, 8), ("c.ts", 0, "class", "K", "K", 1, 5), ("c.ts", 1, "method", "run", "K.run", 2, 4), ("c.ts", 2, "function", "f", "f", 6, 8)], "path, symbol_idx, kind, name, qualified_name, start_line, end_line"))
def code_symbols(spark, sf):
    return parsing.symbols(_code(spark))


@query(_values([("d.py", "error", 1, 1)], "path, kind, start_line, end_line"))
def code_diagnostics(spark, sf):
    return parsing.diagnostics(_code(spark))


@query(_values([("a.py", "x", 8, 7, "definition"), ("a.py", "x", 9, 18, "reference"), ("a.py", "x", 9, 23, "reference"), ("a.py", "x", 4, 17, "shadowed"), ("a.py", "x", 5, 13, "shadowed")], 'path, name, line, "column", occurrence'))
def code_scoped_references(spark, sf):
    at = spark.createDataFrame([("a.py", 8, 7)], "path string, line int, column int")
    return parsing.scoped_references(parsing.bindings(_code(spark)), at).select("path", "name", "line", "column", "occurrence")


@query(_values([("a.py", 0, 5, 5, "5-5"), ("a.py", 1, 9, 9, "9-9")], "path, match_idx, start_line, end_line, a"))
def code_search(spark, sf):
    return parsing.ast_search(_code(spark), "$a + $b").select("path", "match_idx", "start_line", "end_line", F.col("captures")["a"].alias("a"))


@query(_values([("a.py", 5, 9), ("a.py", 6, 16)], 'path, line, "column"'))
def code_rename_conflicts(spark, sf):
    """y in f of a.py, where x is a parameter; y in f of e.py, where another function alone has x."""
    apart = spark.createDataFrame([("e.py", "python", "def f():\n    y = 1\n    return y\n\ndef g(x):\n    return x\n")], "path string, language string, text string")
    at = spark.createDataFrame([("a.py", 5, 9), ("e.py", 2, 5)], "path string, line int, column int")
    return parsing.rename_conflicts(_code(spark).unionByName(apart), at, "x")
@query(_values([("a.c", 14), ("a.c", 26)], "path, byte"))
def code_references_outside_comments(spark, sf):
    text = 'int f; /* n */n = 1; /* */n(); char *s = "n"; // n\n'
    files = spark.createDataFrame([("a.c", "c", text)], "path string, language string, text string")
    found = files.select("path", F.explode(identifiers.spans(F.col("text"))).alias("s")).where("s.token = 'n'").select("path", F.col("s.byte").cast("long").alias("byte"))
    return Y.outside(found, parsing.ignored(files)).withColumn("byte", F.col("byte").cast("int"))


@query(f"""WITH {_CHAT}, one AS (SELECT * FROM symbols WHERE qualified_name = 'conversation.turn_1'), k AS (SELECT f.path, string_split(f.text, chr(10)) AS l, o.start_line AS s, o.end_line AS e FROM files f LEFT JOIN one o USING (path))
SELECT path, CASE WHEN s IS NULL THEN NULL ELSE array_to_string(list_concat(list_concat(l[1:s - 1], ['a' || chr(10) || '  b']), l[e + 1:]), chr(10)) END AS new_text, CASE WHEN s IS NULL THEN 'not-found' ELSE 'ok' END AS outcome FROM k""")
def replace_symbol(spark, sf):
    files = corpus.chat_files(spark, sf)
    bodies = files.select("path", F.lit("conversation.turn_1").alias("symbol"), F.lit("    a\n      b").alias("body"))
    return Y.replace(files, corpus.chat_symbols(spark, sf), bodies)


_WINDOWS = f"""WITH {_DOC}, hits AS (SELECT path, line, text FROM lines WHERE contains(text, 'of the')), {S.enclosing('hits', S.FIRST)}, p AS (SELECT h.path, h.line, symbol_name AS n, symbol_start_line AS s, symbol_end_line AS e FROM hits h LEFT JOIN inside USING (path, line))"""


@query(_WINDOWS + " SELECT path, n AS symbol_name, coalesce(s, line) AS start_line, coalesce(e, line) AS end_line, count(*) AS matches FROM p GROUP BY ALL")
def grep_whole_symbols(spark, sf):
    files = corpus.document_files(spark, sf)
    return Y.grep_windows(L.grep(files, "of the", literal=True), corpus.block_symbols(files))


@query(_WINDOWS + """, w AS (SELECT path, n, s, line, greatest(1, s, line - 1) AS low, least(e, line + 1) AS high FROM p),
m AS (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY path, n, s ORDER BY low, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM w),
i AS (SELECT *, sum(new) OVER (PARTITION BY path, n, s ORDER BY low, line ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT path, n AS symbol_name, min(low)::int AS start_line, max(high)::int AS end_line, count(*) AS matches FROM i GROUP BY path, n, s, island""")
def grep_symbol_windows(spark, sf):
    files = corpus.document_files(spark, sf)
    return Y.grep_windows(L.grep(files, "of the", literal=True), corpus.block_symbols(files), 1)


@query(f"""WITH {_DOC}, {S.occurrences('the')}, {S.enclosing('occ', S.LAST)}, {S.hashes('occ')}
SELECT path, line, "column", hash, text, symbol_kind AS kind, symbol_name AS name, symbol_qualified_name AS qualified_name FROM occ JOIN hashed USING (text) LEFT JOIN inside USING (path, line)""")
def compact_references(spark, sf):
    files = corpus.document_files(spark, sf)
    return output.compact_locations(Y.enclosing(identifiers.occurrences(files, "the"), corpus.block_symbols(files)))


@query(f"""WITH {S.DOCS}, {S.LINES}, {S.occurrences('that')} SELECT path || ':' || line || ':' || "column" || ': ' || text AS entry FROM occ""")
def quickfix_list(spark, sf):
    return output.quickfix(identifiers.occurrences(corpus.document_files(spark, sf), "that", hashed=False))


@query(f"""WITH {_CHAT} SELECT path, '{{"path":"' || path || '","symbol_idx":' || symbol_idx || ',"kind":"' || kind || '","start_line":' || start_line || '}}' AS json FROM symbols""")
def symbols_as_json(spark, sf):
    return output.as_json(corpus.chat_symbols(spark, sf).select("path", "symbol_idx", "kind", "start_line"))


@query(f"""WITH {S.DOCS}, {S.LINES}, {S.occurrences('that')} SELECT path, count(*)::int AS n, arg_min(line, (line, "column")) AS first_line, arg_max("column", (line, "column")) AS last_column FROM occ GROUP BY path""")
def nested_matches(spark, sf):
    found = output.nested(identifiers.occurrences(corpus.document_files(spark, sf), "that", hashed=False), ["line", "column"])
    return found.select("path", F.size("matches").alias("n"), F.col("matches")[0]["line"].alias("first_line"), F.element_at("matches", -1)["column"].alias("last_column"))


@query(f"""WITH {S.CHATS} SELECT path, CASE WHEN length(text) % 3 = 0 THEN NULL ELSE CASE WHEN length(text) % 2 = 0 THEN chr(65279) ELSE '' END || CASE WHEN length(text) % 5 = 0 THEN replace(text || chr(10), chr(10), chr(13) || chr(10)) ELSE text || chr(10) END END AS written FROM files""")
def restore_line_ends(spark, sf):
    n = F.char_length("text")
    original = F.concat(F.when(n % 2 == 0, F.lit("\ufeff")).otherwise(""), F.when(n % 5 == 0, F.lit("a\r\nb\r\n")).otherwise("a\nb\r\n"))
    new = F.when(n % 3 == 0, F.concat("text", F.lit("\rx"))).otherwise(F.concat("text", F.lit("\n")))
    files = corpus.chat_files(spark, sf).select("path", original.alias("original"), new.alias("new"))
    return E.restore_line_ends(files, "original", "new").select("path", "written")


@query(_values([("a.py", 1, 0)], "path, errors, missing"))
def syntax_regressions(spark, sf):
    before = _code(spark)
    after = before.withColumn("text", F.when(F.col("path") == "a.py", F.concat("text", F.lit("def (\n"))).otherwise(F.col("text")))
    out = parsing.regressions(parsing.diagnostics(before), parsing.diagnostics(after))
    return out.select("path", F.col("errors").cast("int").alias("errors"), F.col("missing").cast("int").alias("missing"))
