"""Queries over lines and text: reading, hashing, searching, scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import identifiers, lines as L, line_symbols
from textloom.plans import sql as S
from textloom.sources import corpus, detect

REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return add


def _doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.lines(corpus.document_files(spark, sf))


@query(f"WITH {S.DOCS}, {S.LINES} SELECT path, line, text FROM lines")
def split_lines(spark, sf):
    return _doc_lines(spark, sf)


@query(f"WITH {S.DOCS}, {S.LINES} SELECT path, line, text, (coalesce(sum(strlen(text) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS start_byte FROM lines")
def line_starts(spark, sf):
    return L.line_starts(corpus.document_files(spark, sf))


@query(f"WITH {S.CHATS}, {S.LINES}, {S.hashes('lines')} SELECT path, line, hash, text FROM lines JOIN hashed USING (text)")
def line_hashes(spark, sf):
    return L.read_range(corpus.chat_files(spark, sf))


@query(f"WITH {S.DOCS}, {S.LINES}, {S.hashes('(SELECT text FROM lines WHERE line BETWEEN 3 AND 5)')} SELECT path, line, hash, text FROM lines JOIN hashed USING (text) WHERE line BETWEEN 3 AND 5")
def read_range(spark, sf):
    return L.read_range(corpus.document_files(spark, sf), 3, 5)


@query(f"WITH {S.DOCS}, {S.LINES}, {S.hashes('(SELECT text FROM lines WHERE line BETWEEN 2 AND 3)')} SELECT path, line, hash, text FROM lines JOIN hashed USING (text) WHERE line BETWEEN 2 AND 3")
def read_limit(spark, sf):
    return L.read_range(corpus.document_files(spark, sf), 2, limit=2)


@query(f"WITH {S.DOCS}, {S.LINES}, sized AS (SELECT path, count(line) AS n FROM files LEFT JOIN lines USING (path) GROUP BY path) SELECT path, n::int AS line_count FROM sized WHERE n < 5")
def range_errors(spark, sf):
    return L.range_errors(corpus.document_files(spark, sf), 5)


@query(f"WITH {S.CHATS}, {S.LINES}, {S.hashes('lines')}, all_lines AS (SELECT path, line, hash FROM lines JOIN hashed USING (text)) SELECT path, min(line) AS line FROM all_lines WHERE hash = (SELECT min(hash) FROM all_lines) GROUP BY path")
def first_line_of_hash(spark, sf):
    rows = L.read_range(corpus.chat_files(spark, sf))
    least = rows.agg(F.min("hash").alias("least"))
    return L.by_hash(rows.crossJoin(least), F.col("least"))


@query(f"WITH {S.DOCS} SELECT path, sha256(text) AS file_hash, strlen(text) AS bytes FROM files")
def content_ids(spark, sf):
    return corpus.document_files(spark, sf).select("path", T.content_id(F.col("text")).alias("file_hash"), F.octet_length("text").cast("long").alias("bytes"))


@query(f"WITH {S.DOCS}, {S.LINES} SELECT path, line, text FROM lines WHERE regexp_matches(text, '(?i)licensed under|copyright [0-9]+')")
def grep_regex(spark, sf):
    return L.grep(corpus.document_files(spark, sf), "licensed under|copyright [0-9]+", ignore_case=True)


@query(f"WITH {S.PAGES}, {S.LINES} SELECT path, line, text FROM lines WHERE contains(lower(text), '<script>') AND regexp_matches(path, '/[^/]*7[^/]*[.]html$')")
def grep_literal_glob(spark, sf):
    return L.grep(corpus.page_files(spark, sf), "<SCRIPT>", literal=True, ignore_case=True, glob="*7*.html")


@query(f"WITH {S.DOCS}, {S.LINES} SELECT path, line, text FROM lines WHERE contains(text, ' of ') ORDER BY path, line LIMIT 100")
def grep_limit(spark, sf):
    return L.first_matches(L.grep(corpus.document_files(spark, sf), " of ", literal=True))


@query(f"WITH {S.DOCS}, {S.LINES}, m AS (SELECT path, count(*) AS matches FROM lines WHERE contains(text, 'the') GROUP BY path) SELECT path, matches, (SELECT sum(matches) FROM m)::bigint AS total, (SELECT count(*) FROM m) AS files FROM m")
def grep_summary(spark, sf):
    return L.summary(L.grep(corpus.document_files(spark, sf), "the", literal=True))


_CONTEXT = f"""WITH {S.CHATS}, {S.LINES}, m AS (SELECT path, line, text, contains(text, 'that') AS hit FROM lines),
near AS (SELECT *, max(hit::int) OVER (PARTITION BY path ORDER BY line RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM m)
SELECT path, line, text, CASE WHEN hit THEN 'match' ELSE 'context' END AS kind, coalesce(line - lag(line) OVER (PARTITION BY path ORDER BY line) > 1, false) AS gap FROM near WHERE near = 1"""


@query(_CONTEXT)
def grep_context(spark, sf):
    rows = corpus.lines(corpus.chat_files(spark, sf)).withColumn("hit", F.contains("text", F.lit("that")))
    return L.with_context(rows, 2)


def _merged(gap: int) -> str:
    return f"""WITH {S.DOCS}, {S.LINES}, r AS (SELECT path, line AS start_line, line + length(text) % 3 AS end_line FROM lines WHERE contains(text, 'the')),
n AS (SELECT *, CASE WHEN start_line <= max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT path, min(start_line)::int AS start_line, max(end_line)::int AS end_line, count(*) AS parts FROM g GROUP BY path, island"""


def _ranges(spark, sf):
    return L.grep(corpus.document_files(spark, sf), "the", literal=True).select("path", F.col("line").alias("start_line"), (F.col("line") + F.char_length("text") % 3).alias("end_line"))


@query(_merged(2))
def merge_ranges(spark, sf):
    return L.merge_ranges(_ranges(spark, sf), 2)


@query(_merged(1))
def merge_windows(spark, sf):
    return L.merge_ranges(_ranges(spark, sf), 1)


@query(f"""WITH {S.DOCS}, {S.LINES}, m AS (SELECT path, line, text, row_number() OVER (PARTITION BY path ORDER BY line) AS n, count(*) OVER (PARTITION BY path) AS c, count(*) OVER () AS total FROM lines WHERE contains(text, 'a'))
SELECT path, line, text, (CASE WHEN total > 50 THEN greatest(0, c - 10) ELSE 0 END)::bigint AS hidden FROM m WHERE total <= 50 OR n <= 10""")
def grep_capped(spark, sf):
    return L.capped(L.grep(corpus.document_files(spark, sf), "a", literal=True))


@query(f"""WITH {S.DOCS}, {S.LINES}, u AS (SELECT path, line, text, (sum(strlen(text) + 1) OVER (PARTITION BY path ORDER BY line) - 1)::bigint AS used_bytes, count(*) OVER (PARTITION BY path ORDER BY line) AS n FROM lines)
SELECT path, line, text, used_bytes FROM u WHERE n <= 20 AND used_bytes <= 4096""")
def head_budget(spark, sf):
    return L.head_budget(_doc_lines(spark, sf), 20, 4096)


@query(f"WITH {S.DOCS}, {S.LINES}, {S.occurrences('the')}, {S.hashes('occ')} SELECT path, line, \"column\", hash, text FROM occ JOIN hashed USING (text)")
def references(spark, sf):
    return identifiers.occurrences(corpus.document_files(spark, sf), "the")


@query(f"""WITH {S.DOCS}, {S.LINES}, {S.occurrences('the')}, {S.BLOCKS}, {S.enclosing('occ', S.LAST)}, {S.hashes('occ')}
SELECT path, line, "column", hash, text, {S.SYMBOL_COLUMNS} FROM occ JOIN hashed USING (text) LEFT JOIN inside USING (path, line)""")
def references_with_symbols(spark, sf):
    from textloom.operators import symbols

    files = corpus.document_files(spark, sf)
    return symbols.enclosing(identifiers.occurrences(files, "the"), corpus.block_symbols(files))


@query(f"""WITH {S.DOCS}, {S.LINES}, s AS (SELECT path, line, (coalesce(sum(strlen(text) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS b FROM lines),
o AS (SELECT path, strlen(text) // 2 AS byte FROM files WHERE text <> '')
SELECT path, byte::bigint AS byte, line, (byte - b + 1)::bigint AS "column" FROM (SELECT o.path, byte, line, b, row_number() OVER (PARTITION BY o.path ORDER BY b DESC) AS n FROM o JOIN s ON o.path = s.path AND b <= byte) WHERE n = 1""")
def line_of_byte(spark, sf):
    files = corpus.document_files(spark, sf)
    offsets = files.where("text <> ''").select("path", F.expr("octet_length(text) div 2").alias("byte"))
    return L.line_of_byte(offsets, L.line_starts(files))


@query(f"WITH {S.CHATS}, {S.LINES} SELECT path, line, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS token FROM lines")
def line_identifiers(spark, sf):
    return identifiers.identifiers(corpus.lines(corpus.chat_files(spark, sf)))


@query(r"""SELECT conv_id, turn, CASE WHEN len(i) > 0 THEN i[len(i)] END AS last_identifier, nullif(regexp_extract(substr(raw, 1, least(9, length(raw) - 1)), '[A-Za-z0-9_]*$') || regexp_extract(substr(raw, least(10, length(raw))), '^[A-Za-z0-9_]*'), '') AS at_ten,
nullif(trim(regexp_extract(text, '^\s{0,3}#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$', 1)), '') AS heading, regexp_full_match(role, '[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)*') AS qualified, regexp_full_match(role, '[\p{L}_][\p{L}\p{N}_]*') AS plain
FROM (SELECT *, list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda t: NOT regexp_matches(t, '^[0-9]')) AS i, regexp_replace(regexp_replace(regexp_replace(text, '[\x{80}-\x{7FF}]', '??', 'g'), '[\x{800}-\x{FFFF}]', '???', 'g'), '[\x{10000}-\x{10FFFF}]', '????', 'g') AS raw FROM conversations)""")
def identifier_functions(spark, sf):
    c = F.col("text")
    return corpus.read(spark, sf, "conversations").select("conv_id", "turn", T.last_identifier(c).alias("last_identifier"), T.identifier_at(c, F.lit(10)).alias("at_ten"), T.heading_name(c).alias("heading"), T.is_qualified_name(F.col("role")).alias("qualified"), T.is_plain_identifier(F.col("role")).alias("plain"))


_FLAT = r"trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))"


@query(rf"""SELECT doc_id, CASE WHEN length({_FLAT}) > 500 THEN substr({_FLAT}, 1, 500) || '...' ELSE {_FLAT} END AS compact, 'n_' || substr(sha256(concat_ws('|', doc_id::varchar, source)), 1, 16) AS node_id,
round(least(1000, greatest(0, n_chars - 300)) * 640 / 1000.0)::int AS pixel FROM documents""")
def compact_and_ids(spark, sf):
    docs = corpus.read(spark, sf, "documents")
    return docs.select("doc_id", T.compact(F.col("text")).alias("compact"), T.short_id("n", F.col("doc_id"), F.col("source")).alias("node_id"), T.to_pixel(F.col("n_chars") - 300, F.lit(640)).alias("pixel"))


@query(r"""SELECT event_id, CASE WHEN regexp_full_match(x, '[+-]?[0-9]{1,16}') AND abs(x::bigint) <= 9007199254740991 THEN x::bigint END AS number, regexp_extract(y, '^\s*(?:[>+-]{1,3}\s*)?(\d+)\s*:\s*([0-9a-fA-F]{3})$', 1)::int AS anchor_line, lower(regexp_extract(y, '^\s*(?:[>+-]{1,3}\s*)?(\d+)\s*:\s*([0-9a-fA-F]{3})$', 2)) AS anchor_hash
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE (event_id * 900719925474 - user_id)::varchar END AS x, '>> ' || event_id || ' : ' || substr(md5(event_id::varchar), 1, 3) AS y FROM events)""")
def coercions(spark, sf):
    e = corpus.read(spark, sf, "events")
    x = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise((F.col("event_id") * 900719925474 - F.col("user_id")).cast("string"))
    y = F.concat(F.lit(">> "), F.col("event_id").cast("string"), F.lit(" : "), F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 3))
    a = T.parse_anchor(y)
    return e.select("event_id", T.coerce_int(x).alias("number"), a.line.alias("anchor_line"), a.hash.alias("anchor_hash"))


@query(f"""WITH {S.DOCS}, d AS (SELECT path, replace(replace(text, ' of ', chr(13) || chr(10)), ' and ', chr(10)) AS x FROM files), c AS (SELECT path, length(x) - length(replace(x, chr(13) || chr(10), chr(10))) AS crlf, length(x) - length(replace(x, chr(10), '')) AS lf FROM d)
SELECT path, CASE WHEN crlf > lf - crlf THEN 'crlf' ELSE 'lf' END AS two, CASE WHEN lf - crlf >= crlf THEN 'lf' ELSE 'crlf' END AS three FROM c""")
def line_end_majority(spark, sf):
    x = F.replace(F.replace("text", F.lit(" of "), F.lit("\r\n")), F.lit(" and "), F.lit("\n"))
    name = lambda c: F.when(c == "\r\n", "crlf").when(c == "\n", "lf").otherwise("cr")
    return corpus.document_files(spark, sf).select("path", name(T.eol_majority(x)).alias("two"), name(T.eol_majority3(x)).alias("three"))


@query(r"""WITH x AS (SELECT conv_id, turn, regexp_replace(replace(text, 'th', chr(8217) || chr(8212) || chr(65112)) || chr(160) || chr(10) || '-' || chr(8195) || '.' || chr(12288), '[\t\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+(\n|$)', '\1', 'g') AS x, replace(text, 'e', chr(27)) AS y FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[\x{2018}-\x{201B}]', '''', 'g'), '[\x{201C}-\x{201F}]', '"', 'g'), '[\x{2010}-\x{2015}\x{2212}\x{FE63}\x{FF0D}]', '-', 'g'), '[\x{A0}\x{2002}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g') AS fuzzy, replace(y, chr(27), '\u001b') AS escaped FROM x""")
def fuzzy_and_escape(spark, sf):
    c = F.col("text")
    odd = F.concat(F.replace(c, F.lit("th"), F.lit("\u2019\u2014\ufe58")), F.lit("\u00a0\n-\u2003.\u3000"))
    return corpus.read(spark, sf, "conversations").select("conv_id", "turn", T.fuzzy(odd).alias("fuzzy"), T.escape_controls(F.replace(c, F.lit("e"), F.lit("\x1b"))).alias("escaped"))


_TOK = r"list_distinct(list_filter(regexp_split_to_array({}, '[ \t\n\r\f\x0B]+'), lambda t: t <> ''))"


@query(f"""WITH p AS (SELECT conv_id, turn, {_TOK.format('text')} AS a, {_TOK.format('n')} AS b FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n IS NOT NULL)
SELECT conv_id, turn, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::double / greatest(len(a), len(b)) ELSE 0 END AS similarity FROM p""")
def token_similarity(spark, sf):
    from pyspark.sql import Window

    turns = corpus.read(spark, sf, "conversations").withColumn("n", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("n is not null")
    return turns.select("conv_id", "turn", T.token_similarity(F.col("text"), F.col("n")).alias("similarity"))


@query(rf"""WITH {S.CHATS}, {S.LINES}, m AS (SELECT path, line, replace(text, ' ', ':') AS text FROM lines) SELECT path, line, 'target' AS kind, regexp_extract(text, '^([A-Za-z0-9_./%-]+)[ \t]*:([^=]|$)', 1) AS name FROM m WHERE regexp_matches(text, '^[A-Za-z0-9_./%-]+[ \t]*:([^=]|$)')""")
def make_targets(spark, sf):
    rows = corpus.lines(corpus.chat_files(spark, sf)).withColumn("text", F.replace("text", F.lit(" "), F.lit(":")))
    return line_symbols.symbols(rows, "make")


@query(rf"""WITH {S.DOCS}, {S.LINES}, m AS (SELECT path, line, repeat('#', line % 7) || ' ' || text AS text FROM lines), h AS (SELECT path, line, line % 7 AS level, trim(regexp_replace(substr(text, line % 7 + 1), '#+[ \t]*$', '')) AS name FROM m WHERE line % 7 > 0 AND regexp_matches(text, '^#+[ \t]+.*$')),
n AS (SELECT path, max(line) AS n FROM lines GROUP BY path) SELECT path, line, level::int AS level, name, coalesce((SELECT min(b.line) FROM h b WHERE b.path = h.path AND b.line > h.line AND b.level <= h.level) - 1, n)::int AS end_line FROM h JOIN n USING (path)""")
def heading_ranges(spark, sf):
    rows = corpus.lines(corpus.document_files(spark, sf)).withColumn("text", F.concat(F.repeat(F.lit("#"), F.col("line") % 7), F.lit(" "), "text"))
    return line_symbols.heading_ranges(rows).withColumn("name", F.trim("name"))


@query("""SELECT path, CASE WHEN regexp_matches(path, '[.]html$') THEN 'html' ELSE 'unknown' END AS language FROM (SELECT 'pages/' || page_id || CASE page_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.zzz' ELSE '/README' END AS path FROM pages)""")
def detect_language(spark, sf):
    pages = corpus.read(spark, sf, "pages")
    m = F.col("page_id") % 3
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.when(m == 0, ".html").when(m == 1, ".zzz").otherwise("/README"))
    return pages.select(path.alias("path")).select("path", detect.language(F.col("path"), F.lit("")).alias("language"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 1 THEN 'pdf' WHEN page_id % 5 = 2 THEN 'binary' WHEN page_id % 5 = 3 THEN 'binary' WHEN page_id % 5 = 4 THEN 'image' ELSE 'text' END AS category FROM pages""")
def classify_content(spark, sf):
    m = F.col("page_id") % 5
    body = F.col("html").cast("binary")
    content = F.when(m == 1, F.concat(F.lit(b"%PDF-1.7\n"), body)).when(m == 2, F.concat(F.lit(b"a\x00"), body)).when(m == 4, F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), body)).otherwise(body)
    mime = F.when(m == 3, F.lit("application/zip"))
    return corpus.read(spark, sf, "pages").select("page_id", detect.category(content, mime).alias("category"))


@query(rf"""WITH {S.CHATS}, l AS (SELECT path, string_split(text || chr(10) || '   ' || chr(10) || '  y', chr(10)) AS l FROM files), m AS (SELECT path, l, coalesce(list_min(list_transform(list_filter(l, lambda x: trim(replace(x, chr(9), ' ')) <> ''), lambda x: length(regexp_extract(x, '^[ \t]*')))), 0) AS n FROM l)
SELECT path, array_to_string(list_transform(l, lambda x: substr(x, n + 1)), chr(10)) AS bare, array_to_string(list_transform(l, lambda x: CASE WHEN x = '' THEN '' ELSE '  ' || x END), chr(10)) AS deeper FROM m""")
def dedent_and_reindent(spark, sf):
    c = F.concat("text", F.lit("\n   \n  y"))
    return corpus.chat_files(spark, sf).select("path", T.dedent(T.reindent(c, F.lit("    "))).alias("bare"), T.reindent(c, F.lit("  ")).alias("deeper"))


@query(rf"""WITH {S.CHATS} SELECT path, text AS bare FROM files""")
def strip_copied_prefixes(spark, sf):
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit(":0af|"), x))
    return corpus.chat_files(spark, sf).select("path", T.strip_copied_prefixes(F.array_join(numbered, "\n")).alias("bare"))
