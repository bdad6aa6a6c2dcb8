"""Parts of the DuckDB SQL that states the same queries."""

from __future__ import annotations

P1, P2, P3, P4, P5, M = 2654435761, 2246822519, 3266489917, 668265263, 374761393, 1 << 32
BLANKS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def norm(x: str) -> str:
    return f"replace(replace(CASE WHEN starts_with({x}, chr(65279)) THEN substr({x}, 2) ELSE {x} END, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


DOCS = f"files AS (SELECT source || '/' || doc_id || '.txt' AS path, {norm('text')} AS text, lang AS language FROM documents)"
PAGES = f"files AS (SELECT 'pages/' || page_id || '.html' AS path, {norm('html')} AS text, 'html' AS language FROM pages)"
TURNS = f"turns AS (SELECT 'chat/' || conv_id || '.txt' AS path, turn, role, {norm('text')} AS text FROM conversations)"
CHATS = TURNS + ", files AS (SELECT path, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM turns GROUP BY path)"
CHAT_SYMBOLS = """sized AS (SELECT path, turn, role, len(string_split(text, chr(10))) AS n, row_number() OVER (PARTITION BY path ORDER BY turn, role, len(string_split(text, chr(10)))) AS i FROM turns),
ended AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY i) AS e FROM sized),
symbols AS (SELECT path, i::int AS symbol_idx, role AS kind, 'turn_' || turn AS name, 'conversation.turn_' || turn AS qualified_name, (e - n + 1)::int AS start_line, e::int AS end_line FROM ended
UNION ALL SELECT path, 0, 'conversation', 'conversation', 'conversation', 1, sum(n)::int FROM sized GROUP BY path)"""
LINES = "lines AS (SELECT path, unnest(range(1, len(l) + 1))::int AS line, unnest(l) AS text FROM (SELECT path, CASE WHEN text = '' OR suffix(text, chr(10)) THEN list_slice(p, 1, len(p) - 1) ELSE p END AS l FROM (SELECT path, text, string_split(text, chr(10)) AS p FROM files)))"
BLOCKS = """sized AS (SELECT path, count(*)::int AS n FROM lines GROUP BY path),
ranged AS (SELECT path, 0 AS o, 0 AS k, 'file' AS kind, 1 AS start_line, n AS end_line FROM sized
UNION ALL SELECT path, 1, k, 'section', k * 10 + 1, least(n, (k + 1) * 10) FROM (SELECT path, n, unnest(range(0, (n - 1) // 10 + 1))::int AS k FROM sized)
UNION ALL SELECT path, 2, k, 'block', k + 1, least(n, k + 3, (k // 10 + 1) * 10) FROM (SELECT path, n, unnest(range(0, n))::int AS k FROM sized) WHERE k % 10 % 3 = 0),
symbols AS (SELECT path, (row_number() OVER (PARTITION BY path ORDER BY o, k) - 1)::int AS symbol_idx, kind, kind || '_' || start_line AS name,
CASE kind WHEN 'file' THEN 'file_1' WHEN 'section' THEN 'file_1.section_' || start_line ELSE 'file_1.section_' || (start_line - 1 - (start_line - 1) % 10 + 1) || '.block_' || start_line END AS qualified_name, start_line::int AS start_line, end_line::int AS end_line FROM ranged)"""


def _rot(y: str, r: int) -> str:
    return f"((({y}) * {1 << r}) % {M} + ({y}) // {1 << (32 - r)})"


def hashes(source: str, out: str = "hashed") -> str:
    """A CTE ``out`` (text, hash) of the distinct texts of ``source``: 32-bit xxHash of the text without white space, modulo 4096."""
    lane = lambda j, init: f"list_reduce(list_transform(range(n // 16), lambda s: w[4 * s + {j + 1}]), lambda a, v: ({_rot(f'(a + v * {P2}) % {M}', 13)} * {P1}) % {M}, {init}::hugeint)"
    lanes = " + ".join(_rot(lane(j, i), r) for j, i, r in ((0, (P1 + P2) % M, 1), (1, P2, 7), (2, 0, 12), (3, M - P1, 18)))
    return f"""h1 AS (SELECT DISTINCT text, regexp_replace(text, '{BLANKS}', '', 'g') AS s FROM {source}),
h2 AS (SELECT text, strlen(s) AS n, hex(encode(s)) AS x FROM h1),
h3 AS (SELECT text, n, list_transform(range(n), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint::hugeint) AS b FROM h2),
h4 AS (SELECT text, n, b, list_transform(range(n // 4), lambda i: b[4 * i + 1] + 256 * b[4 * i + 2] + 65536 * b[4 * i + 3] + 16777216 * b[4 * i + 4]) AS w FROM h3),
h5 AS (SELECT text, n, b, w, ((CASE WHEN n >= 16 THEN ({lanes}) % {M} ELSE {P5} END) + n) % {M} AS h FROM h4),
h6 AS (SELECT text, n, b, list_reduce(list_transform(range(n // 16 * 4, n // 4), lambda i: w[i + 1]), lambda a, v: ({_rot(f'(a + v * {P3}) % {M}', 17)} * {P4}) % {M}, h::hugeint) AS h FROM h5),
h7 AS (SELECT text, list_reduce(list_transform(range(n // 4 * 4, n), lambda i: b[i + 1]), lambda a, v: ({_rot(f'(a + v * {P5}) % {M}', 11)} * {P1}) % {M}, h::hugeint)::ubigint AS h FROM h6),
h8 AS (SELECT text, ((xor(h, h >> 15)::hugeint * {P2}) % {M})::ubigint AS h FROM h7),
h9 AS (SELECT text, ((xor(h, h >> 13)::hugeint * {P3}) % {M})::ubigint AS h FROM h8),
{out} AS (SELECT text, printf('%03x', (xor(h, h >> 16) % 4096)::bigint) AS hash FROM h9)"""


def occurrences(name: str) -> str:
    """CTEs to ``occ`` (path, line, column, text) over ``lines``: tokens with the bytes before them."""
    return f"""tok AS (SELECT path, line, text, regexp_extract_all(text, '[A-Za-z0-9_]+') AS t, regexp_split_to_array(text, '[A-Za-z0-9_]+') AS g FROM lines WHERE contains(text, '{name}')),
placed AS (SELECT path, line, text, t, g, unnest(range(1, len(t) + 1)) AS i FROM tok),
occ AS (SELECT path, line, (strlen(array_to_string(g[1:i], '')) + strlen(array_to_string(t[1:i - 1], '')) + 1)::int AS "column", text FROM placed WHERE t[i] = '{name}')"""


def enclosing(rows: str, order: str, out: str = "inside") -> str:
    """A CTE (path, line, symbol_*) of the best symbol around each distinct line of ``rows``."""
    return f"""ranked AS (SELECT r.path, r.line, s.*EXCLUDE (path), row_number() OVER (PARTITION BY r.path, r.line ORDER BY {order}) AS rn FROM (SELECT DISTINCT path, line FROM {rows}) r JOIN symbols s ON r.path = s.path AND r.line BETWEEN s.start_line AND s.end_line),
{out} AS (SELECT path, line, kind AS symbol_kind, name AS symbol_name, qualified_name AS symbol_qualified_name, start_line AS symbol_start_line, end_line AS symbol_end_line FROM ranked WHERE rn = 1)"""


LAST = "end_line - start_line, start_line DESC, end_line DESC, symbol_idx DESC"
FIRST = "end_line - start_line, start_line, name"
SYMBOL_COLUMNS = "symbol_kind, symbol_name, symbol_qualified_name, symbol_start_line, symbol_end_line"
