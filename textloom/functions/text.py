"""Text expressions over columns; all built-in functions but the line hash."""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space, as line hashes drop it.
BLANKS = "\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
HASHES = 4096
QUOTES = "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d"
#: White space at the ends of lines and before them, but for LF.
EDGES = "\\t\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
WIDE = "\u00a0" + "".join(map(chr, range(0x2002, 0x200B))) + "\u202f\u205f\u3000"


def normalize(text: Column) -> Column:
    """Without one leading byte order mark; CRLF and lone CR become LF."""
    bare = F.when(F.startswith(text, F.lit("\ufeff")), F.substring(text, 2, 2**31 - 1)).otherwise(text)
    return F.replace(F.replace(bare, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def split_lines(text: Column) -> Column:
    """Lines of a normalized text: one trailing empty piece is no line, so '' has none."""
    parts = F.split(text, "\n", -1)
    return F.when(F.endswith(text, F.lit("\n")) | (text == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def content_id(content: Column) -> Column:
    return F.sha2(content, 256)


def short_hash(line: str) -> str:
    return format(xxhash.xxh32_intdigest(_SPACES.sub("", line).encode()) % HASHES, "03x")


@F.pandas_udf(StringType())
def line_hash(line: pd.Series) -> pd.Series:
    """Three hex digits that don't change with white space; null for null."""
    return line.map(lambda s: None if s is None else format(xxhash.xxh32_intdigest(_SPACES.sub("", s).encode()) % HASHES, "03x"))


def anchor(line: Column, digits: Column) -> Column:
    return F.concat_ws(":", line.cast("string"), digits)


def parse_anchor(text: Column) -> Column:
    """(line, hash) of ``12:a3f``, with a gutter, blanks around the colon or copied content behind; null where there is none."""
    pattern = r"^\s*(?:[>+\-]{1,3}\s*)?(\d+)\s*:\s*([0-9a-fA-F]{3})(?![0-9a-zA-Z_])"
    line = F.regexp_extract(text, pattern, 1)
    return F.when(line != "", F.struct(line.cast("int").alias("line"), F.lower(F.regexp_extract(text, pattern, 2)).alias("hash")))


def word_pattern(name: str) -> str:
    """A regular expression for a whole identifier; only ASCII letters, digits and _ extend it."""
    return rf"(?<![A-Za-z0-9_])\Q{name}\E(?![A-Za-z0-9_])"


def tokens(text: Column) -> Column:
    """Distinct white-space separated tokens."""
    return F.array_distinct(F.filter(F.split(text, r"[ \t\n\r\f\x0B]+", -1), lambda t: t != ""))


def token_similarity(a: Column, b: Column) -> Column:
    """Shared tokens over the larger token set; 0 if either has none."""
    return set_similarity(tokens(a), tokens(b))


def set_similarity(ta: Column, tb: Column) -> Column:
    most = F.greatest(F.size(ta), F.size(tb))
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0), F.size(F.array_intersect(ta, tb)) / most).otherwise(F.lit(0.0))


def escape_controls(text: Column) -> Column:
    """Control characters below blank, but for tab, LF and CR, as \\u00xx; texts without any are only looked through once."""
    out = text
    for c in [*range(0, 9), 11, 12, *range(14, 32)]:
        out = F.replace(out, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    return F.when(text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), out).otherwise(text)


def compact(text: Column, limit: int = 500) -> Column:
    """White space collapsed; cut to ``limit`` characters and '...'."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))
    return F.when(F.char_length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def short_id(prefix: str, *parts: Column) -> Column:
    """``n_`` or ``a_`` and 16 digits of a digest of the parts."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 16))


def to_pixel(position: Column, extent: Column) -> Column:
    """A coordinate of a 0..1000 grid on an axis of ``extent`` pixels."""
    return F.round(F.least(F.lit(1000), F.greatest(F.lit(0), position)) * extent / F.lit(1000.0)).cast("int")


def heading_name(line: Column) -> Column:
    """A Markdown heading without its marks; null if it is none."""
    return F.nullif(F.trim(F.regexp_extract(line, r"^\s{0,3}#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$", 1)), F.lit(""))


def last_identifier(text: Column) -> Column:
    """The last run of letters, digits and _ that doesn't begin with a digit; null if there is none."""
    found = F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), 1), lambda t: ~t.rlike("^[0-9]"))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def identifier_at(line: Column, column: Column) -> Column:
    """The identifier around a 1-based byte column, one step to the left of it if it stands on a bound; null if none."""
    return identifier_span(line, column).text


def identifier_span(line: Column, column: Column) -> Column:
    """(text, start_column, end_column) of ``identifier_at``, byte columns from 1, the end outside; null if there is none. A column behind the
    line stands for its last byte."""
    raw = line.cast("binary")
    at = F.least(column, F.octet_length(line))
    left = F.regexp_extract(F.substring(raw, F.lit(1), at - 1).cast("string"), r"([A-Za-z0-9_]*)\z", 1)
    right = F.regexp_extract(F.substring(raw, at, F.octet_length(line)).cast("string"), r"\A([A-Za-z0-9_]*)", 1)
    text, start = F.concat(left, right), at - F.char_length(left)
    return F.when((text != "") & (column > 0), F.struct(text.alias("text"), start.alias("start_column"), (start + F.char_length(text)).alias("end_column")))


def is_qualified_name(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$")


def is_plain_identifier(text: Column) -> Column:
    return text.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$")


def coerce_int(text: Column) -> Column:
    """A decimal string within the integers that a double holds exactly; null otherwise."""
    value = F.when(text.rlike(r"^[+-]?[0-9]{1,16}$"), text.try_cast("long"))
    return F.when(F.abs(value) <= 2**53 - 1, value)


def glob_pattern(glob: str) -> str:
    """A regular expression for a file name glob: *, ?, [..] and {a,b}; ** also crosses folders."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 2
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def fuzzy(text: Column) -> Column:
    """Without white space at the ends of lines; typographic quotes, dashes and blanks as ASCII."""
    out = F.regexp_replace(text, rf"[{EDGES}]+(\n|\z)", "$1")
    out = F.translate(out, QUOTES, "'" * 4 + '"' * 4)
    out = F.translate(out, DASHES, "-" * len(DASHES))
    return F.translate(out, WIDE, " " * len(WIDE))


def indentation(line: Column) -> Column:
    """The white space that a line begins with."""
    return F.regexp_extract(line, rf"\A([{EDGES}]*)", 1)


def dedent(text: Column) -> Column:
    """Every line without as many characters as the least indentation of lines that hold more than white space; a line of white space alone
    loses as many too. A text of such lines only stays."""
    lines = F.split(text, "\n", -1)
    least = F.coalesce(F.array_min(F.transform(F.filter(lines, lambda x: x.rlike(f"[^{EDGES}]")), lambda x: F.char_length(indentation(x)))), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.substring(x, least + 1, F.char_length(x))), "\n")


def reindent(text: Column, by: Column) -> Column:
    """Every line but empty ones behind ``by``."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(x == "", x).otherwise(F.concat(by, x))), "\n")


def strip_copied_prefixes(text: Column) -> Column:
    """Without what stands before lines copied from a listing, if at least half of the lines that aren't empty have it: ``12:a3f|``, else (of two lines or more)
    a bare ``a3f|``, else a single ``+``."""
    lines = F.split(text, "\n", -1)
    filled = F.size(F.filter(lines, lambda x: x != ""))
    bare = F.when(filled == 0, lines)
    for pattern, least in PREFIXES:
        have = F.size(F.filter(lines, lambda x: x.rlike(pattern)))
        bare = bare.when((filled >= least) & (have * 2 >= filled), F.transform(lines, lambda x: F.regexp_replace(x, pattern, "")))
    return F.array_join(bare.otherwise(lines), "\n")


#: Prefixes of copied lines, and how many lines must be there for each to be taken away.
PREFIXES = ((r"\A[>\s]*[0-9]+:[A-Za-z0-9]{1,16}[|]", 1), (r"\A[a-f0-9]{3}[|]", 2), (r"\A[+](?![+])", 1))


def eol_majority(text: Column) -> Column:
    """CRLF if there are strictly more of it than of lone LF."""
    crlf = F.char_length(text) - F.char_length(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    lf = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) - crlf
    return F.when(crlf > lf, F.lit("\r\n")).otherwise(F.lit("\n"))


def eol_majority3(text: Column) -> Column:
    """The most frequent of LF, CRLF and CR; LF, then CRLF, at a tie."""
    size = F.char_length(text)
    crlf = size - F.char_length(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    lf = size - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) - crlf
    cr = size - F.char_length(F.replace(text, F.lit("\r"), F.lit(""))) - crlf
    return F.when((lf >= crlf) & (lf >= cr), F.lit("\n")).when(crlf >= cr, F.lit("\r\n")).otherwise(F.lit("\r"))
