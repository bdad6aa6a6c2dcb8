"""What a file is: language by name, category by content, image headers."""

from __future__ import annotations

import json
import re
import struct
from urllib.parse import unquote_to_bytes
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: id: aliases | extensions | file names
LANGUAGES = """
assembly: asm x86 arm | asm s |
c: | c h |
bash: sh shell | bash sh | .bashrc .bash_profile .profile
cpp: cxx cplusplus | cc cpp cxx hh hpp hxx |
csharp: cs c# | cs |
css: | css |
dockerfile: containerfile | | Dockerfile Containerfile
go: golang | go | go.mod
gdscript: gd | gd |
java: | java |
javascript: js | js mjs cjs |
jsx: | jsx |
html: htm | html htm |
json: | json | package-lock.json composer.lock
xml: | xml xsd xsl xslt |
yaml: yml | yaml yml |
just: justfile | just | justfile Justfile .justfile
kconfig: | | Kconfig
make: makefile | mk mak make | Makefile makefile GNUmakefile
latex: tex | tex ltx latex |
lua: | lua |
markdown: md | md markdown mdown mkd |
meson: | | meson.build meson_options.txt
nix: | nix | flake.lock
perl: pl pm | pl pm t |
python: py | py pyw |
php: | php php3 php4 php5 phtml |
puppet: pp | pp | Puppetfile
ruby: rb | rb rake gemspec | Gemfile Rakefile
riscv: riscv64 | riscv |
rust: rs | rs |
swift: | swift |
sql: | sql |
typescript: ts | ts mts cts |
tsx: | tsx |
toml: | toml | Cargo.lock
typst: typ | typ |
vimscript: vim viml | vim vimrc gvimrc | .vimrc .gvimrc
zig: | zig zon | build.zig build.zig.zon
"""
SPECS = {a.strip(): [x.split() for x in b.split("|")] for a, _, b in (line.partition(":") for line in LANGUAGES.strip().splitlines())}
HAS_SYMBOLS = set("c bash cpp csharp go java javascript jsx just kconfig make markdown python php ruby rust swift typescript tsx vimscript".split())
SHEBANGS = {"sh": "bash", "bash": "bash", "zsh": "bash", "python": "python", "python3": "python", "node": "javascript", "perl": "perl", "ruby": "ruby", "php": "php", "lua": "lua", "make": "make"}


def parse_language(name: str) -> str | None:
    """A language by id or alias, case, - and _ aside."""
    flat = re.sub("[-_]", "", name.lower())
    return next((k for k, (aliases, *_) in SPECS.items() if flat in (k, *(a.replace("-", "") for a in aliases))), None)


def language(path: Column, text: Column | None = None) -> Column:
    """By file name, else by extension in any case, else by the interpreter on the first line; ``unknown`` otherwise.

    The table has some 60 entries, so it is a literal map, not a join."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    names = {n: k for k, (_, _, ns) in reversed(SPECS.items()) for n in ns}
    exts = {e: k for k, (_, es, _) in reversed(SPECS.items()) for e in es}
    literal = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    by = [literal(names)[name], literal(exts)[F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))]]
    if text is not None:
        by.append(literal(SHEBANGS)[F.regexp_extract(text, r"^#!\s*(?:\S*/)?(?:env\s+(?:-\S+\s+)*)?(?:\S*/)?([A-Za-z]+3?)", 1)])
    return F.coalesce(*by, F.lit("unknown"))


def category(content: Column, mime: Column) -> Column:
    """text if the type is unknown or text/* and there is no NUL; else image, pdf or binary."""
    head = F.hex(F.substring(content, 1, 12))
    image = F.startswith(mime, F.lit("image/")) | head.rlike("^(89504E470D0A1A0A|FFD8FF|474946383[79]61|424D|49492A00|4D4D002A)") | head.rlike("^52494646.{8}57454250$")
    no_nul = F.instr(F.hex(content), "00") == 0
    # an odd place of '00' in the digits is no NUL byte
    has_nul = F.when(no_nul, False).otherwise(F.hex(content).rlike("^(?:..)*?00"))
    return F.when((mime.isNull() | F.startswith(mime, F.lit("text/"))) & ~has_nul & ~F.coalesce(image, F.lit(False)) & ~F.startswith(head, F.lit("255044462D")), "text").when(F.coalesce(image, F.lit(False)), "image").when(F.startswith(head, F.lit("255044462D")), "pdf").otherwise("binary")


def looks_binary(content: Column) -> Column:
    """A NUL, or bytes that aren't UTF-8."""
    return F.hex(content).rlike("^(?:..)*?00") | ~F.is_valid_utf8(content.cast("string"))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text) of UTF-8 text files below a folder, but for those in index folders; paths are filtered before contents are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    some = raw.where(~F.contains("path", F.lit(f"/{INDEX_FOLDER}/")))
    return some.where(~looks_binary(F.col("content"))).select("path", F.col("content").cast("string").alias("text"))


#: Folders of this name hold what ``plans.update`` writes beside a corpus.
INDEX_FOLDER = ".textloom"


def scoped(files: DataFrame, cached: bool = False, others: bool = False, ignored: bool = False) -> DataFrame:
    """Files of (path, tracked, untracked, ignored) that version-control flags ask for: tracked and untracked ones that aren't
    ignored by default. Ignored files need ``others``."""
    if ignored and not others:
        raise ValueError("ignored files are a kind of other files")
    if not cached and not others:
        return files.where("tracked or (untracked and not ignored)")
    keep = F.lit(False)
    keep = keep | F.col("tracked") if cached else keep
    keep = keep | (F.col("untracked") & (F.col("ignored") if ignored else ~F.col("ignored"))) if others else keep
    return files.where(keep)


# images


def _png(b: bytes) -> tuple | None:
    if b[:8] != b"\x89PNG\r\n\x1a\n" or len(b) < 24:
        return None
    at, animated = 8, False
    while at + 8 <= len(b):
        size, tag = struct.unpack(">I4s", b[at : at + 8])
        if tag in (b"acTL", b"IDAT"):
            animated = tag == b"acTL"
            break
        at += 12 + size
    return ("png", *struct.unpack(">II", b[16:24]), animated)


def _skip(b: bytes, at: int) -> int:
    while at < len(b) and b[at]:
        at += 1 + b[at]
    return at + 1


def _gif(b: bytes) -> tuple | None:
    if b[:6] not in (b"GIF87a", b"GIF89a") or len(b) < 13:
        return None
    at = 13 + (3 << (b[10] & 7) + 1 if b[10] & 128 else 0)
    frames = 0
    while at < len(b) and b[at] in (0x2C, 0x21) and frames < 2:
        if b[at] == 0x21:
            at = _skip(b, at + 2)
        else:
            frames += 1
            local = b[at + 9] if at + 9 < len(b) else 0
            at = _skip(b, at + 11 + (3 << (local & 7) + 1 if local & 128 else 0))
    return ("gif", *struct.unpack("<HH", b[6:10]), frames > 1)


def _jpeg(b: bytes) -> tuple | None:
    if b[:3] != b"\xff\xd8\xff":
        return None
    at = 2
    while at + 9 <= len(b):
        if b[at] != 0xFF:
            return None
        tag = b[at + 1]
        if 0xC0 <= tag <= 0xCF and tag not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return "jpeg", w, h, False
        at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0] if tag != 0xFF and not 0xD0 <= tag <= 0xD9 else 1 if tag == 0xFF else 2
    return None


def _webp(b: bytes) -> tuple | None:
    if len(b) < 30 or b[:4] != b"RIFF" or b[8:12] != b"WEBP":
        return None
    kind = b[12:16]
    if kind == b"VP8X":
        w, h = 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
    elif kind == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        w, h = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    else:
        w, h = (x & 0x3FFF for x in struct.unpack("<HH", b[26:30]))
    at, animated = 12, False
    while at + 8 <= len(b) and not animated:
        animated = b[at : at + 4] == b"ANIM"
        size = int.from_bytes(b[at + 4 : at + 8], "little")
        at += 8 + size + size % 2
    return "webp", w, h, animated


def _bmp(b: bytes) -> tuple | None:
    if b[:2] != b"BM" or len(b) < 26:
        return None
    w, h = struct.unpack("<ii", b[18:26])
    return "bmp", w, abs(h), False


def image_info(content: bytes) -> tuple | None:
    """(format, width, height, animated) from the header, or None."""
    for probe in (_png, _gif, _jpeg, _webp, _bmp):
        try:
            found = probe(content)
        except (struct.error, IndexError):
            found = None
        if found:
            return found
    return None


def probe_images(files: DataFrame) -> DataFrame:
    """(path, format, width, height, animated) of (path, content); files that are no image aren't listed."""

    def rows(batches):
        for pdf in batches:
            found = [(p, *i) for p, c in zip(pdf["path"], pdf["content"]) if c is not None and (i := image_info(bytes(c)))]
            yield pd.DataFrame(found, columns=["path", "format", "width", "height", "animated"]).astype({"width": "int32", "height": "int32", "animated": bool})

    return files.select("path", "content").mapInPandas(rows, "path string, format string, width int, height int, animated boolean")


def diagram_labels(content: bytes) -> str | None:
    """Labels of a diagram that a PNG carries in its text chunk ``mxfile``; None if there are none."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at = 8
    while at + 12 <= len(content):
        size, tag = struct.unpack(">I4s", content[at : at + 8])
        key, found, value = content[at + 8 : at + 8 + size].partition(b"\0")
        if tag == b"tEXt" and found and key == b"mxfile":
            try:
                root = ElementTree.fromstring(unquote_to_bytes(value))
            except ElementTree.ParseError:
                return None
            out = []
            for cell in root.iter("mxCell"):
                text = re.sub(r"<[^>]*>", "", re.sub(r"<br ?/?>", "\n", cell.get("value", "")).replace("&nbsp;", " "))
                out += [x.strip() for x in text.splitlines() if x.strip()]
            return "\n".join(out) or None
        at += 12 + size
    return None


def recover_json(raw: str) -> dict | None:
    """The object from the first brace on: as it is, or cut behind the last closing brace from which closing the open
    brackets gives an object."""
    begin = raw.find("{")
    if begin < 0:
        return None
    body = raw[begin:].rstrip()
    for end in [len(body), *(i + 1 for i in range(len(body) - 1, -1, -1) if body[i] == "}")]:
        part, stack, quoted, escaped, ok = body[:end], [], False, False, True
        for c in part:
            if quoted:
                quoted, escaped = escaped or c != '"', not escaped and c == "\\"
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]":
                ok = bool(stack) and stack.pop() == c
                if not ok:
                    break
        if ok and not quoted:
            try:
                found = json.loads(part.rstrip().rstrip(",").rstrip() + "".join(reversed(stack)))
                return found if isinstance(found, dict) else None
            except ValueError:
                continue
    return None
