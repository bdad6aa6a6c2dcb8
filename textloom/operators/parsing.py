"""Syntax-aware operators: symbols, diagnostics, bindings and pattern search.

Python is parsed with the standard library. Languages with braces go through a scanner that knows comments, strings and
bracket pairs, and finds declarations by their keywords: nested ranges are exact for balanced code, but declarations
without a keyword (C functions, methods of Java-like classes) are found by their shape. Each operator works a file at a
time in Arrow batches; everything behind it is relational.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.line_ranges import SCANNERS

SYMBOLS = "path string, symbol_idx int, kind string, name string, qualified_name string, start_line int, end_line int"
BUDGET = 100_000

_COMMON = r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|unsafe|override|open|sealed|partial|pub(?:\([^)]*\))?|const|extern|inline|virtual|declare)\s+)*"
_NOT = r"(?!(?:if|for|while|switch|catch|return|else|do|new|throw|sizeof|synchronized|using|lock|foreach)\b)"
_SHAPE = rf"^[ \t]*+{_NOT}(?:[\w<>,.\[\]*&:~?@ \t]+[ \t*&]){_NOT}([A-Za-z_~]\w*)[ \t]*\([^;{{}}]*\)[^;{{}}=]*$"
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "rust": [("function", _COMMON + r"fn\s+(\w+)"), ("struct", _COMMON + r"struct\s+(\w+)"), ("enum", _COMMON + r"enum\s+(\w+)"), ("trait", _COMMON + r"trait\s+(\w+)"), ("impl", r"impl(?:\s*<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)"), ("module", _COMMON + r"mod\s+(\w+)")],
    "javascript": [("function", _COMMON + r"function\s*\*?\s*(\w+)"), ("class", _COMMON + r"class\s+(\w+)"), ("interface", _COMMON + r"interface\s+(\w+)"), ("enum", _COMMON + r"enum\s+(\w+)"), ("function", _COMMON + r"(?:let|var|const)?\s*(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::[^=]+)?=>"), ("method", r"^[ \t]*(?:(?:async|static|get|set|public|private|protected|readonly)\s+)*(?!(?:if|for|while|switch|catch|function)\b)(\w+)\s*\([^;{}]*\)\s*(?::[^{]+)?$")],
    "go": [("method", r"func\s*\([^)]*\)\s*(\w+)"), ("function", r"func\s+(\w+)"), ("type", r"type\s+(\w+)")],
    "java": [("class", _COMMON + r"(?:class|record)\s+(\w+)"), ("interface", _COMMON + r"@?interface\s+(\w+)"), ("enum", _COMMON + r"enum\s+(\w+)"), ("method", _SHAPE)],
    "csharp": [("namespace", r"namespace\s+([\w.]+)"), ("class", _COMMON + r"(?:class|record)\s+(\w+)"), ("struct", _COMMON + r"struct\s+(\w+)"), ("interface", _COMMON + r"interface\s+(\w+)"), ("enum", _COMMON + r"enum\s+(\w+)"), ("method", _SHAPE)],
    "swift": [("function", _COMMON + r"func\s+(\w+)"), ("class", _COMMON + r"class\s+(\w+)"), ("struct", _COMMON + r"struct\s+(\w+)"), ("enum", _COMMON + r"enum\s+(\w+)"), ("protocol", _COMMON + r"protocol\s+(\w+)"), ("extension", r"extension\s+(\w+)")],
    "php": [("function", _COMMON + r"function\s+&?(\w+)"), ("class", _COMMON + r"class\s+(\w+)"), ("interface", _COMMON + r"interface\s+(\w+)"), ("trait", _COMMON + r"trait\s+(\w+)"), ("namespace", r"namespace\s+([\w\\]+)")],
    "cpp": [("namespace", r"namespace\s+(\w+)"), ("class", r"class\s+(\w+)(?!\s*;)"), ("struct", r"(?:typedef\s+)?struct\s+(\w+)"), ("enum", r"enum\s+(?:class\s+)?(\w+)"), ("function", _SHAPE)],
}
DECLARATIONS |= {"typescript": DECLARATIONS["javascript"], "jsx": DECLARATIONS["javascript"], "tsx": DECLARATIONS["javascript"], "c": DECLARATIONS["cpp"]}
_COMPILED = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in DECLARATIONS.items()}
_HIDE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_HIDE_RUST = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S)


def ignored_ranges(text: str, language: str) -> list[tuple[int, int]]:
    """Character ranges of comments and literals."""
    return [m.span() for m in (_HIDE_RUST if language == "rust" else _HIDE).finditer(text)]


def _blanked(text: str, language: str) -> str:
    return (_HIDE_RUST if language == "rust" else _HIDE).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def brace_symbols(text: str, language: str) -> list[tuple[str, str, str, int, int]]:
    """(kind, name, qualified name, start line, end line), outer ones first."""
    code = _blanked(text, language)
    found, open_, last = [], [], 0
    line_of = lambda at: code.count("\n", 0, at) + 1
    for m in re.finditer(r"[{};]", code):
        if m[0] == "}":
            if open_:
                entry = open_.pop()
                if entry is not None:
                    entry[4] = line_of(m.start())
        else:
            head = code[last : m.start()]
            hit = None
            for kind, pattern in _COMPILED[language]:
                hits = list(pattern.finditer(head.rstrip()))
                if hits and (m[0] == "{" or kind in ("type", "struct") and language in ("go", "rust")):
                    start = last + hits[-1].start()
                    start += len(code[start:]) - len(code[start:].lstrip())
                    outer = next((e for e in reversed(open_) if e is not None), None)
                    k = "method" if kind == "function" and outer is not None and outer[0] in ("class", "struct", "impl", "trait", "interface", "protocol", "extension", "enum") else kind
                    hit = [k, hits[-1][1], (outer[2] + "." if outer else "") + hits[-1][1], line_of(start), line_of(m.start())]
                    found.append(hit)
                    break
            if m[0] == "{":
                open_.append(hit)
        last = m.end()
    n = code.count("\n") + 1
    for e in open_:
        if e is not None:
            e[4] = n
    return sorted((tuple(x) for x in found), key=lambda x: (x[3], -x[4]))


def python_symbols(text: str) -> list[tuple[str, str, str, int, int]]:
    out = []
    todo: list[tuple[ast.AST, str, bool]] = [(ast.parse(text), "", False)]
    while todo:
        node, above, in_class = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                name = f"{above}.{child.name}" if above else child.name
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                out.append((kind, child.name, name, first, child.end_lineno))
                todo.append((child, name, kind == "class"))
            else:
                todo.append((child, above, in_class))
    return sorted(out, key=lambda x: (x[3], x[4]))


def _per_file(files: DataFrame, work, schema: str, *columns: str) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, *r) for path, *rest in zip(*(pdf[c] for c in ("path", *columns))) for r in work(*rest)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", *columns).mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """The symbol table of (path, text, language); files of other languages or that don't parse have no symbols."""

    def work(text, language):
        try:
            found = python_symbols(text) if language == "python" else brace_symbols(text, language) if language in DECLARATIONS else SCANNERS[language](text) if language in SCANNERS else []
        except (SyntaxError, ValueError, RecursionError):
            found = []
        return [(i, *s) for i, s in enumerate(found)]

    return _per_file(files.where("text is not null"), work, SYMBOLS, "text", "language")


def diagnostics(files: DataFrame) -> DataFrame:
    """(path, kind, start_line, end_line): ``error`` where a Python file doesn't parse; for brace languages ``error`` at a closing bracket
    without its opening one and ``missing`` at an opening one that is never closed."""

    def work(text, language):
        if language == "python":
            try:
                ast.parse(text)
            except SyntaxError as e:
                return [("error", e.lineno or 1, e.end_lineno or e.lineno or 1)]
            except ValueError:
                return [("error", 1, 1)]
            return []
        if language not in DECLARATIONS:
            return []
        out, stack, line, pair = [], [], 1, {")": "(", "]": "[", "}": "{"}
        for c in _blanked(text, language):
            if c == "\n":
                line += 1
            elif c in "([{":
                stack.append((c, line))
            elif c in pair:
                if stack and stack[-1][0] == pair[c]:
                    stack.pop()
                else:
                    out.append(("error", line, line))
        return [*out, *(("missing", at, at) for _, at in stack)]

    return _per_file(files.where("text is not null"), work, "path string, kind string, start_line int, end_line int", "text", "language")


def diagnostic_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("path").agg(F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "missing").alias("missing"))


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, errors, missing): by how much an edit made syntax worse; files where nothing got worse aren't listed."""
    a, b = diagnostic_counts(before).alias("a"), diagnostic_counts(after).alias("b")
    d = lambda c: F.col(f"b.{c}") - F.coalesce(F.col(f"a.{c}"), F.lit(0))
    return b.join(a, "path", "left").select("path", d("errors").alias("errors"), d("missing").alias("missing")).where("errors > 0 or missing > 0")


# bindings


class _Scopes(ast.NodeVisitor):
    """Names of a Python file resolved to the scope that binds them: assignments anywhere in a function bind it there, class scopes are
    hidden from functions within, global and nonlocal lift a name out."""

    def __init__(self) -> None:
        self.scopes: list[dict] = [{"up": None, "class": False, "names": set(), "lift": {}}]
        self.uses: list[tuple[int, str, int, int, bool]] = []
        self.at = 0

    def _bind(self, name: str, line: int, column: int) -> None:
        scope = self.scopes[self.at]
        if name not in scope["lift"]:
            scope["names"].add(name)
        self.uses.append((self.at, name, line, column, True))

    def _enter(self, node: ast.AST, body: list, is_class: bool = False) -> None:
        self.scopes.append({"up": self.at, "class": is_class, "names": set(), "lift": {}})
        above, self.at = self.at, len(self.scopes) - 1
        for x in body:
            self.visit(x)
        self.at = above

    def _function(self, node) -> None:
        for x in [*node.decorator_list, *node.args.defaults, *(d for d in node.args.kw_defaults if d)]:
            self.visit(x)
        word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
        self._bind(node.name, node.lineno, node.col_offset + len(word) + 1)
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *(a for a in (node.args.vararg, node.args.kwarg) if a)]
        for a in args:
            if a.annotation:
                self.visit(a.annotation)
        self._enter(node, [*args, *node.body])

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Lambda(self, node: ast.Lambda) -> None:
        for d in node.args.defaults:
            self.visit(d)
        self._enter(node, [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, node.body])

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        for x in [*node.decorator_list, *node.bases, *(k.value for k in node.keywords)]:
            self.visit(x)
        self._bind(node.name, node.lineno, node.col_offset + 6)
        self._enter(node, node.body, True)

    def _comprehension(self, node) -> None:
        self.visit(node.generators[0].iter)
        parts: list = []
        for i, g in enumerate(node.generators):
            parts += [g.target, *([g.iter] if i else []), *g.ifs]
        parts += [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
        self._enter(node, parts)

    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = _comprehension

    def visit_arg(self, node: ast.arg) -> None:
        self._bind(node.arg, node.lineno, node.col_offset)

    def visit_Global(self, node: ast.Global) -> None:
        self.scopes[self.at]["lift"] |= {n: "global" for n in node.names}

    def visit_Nonlocal(self, node: ast.Nonlocal) -> None:
        self.scopes[self.at]["lift"] |= {n: "nonlocal" for n in node.names}

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self.uses.append((self.at, node.id, node.lineno, node.col_offset, False))
        else:
            self._bind(node.id, node.lineno, node.col_offset)

    def visit_alias(self, node: ast.alias) -> None:
        name = node.asname or node.name.split(".")[0]
        column = node.end_col_offset - len(name.encode()) if node.asname else node.col_offset
        self._bind(name, node.lineno, column)

    def resolve(self, scope: int, name: str) -> int | None:
        first = True
        lift = self.scopes[scope]["lift"].get(name)
        if lift == "global":
            return 0
        at: int | None = self.scopes[scope]["up"] if lift else scope
        while at is not None:
            s = self.scopes[at]
            if name in s["names"] and (first or not s["class"]):
                return at
            first, at = False, s["up"]
        return None


def bindings(files: DataFrame) -> DataFrame:
    """(path, name, line, column, scope, occurrence) of every name of Python files: ``scope`` numbers the binding scope (null if none binds
    it), byte columns from 1, occurrence definition or reference."""

    def work(text):
        scopes = _Scopes()
        try:
            scopes.visit(ast.parse(text))
        except (SyntaxError, ValueError, RecursionError):
            return []
        return [(n, line, column + 1, scopes.resolve(s, n), "definition" if d else "reference") for s, n, line, column, d in scopes.uses]

    out = _per_file(files.where("language = 'python' and text is not null"), lambda t: [(n, a, b, float(s) if s is not None else None, o) for n, a, b, s, o in work(t)], "path string, name string, line int, column int, scope double, occurrence string", "text")
    return out.withColumn("scope", F.col("scope").cast("int"))


def scoped_references(bound: DataFrame, at: DataFrame) -> DataFrame:
    """Occurrences bound as the one at (path, line, column); others of the name are ``shadowed``."""
    target = bound.join(at, ["path", "line", "column"], "left_semi").select("path", "name", F.col("scope").alias("own"))
    return bound.join(target, ["path", "name"]).withColumn("occurrence", F.when(F.col("scope").eqNullSafe(F.col("own")), F.col("occurrence")).otherwise("shadowed")).drop("own")


def rename_conflicts(files: DataFrame, at: DataFrame, new: str) -> DataFrame:
    """(path, line, column) of the occurrences that renaming the binding at (path, line, column) of Python files changes and at which the new
    name is bound already, as seen from the scope that the occurrence stands in. A name that no scope binds has none."""

    def work(text, line, column):
        scopes = _Scopes()
        try:
            scopes.visit(ast.parse(text))
        except (SyntaxError, ValueError, RecursionError):
            return []
        here = next(((s, n) for s, n, a, b, _ in scopes.uses if (a, b + 1) == (line, column)), None)
        own = scopes.resolve(*here) if here else None
        if own is None:
            return []
        mine = [(s, a, b + 1) for s, n, a, b, _ in scopes.uses if n == here[1] and scopes.resolve(s, n) == own]
        return sorted({(a, b) for s, a, b in mine if scopes.resolve(s, new) is not None})

    found = files.where("language = 'python' and text is not null").select("path", "text").join(at.select("path", "line", "column"), "path")
    return _per_file(found, work, "path string, line int, column int", "text", "line", "column")


# pattern search


class _Variable:
    def __init__(self, name: str, many: bool) -> None:
        self.name, self.many = name, many


def compile_pattern(pattern: str) -> list[ast.AST]:
    """Statements of a Python pattern in which $X stands for one node and $$$X for any number of them."""
    marked = re.sub(r"\$\$\$([A-Za-z_]\w*)", r"__many_\1__", pattern)
    marked = re.sub(r"\$([A-Za-z_]\w*)", r"__one_\1__", marked)
    return ast.parse(marked).body


def _variable(node) -> _Variable | None:
    if isinstance(node, ast.Expr):
        node = node.value
    name = node.id if isinstance(node, ast.Name) else node.arg if isinstance(node, ast.arg) else node if isinstance(node, str) else None
    m = re.fullmatch(r"__(one|many)_(\w+?)__", name) if name else None
    return _Variable(m[2], m[1] == "many") if m else None


class _Matcher:
    def __init__(self) -> None:
        self.states = 0

    def _bind(self, env: dict, name: str, value) -> dict | None:
        text = repr([ast.dump(v) if isinstance(v, ast.AST) else v for v in (value if isinstance(value, list) else [value])])
        if name != "_" and name in env and env[name][0] != text:
            return None
        return env | {name: (text, value)}

    def match(self, p, node, env: dict) -> Iterator[dict]:
        self.states += 1
        if self.states > BUDGET:
            raise OverflowError
        v = _variable(p) if isinstance(p, (ast.AST, str)) else None
        if v and not v.many:
            if node is not None and not isinstance(node, list):
                bound = self._bind(env, v.name, node.value if isinstance(p, ast.Expr) and isinstance(node, ast.Expr) else node)
                if bound is not None:
                    yield bound
            return
        if isinstance(p, list):
            if isinstance(node, list):
                yield from self.sequence(p, node, env)
        elif isinstance(p, ast.AST):
            if type(p) is type(node):
                fields = [f for f in p._fields if f not in ("ctx", "type_comment", "kind")]
                yield from self.fields(p, node, fields, env)
        elif p == node:
            yield env

    def fields(self, p, node, names: list[str], env: dict) -> Iterator[dict]:
        if not names:
            yield env
            return
        for e in self.match(getattr(p, names[0], None), getattr(node, names[0], None), env):
            yield from self.fields(p, node, names[1:], e)

    def sequence(self, ps: list, nodes: list, env: dict) -> Iterator[dict]:
        if not ps:
            if not nodes:
                yield env
            return
        v = _variable(ps[0]) if isinstance(ps[0], ast.AST) else None
        if v and v.many:
            for k in range(len(nodes) + 1):
                self.states += 1
                if self.states > BUDGET:
                    raise OverflowError
                bound = self._bind(env, v.name, list(nodes[:k]))
                if bound is not None:
                    yield from self.sequence(ps[1:], nodes[k:], bound)
        elif nodes:
            for e in self.match(ps[0], nodes[0], env):
                yield from self.sequence(ps[1:], nodes[1:], e)


def ast_search(files: DataFrame, pattern: str) -> DataFrame:
    """(path, match_idx, start_line, end_line, captures) of Python code that has the pattern's syntax tree; captures is a map from name to
    'first-last' lines. The same variable twice stands for the same code; $_ matches anything. Variadic variables take as few nodes
    as they can. A file that needs over 100,000 steps has one row with match_idx -1. A pattern that doesn't
    parse is an error."""
    wanted = compile_pattern(pattern)
    single = wanted[0].value if len(wanted) == 1 and isinstance(wanted[0], ast.Expr) else None

    def work(text):
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
        matcher, out = _Matcher(), []
        try:
            for node in ast.walk(tree):
                runs: list[tuple] = []
                if single is not None:
                    runs = [(single, node, [node])] if isinstance(node, ast.expr) else []
                else:
                    for field in ("body", "orelse", "finalbody"):
                        body = getattr(node, field, None)
                        if isinstance(body, list):
                            runs += [(wanted, body[i : i + n], body[i : i + n]) for i in range(len(body)) for n in ([len(wanted)] if not any(_variable(w) and _variable(w).many for w in wanted) else range(1, len(body) - i + 1)) if i + n <= len(body)]
                for p, target, span in runs:
                    env = next(matcher.match(p, target, {}), None)
                    if env is not None:
                        caps = {}
                        for name, (_, v) in env.items():
                            vs = [x for x in (v if isinstance(v, list) else [v]) if hasattr(x, "lineno")]
                            caps[name] = f"{vs[0].lineno}-{vs[-1].end_lineno}" if vs else ""
                        out.append((span[0].lineno, span[-1].end_lineno, caps))
        except OverflowError:
            return [(-1, 0, 0, {})]
        out.sort(key=lambda x: (x[0], x[1]))
        return [(i, *x) for i, x in enumerate(out)]

    return _per_file(files.where("language = 'python' and text is not null"), work, "path string, match_idx int, start_line int, end_line int, captures map<string,string>", "text")


def ignored(files: DataFrame) -> DataFrame:
    """(path, start_byte, end_byte) of comments and literals in C and C++ files."""

    def work(text, language):
        return [(len(text[:a].encode()), len(text[:b].encode())) for a, b in ignored_ranges(text, language)]

    return _per_file(files.where("language in ('c', 'cpp') and text is not null"), work, "path string, start_byte long, end_byte long", "text", "language")
