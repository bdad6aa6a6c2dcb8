"""Symbols with their ranges in line-oriented languages and in Ruby, a file at a time.

Kinds, names and ranges are those of the syntax nodes that the declarations would have: a Markdown heading and a Just recipe are
their own lines, a Make rule goes to its last recipe line, a Kconfig entry to its last attribute and a menu to its ``endmenu``, a
function of Bash or Vim and a Ruby declaration to the word or bracket that closes it. Text in fences, comments, strings, here
documents and help texts declares nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

from textloom.operators.line_symbols import PATTERNS

Symbol = tuple[str, str, str, int, int]
_HEADING = re.compile(PATTERNS["markdown"][0][1])
_RECIPE = re.compile(PATTERNS["just"][0][1])


def _qualified(found: list[tuple[str, str, int, int]]) -> list[Symbol]:
    """(kind, name, qualified name, start, end) in order, names of the symbols around joined by dots."""
    out: list[Symbol] = []
    above: list[Symbol] = []
    for kind, name, start, end in sorted(found, key=lambda s: (s[2], -s[3])):
        while above and above[-1][4] < end:
            above.pop()
        symbol = (kind, name, f"{above[-1][2]}.{name}" if above else name, start, end)
        out.append(symbol)
        above.append(symbol)
    return sorted(out, key=lambda s: (s[3], s[4]))


def markdown(text: str) -> list[Symbol]:
    out, fence, paragraph = [], None, None
    rows = text.split("\n")
    skip = 0
    if rows[0].rstrip() in ("---", "+++"):
        skip = next((i + 1 for i, row in enumerate(rows[1:], 1) if row.rstrip() == rows[0].rstrip()), 0)
    for line, row in enumerate(rows, 1):
        if line <= skip:
            continue
        row = re.sub(r"^(?: {0,3}> ?)+", "", row)
        m = re.match(r"^(?: {0,3}(?:[-*+]|\d{1,9}[.)])[ \t]+)* {0,3}(`{3,}|~{3,})(.*)$", row)
        if fence is not None:
            closing = re.match(r"^\s*(`{3,}|~{3,})\s*$", row)
            if closing and closing[1].startswith(fence):
                fence = None
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence, paragraph = m[1], None
        elif paragraph and re.match(r"^ {0,3}(?:=+|-+)[ \t]*$", row):
            out.append(("heading", paragraph[1], paragraph[1], paragraph[0], line))
            paragraph = None
        else:
            h = _HEADING.match(re.sub(r"^ {0,3}(?:(?:[-*+]|\d{1,9}[.)]) {1,4})+", "", row))
            if h:
                if h[1]:
                    out.append(("heading", h[1], h[1], line, line))
                paragraph = None
            elif not row.strip() or re.match(r"^ {0,3}(?:#{1,6}(?:\s|$)|([-*_])[ \t]*(?:\1[ \t]*){2,}$|[-*+][ \t]|\d{1,9}[.)][ \t])", row) or paragraph is None and re.match(r"^(?: {4}|\t|\|)", row):
                paragraph = None
            elif paragraph is None:
                paragraph = (line, row.strip().strip("#").strip())
    return out


_RULE = re.compile(r"^ {0,7}([^\s:=#][^:=#]*?)[ \t]*&?::?(?!:{0,2}=)(.*)$")
_TARGET_VARIABLE = re.compile(r"^\s*(?:(?:export|override|private)\s+)*[^\s:=#;]+\s*(?:[+?!]|:{1,3})?=")
_CONDITION = re.compile(r"^\s*(?:ifn?eq|ifn?def|else|endif)\b")


def make(text: str) -> list[Symbol]:
    found: list[list] = []
    rule = None
    define, joined = 0, False
    for line, row in enumerate(text.split("\n"), 1):
        before, joined = joined, row.endswith("\\")
        if define:
            define += bool(re.match(r"^\s*define\b", row)) - bool(re.match(r"^\s*endef\b", row))
        elif before:
            if rule is not None:
                rule[3] = line
        elif row.startswith("\t"):
            if rule is not None:
                rule[3] = line
        elif re.match(r"^\s*(?:(?:export|override)\s+)*define\b", row):
            define, rule = 1, None
        elif row.strip() and not row.lstrip().startswith("#") and not _CONDITION.match(row):
            rule = None
            # colons in references aren't the rule's
            m = _RULE.match(re.sub(r"\$[({][^(){}]*[)}]", lambda r: re.sub(r"[:=#]", "_", r[0]), row))
            name = re.search(r"^[^\s$&]+|\w+", m[1]) if m and not _TARGET_VARIABLE.match(m[2]) and not re.match(r"-?s?include\b|export\b|unexport\b|vpath\b", m[1]) else None
            if name:
                rule = ["target", name[0], line, line]
                found.append(rule)
    return _qualified([tuple(r) for r in found])


def just(text: str) -> list[Symbol]:
    return [("recipe", m[1], m[1], line, line) for line, row in enumerate(text.split("\n"), 1) if (m := _RECIPE.match(row)) and not re.match(r"(?:set|alias|export|import|mod)[ \t].*:=", row)]


_KCONFIG = re.compile(r"^[ \t]*(config|menuconfig|menu|endmenu|choice|endchoice|if|endif|comment|source|rsource|osource|orsource|mainmenu)\b(?![ \t]*[:+?]?=)[ \t]*(.*?)[ \t]*$")


def kconfig(text: str) -> list[Symbol]:
    found: list[list] = []
    menus: list[list] = []
    entry, helping, base = None, False, None
    for line, row in enumerate(text.split("\n"), 1):
        width = len(row.expandtabs(8)) - len(row.expandtabs(8).lstrip())
        if helping:
            if not row.strip():
                continue
            base = width if base is None else base
            if width >= base and width > 0:
                if entry is not None:
                    entry[3] = line
                continue
            helping = False
        if not row.strip() or row.lstrip().startswith("#"):
            continue
        m = _KCONFIG.match(row)
        if m is None:
            if entry is not None:
                entry[3] = line
            if re.match(r"^\s*(?:help|---help---)\s*$", row):
                helping, base = True, None
            continue
        entry = None
        if m[1] in ("config", "menuconfig") and re.fullmatch(r"\w+", m[2]):
            entry = [m[1], m[2], line, line]
            found.append(entry)
        elif m[1] == "menu":
            name = re.match(r"\"((?:\\.|[^\"\\])*)\"|'([^']*)'", m[2])
            menus.append(["menu", (name[1] or name[2] or "") if name else m[2], line, line])
            found.append(menus[-1])
        elif m[1] == "endmenu" and menus:
            menus.pop()[3] = line
    for menu in menus:
        menu[3] = len(text.rstrip("\n").split("\n"))
    return _qualified([tuple(s) for s in found if s[1]])


def _line_of(text: str) -> Callable[[int], int]:
    ends = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect_left(ends, at) + 1


def _blank(found: str) -> str:
    return re.sub(r"[^\n]", " ", found)


def _bash_code(text: str) -> str:
    """The text with comments, quoted parts, parameter expansions and here documents blanked."""
    out, i, n = [], 0, len(text)
    docs: list[tuple[str, bool]] = []

    def quoted(at: int) -> int:
        """The place behind a double-quoted part, commands and expansions in it included."""
        at += 1
        while at < n and text[at] != '"':
            at = at + 2 if text[at] == "\\" else nested(at + 1) if text[at] == "$" and text[at + 1 : at + 2] in ("(", "{") else at + 1
        return at + 1

    def nested(at: int) -> int:
        """The place behind the bracket that closes the one at ``at``."""
        opened, closed, depth = text[at], ")" if text[at] == "(" else "}", 0
        while at < n:
            c = text[at]
            if c == "\\":
                at += 1
            elif c == '"':
                at = quoted(at) - 1
            elif c == "'" and opened == "(":
                at = (text.find("'", at + 1) + n + 1) % (n + 1)
            depth += (c == opened) - (c == closed)
            at += 1
            if not depth:
                return at
        return n

    while i < n:
        c = text[i]
        end = i + 1
        if c == "\\":
            end = i + 2
        elif c == "'":
            ansi = text[i - 1 : i] == "$"
            m = re.compile(r"'(?:\\.|[^'\\])*'" if ansi else r"'[^']*'", re.S).match(text, i)
            end = m.end() if m else n
        elif c == '"':
            end = quoted(i)
        elif c == "$" and text[i + 1 : i + 2] in ("{", "("):
            end = nested(i + 1)
        elif c == "#" and (i == 0 or text[i - 1] in " \t\n;&|()"):
            end = (text.find("\n", i) + n + 1) % (n + 1)
        elif text.startswith("<<<", i):
            end = i + 3
        elif m := re.compile(r"<<(-?)[ \t]*(?:'([^'\n]+)'|\"([^\"\n]+)\"|\\?([\w.+-]+))").match(text, i):
            docs.append((m[2] or m[3] or m[4], bool(m[1])))
            end = m.end()
        elif c == "\n" and docs:
            for word, tabs in docs:
                while end < n:
                    stop = (text.find("\n", end) + n + 1) % (n + 1)
                    row, end = text[end:stop], min(n, stop + 1)
                    if (row.lstrip("\t") if tabs else row) == word:
                        break
            docs = []
        else:
            out.append(c)
            i += 1
            continue
        end = min(end, n)
        out.append(_blank(text[i:end]))
        i = end
    return "".join(out)


_FUNCTION = re.compile(r"(?:^|(?<=[;&|{(]))[ \t]*(?:function[ \t]+([^\s(){}|&;<>$`]+)(?:[ \t]*\([ \t]*\))?|([^\s(){}|&;<>$`=]+)[ \t]*\([ \t]*\))\s*(?=[{(]|\[\[|(?:if|for|while|until|case|select)\b)", re.M)


def bash(text: str) -> list[Symbol]:
    code = _bash_code(text)
    line_of = _line_of(code)
    found = []
    for m in _FUNCTION.finditer(code):
        at, opened = m.end(), code[m.end()]
        start = line_of(m.start(1) if m[1] else m.start(2))
        if opened in "{(":
            # a brace is a word of its own where it opens or closes a group
            pairs = re.compile(r"(?:^|(?<=[\s;&|(){}]))(?:(\{)(?=\s|$)|(\})(?=[\s;&|)}<>0-9]|$))", re.M) if opened == "{" else re.compile(r"(\()|(\))")
            ends = pairs.finditer(code, at)
        else:
            word = re.compile(r"\[\[|\w+").match(code, at)[0]
            one = {"[[": r"(\[\[)|(\]\])", "if": r"\b(if)\b|\b(fi)\b", "case": r"\b(case)\b|\b(esac)\b"}.get(word, r"\b(do)\b|\b(done)\b")
            ends = re.compile(one).finditer(code, at)
        depth, last = 0, len(code.rstrip("\n"))
        for e in ends:
            depth += 1 if e[1] else -1
            if depth <= 0:
                last = e.end() - 1
                break
        found.append(("function", m[1] or m[2], start, line_of(last)))
    return _qualified(found)


_VIM = re.compile(r"^[\s:]*(?:(?:legacy|export|static)\s+)*(?:fu(?:n(?:c(?:t(?:i(?:on?)?)?)?)?)?!?[ \t]+|def!?[ \t]+)((?:<SID>|<sid>|[abglstvw]:)?[A-Za-z_{][\w:#.{}]*)[ \t]*\(")
_VIM_END = re.compile(r"^[\s:]*(?:endf(?:u(?:n(?:c(?:t(?:i(?:on?)?)?)?)?)?)?|enddef)\b(?!\s*=)")


def vimscript(text: str) -> list[Symbol]:
    found: list[list] = []
    open_: list[list] = []
    document = None
    for line, row in enumerate(text.split("\n"), 1):
        if document is not None:
            if row.strip() == document:
                document = None
            continue
        m = re.search(r"(?:=<<|^\s*(?:lua|python3?|py3?|pythonx|pyx|ruby|perl|tcl|mzscheme)\s*<<)[ \t]*((?:(?:trim|eval)[ \t]+)*)(\S*)[ \t]*$", row)
        if m:
            document = m[2] or "."
        elif m := _VIM.match(row):
            open_.append(["function", m[1], line, line])
            found.append(open_[-1])
        elif _VIM_END.match(row) and open_:
            open_.pop()[3] = line
    for s in open_:
        s[3] = len(text.rstrip("\n").split("\n"))
    return _qualified([tuple(s) for s in found])


_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_RUBY_TOKEN = re.compile(r"(?:@@?|\$)?[A-Za-z_\x80-\U0010ffff][\w]*(?:[?!](?![=~]))?|\d[\w.]*\b")
_EXPECTS = set("if unless while until and or not return when in case then do else elsif begin ensure rescue yield puts raise p".split())


def _ruby_quoted(text: str, at: int, closing: str, opening: str | None = None, interpolated: bool = True) -> int:
    """The place behind a literal that starts before ``at``."""
    depth = 1
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if interpolated and text.startswith("#{", at):
            inner = 1
            at += 2
            while at < len(text) and inner:
                if text[at] in "\"'`":
                    at = _ruby_quoted(text, at + 1, text[at], None, text[at] != "'")
                    continue
                inner += (text[at] == "{") - (text[at] == "}")
                at += 1
            continue
        if c == closing:
            depth -= 1
        elif c == opening:
            depth += 1
        at += 1
        if not depth:
            return at
    return len(text)


def _ruby_tokens(text: str) -> list[tuple[str, int]]:
    """Words, operators and line ends with their places; comments and literals are left out or stand as one token '0'."""
    out: list[tuple[str, int]] = []
    docs: list[tuple[str, bool, bool]] = []
    i, n = 0, len(text)

    def value() -> bool:
        """Whether what was read last ends a value, so that an operator follows."""
        last = out[-1][0] if out else "\n"
        return last in (")", "]", "}", "0", "end", "self", "nil", "true", "false") or bool(re.match(r"[\w@$]", last)) and last not in _EXPECTS

    while i < n:
        c = text[i]
        end = None
        line_start = i == 0 or text[i - 1] == "\n"
        if line_start and re.compile(r"=begin\b").match(text, i):
            m = re.compile(r"^=end\b[^\n]*", re.M).search(text, i)
            i = m.end() if m else n
            continue
        if line_start and re.compile(r"__END__\r?(?:\n|\Z)").match(text, i):
            break
        if c == "\\":
            i += 2
            continue
        if c == "#":
            i = (text.find("\n", i) + n + 1) % (n + 1)
            continue
        if c == "\n":
            out.append(("\n", i))
            i += 1
            for word, bare, _ in docs:
                while i < n:
                    stop = text.find("\n", i)
                    stop = n if stop < 0 else stop
                    row, i = text[i:stop], min(n, stop + 1)
                    if (row if bare else row.strip()) == word:
                        break
            docs = []
            continue
        if c.isspace():
            i += 1
            continue
        spaced = i > 0 and text[i - 1] in " \t" and text[i + 1 : i + 2] not in (" ", "=", "\n", "")
        after_word = bool(out) and bool(re.match(r"[a-z_]", out[-1][0])) and out[-1][0] not in ("end", "self", "nil", "true", "false")
        literal = not value() or spaced and after_word
        m = re.compile(r"<<([~-]?)(?:([\"'`])([^\"'`\n]+)\2|([A-Z_]\w*))").match(text, i)
        if m and (literal or m[1] and spaced) and (m[1] or m[2] or m[4]):
            docs.append((m[3] or m[4], not m[1], True))
            end = m.end()
        elif c in "\"'`" and not (out and out[-1][0] in (".", "def") and c == "`"):
            end = _ruby_quoted(text, i + 1, c, None, c != "'")
            if text[end : end + 1] == ":" and text[end : end + 2] != "::":
                end += 1
        elif c == "/" and literal:
            end = _ruby_quoted(text, i + 1, "/")
        elif literal and (m := re.compile(r"%([qQwWiIrsx]?)([^\w\s=]|=(?!\s))").match(text, i)):
            end = _ruby_quoted(text, m.end(), _PAIRS.get(m[2], m[2]), m[2] if m[2] in _PAIRS else None, m[1] not in tuple("qwis"))
        elif c == "?" and literal and re.compile(r"\?(?:\\.|\S)(?!\w)").match(text, i):
            end = i + (3 if text[i + 1] == "\\" else 2)
        elif c == ":" and text[i + 1 : i + 2] in ('"', "'"):
            end = _ruby_quoted(text, i + 2, text[i + 1], None, text[i + 1] == '"')
        elif c == ":" and text[i - 1 : i] != ":" and (m := re.compile(r":(?:[A-Za-z_]\w*[?!=]?|[+\-*/<=>!~%&|^\[\]]+)").match(text, i)) and text[i + 1 : i + 2] != ":":
            end = m.end() - (m[0].endswith("=") and text[m.end() : m.end() + 1] in (">", "=", "~"))
        if end is not None:
            out.append(("0", i))
            i = min(n, max(end, i + 1))
            continue
        m = _RUBY_TOKEN.match(text, i)
        if m:
            word, stop = m[0], m.end()
            dotted = bool(out) and out[-1][0] in (".", "&.") and out[-1][1] == i - len(out[-1][0])
            label = text[stop : stop + 1] == ":" and text[stop : stop + 2] != "::" and not (out and out[-1][0] == "?")
            defined = bool(out) and out[-1][0] == "def"
            if label:
                out.append((",", i))  # the value of a key follows
                i = stop + 1
                continue
            out.append((word if not dotted else word + "\0" if word in _WORDS else word, i) if not defined or word not in _WORDS or word == "self" else (word + "\0", i))
            i = stop
            continue
        m = re.compile(r"&\.|::|\.\.\.?|<=>|===?|=~|=>|<<|[+\-*/%|&^<>!]=|&&|\|\||.", re.S).match(text, i)
        out.append((m[0], i))
        i = m.end()
    return out


_WORDS = set("class module def begin case if unless while until for do end then self".split())


def ruby(text: str) -> list[Symbol]:
    tokens = _ruby_tokens(text)
    line_of = _line_of(text)
    found: list[list] = []
    open_: list[list | None] = []
    loops = 0  # loops whose ``do`` is still to come on this line
    for k, (word, at) in enumerate(tokens):
        before = tokens[k - 1][0] if k else "\n"
        if word == "\n":
            loops = 0
        elif word == "end":
            if open_ and (entry := open_.pop()) is not None:
                entry[3] = line_of(at)
        elif word in ("class", "module"):
            m = re.compile(r"\s+((?:::)?[A-Z]\w*(?:::[A-Z]\w*)*)").match(text, at + len(word))
            open_.append([word, m[1], line_of(at), 0] if m else None)
            if m:
                found.append(open_[-1])
        elif word == "def":
            m = re.compile(r"\s+(?:(?:self|[A-Za-z_@$]\w*|\([^()]*\))(?:\.|::))?([A-Za-z_\x80-\U0010ffff]\w*(?:[?!](?!=(?!=))|=(?=\s*\(|\s+\w+\s*$))?|\[\]=?|<=>|===?|=~|![=~]?|\*\*|<<|>>|<=|>=|[+\-]@?|[*/%&|^<>~`])", re.M).match(text, at + 3)
            if not m:
                continue
            entry = ["method", m[1], line_of(at), 0]
            found.append(entry)
            # a method without end: its parameters, then an equals sign and a value up to the end of the line
            rest, depth, stop = m.end(), 0, len(text)
            while rest < len(text) and (text[rest] in " \t" or depth or text[rest] == "("):
                depth += (text[rest] == "(") - (text[rest] == ")")
                rest += 1
            if re.compile(r"=(?![=~>])").match(text, rest):
                last = next((j for j in range(k, len(tokens)) if tokens[j][1] > rest), len(tokens))
                level = 0
                for t, place in tokens[last:]:
                    level += (t in ("(", "[", "{") or t in ("do", "begin", "case")) - (t in (")", "]", "}", "end"))
                    stop = place
                    if t == "\n" and level <= 0:
                        break
                entry[3] = line_of(stop - 1 if text[stop : stop + 1] == "\n" else stop)
            else:
                open_.append(entry)
        elif word in ("begin", "case", "for"):
            open_.append(None)
            loops += word == "for"
        elif word in ("if", "unless", "while", "until"):
            operand = before in (")", "]", "}", "0", "end", "self") or bool(re.match(r"[\w@$]", before)) and before not in _EXPECTS - {"yield", "return", "puts", "p", "raise", "in"}
            if not operand:
                open_.append(None)
                loops += word in ("while", "until")
        elif word == "do":
            if loops:
                loops -= 1
            else:
                open_.append(None)
    last = len(text.rstrip("\n").split("\n"))
    for s in found:
        s[3] = s[3] or last
    return _qualified([tuple(s) for s in found])


SCANNERS: dict[str, Callable[[str], list[Symbol]]] = {"markdown": markdown, "make": make, "just": just, "kconfig": kconfig, "bash": bash, "vimscript": vimscript, "ruby": ruby}
