"""A small reader of Go sources: enough to find functions, calls and imports."""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<raw>`[^`]*`)|(?P<str>"(?:\\.|[^"\\\n])*")|(?P<rune>'(?:\\.|[^'\\\n])+')"""
    r"""|(?P<name>[^\W\d]\w*)|(?P<num>\d[\w.]*)|(?P<nl>\n)|(?P<space>[ \t\r]+)|(?P<op>.)""",
    re.S,
)
#: Fixed values.
BUILTINS = {"append", "len", "cap", "make", "new", "panic", "recover"}
_KEYWORDS = {"if", "for", "switch", "select", "func", "return", "go", "defer", "range", "case", "map", "chan", "struct", "interface", "var", "const", "type", "import", "package", "else"}
_PAIRS = {")": "(", "]": "[", "}": "{"}


def tokens(source: str) -> list[tuple[str, str, int, int]] | None:
    """(kind, text, offset, depth of braces); None if brackets or quotes don't close."""
    out, stack = [], []
    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m.group()
        if kind == "op" and text in "\"'`":
            return None
        if kind == "op" and text in "([{":
            stack.append(text)
        if kind == "op" and text in _PAIRS and (not stack or stack.pop() != _PAIRS[text]):
            return None
        if kind != "space":
            out.append((kind, text, m.start(), len(stack)))
    code = [t for t in out if t[0] not in ("comment", "nl")]
    if stack or len(code) < 2 or code[0][1] != "package" or code[1][0] != "name":
        return None
    return out


def _functions(toks):
    """(index of func, name, kind, index of the last token) of top-level functions."""
    i = 0
    while i < len(toks):
        kind, text, _, depth = toks[i]
        if kind == "name" and text == "func" and depth == 0:
            j, is_method = i + 1, False
            while j < len(toks) and toks[j][0] in ("nl", "comment"):
                j += 1
            if j < len(toks) and toks[j][1] == "(":
                is_method = True
                while not (toks[j][1] == ")" and toks[j][3] == 0):
                    j += 1
                j += 1
            if j >= len(toks) or toks[j][0] != "name":
                i += 1
                continue
            name, z, body = toks[j][1], j, None
            for k in range(j, len(toks)):
                if toks[k][1] == "{" and toks[k][3] == 1:
                    body = k
                if toks[k][1] == "}" and toks[k][3] == 0 and body is not None:
                    after = toks[k + 1 : k + 2]
                    if not after or after[0][0] in ("nl", "comment"):
                        z = k
                        break
                if toks[k][0] == "nl" and toks[k][3] == 0 and body is None:
                    break
                z = k
            yield i, name, "method" if is_method else "function", z
            i = z
        i += 1


def chunk_go(source: str | None) -> list[tuple] | None:
    """(start_line, end_line, symbol, kind, body) of every top-level function; the body begins at its doc
    comment, the lines at func. None if the source doesn't parse."""
    toks = tokens(source or "")
    if toks is None:
        return None
    out = []
    for i, name, kind, z in _functions(toks):
        start, k = toks[i][2], i
        while k >= 2 and toks[k - 1][0] == "nl" and toks[k - 2][0] == "comment" and (k == 2 or toks[k - 3][0] == "nl"):
            k -= 2
            start = toks[k][2]
        end = toks[z][2] + len(toks[z][1])
        line = source.count("\n", 0, toks[i][2]) + 1
        out.append((line, line + source.count("\n", toks[i][2], end), name, kind, source[start:end]))
    return out


def go_signals(source: str | None, include_local: bool) -> str:
    """Functions (if include_local), calls and imports in order of place; the source itself if it doesn't parse."""
    source = source or ""
    toks = tokens(source)
    if toks is None:
        return source
    declared = {t[2]: name for i, name, _, _ in _functions(toks) for t in [toks[i]]}
    code = [t for t in toks if t[0] not in ("comment", "nl")]
    out: dict[str, None] = {}
    in_import = False
    for i, (kind, text, at, depth) in enumerate(code):
        if kind == "name" and text == "import" and depth == 0:
            in_import = "block" if i + 1 < len(code) and code[i + 1][1] == "(" else "one"
        elif in_import and kind in ("str", "raw"):
            out[text.strip('"`') if kind == "str" else text] = None
            in_import = False if in_import == "one" else in_import
        elif in_import == "block" and text == ")" and depth == 0:
            in_import = False
        elif at in declared and include_local:
            out[declared[at]] = None
        elif kind == "name" and i + 1 < len(code) and code[i + 1][1] == "(" and text not in _KEYWORDS:
            prev = code[i - 1][1] if i else ""
            if prev == ".":
                if i >= 2 and code[i - 2][0] == "name" and (i < 3 or code[i - 3][1] != "."):
                    out[f"{code[i - 2][1]}.{text}"] = None
                elif include_local:
                    out[text] = None
            elif prev != "func" and not _declared_here(code, i) and text not in BUILTINS:
                out[text] = None
    return "\n".join(k for k in out if k)


def _declared_here(code, i) -> bool:
    """Whether the name at i is that of a method: func (r T) name(."""
    if code[i - 1][1] != ")" or code[i - 1][3] != 0:
        return False
    k = i - 1
    while k > 0 and not (code[k][1] == "(" and code[k][3] == 1):
        k -= 1
    return code[k - 1][1] == "func" and code[k - 1][3] == 0
