"""Symbols of JavaScript and TypeScript sources.

Comments, strings, templates and regular expressions are blanked first, position
by position, so that what is left can be matched and its brackets counted.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`"
    r"|(?<=[=(,:;!&|?{}\[\n])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[gimsuy]*",
    re.S,
)
_RESERVED = frozenset("if for while switch catch return function with do else new await typeof throw super import case delete void yield in of".split())
_CLASS = re.compile(r"\bclass\s+([A-Za-z_$][\w$]*)")
_FUNCTION = re.compile(r"\b(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\s*(?=\()")
_VALUE = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(async\s+)?(function\b\s*\*?\s*[\w$]*\s*(?=\()|(?=\()|[A-Za-z_$][\w$]*(?=\s*=>))")
_METHOD = re.compile(r"(?:^|(?<=[{};\n]))[ \t]*((?:(?:static|async|get|set|public|private|protected|readonly|override|abstract)\s+)*\*?\s*)(#?[A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\s*(?=\()", re.M)
_CALL = re.compile(r"([A-Za-z_$][\w$]*)\s*\(")


def blank(text: str) -> str:
    return _TOKEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _close(text: str, at: int) -> int:
    """Position after the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(text)):
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                return i + 1
    return len(text)


def _calls(code: str) -> list[str]:
    names = {m[1] for m in _CALL.finditer(code) if m[1] not in _RESERVED and not re.search(r"\b(?:function\s*\*?|class|new)\s*$", code[max(0, m.start() - 12) : m.start()])}
    return sorted(names)


def _body(code: str, at: int) -> tuple[int, int] | None:
    """Span of the block that starts after position ``at``, past a return type."""
    m = re.compile(r"\s*(?::\s*[^{;=]+?)?\s*\{").match(code, at)
    return (m.end() - 1, _close(code, m.end() - 1)) if m else None


def js_symbols(text: str) -> list[dict]:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    code = blank(text)
    line = lambda p: text.count("\n", 0, p) + 1
    classes, functions, values, methods = [], [], [], []

    def add(to: list, name: str, kind: str, signature: str, start: int, end: int, calls: list[str]) -> None:
        to.append(dict(type=kind, name=name, signature=signature, docstring="", line_start=line(start), line_end=line(max(start, end - 1)), calls=calls))

    spans = []
    for m in _CLASS.finditer(code):
        at = code.find("{", m.end())
        end = _close(code, at) if at >= 0 else m.end()
        spans.append((at, end))
        add(classes, m[1], "class", f"class {m[1]}", m.start(), end, [])
    for m in _FUNCTION.finditer(code):
        close = _close(code, m.end())
        if b := _body(code, close):
            add(functions, m[1], "function", f"function {m[1]}{text[m.end():close]}", m.start(), b[1], _calls(code[m.end() : b[1]]))
    for m in _VALUE.finditer(code):
        arrow = not m[3].startswith("function")
        if m[3] and arrow:
            params, after = m[3], m.end()
        else:
            after = _close(code, m.end())
            params = text[m.end() : after]
        if arrow:
            a = re.compile(r"\s*(?::[^=]+?)?=>\s*").match(code, after)
            if not a:
                continue
            end = _close(code, a.end()) if code[a.end() : a.end() + 1] in ("{", "(") else next((i for i in range(a.end(), len(code)) if code[i] in ";\n"), len(code))
        elif b := _body(code, after):
            end = b[1]
        else:
            continue
        add(values, m[1], "function", f"const {m[1]} = {'arrow_function' if arrow else 'function'}{params}", m.start(1), end, _calls(code[m.end() : end]))
    for a, b in spans:
        for m in _METHOD.finditer(code, a + 1, b):
            if m[2] in _RESERVED or _depth(code, a, m.start(2)) != 1:
                continue
            close = _close(code, m.end())
            if body := _body(code, close):
                add(methods, m[2], "function", f"{m[2]}{text[m.end():close]}", m.start(2), body[1], [])
    return classes + functions + values + methods


def _depth(code: str, start: int, at: int) -> int:
    part = code[start:at]
    return sum(part.count(c) for c in "([{") - sum(part.count(c) for c in ")]}")
