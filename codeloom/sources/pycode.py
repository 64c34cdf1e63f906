"""Symbols of Python sources, from the standard library's syntax tree.

A file that doesn't parse is read line by line instead, by indentation, so that
one broken file loses no more than what is broken.
"""

from __future__ import annotations

import ast
import re
import textwrap
import warnings

MOST_DOC = 500  # characters of a docstring that are kept


def _called(node: ast.AST) -> list[str]:
    names = []
    for n in ast.walk(node):
        if isinstance(n, ast.Call):
            if isinstance(n.func, ast.Name):
                names.append(n.func.id)
            elif isinstance(n.func, ast.Attribute):
                names.append(n.func.attr)
    return sorted(set(names))


def _doc(body: list[ast.stmt]) -> str:
    for s in body:
        if isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
            return s.value.value.strip()[:MOST_DOC]
    return ""


def _tree(text: str) -> list[dict]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        root = ast.parse(text)
    lines = text.split("\n")
    out = []
    # in order of the text, classes before functions
    nodes = sorted((n for n in ast.walk(root) if hasattr(n, "lineno")), key=lambda n: (n.lineno, n.col_offset))
    for n in nodes:
        if isinstance(n, ast.ClassDef):
            out.append(dict(type="class", name=n.name, signature=f"class {n.name}", docstring=_doc(n.body), line_start=n.lineno, line_end=n.end_lineno, calls=[]))
    for n in nodes:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            head = "\n".join(lines[n.lineno - 1 : n.body[0].lineno])
            at = re.search(rf"def\s+{re.escape(n.name)}\s*", head)
            params = _balanced(head[at.end() :]) if at else "()"
            ret = f" -> {ast.get_source_segment(text, n.returns)}" if n.returns else ""
            out.append(dict(type="function", name=n.name, signature=f"def {n.name}{params}{ret}", docstring=_doc(n.body), line_start=n.lineno, line_end=n.end_lineno, calls=_called(n)))
    return out


def _balanced(text: str) -> str:
    depth = 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if depth == 0 and c == ")":
            return text[: i + 1]
    return "()"


_DEF = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+(\w+)")
_CALL = re.compile(r"(?<![\w])([A-Za-z_]\w*)\s*\(")
_KEYWORDS = frozenset("and as assert async await class def del elif else except for from global if import in is lambda nonlocal not or raise return try while with yield print_".split())


def _lines(text: str) -> list[dict]:
    lines = text.split("\n")
    found = []
    for i, line in enumerate(lines):
        m = _DEF.match(line)
        if not m:
            continue
        end, depth = i, len(m[1])
        for j in range(i + 1, len(lines)):
            if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= depth:
                break
            if lines[j].strip():
                end = j
        body = "\n".join(lines[i + 1 : end + 1])
        doc = re.match(r"\s*[rRuU]?(\"\"\"|''')(.*?)(?:\1|$)", body, re.S)
        text_doc = doc[2].strip()[:MOST_DOC] if doc else ""
        if m[2] == "class":
            found.append(dict(type="class", name=m[3], signature=f"class {m[3]}", docstring=text_doc, line_start=i + 1, line_end=end + 1, calls=[]))
        else:
            params = _balanced(line[m.end() :].lstrip())
            calls = sorted({c for c in _CALL.findall(body) if c not in _KEYWORDS})
            found.append(dict(type="function", name=m[3], signature=f"def {m[3]}{params}", docstring=text_doc, line_start=i + 1, line_end=end + 1, calls=calls))
    return [x for x in found if x["type"] == "class"] + [x for x in found if x["type"] == "function"]


def python_symbols(text: str) -> list[dict]:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    for t in (text, textwrap.dedent(text)):
        try:
            return _tree(t)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
    return _lines(text)
