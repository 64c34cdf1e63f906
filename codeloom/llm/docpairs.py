"""Functions paired with their documentation.

From the source text of a symbol its declarations and comments are read: comment
blocks above a declaration (and above its decorators) and strings that open a
body.  Descriptions that say nothing are rejected first.  The other comments and
the declarations are matched by a maximum-weight bipartite assignment over
distance, parameter tags and shared names; links of too little weight are
implausible and don't take part.  Tags and names decide between rivals and carry
a link over a gap.  The stored docstring is the strongest link, since the indexer
took it from the symbol itself.

A description is trivial if fewer than four words remain without marks and tag
lines, or if it repeats the symbol's name, holds a place, directs a tool or is
code that was commented out.

Defined results: a null or empty docstring or raw_text offers no description; a
null name repeats nothing; either kind of line end is read; texts are read
whole; rows that aren't functions or methods give nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.normal import filled, latest, norm_id
from codeloom.session import ship, spread

# ---------------------------------------------------------------- descriptions

_TAG = re.compile(r"^\s*(?:[@\\][A-Za-z]\w*|:[A-Za-z]\w*(?:\s+[^:]*)?:)")
_SECTION = re.compile(r"^(\s*)(?:args|arguments|parameters|params|returns?|yields?|raises|throws|attributes|keyword args|other parameters)\s*:", re.I)
_MARK = re.compile(r"</?[A-Za-z][^<>]*>|\{@\w+[^{}]*\}|&\w+;")
_WORD = re.compile(r"[^\W_]+(?:['’_-][^\W_]+)*")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_HOLDS = re.compile(
    r"^\W*(?:todo|fixme|xxx|tbd|tba|hack|wip)\b"
    r"|^\W*lorem ipsum\b"
    r"|\b(?:add|write|insert|provide|fill in|missing|needs?|no|undocumented|put)\b[\w ,'-]{0,24}\b(?:doc|docs|docstring|docstrings|documentation|description|summary|comment)\b"
    r"|\b(?:doc|docs|docstring|documentation|description|summary|comment)\b\W*(?:is |are )?(?:to be|goes here|will be|needed|missing|pending|follows|comes later)\b"
    r"|\b(?:to be|will be) (?:written|added|documented|filled in|completed|done|determined)\b[\w ]{0,12}$"
    r"|^\W*(?:please )?document (?:me|this|it)\b"
    r"|^\W*(?:placeholder|coming soon|not documented|no description|work in progress|auto-?generated (?:method|function|doc))\b",
    re.I,
)
_TOOL = re.compile(
    r"^\W*(?:noqa\b|type:\s*ignore|pylint\s*:|pragma\s*:|pragma\b|fmt:\s*(?:on|off|skip)|yapf\s*:|isort\s*:|mypy\s*:|ruff\s*:|flake8\s*:|pyright\s*:|bandit\s*:|nosec\b|nosonar\b|black\s*:"
    r"|eslint(?:-\w+)*\b|tslint\s*:|jshint\b|jslint\b|prettier-ignore\b|ts-(?:ignore|expect-error|nocheck|check)\b|@ts-\w+|istanbul ignore|c8 ignore|v8 ignore|stylelint-\w+|biome-ignore\b|global\s+\w+$|#?region\b|#?endregion\b|-\*-|vim?\s*:|coding[:=])",
    re.I,
)
_CODE = re.compile(
    r"^(?:(?:const|let|var|final|static|export|await|self\.|this\.)\b.*[=;({]"
    r"|[\w.$]+(?:\[[^\]]*\])?(?:\s*,\s*[\w.$]+)*\s*(?:[-+*/%|&^]|\?\?|\*\*|//|>>|<<)?=(?!=)\s*\S.*"
    r"|(?:return|throw|raise|yield|del|assert)\b(?:.*[;()\[\]{}=]|\s+\w+)$"
    r"|(?:if|for|while|switch|catch|elif|with|def|class|function|async|except)\b.*[:{]$"
    r"|(?:else|try|finally|do)\s*[:{]$"
    r"|(?:import|from)\s+[\w.{}*, ]+(?:import\b.*|from\b.*|;)?$"
    r"|[\w.$]+\(.*\)\s*[;:{,]?$"
    r"|[)\]}]+[;,]?(?:\s*(?:else|catch|finally)\b.*)?[{:]?"
    r"|(?:pass|break|continue)\b;?"
    r"|.*[;{]$)"
)
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Words that add nothing to a symbol's name.
_FILL = frozenset("a an the this that of for to and in on is it function method def fn func class constructor procedure helper routine".split())


def strip_marks(text: str) -> str:
    """Text of a comment or docstring without quotes, comment marks and common indentation."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out = []
    for line in lines:
        s = re.sub(r"^\s*(?:/\*+!?|\*+/|//+!?|#+!?(?=\s|$)|\*(?!\*)(?=\s|$|/))", "", line, count=1)
        s = re.sub(r"\s*\*+/\s*$", "", s)
        out.append(s.rstrip())
    body = [x for x in out if x.strip()]
    cut = min((len(x) - len(x.lstrip()) for x in body), default=0)
    return "\n".join(x[cut:] if x.strip() else "" for x in out).strip("\n")


def prose_of(text: str) -> list[str]:
    """Lines of a description without tag lines and what belongs to them."""
    keep, inside = [], None
    for line in text.split("\n"):
        if not line.strip():
            if inside == "tag":
                inside = None
            keep.append("")
            continue
        depth = len(line) - len(line.lstrip())
        if _TAG.match(line):
            inside, at = "tag", depth
            continue
        if m := _SECTION.match(line):
            inside, at = "section", len(m[1])
            continue
        if inside and depth > at:
            continue
        inside = None
        keep.append(line)
    return keep


def word_count(text: str) -> int:
    wide = len(_WIDE.findall(text))
    return wide + len(_WORD.findall(_WIDE.sub(" ", text)))


def name_words(name: str | None) -> set[str]:
    return {w.lower() for w in _CAMEL.findall(name or "")}


def _root(w: str) -> str:
    for end in ("ing", "es", "ed", "s", "e"):
        if w.endswith(end) and len(w) > len(end) + 2:
            return w[: -len(end)]
    return w


def repeats_name(text: str, name: str | None) -> bool:
    words = {w.lower() for x in _WORD.findall(text) for w in _CAMEL.findall(x)}
    of = {_root(w) for w in name_words(name)}
    return bool(of) and bool(words) and not _WIDE.search(text) and all(w in _FILL or _root(w) in of for w in words)


def description(text: str | None, name: str | None = None) -> str | None:
    """What ``text`` (a docstring or comment) says, or null if that is trivial."""
    if not text:
        return None
    clean = strip_marks(text)
    lines = [x for x in prose_of(clean) if not _TOOL.match(x.strip())]
    full = [x.strip() for x in lines if x.strip()]
    if full and all(_CODE.match(x) for x in full):
        return None
    blocks = [_MARK.sub(" ", b) for b in re.split(r"\n\s*\n", "\n".join(x for x in lines))]
    said = []
    for b in blocks:
        flat = " ".join(b.split())
        if not flat or (_HOLDS.search(flat) and word_count(flat) < 15):
            continue
        said.append(flat)
    flat = " ".join(said)
    if word_count(flat) < 4 or repeats_name(flat, name):
        return None
    return clean


# ---------------------------------------------------------------- source text


@dataclass(frozen=True)
class Decl:
    name: str
    params: tuple[str, ...]
    top: int  # first line of its decorators
    line: int
    end: int  # line on which its head ends


@dataclass(frozen=True)
class Comment:
    text: str
    first: int
    last: int
    opens: bool  # a string that is a statement of its own
    of: int = -1  # the declaration whose body it opens, by its line


_PY = re.compile(r"^\s*(?:async\s+)?def\s+(\w+)\s*\(")
_JS_SKIP = frozenset("if for while switch catch return function with do else new await typeof throw".split())
_MODS = r"(?:(?:export|default|async|static|public|private|protected|readonly|override|abstract|get|set|declare)\s+)*"
_JS = (
    re.compile(rf"^\s*{_MODS}function\s*\*?\s*([\w$]+)\s*(?:<[^(]*>)?\("),
    re.compile(rf"^\s*{_MODS}(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\(|[\w$]+\s*=>)"),
    re.compile(rf"^\s*{_MODS}\*?\s*(#?[\w$]+)\s*(?:<[^(]*>)?\([^;]*\)\s*(?::[^{{]+)?\{{\s*$"),
    re.compile(rf"^\s*{_MODS}([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\([^;]*\)|[\w$]+)\s*(?::[^=]+)?=>"),
)
_QUOTE = re.compile(r'^\s*[rRuUbBfF]{0,2}("""|\'\'\'|"|\'|`)')

_QUIET = re.compile(r"""\"(?:\\.|[^"\\])*\"|'(?:\\.|[^'\\])*'|#.*|(?:^|\s)//\s.*""")
_BRACKET = re.compile(r"[()\[\]{}]")


def _head(lines: list[str], at: int) -> tuple[int, str]:
    """Line on which the brackets of a head close again, and what it holds."""
    depth, seen, got = 0, False, []
    for i in range(at, min(len(lines), at + 60)):
        for ch in lines[i]:
            if ch in "([{" and not (ch == "{" and depth == 0):
                depth, seen = depth + 1, True
            elif ch in ")]}":
                depth -= 1
        got.append(lines[i])
        if seen and depth <= 0 or (i == at and "(" not in lines[i]):
            return i, "\n".join(got)
    return _long_head(lines, at) if at + 60 < len(lines) else (at, lines[at])


def _long_head(lines: list[str], at: int) -> tuple[int, str]:
    """``_head`` to the end of the text, without brackets in strings and comments; one line if they never close.

    Another declaration or the end of the text says that they don't.
    """
    depth, seen = 0, False
    for i in range(at, len(lines)):
        if i > at and _PY.match(lines[i]):
            break
        for ch in _BRACKET.findall(_QUIET.sub("", lines[i])):
            if ch in "([{" and not (ch == "{" and depth == 0):
                depth, seen = depth + 1, True
            elif ch in ")]}":
                depth -= 1
        if seen and depth <= 0:
            return i, "\n".join(lines[at : i + 1])
    return at, lines[at]


def _params(head: str) -> tuple[str, ...]:
    inner = head[head.find("(") + 1 :]
    cut = inner.rfind(")")
    names = (re.match(r"\s*[*.]*([\w$]+)", p) for p in (inner[:cut] if cut >= 0 else inner).split(","))
    return tuple(m[1] for m in names if m and m[1] not in ("self", "cls", "this"))


def read_source(text: str) -> tuple[list[Decl], list[Comment], list[bool]]:
    """Declarations and comments of a source text, by line, and which lines are blank."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    decls: list[Decl] = []
    comments: list[Comment] = []
    top, i, n = None, 0, len(lines)
    head_of = -1  # the declaration of which nothing but comments has followed yet
    while i < n:
        s = lines[i].strip()
        if s.startswith("/*"):
            j = i
            while j < n - 1 and "*/" not in lines[j][lines[j].find("/*") + 2 if j == i else 0 :]:
                j += 1
            comments.append(Comment("\n".join(lines[i : j + 1]), i, j, False))
            i = j + 1
            continue
        if s.startswith("//") or (s.startswith("#") and not re.match(r"#[\w$]+\s*[(=]", s)):
            mark = "//" if s.startswith("//") else "#"
            j = i
            while j < n - 1 and lines[j + 1].strip().startswith(mark):
                j += 1
            comments.append(Comment("\n".join(lines[i : j + 1]), i, j, False))
            i = j + 1
            continue
        if s.startswith("@") and not s.startswith("@param"):
            top = i if top is None else top
            i = _head(lines, i)[0] + 1 if "(" in s else i + 1
            continue
        if (m := _QUOTE.match(lines[i])) and (body := _string(lines, i, m[1])):
            comments.append(Comment(body[0], i, body[1], True, head_of))
            head_of = -1
            i = body[1] + 1
            continue
        m = _PY.match(lines[i]) or next((m for r in _JS if (m := r.match(lines[i])) and m[1] not in _JS_SKIP), None)
        if m:
            end, head = _head(lines, i)
            decls.append(Decl(m[1], _params(head), i if top is None else top, i, end))
            head_of = i
            rest = re.search(r":\s*([rRuU]{0,2}(?:\"|').*)$", lines[end]) if _PY.match(lines[i]) else None
            if rest and (q := _QUOTE.match(rest[1])) and (body := _string([rest[1]], 0, q[1])):
                comments.append(Comment(body[0], end, end, True, i))
                head_of = -1
            i = end + 1
        else:
            if s:
                head_of = -1
            i += 1
        if s:
            top = None
    return decls, comments, [not x.strip() for x in lines]


def _string(lines: list[str], at: int, quote: str) -> tuple[str, int] | None:
    """A string that is a statement of its own: its content and last line."""
    start = lines[at].find(quote) + len(quote)
    if len(quote) == 1:
        m = re.match(rf"((?:\\.|[^\\{quote}])*){quote}\s*;?\s*(?:#.*|//.*)?$", lines[at][start:])
        return (m[1], at) if m else None
    got = [lines[at][start:]]
    j = at
    while quote not in got[-1]:
        j += 1
        if j >= len(lines):
            return "\n".join(got), len(lines) - 1  # the text was cut inside the string
        got.append(lines[j])
    rest = got[-1][got[-1].index(quote) + len(quote) :].strip()
    if rest and not rest.startswith(("#", ";")):
        return None
    got[-1] = got[-1][: got[-1].index(quote)]
    return "\n".join(got), j


@dataclass(frozen=True)
class Link:
    comment: int
    decl: int
    weight: float
    direct: bool  # nothing but comments and decorators lies between


_PARAM = re.compile(r"(?:[@\\]param|:param)\s+(?:\{[^}]*\}\s*)?(?:[\w.\[\]]+\s+(?=\w+\s*:))?\[?([\w$]+)")
_LEAST = 1.0  # links of less weight are implausible


def links_of(decls: list[Decl], comments: list[Comment], blank: list[bool], others: Sequence[Comment] = ()) -> list[Link]:
    """Plausible links of informative comments to declarations; ``blank`` tells which lines hold nothing, ``others`` say nothing.

    The weight is distance - above 1 only where nothing but comments, decorators
    and tool directives lies between, else 1 by the lines between, code counting
    for three - and evidence: up to 0.6 for parameter tags that name parameters
    and up to 0.4 for words of the declaration's name.  So tags and names carry a
    link over a gap.  A comment meets the next declaration below, and those
    further down whose parameters its tags all name.
    """
    out: list[Link] = []
    if not decls or not comments:
        return out
    by_line = {d.line: i for i, d in enumerate(decls)}
    tops = [d.top for d in decls]
    with_param: dict[str, list[int]] = {}
    for i, d in enumerate(decls):
        for x in d.params:
            with_param.setdefault(x, []).append(i)
    code = np.ones(len(blank) + 1, np.int64)  # weight of a line as part of a gap
    code[: len(blank)] = np.where(blank, 1, 3)
    for c in (*comments, *others):
        code[c.first : c.last + 1] = 0
    for d in decls:
        code[d.top : d.line] = np.where(code[d.top : d.line] == 1, 1, 0)
    way = np.concatenate([[0], np.cumsum(code)])
    starts = [c.first for c in comments if not c.opens]
    for j, c in enumerate(comments):
        if c.opens:
            if c.of in by_line:  # a string that opens a body belongs nowhere else
                out.append(Link(j, by_line[c.of], 1.1 + _evidence(c, decls[by_line[c.of]]), True))
            continue
        tags = set(_PARAM.findall(c.text))
        around = bisect_right(tops, c.first) - 1
        inside = around >= 0 and tops[around] <= c.first and c.last < decls[around].line
        nxt = around if inside else around + 1  # between decorators and declaration, or above
        some = {nxt} if nxt < len(decls) else set()
        if tags:
            far = set.intersection(*(set(with_param.get(t, ())) for t in tags))
            some |= {i for i in far if tops[i] > c.last}
        for i in some:
            d = decls[i]
            gap = int(way[d.line if inside and i == around else d.top] - way[c.last + 1])
            between = bisect_right(starts, d.line) - bisect_right(starts, c.first)
            near = max(1.0, 1.05 - 0.01 * between) if gap == 0 else 1 / (1 + gap)
            w = near + _evidence(c, d, tags)
            if w >= _LEAST:
                out.append(Link(j, i, w, gap == 0))
    return out


def _evidence(c: Comment, d: Decl, tags: set[str] | None = None) -> float:
    tags = set(_PARAM.findall(c.text)) if tags is None else tags
    fit = len(tags & set(d.params)) / len(tags) if tags else 0.0
    of = {_root(w) for w in name_words(d.name)}
    words = {_root(w.lower()) for x in _WORD.findall(c.text) for w in _CAMEL.findall(x)} if of else set()
    return 0.6 * fit + 0.4 * len(words & of) / max(1, len(of))


def assign(w: np.ndarray) -> dict[int, int]:
    """Row to column of a maximum-weight bipartite matching; links of weight 0 don't count.

    The Hungarian method with potentials, on the matrix padded to a square.
    """
    n = max(w.shape, default=0)
    if not n:
        return {}
    cost = np.zeros((n + 1, n + 1))
    cost[1 : w.shape[0] + 1, 1 : w.shape[1] + 1] = -w
    u, v, of, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for r in range(1, n + 1):
        of[0], c = r, 0
        low, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[c] = True
            free = ~used
            free[0] = False
            slack = cost[of[c]] - u[of[c]] - v
            better = free & (slack < low)
            low[better], way[better] = slack[better], c
            nxt = int(np.where(free, low, np.inf).argmin())
            step = low[nxt]
            u[of[used]] += step
            v[used] -= step
            low[free] -= step
            c = nxt
            if of[c] == 0:
                break
        while c:
            of[c] = of[way[c]]
            c = way[c]
    return {int(of[c]) - 1: c - 1 for c in range(1, n + 1) if of[c] - 1 < w.shape[0] and c - 1 < w.shape[1] and w[of[c] - 1, c - 1] > 0}


def match(links: list[Link]) -> list[Link]:
    """The links of a maximum-weight assignment, solved for each connected component by itself."""
    head: dict[tuple[str, int], tuple[str, int]] = {}

    def find(x: tuple[str, int]) -> tuple[str, int]:
        while head.setdefault(x, x) != x:
            head[x] = x = head[head[x]]
        return x

    for k in links:
        head[find(("d", k.decl))] = find(("c", k.comment))
    parts: dict[tuple[str, int], list[Link]] = {}
    for k in links:
        parts.setdefault(find(("d", k.decl)), []).append(k)
    out = []
    for part in parts.values():
        if len(part) == 1:
            out += part
            continue
        rows, cols = sorted({k.decl for k in part}), sorted({k.comment for k in part})
        w = np.zeros((len(rows), len(cols)))
        at = {}
        for k in part:
            i, j = rows.index(k.decl), cols.index(k.comment)
            w[i, j], at[i, j] = k.weight, k
        out += [at[i, j] for i, j in assign(w).items()]
    return out


def documented(name: str | None, docstring: str | None, raw_text: str | None) -> tuple[str, str, bool] | None:
    """(place, description, direct) of a function, or null: place is docstring, body or comment.

    A declaration takes one description: the string that opens its body and the
    comments above are rivals for it.  The stored docstring was linked to its symbol
    by the indexer: that link outweighs all others of the symbol, so it is in every
    best assignment and is taken before the text is read.
    """
    if said := description(docstring, name):
        return "docstring", said, True
    if not raw_text:
        return None
    decls, comments, blank = read_source(raw_text)
    if not decls or not comments:
        return None
    own = next((i for i, d in enumerate(decls) if d.name == name), 0)
    names = {d.line: d.name for d in decls}
    after = {c: decls[i].name for c, i in ((c, bisect_right([d.top for d in decls], c.first)) for c in comments) if i < len(decls)}
    say = lambda c: description(c.text, names.get(c.of) if c.opens else (name if after.get(c) == decls[own].name else after.get(c)))
    told = [c for c in comments if say(c)]
    hit = next((k for k in match(links_of(decls, told, blank, comments)) if k.decl == own), None)
    if hit and (said := description(told[hit.comment].text, name)):
        return "body" if told[hit.comment].opens else "comment", said, hit.direct
    return None


# ---------------------------------------------------------------- tables


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("is_code", "name", "docstring", "raw_text")]
        got = [documented(n, d, r) if code else None for code, n, d, r in zip(*cols)]
        place = pa.array([g and g[0] for g in got], pa.string())
        said = pa.array([g and g[1] for g in got], pa.string())
        direct = pa.array([g and g[2] for g in got], pa.bool_())
        keep = [i for i, x in enumerate(b.schema.names) if x not in ("docstring",)]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), place, said, direct], names=[*(b.schema.names[i] for i in keep), "place", "description", "direct"])


def function_docs(nodes: DataFrame, with_text: bool = True) -> DataFrame:
    """(id, place, direct[, code, signature, description]) of each current function or method that has a description.

    ``direct`` is false where parameter tags and names carried a comment over a gap.

    Descriptions are read before the versions of an id are compared, so that
    without texts the shuffle carries ids and flags only.
    """
    ship(nodes.sparkSession)
    kind = norm_id("type").isin("function", "method")
    src = nodes.where(filled("id")).select(
        norm_id("id").alias("id"), "indexed_at", "landed_at", F.col("removed_at").isNull().alias("alive"),
        F.coalesce(kind, F.lit(False)).alias("is_code"), "name", "signature", "docstring", "raw_text",
    )
    out = "id string, indexed_at timestamp_ntz, landed_at timestamp_ntz, alive boolean, is_code boolean, name string, signature string, raw_text string, place string, description string, direct boolean"
    read = spread(src).mapInArrow(_rows, out)
    text = [F.col("signature"), F.col("raw_text").alias("code"), F.col("description")] if with_text else []
    rows = latest(read, F.col("id"), [F.col("indexed_at"), F.col("landed_at")], [F.col("alive"), F.col("place"), F.col("direct"), *text], "id")
    return rows.where("alive and place is not null").drop("alive")
