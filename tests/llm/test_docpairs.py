"""Documentation of functions: where it stands, what counts as trivial, and how comments are matched."""

import datetime as dt
import itertools

import numpy as np
import pytest
from codeloom.llm import docpairs as dp

GOOD = "Keeps at most nine cookies in memory."


@pytest.mark.parametrize(
    "text",
    [
        None, "", " \n", "TODO", "fixme: add a docstring here, please", "TODO: write documentation for this one", "Add a short description here", "[summary] to be written", "Description to be added later",
        "XXX document me before the release", "Missing docstring, see the style guide ticket", "Lorem ipsum dolor sit amet", "n/a", "??", "...", "----------------", "* * * * *", "None", "See above",
        "noqa: E501", "pylint: disable=too-many-locals,too-many-branches", "eslint-disable-next-line no-unused-vars", "@ts-ignore", "prettier-ignore", "pragma: no cover", "type: ignore",
        "Load the user table.", "load user table", "Function load user table", "Method: loadUserTable", "@param a\n@returns", ":param a: state to load\n:return: all of the rows", "Args:\n    user: the user that is loaded\n    table:",
        "x = [a.b for c in d if load(x)]", "const { a, b } = x.load();", "if (!user) {", "try {", "this.flag = x ?? 2706;", "{@inheritDoc}", "<b>Load</b> the table.",
    ],
)
def test_trivial(text):
    assert dp.description(text, "load_user_table") is None


@pytest.mark.parametrize(
    "text",
    [
        GOOD, "Recalcule le link de chaque claim quand la file est vide.", "如果文件没有变化，索引器会跳过它。", "Loads the user table from disk.", "Returns the narrow table that belongs to a spool.",
        "TODO: write docs\n\nKeeps at most nine cookies in memory.", "Guards against half written folders\n\n:param x: a", "Raises when the selector is strict → callers should retry.",
        "/**\n * Guards against half written files.\n * @param x the file\n */", "# Cheap upper bound on growth.\n# noqa", "Cheap upper bound on <b>request</b> growth.",
    ],
)
def test_says_something(text):
    assert dp.description(text, "load_user_table")


PLACES = [
    (f'def f(a):\n    """{GOOD}"""\n    return a', "body"),
    (f"def f(a):\n    r'''\n    {GOOD}\n    '''\n    return a", "body"),
    (f'def f(\n    a: int = (1),\n) -> dict[str, int]:\n    "{GOOD}"\n    return a', "body"),
    (f"# {GOOD}\n@cache(size=3)\n@other\ndef f(a):\n    return a", "comment"),
    (f"@cache(size=3)\n# {GOOD}\ndef f(a):\n    return a", "comment"),
    (f"/** {GOOD} */\nexport async function f(a) {{\n  return a;\n}}", "comment"),
    (f"// Keeps at most nine\n// cookies in memory.\nconst f = (a) => {{\n  return a;\n}};", "comment"),
    (f"    /*\n     * {GOOD}\n     */\n    static async f(a) {{\n      return a;\n    }}", "comment"),
    (f'class A:\r\n    def f(self):\r\n        """{GOOD}"""\r\n', "body"),
    (f'def f(a):\n    # a note\n\n    """{GOOD}"""\n    return a', "body"),
    (f"# {GOOD}\n\ndef f(a):\n    return a", None),
    (f"/** Sorts a file by f.\n * @param a rows */\n\nfunction f(a) {{\n  return a;\n}}", None),
    (f'def f(a):\n    """TODO"""\n    """{GOOD}"""\n    return a', None),
    (f"def f(a):\n    # {GOOD}\n    return a", None),
    (f'def f(a):\n    a += 1\n    """{GOOD}"""\n    return a', None),
    (f'def f(a):\n    x = "{GOOD}"\n    return x', None),
    (f"function f(a) {{\n  // {GOOD}\n  return a;\n}}", None),
    (f"def f(a):\n    def g():\n        '''{GOOD}'''\n    return g", None),
    ("def f(a):\n    return a\n# Keeps at most nine cookies.", None),
    ("", None),
]


@pytest.mark.parametrize("text,place", PLACES)
def test_places(text, place):
    got = dp.documented("f", None, text)
    assert (got and got[2] and got[0] or None) == place  # directly above or opening the body


def test_long_heads():
    plain = "".join(f"    a{i}: int = {i},\n" for i in range(61))
    many = plain + "".join(f"    b{i}=({i}),  # :-) {i}\n    c{i}=')',\n" for i in range(30))
    assert dp.documented("f", None, f'def f(\n{many}):\n    """{GOOD}"""\n    return a0')[0] == "body"
    assert dp.documented("f", None, f'def f(\n{plain}) -> int:\n    """{GOOD}"""\n    return a0')[0] == "body"
    assert dp.documented("f", None, f"# {GOOD}\n@cases(\n{plain})\ndef f(a):\n    return a")[0] == "comment"
    open_ = "def g(\n" + "    a,\n" * 70 + f'def f(a):\n    """{GOOD}"""'
    assert dp.documented("f", None, open_)[0] == "body"


def test_stored_docstring_first():
    assert dp.documented("f", GOOD, "def f(): pass") == ("docstring", GOOD, True)
    assert dp.documented("f", "TODO", f"# {GOOD}\ndef f(): pass")[0] == "comment"
    assert dp.documented(None, None, None) is None and dp.documented("f", GOOD, None)[0] == "docstring"


def test_assignment_is_the_best():
    rng = np.random.default_rng(4)
    for _ in range(200):
        shape = rng.integers(1, 5, 2)
        w = np.round(rng.random(shape) * 3, 2)
        got = dp.assign(np.where(w >= 1, w, 0))
        assert len(set(got.values())) == len(got) and all(w[r, c] >= 1 for r, c in got.items())
        n = max(shape)
        full = np.zeros((n, n))
        full[: shape[0], : shape[1]] = np.where(w >= 1, w, 0)
        best = max(sum(full[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert sum(w[r, c] for r, c in got.items()) == pytest.approx(best)


def test_comment_goes_to_its_own_function():
    text = f"# Sorts all of the rows.\ndef g(b):\n    return b\n\n# {GOOD}\n# :param a: number\ndef f(a):\n    return a"
    assert dp.documented("f", None, text)[1].startswith("Keeps") and dp.documented("g", None, text)[1].startswith("Sorts")


def test_tags_and_names_carry_a_comment_over_a_gap():
    far = f"/** Sorts the rows of a file. @param rows what to sort */\n\nexport function sort(rows) {{\n  return rows;\n}}"
    assert dp.documented("sort", None, far)[2] is False
    assert dp.documented("sort", None, far.replace("@param rows", "@param columns")) is None
    assert dp.documented("sort", None, far.replace("@param", "")) is None  # the name alone isn't enough
    past = f"# Sorts the rows of a file.\n# :param rows: what to sort\n\ndef helper(x):\n    return x\n\ndef sort_rows(rows):\n    return rows"
    assert dp.documented("sort_rows", None, past)[1].startswith("Sorts") and dp.documented("helper", None, past) is None


def test_directives_between_do_not_part_a_comment():
    text = f"/** {GOOD} */\n// eslint-disable-next-line no-shadow\nfunction f(a) {{\n  return a;\n}}"
    assert dp.documented("f", None, text)[:1] == ("comment",) and dp.documented("f", None, text)[2]


def test_assignment_differs_from_the_nearest_comment():
    """Two comments above g: the nearer one speaks of f's parameter, so the assignment gives it to f and the other to g."""
    text = (
        "# Keeps every warm cookie apart.\n# :param jar: where they are\n\n# Warms the oven of the kitchen first.\n# :param oven: which one\n"
        "def keep(jar):\n    return jar\n\ndef warm(oven):\n    return oven"
    )
    decls, comments, blank = dp.read_source(text)
    links = dp.links_of(decls, comments, blank)
    assert len(links) > 2 and {(comments[k.comment].text[2:7], decls[k.decl].name) for k in dp.match(links)} == {("Keeps", "keep"), ("Warms", "warm")}
    nearest = max((k for k in links if decls[k.decl].name == "keep"), key=lambda k: comments[k.comment].last)
    assert comments[nearest.comment].text.startswith("# Warms")
    assert dp.documented("keep", None, text)[1].startswith("Keeps") and dp.documented("warm", None, text)[1].startswith("Warms")


def test_components_are_solved_apart():
    """A file of many functions is as many small matrices, not a dense one."""
    sizes = []
    text = "\n".join(f"# Handles the case {i} of the {i} kind.\n@wrap\n# Runs before number {i} of the cases.\ndef f{i}(a{i}):\n    return a{i}\n" for i in range(300))
    decls, comments, blank = dp.read_source(text)
    whole = dp.assign
    dp.assign = lambda w: sizes.append(w.shape) or whole(w)
    try:
        got = dp.match(dp.links_of(decls, comments, blank))
    finally:
        dp.assign = whole
    assert len(decls) == 300 and len(comments) == 600 and len(got) == 300 and set(sizes) == {(1, 2)}


def test_table(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    rows = [
        ("A ", " Function", "f", "def f()", None, f"# {GOOD}\ndef f(): pass", t(1), t(1), None), ("a", "function", "f", "def f()", None, "def f(): pass", t(2), t(3), None),
        ("b", "METHOD", "f", "def f()", GOOD, None, t(2), t(2), None), ("b", "method", "f", "def f()", GOOD, None, t(2), t(4), None),
        ("c", "function", "f", None, GOOD, None, t(1), t(1), None), ("c", None, None, None, None, None, t(5), t(5), t(5)),
        ("d", "class", "f", None, GOOD, None, t(1), t(1), None), ("e", None, "f", None, GOOD, None, t(1), t(1), None), (None, "function", "f", None, GOOD, None, t(1), t(1), None),
        ("g", "function", None, None, GOOD, "", None, None, None),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id string, type string, name string, signature string, docstring string, raw_text string, indexed_at timestamp_ntz, landed_at timestamp_ntz, removed_at timestamp_ntz, place string, alive string")
    got = {r.id: r for r in dp.function_docs(df).collect()}
    assert set(got) == {"b", "g"} and got["b"].description == GOOD and got["b"].signature == "def f()"
    assert {r.id for r in dp.function_docs(df, with_text=False).collect()} == {"b", "g"}
    assert dp.function_docs(df.limit(0)).count() == 0
