"""Parsing, indexing, history, snapshots and the live graph on made trees."""

import datetime as dt
import io
import subprocess

import pytest
from codeloom.api import Engine
from codeloom.sources import commits, ingest, scan, snapshots
from codeloom.sources.jscode import js_symbols
from codeloom.sources.pycode import python_symbols
from codeloom.streaming import live

PY = '''import os

class A(Base):
    """Doc of A."""
    x = 1

    def m(self, a: int = (1), *b) -> dict:
        """  Doc of m. """
        os.path.join(a)
        self.helper()
        return helper(a)

def helper(a):
    def inner():
        deep()
    "not first, still the first string"
    return helper(inner())

@deco(1)
async def run(
    x,
    y=2,
):
    await go.fetch(x)
'''

JS = """// function no() {}
import x from 'y';
export class Box extends Base {
  constructor(a) { super(a); this.a = a; }
  async load(u) {
    if (u) { fetch(u); }
    return "function fake() {}";
  }
  static get size() { return 1; }
}
export async function main(a, b = {c: 1}) {
  const t = `class Q {}`;
  return helper(a).then(obj.method(b));
}
const arrow = (x) => { return main(x); };
let short = y => trim(y);
const fn = function (z) { return arrow(z) };
const notFn = main(1);
"""


def by_name(rows):
    return {r["name"]: r for r in rows}


def test_python_symbols():
    s = by_name(python_symbols(PY))
    assert [r["name"] for r in python_symbols(PY)] == ["A", "m", "helper", "inner", "run"]
    assert s["A"]["signature"] == "class A" and s["A"]["docstring"] == "Doc of A." and s["A"]["calls"] == []
    assert s["m"]["signature"] == "def m(self, a: int = (1), *b) -> dict" and s["m"]["docstring"] == "Doc of m." and s["m"]["calls"] == ["helper", "join"]
    assert s["helper"]["docstring"].startswith("not first") and s["helper"]["calls"] == ["deep", "helper", "inner"]
    assert s["run"]["type"] == "function" and s["run"]["calls"] == ["fetch"] and s["run"]["line_start"] == 21 or s["run"]["line_start"] == 20
    long = python_symbols(f'def f():\n    """{"x" * 600}"""')[0]
    assert len(long["docstring"]) == 500


def test_python_that_does_not_parse():
    s = by_name(python_symbols("def ok(a):\n    '''Doc.'''\n    return call(a)\n\ndef broken(:\n    x = = 1\nclass C:\n    pass\n"))
    assert {"ok", "broken", "C"} <= set(s) and s["ok"]["calls"] == ["call"] and s["ok"]["docstring"] == "Doc."
    assert by_name(python_symbols("    def m(self):\n        return f(self)\n"))["m"]["calls"] == ["f"]
    assert python_symbols("") == []


def test_js_symbols():
    s = by_name(js_symbols(JS))
    assert set(s) == {"Box", "main", "arrow", "short", "fn", "constructor", "load", "size"}
    assert s["main"]["signature"] == "function main(a, b = {c: 1})" and s["main"]["calls"] == ["helper", "method", "then"]
    assert s["arrow"]["signature"] == "const arrow = arrow_function(x)" and s["arrow"]["calls"] == ["main"] and s["fn"]["calls"] == ["arrow"]
    assert s["load"]["calls"] == [] and s["load"]["signature"] == "load(u)" and s["Box"]["type"] == "class"
    assert s["Box"]["line_start"] == 3 and s["Box"]["line_end"] == 10
    assert js_symbols("") == [] and js_symbols("function (") == []


@pytest.fixture
def tree(tmp_path):
    for name, text in {"pkg/a.py": PY, "pkg/b.py": "def helper(z):\n    return run(z)\n", "web/c.ts": JS, "node_modules/x.py": "def no(): pass", "notes.txt": "x", "d3.js": "function no() {}"}.items():
        p = tmp_path / "t" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path / "t"


def links(i):
    name = {r.id: (r.file, r.name) for r in i.nodes.collect()}
    return {(name[r.src], name[r.dst]) for r in i.edges.collect()}


def test_index_and_increment(spark, tree):
    root = str(tree)
    files = scan.source_files(spark, root)
    assert sorted(r.file for r in files.collect()) == ["pkg/a.py", "pkg/b.py", "web/c.ts"]
    i = ingest.index_tree(spark, root, dim=32)
    r = i.report.first()
    assert (r.files_total, r.files_indexed, r.skipped) == (3, 3, 0)
    assert (("pkg/b.py", "helper"), ("pkg/a.py", "run")) in links(i) and (("pkg/a.py", "m"), ("pkg/b.py", "helper")) in links(i)
    again = ingest.index_tree(spark, root, i, dim=32).report.first()
    assert (again.files_indexed, again.skipped) == (0, 3)
    (tree / "pkg/a.py").write_text(PY.replace("async def run", "async def run2") + "\ndef run():\n    pass\n")
    (tree / "web/c.ts").unlink()
    part = ingest.index_tree(spark, root, i, dim=32)
    whole = ingest.index_tree(spark, root, dim=32)
    key = lambda x: sorted((r.id, r.name, tuple(r.calls)) for r in x.nodes.collect())
    assert part.report.first().files_indexed == 1 and key(part) == key(whole) and links(part) == links(whole)
    assert (("pkg/b.py", "helper"), ("pkg/a.py", "run")) in links(part)  # the link into the changed file survives


def test_engine(spark, tree, tmp_path):
    e = Engine.from_tree(spark, str(tree), dim=64, snapshots=f"file://{tmp_path}/snaps")
    assert e.index_status().first().files_indexed == 3
    assert {r.name for r in e.get_callees("m").collect()} == {"helper"} and e.get_callers("nobody").columns == ["error"]
    assert e.search("helper", 3).count() == 3
    ctx = e.get_context("run the helper").first()
    assert ctx.included > 0 and "helper" in ctx.context
    assert snapshots.read_snapshot(spark, e.snapshots)[0].count() == ctx.included
    assert e.impact_analysis(["helper"]).report.first().blast_radius >= 2
    assert "def helper(a)" in e.get_file_map("pkg/a.py").first().map
    assert e.semantic_audit(threshold=0.0).count() >= 1 and e.get_volatility().columns == ["error"]
    e.save_session(spark.createDataFrame([("s1", "p", "did things", ["t"], dt.datetime(2025, 1, 1), e.vector("did things"))], "id string, project string, summary string, tags array<string>, created_at timestamp_ntz, embedding array<float>"))
    assert "did things" in e.session_memory("things", "p").first().text
    assert set(e.overview()) == {"folders", "files", "folder_edges", "file_edges"} and e.ranks().count() == e.nodes.count()
    (tree / "pkg/b.py").write_text("def other():\n    pass\n")
    assert e.refresh(str(tree)).first().files_indexed == 1


def test_snapshot_ring(spark, tmp_path):
    n = spark.createDataFrame([("a", "n", "function", "f", None, 1)], "id string, name string, type string, file string, signature string, line_start int")
    e = spark.createDataFrame([("a", "a", "CALLS")], "src string, dst string, relation string")
    root = f"file://{tmp_path}/ring"
    assert snapshots.list_snapshots(spark, root) == [] and snapshots.read_snapshot(spark, root) is None
    for i in range(1, 5):
        snapshots.save_snapshot(n, e, spark.createDataFrame([("a", True)], "id string, seed boolean"), root, i, keep=3)
    assert snapshots.list_snapshots(spark, root) == [4, 3, 2]
    nodes, edges = snapshots.read_snapshot(spark, root)
    assert nodes.first().seed and edges.count() == 1


def test_history(spark, tmp_path):
    repo = tmp_path / "g"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    versions = ["def login(user):\n    return user\n", "def login(user):\n    return user\n\ndef logout(user):\n    pass\n", "def login(user, password):\n    validate(password)\n    return user\n\ndef logout(user):\n    pass\n\ndef validate(p):\n    return p\n"]
    for v in versions:
        (repo / "auth.py").write_text(v)
        (repo / "notes.md").write_text(v)
        run("add", "-A")
        run("commit", "-qm", "x")
    log = commits.commit_log(spark, str(repo))
    assert log.count() == 6 and log.where("file = 'auth.py'").count() == 3
    life, edges, report = commits.history(log)
    got = {(r.name, r.type): r for r in life.collect()}
    per = sorted((r.name, r.change_count, r.volatility) for r in life.collect())
    assert per == [("auth.py", 3, 1.0), ("login", 3, 1.0), ("logout", 1, 0.3333), ("logout", 1, 0.3333), ("validate", 1, 0.3333)]
    r = report.first()
    assert (r.commits_processed, r.nodes_tracked, r.edges_tracked) == (3, 5, 1) and got
    (repo / "auth.py").unlink()
    run("add", "-A")
    run("commit", "-qm", "gone")
    log = commits.commit_log(spark, str(repo))
    assert log.where("content is null").count() == 1
    last = {r.name: r.last_commit for r in commits.history(log)[0].collect()}
    assert last["validate"] == log.where("seq = 3").first().sha
    empty = commits.commit_log(spark, str(tmp_path))
    assert empty.count() == 0 and commits.history(empty)[2].first().nodes_tracked == 0


def test_live_graph(spark, tmp_path):
    root, inbox = f"file://{tmp_path}/live", tmp_path / "in"
    inbox.mkdir()
    g = live.LiveGraph(spark, root, rounds=5)
    put = lambda rows: spark.createDataFrame([(f, None if c is None else c.encode(), dt.datetime(2025, 1, 1, h)) for f, c, h in rows], live.EVENTS).coalesce(1).write.mode("append").parquet(f"file://{inbox}")

    def step(rows):
        put(rows)
        q = g.start(live.watch(spark, f"file://{inbox}"), f"file://{tmp_path}/ck", once=True)
        q.awaitTermination()

    step([("a.py", "def f():\n    g()\n", 1), ("a.py", "def f():\n    g()\n\ndef g():\n    pass\n", 2), ("b.txt", "x", 1)])
    assert {r.name for r in g.symbols().collect()} == {"a.py", "f", "g"} and len(g.deltas().first().added) == 3
    assert g.scores().count() == 3  # the file row too, though it has no links
    step([("a.py", "def f():\n    g()\n", 3), ("c.py", "def h():\n    f()\n", 3)])
    d = {r.file: r for r in g.deltas().orderBy("ts").collect()}
    assert len(d["a.py"].removed) == 1 and len(d["a.py"].changed) == 2 and len(d["c.py"].added) == 2
    step([("a.py", None, 4)])
    assert {r.name for r in g.symbols().collect()} == {"c.py", "h"}
    before = g.deltas().count()
    g.apply(spark.createDataFrame([("c.py", b"", dt.datetime(2025, 1, 2))], live.EVENTS), 0)  # delivered again
    assert g.deltas().count() == before and {r.name for r in g.symbols().collect()} == {"c.py", "h"}


def test_embedding(spark):
    df = spark.createDataFrame([("a", "load user table"), ("b", None), ("c", "loadUserTable")], "id string, text string")
    got = {r.id: r.embedding for r in ingest.embed(df, "text", 16).collect()}
    assert len(got["a"]) == 16 and got["a"] == got["c"] and not any(got["b"])
    import numpy as np

    own = ingest.embed(df, "text", 2, "v", lambda texts: np.array([[len(t), 1] for t in texts]))
    assert {tuple(r.v) for r in own.collect()} == {(15.0, 1.0), (0.0, 1.0), (13.0, 1.0)}


def test_command_line(spark, tree, tmp_path, monkeypatch):
    from codeloom.__main__ import parser, run

    go = lambda *a, repo="one": run(spark, parser().parse_args(["--store", f"file://{tmp_path}/store", "--dim", "32", "--repo", repo, *a]))
    assert go("init", str(tree)).first().files_indexed == 3
    assert go("init", str(tree)).first().files_indexed == 0
    assert go("init", str(tree / "pkg"), repo="two").first().files_indexed == 2
    assert go("status").first().files_indexed == 3 and go("callees", "m").count() >= 1 and go("map", "pkg/b.py").count() == 1
    assert go("search", "helper").count() > 0 and go("query", "helper").first().included > 0 and go("impact", "helper").first().blast_radius > 0
    assert go("federate").count() == 2 and {r.repo for r in go("trace", "helper").collect()} == {"one", "two"}
    assert go("volatility").columns == ["error"] and go("timeline", str(tmp_path)).first().nodes_tracked == 0
    (tmp_path / "d").write_text("+def helper(x):\n")
    assert go("diff", str(tmp_path / "d")).first().changed >= 1 and go("audit").columns[0] == "node_id"
    monkeypatch.setattr("sys.stdin", io.StringIO("+def helper(x):\n"))
    assert go("diff", "-").first().changed >= 1 and go("status").first().db_size_kb > 0
    first = go("remember", "fixed the helper").first().id
    go("remember", "wrote the readme")
    assert go("sessions").count() == 2 and go("session", first[:6]).first().summary == "fixed the helper" and go("sessions", repo="two").count() == 0
    assert "helper" in go("recall", "helper").first().text


def test_catalog(spark, tmp_path):
    from codeloom.sources.catalog import Catalog

    c = Catalog(spark, f"file://{tmp_path}/c")
    assert c.read("edges").count() == 0 and not c.has("edges")
    row = spark.createDataFrame([("a", "b", "CALLS")], "src string, dst string, relation string")
    c.write("edges", row, "x")
    c.write("edges", row.union(row), "y")
    c.write("edges", c.read("edges").where("repo_id = 'y'").limit(1), "y")
    assert sorted((r.repo_id, r.src) for r in c.read("edges").collect()) == [("x", "a"), ("y", "a")]
    c.write("nodes", spark.createDataFrame([("i", "f")], "id string, name string"))  # an older schema
    assert c.read("nodes").first().embedding is None


def test_live_graph_compacts(spark, tmp_path):
    """Compaction changes nothing that is seen, tombstones stay gone, and later batches go on from it."""
    g = live.LiveGraph(spark, f"file://{tmp_path}/live", score=False, compact_every=2)
    event = lambda f, c, h: spark.createDataFrame([(f, None if c is None else c.encode(), dt.datetime(2025, 1, 1, h))], live.EVENTS)
    steps = [("a.py", "def f():\n    pass\n"), ("b.py", "def g():\n    pass\n"), ("a.py", None), ("b.py", "def h():\n    pass\n"), ("c.py", "def k():\n    pass\n")]
    for i, (f, c) in enumerate(steps):
        g.apply(event(f, c, i), i)
    assert {r.name for r in g.symbols().collect()} == {"b.py", "h", "c.py", "k"} and g._numbers("compacted") == [1, 3]
    assert g.stats().first().asDict() == {"batches": 5, "files": 2, "symbols": 4, "added": 7, "removed": 3, "changed": 1}
    assert {r.name for r in g.symbols(spark.createDataFrame([("b.py",)], "file string")).collect()} == {"b.py", "h"}


def test_scores_around_a_change_need_no_other_links(spark):
    """PageRank around a change is the same on the links found by name as on all links."""
    from codeloom.operators.graph import local_pagerank, symmetrize

    code = "".join(f"def f{i}():\n    f{(i * 7 + 1) % 40}()\n    f{(i * 3 + 2) % 40}()\n\n" for i in range(40))
    files = spark.createDataFrame([("a.py", code), ("b.py", "def z():\n    f3()\n\ndef f3():\n    y()\n"), ("c.py", "def y():\n    pass\n\ndef far():\n    pass\n")], "file string, content string")
    n = ingest.parse_files(files)
    changed = n.where("name = 'z'").select("id")
    want = {r.id: r.score for r in local_pagerank(symmetrize(n, ingest.call_edges(n)), changed, 2).collect()}
    some = live.around(n, changed, 2)
    got = {r.id: r.score for r in local_pagerank(symmetrize(some, ingest.call_edges(some)), changed, 2).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) < n.count()


def test_file_states_go_on_after_a_restart(spark, tmp_path):
    from codeloom.streaming.windows import file_states, read_stream

    log = lambda rows, n: spark.createDataFrame([(f, h, dt.datetime(2025, 1, d), dt.datetime(2025, 1, d)) for f, h, d in rows], "file string, hash string, indexed_at timestamp_ntz, landed_at timestamp_ntz").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/t/file_hashes.parquet")
    state = lambda: sorted((r.file, r.hash) for r in file_states(read_stream(spark, f"file://{tmp_path}/t", "file_hashes"), f"file://{tmp_path}/s").collect())
    log([("a", "1", 1), ("b", "1", 1)], 0)
    assert state() == [("a", "1"), ("b", "1")]
    log([("a", "2", 3), ("b", "0", 0 + 1), ("c", "1", 2)], 1)
    assert state() == [("a", "2"), ("b", "1"), ("c", "1")] and state() == [("a", "2"), ("b", "1"), ("c", "1")]
