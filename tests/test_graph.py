"""Golden values for impact, drift, PageRank, look-ups, history, federation and memory on small made graphs."""

import datetime as dt
import math

import pytest
from codeloom.functions import scalar, vectors
from codeloom.operators import context, drift, federation, graph, impact, lookup, memory, resolve, rollup, store, temporal
from pyspark.sql import functions as F

NODE = "id string, type string, name string, file string, signature string, docstring string, line_start int, line_end int, calls array<string>, ordinal int, repo_id string, embedding array<float>"
EDGE = "src string, dst string, relation string"
VALUES = lambda df, *cols: sorted(tuple(r[c] for c in cols) for r in df.collect())


def node(i, name=None, file="payments.py", kind="function", line=1, calls=None, ordinal=0, repo="r", emb=None, sig=None, doc=None):
    return (i, kind, name or i, file, sig, doc, line, line + 5, calls, ordinal, repo, emb)


@pytest.fixture(scope="module")
def chain(spark):
    names = ["test_handler", "process_payment", "validate_card", "charge_card"]
    n = spark.createDataFrame([node(x, line=1 + 10 * i) for i, x in enumerate(names)], NODE)
    e = spark.createDataFrame([(a, b, "CALLS") for a, b in zip(names, names[1:])], EDGE)
    return n, e


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id string")


def test_impact_chain(spark, chain):
    n, e = chain
    both = impact.blast_radius(n, e, ids(spark, "validate_card"))
    assert {r.id for r in both.affected.collect()} == {"process_payment", "test_handler", "charge_card"}
    r = both.report.first()
    assert (r.blast_radius, r.risk_score, r.untested) == (3, 33, 2) and "MEDIUM" in r.summary
    up = impact.blast_radius(n, e, ids(spark, "validate_card"), direction="callers").report.first()
    assert (up.blast_radius, up.risk_score) == (2, 26)
    text = impact.impact_text(both).first().text
    assert "Blast radius   : 3" in text and "[x] test_handler" in text


def test_impact_empty_and_unknown(spark, chain):
    n, e = chain
    r = impact.blast_radius(n, e, ids(spark)).report.first()
    assert (r.blast_radius, r.risk_score, r.changed) == (0, 0, 0)
    r = impact.blast_radius(n, e, ids(spark, "nobody")).report.first()
    assert (r.blast_radius, r.risk_score, r.affected) == (1, 0, 0)
    r = impact.blast_radius(n, e.limit(0), ids(spark, "charge_card")).report.first()
    assert (r.blast_radius, r.affected) == (1, 1)


def test_impact_of_diff(spark, chain):
    n, e = chain
    diff = spark.createDataFrame([("+++ b\n+def validate_card(x):\n def charge_card():\n+class  Other:\n+    async def no(): pass",)], "text string")
    assert VALUES(resolve.diff_names(diff), "name") == [("Other",), ("validate_card",)]
    assert impact.from_diff(n, e, diff).report.first().blast_radius == 3


def test_risk_of_a_star(spark):
    n = spark.createDataFrame([node("root", file="a.py"), *[node(f"n{i}", file="a.py") for i in range(60)]], NODE)
    e = spark.createDataFrame([("root", f"n{i}", "CALLS") for i in range(60)], EDGE)
    assert impact.blast_radius(n, e, ids(spark, "root")).report.first().risk_score == 100


@pytest.mark.parametrize("file,name,want", [("/p/tests/test_auth.py", "something", True), ("/p/auth.py", "login", False), ("/p/auth.py", "test_login", True), ("/p/auth.py", "TestLogin", True), (None, None, False), ("contest.py", "x", True)])
def test_coverage(spark, file, name, want):
    assert spark.createDataFrame([(file, name)], "f string, n string").select(scalar.has_test("f", "n")).first()[0] is want


def python_pagerank(vertices, links, p, alpha=0.85, tol=1e-6, rounds=100):
    n = len(vertices)
    x = {v: 1 / n for v in vertices}
    out = {v: [d for s, d in links if s == v] for v in vertices}
    for _ in range(rounds):
        last, x = x, {v: 0.0 for v in vertices}
        lost = alpha * sum(last[v] for v in vertices if not out[v])
        for v in vertices:
            for d in out[v]:
                x[d] += alpha * last[v] / len(out[v])
            x[v] += lost * p.get(v, 0) + (1 - alpha) * p.get(v, 0)
        if sum(abs(x[v] - last[v]) for v in vertices) < n * tol:
            break
    return x


def test_pagerank(spark):
    v = ["a", "b", "c", "d", "lone"]
    links = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "c")]
    vd, ld = ids(spark, *v), spark.createDataFrame(links, "src string, dst string")
    for seeds in ({"a": 1.0}, {"a": 0.5, "lone": 0.5}):
        p = spark.createDataFrame([*seeds.items(), ("missing", 3.0)], "id string, p double")
        got = {r.id: r.score for r in graph.pagerank(vd, ld, p).collect()}
        want = python_pagerank(v, links, seeds)
        assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in v) and sum(got.values()) == pytest.approx(1)
    got = {r.id: r.score for r in graph.pagerank(ids(spark, "a", "b", "c"), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")).collect()}
    assert all(x == pytest.approx(1 / 3) for x in got.values())
    assert graph.pagerank(vd, ld, spark.createDataFrame([("missing", 1.0)], "id string, p double")).count() == 0
    assert graph.pagerank(vd.limit(0), ld).count() == 0


def test_local_pagerank(spark):
    cycle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "b"), ("a", "c")], "src string, dst string")
    got = {r.id: r.score for r in graph.local_pagerank(cycle, ids(spark, "a"), 2).collect()}
    assert set(got) == {"a", "b", "c"} and all(x == pytest.approx(1 / 3) for x in got.values())
    assert graph.local_pagerank(cycle, ids(spark, "zz"), 2).count() == 0


def test_bfs_is_shortest(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a"), ("x", "y")], "src string, dst string")
    assert VALUES(graph.bfs(links, ids(spark, "a"), 10), "id", "hop") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert VALUES(graph.bfs(links, ids(spark, "a"), 1), "id", "hop") == [("a", 0), ("b", 1), ("c", 1)]


@pytest.mark.parametrize("own,callees,score", [([1, 0], [[0, 1], [0, 1]], 1.0), ([1, 0], [[1, 0], [1, 0]], None), ([1, 0], [[1, 0], [0, 1]], None), ([1, 0], [[0, 1]], None)])
def test_drift(spark, own, callees, score):
    n = spark.createDataFrame([node("f", emb=[float(x) for x in own]), *[node(f"c{i}", emb=[float(x) for x in c]) for i, c in enumerate(callees)]], NODE)
    e = spark.createDataFrame([("f", f"c{i}", "CALLS") for i in range(len(callees))], EDGE)
    got = drift.drift(n, e, dim=2).collect()
    assert [r.drift_score for r in got] == ([] if score is None else [score])
    low = drift.drift(n, e, dim=2, threshold=-1.0).collect()
    if callees == [[1, 0], [0, 1]]:
        assert low[0].drift_score == pytest.approx(1 - 1 / math.sqrt(2), abs=1e-4)
    if score:
        text = drift.drift_report(n, e, dim=2).first()
        assert "severe, score=1.00" in text.explanation and "has no docstring" in text.explanation and text.actual_callees == "c0, c1"


def test_resolution(spark):
    n = spark.createDataFrame(
        [
            node("f1", "f", "a.py", calls=["g", "f", "h", "g", None], ordinal=1), node("g1", "g", "a.py", ordinal=2), node("g2", "g", "a.py", ordinal=3), node("g3", "g", "b.py"), node("h1", "h", "c.py"), node("h2", "h", "d.py"),
            node("x", "a.py", "a.py", kind="file"), node("f2", "f", "b.py", calls=None),
        ],
        NODE,
    )
    assert VALUES(resolve.resolve_intra(n), "src", "dst") == [("f1", "g2")]
    assert VALUES(resolve.resolve_cross(n), "src", "dst") == [("f1", "f2"), ("f1", "g3"), ("f1", "h1"), ("f1", "h2")]


def test_budget(spark):
    d = spark.createDataFrame([(i, 10) for i in range(6)], "i int, tokens int")
    order = [F.col("i")]
    assert context.within_budget(d, 30, None, order).count() == 3 and context.within_budget(d, 9, None, order).count() == 0
    assert VALUES(context.within_budget(d, 35, None, order, range_of=F.floor(F.col("i") / 2)), "i", "total") == [(0, 10), (1, 20), (2, 30)]


def test_context(spark):
    emb = lambda k: [1.0 if i == k else 0.0 for i in range(4)]
    n = spark.createDataFrame([node("s", emb=emb(0), doc="d" * 201), node("t", emb=emb(1), sig="def t()"), node("u"), node("w", kind="file", emb=emb(0))], NODE)
    e = spark.createDataFrame([("s", "u", "CALLS")], EDGE)
    q = spark.createDataFrame([("q", [float(x) for x in emb(0)])], "id string, embedding array<float>")
    rows, report = context.get_context(n, e, q, semantic_k=2, dim=4)
    got = [r.id for r in rows.orderBy("place").collect()]
    assert got[0] == "s" and "w" not in got and set(got) <= {"s", "t", "u"} and "u" in got
    r = report.first()
    assert r.included == len(got) and r.nodes == len(got) + 1 and r.context.startswith("# context") and "d" * 200 + "..." in r.context
    _, empty = context.get_context(n.limit(0), e, q, dim=4)
    assert empty.first().included == 0


def test_top_k_ties(spark):
    e = spark.createDataFrame([(i, [1.0, 0.0] if i < 8 else [0.0, 1.0]) for i in range(10)] + [(99, None), (98, [0.0, 0.0])], "id int, embedding array<float>")
    got = vectors.top_k(e.where("id = 3"), e, 3, dim=2, block=3)
    assert [(r.id, r.rank) for r in got.orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_timeline(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    seen = [("login", 1), ("login", 2), ("logout4", 2), ("login", 3), ("logout5", 3), ("validate", 3), ("file", 1), ("file", 2), ("file", 3)]
    s = spark.createDataFrame([(n, n, "auth.py", "function", q, t(q), f"c{q}") for n, q in seen], "node_id string, name string, file string, type string, seq int, ts timestamp_ntz, sha string")
    touches = spark.createDataFrame([("auth.py", q, t(q), f"c{q}") for q in (1, 2, 3)], "file string, seq int, ts timestamp_ntz, sha string")
    got = {r.node_id: r for r in temporal.timeline(s, touches).collect()}
    assert len(got) == 5 and (got["login"].change_count, got["login"].volatility) == (3, 1.0)
    assert all((got[x].change_count, got[x].volatility) == (1, 0.3333) for x in ("logout4", "logout5", "validate"))
    assert got["logout4"].last_seen_ts == t(3) and got["logout4"].last_commit == "c3" and got["logout5"].last_commit == "c3"
    assert VALUES(temporal.snapshot_changes(s, touches), "seq", "appeared", "kept", "gone") == [(1, 2, 0, 0), (2, 1, 2, 0), (3, 2, 2, 1)]


def test_coupling_band(spark):
    at = lambda s: dt.datetime(2025, 1, 1, 23) + dt.timedelta(seconds=s)
    n = spark.createDataFrame([("a", at(0)), ("b", at(86_399)), ("c", at(86_400)), ("d", at(-4 * 3600)), ("a", at(0)), ("b", None), (None, at(0))], "file string, last_seen_ts timestamp_ntz")
    got = {(r.file_a, r.file_b): r.cochange_count for r in temporal.coupling_pairs(n, at_least=1).collect()}
    assert got == {("a", "b"): 2, ("b", "c"): 1, ("a", "d"): 2}


@pytest.mark.parametrize("name,file,want", [("get_user", "api/routes.py", ["ENDPOINT", "NAME_MATCH"]), ("authenticate", "auth/__init__.py", ["EXPORT", "NAME_MATCH"]), ("process_payment", "payments/handler.py", ["ENDPOINT", "NAME_MATCH"]), ("_internal_helper", "utils.py", [])])
def test_link_types(spark, name, file, want):
    row = spark.createDataFrame([("function", name, file, None)], "t string, n string, f string, s string").select(scalar.link_types("t", "n", "f", "s").alias("x")).first()
    assert [x.link_type for x in row.x] == want


def test_federation(spark):
    n = spark.createDataFrame([node("1", "validate_token", "a/__init__.py", repo="ra"), node("2", "validate_token", "b/__init__.py", repo="rb"), node("3", "entry", "a/x.py", repo="ra"), node("4", "lost", "c.py", repo=None)], NODE)
    b = federation.boundary_nodes(n)
    x = federation.cross_edges(b)
    assert VALUES(x, "src_repo", "dst_repo", "link_type", "confidence") == [("ra", "rb", "NAME_MATCH", 0.75), ("rb", "ra", "NAME_MATCH", 0.75)]
    assert VALUES(federation.cross_counts(b), "src_repo", "dst_repo", "links") == [("ra", "rb", 1), ("rb", "ra", 1)]
    e = spark.createDataFrame([("3", "1", "CALLS")], EDGE)
    got = federation.trace(n, federation.federated_links(n, e, x), ids(spark, "3"))
    assert VALUES(got, "hop", "repo", "node_id") == [(0, "ra", "3"), (1, "ra", "1"), (2, "rb", "2")]
    assert federation.boundary_nodes(n, "all").where("link_type = 'EXPORT'").count() == 2


def test_recall(spark):
    t = lambda i: dt.datetime(2025, 1, 1) + dt.timedelta(hours=i)
    rows = [(f"s{i:02d}", "p", f"sum {i}", t(i), [float(i == 0), 1.0]) for i in range(51)] + [("n1", "q", "x", t(1), None), ("n2", "q", "y", t(2), None)]
    s = spark.createDataFrame(rows, "id string, project string, summary string, created_at timestamp_ntz, embedding array<float>")
    q = spark.createDataFrame([("p", [1.0, 0.1]), ("q", [1.0, 0.0])], "project string, query array<float>")
    got = memory.recall(s, q, k=2, dim=2)
    assert "s00" not in {r.id for r in got.collect()}  # the 51st newest is never recalled
    assert [r.id for r in got.where("project = 'q'").orderBy("recall_rank").collect()] == ["n2", "n1"]
    text = memory.for_injection(memory.newest(s, 1)).where("project = 'q'").first().text
    assert text == "# Prior session memory\n\n## Session n2 (2025-01-01)\ny"


def test_store(spark):
    h = spark.createDataFrame([("a.py", "1"), ("b.py", "2")], "file string, hash string")
    f = spark.createDataFrame([("a.py", "1"), ("b.py", "3"), ("c.py", "4")], "file string, hash string")
    assert VALUES(store.unchanged(f, h), "file") == [("b.py",), ("c.py",)]
    n, e = spark.createDataFrame([node("1", file="a.py"), node("2", file="b.py")], NODE), spark.createDataFrame([("1", "2", "CALLS"), ("2", "2", "CALLS")], EDGE)
    left = store.delete_files(n, e, h, spark.createDataFrame([("a.py",)], "file string"))
    assert [x.count() for x in left] == [1, 1, 1]
    old = spark.createDataFrame([("f", "a", 1), ("f", "b", None), ("f", "c", 3)], "file string, id string, state int")
    new = spark.createDataFrame([("f", "b", None), ("f", "c", 4), ("f", "d", 1)], "file string, id string, state int")
    assert VALUES(store.delta_sets(old, new), "file", "added", "removed", "changed") == [("f", 1, 1, 1)]
    assert VALUES(store.upsert(old, new, "id", "state"), "id", "state") == [("a", 1), ("b", None), ("c", 4), ("d", 1)]


def test_lookups(spark):
    n = spark.createDataFrame([node("1", "f", "b.py", sig="def f()"), node("2", "f", "a.py", line=9, doc="x" * 120), node("3", "g", "a.py", line=2), node("4", "a.py", "a.py", kind="file")], NODE)
    e = spark.createDataFrame([("3", "2", "CALLS"), ("3", "1", "CALLS")], EDGE)
    assert VALUES(lookup.callers_by_name(n, e), "of", "name") == [("f", "g")]
    m = {r.file: r.map for r in lookup.file_maps(n).collect()}
    assert m["a.py"] == "# Symbol map: a.py\n\nL2  function g\nL9  function f\n      # " + "x" * 100 and m["b.py"].endswith("L1  def f()")
    assert VALUES(lookup.file_like(n, "A.P", 2), "id") == [("2",), ("3",)]
    assert VALUES(rollup.folders(n, ""), "folder", "files", "symbols") == [("(root)", 2, 4)]
    assert VALUES(rollup.folders(n.withColumn("file", F.concat(F.lit("/r/x/"), "file")), "/r"), "folder") == [("x",)]


def test_sql_functions(spark):
    scalar.register(spark)
    r = spark.sql("SELECT token_estimate('abcdefghi') a, token_estimate(null) b, file_stem('/x/y.test.js') c, vector_dot(array(1D, 2D), array(3D, 4D)) d, link_confidence('NAME_MATCH', 'a/x.py', 'b/x.py') e, has_test('a/b.py', 'test_x') f, symbol_id('a', 'b', 'c', 1) g, file_stem('.bashrc') h").first()
    import hashlib

    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.h) == (2, 0, "y.test", 11.0, 0.75, True, ".bashrc") and r.g == hashlib.sha256(b"a::b::c::1").hexdigest()[:16]
