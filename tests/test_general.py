"""Containment, change capture and orphans on small made tables: nulls, ties, repeats, circles, empty tables, clashing columns."""

import datetime as dt

import pytest
from codeloom.operators import changes, containment, orphans
from pyspark.sql import functions as F

T = lambda d, h=0: dt.datetime(2025, 1, d, h)
EDGE = "src string, dst string, relation string, landed_at timestamp_ntz, id string, depth string"


def edges(spark, rows):
    return spark.createDataFrame([(*r, T(1), "clash", "clash") for r in rows], EDGE)


def test_hierarchy(spark):
    deep = [(f"n{i}", f"n{i + 1}", "DEFINES") for i in range(40)]
    rows = [
        *deep, (" N40 ", "leaf", " defines "), ("n40", "leaf", "DEFINES"), ("a", "b", "DEFINES"), ("b", "c", "DEFINES"), ("c", "a", "DEFINES"),
        ("c", "below", "DEFINES"), ("below", "lower", "DEFINES"), ("self", "self", "DEFINES"), ("self", "kid", "DEFINES"), (None, "x", "DEFINES"), (" ", "x", "DEFINES"),
        ("n0", "caller", "CALLS"), ("p", "q", None),
    ]
    got = {r.id: (r.root, r.depth) for r in containment.hierarchy(edges(spark, rows)).collect()}
    assert got["n0"] == ("n0", 0) and got["n40"] == ("n0", 40) and got["leaf"] == ("n0", 41)
    assert got["a"] == got["b"] == got["c"] == got["below"] == got["lower"] == ("a", -1)
    assert got["self"] == got["kid"] == ("self", -1)
    assert "x" not in got and "caller" not in got and "q" not in got and len(got) == 42 + 5 + 2
    path = {r.id: r.path for r in containment.paths(edges(spark, rows)).collect()}
    assert path["n2"] == "n0/n1/n2" and path["a"] is None and path["n0"] == "n0"
    down = containment.descendants(edges(spark, rows))
    assert down.where("id = 'n0'").count() == 41 and down.where("id = 'a'").count() == 0
    assert down.where("id = 'n1' and descendant = 'leaf'").first().distance == 40


def test_hierarchy_only_circles_and_two_parents(spark):
    got = {r.id: (r.root, r.depth) for r in containment.hierarchy(edges(spark, [("z", "y", "DEFINES"), ("y", "z", "DEFINES")])).collect()}
    assert got == {"y": ("y", -1), "z": ("y", -1)}
    two = {r.id: r.root for r in containment.hierarchy(edges(spark, [("m", "k", "DEFINES"), ("b", "k", "DEFINES")])).collect()}
    assert two["k"] == "b"


def test_descendants_on_and_below_circles(spark):
    rows = [
        ("b", "c", "DEFINES"), ("c", "a", "DEFINES"), ("a", "b", "DEFINES"), ("c", "x", "DEFINES"), ("x", "y", "DEFINES"), ("y", "z", "DEFINES"), ("x", "w", "DEFINES"),
        ("self", "self", "DEFINES"), ("self", "kid", "DEFINES"), ("kid", "baby", "DEFINES"), ("top", "leaf", "DEFINES"),
    ]
    want = {("top", "leaf", 1), ("self", "kid", 1), ("self", "baby", 2), ("kid", "baby", 1), ("x", "y", 1), ("x", "z", 2), ("y", "z", 1), ("x", "w", 1)}
    for i, n in enumerate("abc"):
        want |= {(n, "abc"[(i + k) % 3], k) for k in (1, 2)} | {(n, d, 2 - i + k) for d, k in (("x", 1), ("y", 2), ("w", 2), ("z", 3))}
    got = [tuple(r) for r in containment.all_descendants(edges(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert containment.all_descendants(edges(spark, rows[-1:])).count() == 1
    assert containment.all_descendants(edges(spark, [("a", "b", "CALLS")])).count() == 0


def test_hierarchy_empty(spark):
    e = edges(spark, [("a", "b", "CALLS")])
    assert containment.hierarchy(e).count() == 0 and containment.paths(e).count() == 0 and containment.descendants(e).count() == 0


NODE = "id string, indexed_at timestamp_ntz, removed_at timestamp_ntz, landed_at timestamp_ntz, key string"


def test_orphans(spark):
    e = spark.createDataFrame(
        [
            ("ok", "gone", "CALLS", T(5)), ("ok", "gone", " calls ", T(4)), ("ok", "never", "CALLS", T(5)), ("ok", "late", "CALLS", T(5)), ("late", "shared", "IMPORTS", T(9)),
            ("OK ", "back", "CALLS", T(6)), ("ok", None, "CALLS", T(6)), ("", "ok", "CALLS", T(6)), ("nul", "ok", None, None), ("undated", "ok", "CALLS", T(6)),
        ],
        "src string, dst string, relation string, landed_at timestamp_ntz",
    )
    n = spark.createDataFrame(
        [
            ("ok", T(1), None, T(1), "x"), ("gone", T(1), None, T(1), "x"), ("gone", T(3), T(3), T(3), "x"), ("late", T(1), None, T(7), "x"), ("late", T(1), None, T(8), "x"),
            ("back", T(1), T(1), T(1), "x"), ("back", T(2), None, T(2), "x"), ("nul", None, None, T(1), "x"), (None, T(1), None, T(1), "x"), ("undated", T(1), None, None, "x"),
        ],
        NODE,
    )
    b = spark.createDataFrame([("Shared", "k"), (None, "k")], "node_id string, key string")
    got = {(r.src, r.dst, r.side, r.reason) for r in orphans.orphan_references(e, n, b).collect()}
    assert got == {("ok", "gone", "dst", "removed"), ("ok", "never", "dst", "missing"), ("ok", "late", "dst", "late"), ("undated", "ok", "src", "late")}
    report = {(r.relation, r.reason, r.month): r.orphans for r in orphans.orphan_report(e, n, b).collect()}
    assert report[("CALLS", "removed", "2025-01")] == 1
    assert orphans.orphan_references(e.limit(0), n, b).count() == 0
    assert orphans.orphan_references(e, n.limit(0), b.limit(0)).where("side = 'dst'").count() == 7  # each distinct edge


RUN = "run_id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string"
LOG = "file string, hash string, indexed_at timestamp_ntz, landed_at timestamp_ntz, seq int"


def log_of(spark, rows):
    return changes.file_log(spark.createDataFrame([(*r, 0) for r in rows], LOG))


def test_changes_by_run(spark):
    runs = spark.createDataFrame(
        [(1, T(2), None, "started"), (1, T(2), T(2), " Succeeded "), (2, T(4), None, "failed"), (3, T(6), None, "SUCCEEDED"), (4, T(8), None, None), (5, T(20), None, "succeeded"), (5, T(20), None, "succeeded"), (None, T(3), None, "succeeded")],
        RUN,
    )
    rows = [
        ("a", "h1", T(1), T(1)), ("a", " H1", T(1, 1), T(3)), ("b", "h1", T(1), T(1)), ("b", "h2", T(3), T(3)), ("b", "h1", T(2), T(15)), ("c", None, T(1), T(1)),
        ("d", "x", T(1), T(5)), ("d", None, T(9), T(9)), ("d", None, T(9), T(9)), ("e", "x", T(1), T(25)), (None, "x", T(1), T(1)), ("f", "x", T(1), None), ("g", "x", T(1), T(2)), ("h", "x", None, T(1)),
    ]
    got = sorted((r.run_id, r.rec) for r in changes.changes_by_run(runs, {"file_hashes": log_of(spark, rows)}).collect())
    assert got == [(1, "a"), (1, "b"), (1, "g"), (1, "h"), (3, "b"), (3, "d"), (5, "d")]
    assert changes.changes_by_run(runs.where("run_id = 2"), {"f": log_of(spark, rows)}).count() == 0
    assert changes.changes_by_run(runs, {"f": log_of(spark, rows).limit(0)}).count() == 0


def test_changes_against_brute_force(spark):
    import random

    rng = random.Random(3)
    runs = [(i, T(1 + 2 * i, i), "succeeded" if rng.random() < 0.7 else "failed") for i in range(12)]
    rows = [(f"f{rng.randrange(6)}", rng.choice(["x", "y", None]), T(rng.randrange(1, 28), rng.randrange(24)), T(rng.randrange(1, 28), rng.randrange(24))) for _ in range(150)]
    want, before = set(), {}
    for i, at, status in runs:
        if status != "succeeded":
            continue
        now = {}
        for f, h, v, landed in rows:
            if landed <= at and (f not in now or (v, landed, h or "") > now[f][0]):
                now[f] = ((v, landed, h or ""), h)
        for f in {r[0] for r in rows}:
            a, b = now.get(f, (0, None))[1], before.get(f)
            if a != b:
                want.add((i, f))
            before[f] = a
    df = spark.createDataFrame([(i, at, None, s) for i, at, s in runs], RUN)
    got = {(r.run_id, r.rec) for r in changes.changes_by_run(df, {"f": log_of(spark, rows)}).collect()}
    assert got == want


def test_capture_survives_failures(spark, tmp_path):
    rows = [("a", "1", T(1), T(1)), ("b", "1", T(1), T(1)), ("b", "1", T(1), T(1))]
    c = changes.ChangeCapture(spark, f"file://{tmp_path}/c")
    with pytest.raises(RuntimeError):
        c.run({"f": log_of(spark, rows)}, lambda df: (_ for _ in ()).throw(RuntimeError("lost")))
    more = [*rows, ("a", "2", T(2), T(2))]
    plan = c.run({"f": log_of(spark, more)})  # the failed batch again, with its own offsets
    assert plan.batch == 1 and sorted(r.key for r in c.taken().collect()) == ["a", "b"]
    assert c.run({"f": log_of(spark, more)}).batch == 2
    assert c.run({"f": log_of(spark, more)}).batch == 3  # nothing new: an empty batch
    got = sorted((r.key, r.state) for r in c.taken().collect())
    assert got == [("a", "1"), ("a", "2"), ("b", "1")]


def test_capture_hands_on_what_differs(spark, tmp_path):
    c = changes.ChangeCapture(spark, f"file://{tmp_path}/c")
    rows, got = [("a", "1", T(1), T(1)), ("b", "1", T(1), T(1)), ("n", None, T(1), T(1))], []

    def run(*more):
        rows.extend(more)
        got.clear()
        c.run({"f": log_of(spark, rows)}, lambda df: got.extend((r.key, r.state) for r in df.collect()))
        return sorted(got)

    assert run() == [("a", "1"), ("b", "1")]
    assert run(("a", "1", T(1), T(2))) == []  # delivered again
    assert run(("b", "2", T(5), T(5)), ("z", "1", T(5), T(5))) == [("b", "2"), ("z", "1")]
    assert run(("b", "3", T(4), T(6))) == []  # late, behind a newer version
    assert run(("a", "1", T(6), T(7))) == []  # newer, the same state
    assert run(("a", "4", T(5), T(8))) == []  # behind that
    assert run(("y", "1", T(8), T(8))) == [("y", "1")]  # landed at the planned high, after the plan
    assert run(("y", None, T(9), T(9))) == [("y", None)]


def test_capture_plans_for_each_partition(spark, tmp_path):
    c = changes.ChangeCapture(spark, f"file://{tmp_path}/c")
    part = F.when(F.col("key").startswith("s"), "slow")
    run = lambda rows: c.run({"f": log_of(spark, rows).withColumn("part", part)})
    rows = [("a", "1", T(9), T(9)), ("s1", "1", T(1), T(1))]
    assert run(rows).high == {"f": {"": 9 * 86_400_000_000 + 1735603200_000_000, "slow": 1735689600_000_000}}
    run([*rows, ("s2", "1", T(2), T(2))])  # lags behind the other partition
    assert sorted(r.key for r in c.taken().collect()) == ["a", "s1", "s2"]


def test_capture_equals_the_history(spark, tmp_path):
    import random

    rng = random.Random(5)
    rows = [(f"f{rng.randrange(5)}", rng.choice(["x", "y", None]), T(rng.randrange(1, 20)), T(rng.randrange(1, 20))) for _ in range(60)]
    ends, c = (6, 12, 20), changes.ChangeCapture(spark, f"file://{tmp_path}/c")
    for d in ends:
        c.run({"f": log_of(spark, [r for r in rows if r[3] <= T(d)])})
    df = spark.createDataFrame([(d, T(d), None, "succeeded") for d in ends], RUN)
    want = sorted((r.run_id, r.rec) for r in changes.changes_by_run(df, {"f": log_of(spark, rows)}).collect())
    assert sorted((ends[r.batch - 1], r.key) for r in c.taken().collect()) == want


def test_capture_replays_a_history_that_failed(spark, tmp_path):
    """Lost between sink and commit: the plans stand, the second attempt overwrites, and more runs may have been planned meanwhile."""
    rows = [("a", "1", T(1), T(1)), ("a", "2", T(2), T(2)), ("b", "1", T(3), T(3)), ("a", "1", T(4), T(4)), ("b", "2", T(5), T(5))]
    at = lambda d: changes.successful_runs(spark.createDataFrame([(d, T(d), None, "succeeded")], RUN))
    c = changes.ChangeCapture(spark, f"file://{tmp_path}/c")
    logs = {"f": log_of(spark, rows)}
    c.plan_ahead(logs, at(1) + at(2))
    with pytest.raises(RuntimeError):
        c.replay(logs, lambda df: (_ for _ in ()).throw(RuntimeError("lost")))
    assert c.taken().count() == 0 and [p.batch for p in c.pending()] == [1, 2]
    c = changes.ChangeCapture(spark, f"file://{tmp_path}/c")  # the driver was lost as well
    c.plan_ahead(logs, at(3))
    late = {"f": log_of(spark, [*rows, ("c", "1", T(2), T(3))])}  # lands on the last plan's own end, after it was made
    assert [p.run for p in c.replay(late)] == [1, 2, 3]
    got = lambda: sorted((r.run, r.key, r.state) for r in c.taken().collect())
    assert got() == [(1, "a", "1"), (2, "a", "2"), (3, "b", "1"), (3, "c", "1")]
    assert c.replay(late) == [] and c.pending() == []
    c.compact()
    later = {"f": log_of(spark, [*rows, ("c", "1", T(2), T(3)), ("d", "1", T(3), T(3))])}  # again on the end, after the commit
    c.plan_ahead(later, at(5))
    c.replay(later)
    assert got() == [(1, "a", "1"), (2, "a", "2"), (3, "b", "1"), (3, "c", "1"), (5, "a", "1"), (5, "b", "2"), (5, "d", "1")]
    c.compact()
    assert c.run({"f": log_of(spark, [("b", "2", T(6), T(6))])}).batch == 5 and len(got()) == 7


def test_capture_plans_hold_what_each_partition_reached(spark, tmp_path):
    rows = log_of(spark, [("a", "1", T(1), T(1)), ("b", "1", T(1), T(3)), ("s", "1", T(1), T(2))]).withColumn("part", F.when(F.col("key") == "s", "slow"))
    c = changes.ChangeCapture(spark, f"file://{tmp_path}/c")
    day = lambda d: 1735603200_000_000 + d * 86_400_000_000
    plans = c.plan_ahead({"f": rows}, [(7, day(1)), (8, day(2)), (9, day(9))])
    assert [p.high["f"] for p in plans] == [{"": day(1)}, {"": day(1), "slow": day(2)}, {"": day(3), "slow": day(2)}]
    assert [p.low["f"] for p in plans] == [{}, {"": day(1)}, {"": day(1), "slow": day(2)}] and c.plans() == plans


def test_skewed_parent(spark):
    hot = spark.range(20_000).select(F.lit("hub").alias("src"), F.concat(F.lit("c"), "id").alias("dst"), F.lit("DEFINES").alias("relation"), F.lit(None).cast("timestamp_ntz").alias("landed_at"))
    got = containment.hierarchy(hot)
    assert got.count() == 20_001 and got.where("depth = 1 and root = 'hub'").count() == 20_000
