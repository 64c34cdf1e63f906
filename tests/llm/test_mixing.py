"""Shares of a mix: exact budgets, caps, hot sources, nulls and ties."""

import pytest
from codeloom.llm import mixing
from pyspark.sql import functions as F

DOC = "doc_id long, text string, source string, tokens string, share string"
TARGET = "source string, target_share double, max_repeats int, size string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOC)


def targets(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TARGET)


def run(spark, d, t, total=None):
    chosen, report = mixing.mix(docs(spark, d), targets(spark, t), total)
    return {r.doc_id: r for r in chosen.collect()}, {r.source: r for r in report.collect()}


def test_shares_are_met(spark):
    d = [(i, "word " * (1 + i % 7), "Big " if i % 2 else "big") for i in range(3_000)] + [(10_000 + i, "word " * 5, "small") for i in range(50)] + [(20_000 + i, "x y z", "other") for i in range(50)]
    chosen, rep = run(spark, d, [("BIG", 0.9, 2), (" small", 0.1, 4)])
    assert abs(rep["big"].actual_share - 0.9) < 0.002 and abs(rep["small"].actual_share - 0.1) < 0.002
    assert max(r.times for r in chosen.values() if r.source == "small") <= 4 and max(r.times for r in chosen.values() if r.source == "big") <= 2
    assert {r.source for r in chosen.values()} == {"big", "small"}
    for s, r in rep.items():
        got = [x for x in chosen.values() if x.source == s]
        assert r.tokens == sum(x.tokens * x.times for x in got) and r.documents == len(got)
        times = {x.times for x in got}
        assert max(times) - min(times) <= 1  # whole epochs and one part of the next


def test_total_and_caps(spark):
    d = [(i, "word " * 10, "a") for i in range(10)] + [(100 + i, "word " * 10, "b") for i in range(10)]
    chosen, rep = run(spark, d, [("a", 0.5, 1), ("b", 0.5, 3)], total=100_000)
    assert rep["a"].most_times == 1 and rep["b"].most_times == 3 and rep["a"].tokens * 3 == rep["b"].tokens
    _, rep = run(spark, d, [("a", 0.5, 1), ("b", 0.5, 3)], total=100)
    assert abs(rep["a"].tokens - 50) <= 6 and abs(rep["b"].tokens - 50) <= 6


def test_edge_cases(spark):
    d = [(1, None, "a"), (2, "", "a"), (3, "one two", "a"), (4, "one two", "a"), (5, "x", None), (6, "x", "b"), (6, "x", "b"), (7, "x", " ")]
    t = [("a", 0.5, 2), ("A ", 0.1, 3), ("b", 0.4, None), ("none", 0.2, 1), (None, 0.3, 1), ("zero", 0.0, 1), ("nan", float("nan"), 1)]
    chosen, rep = run(spark, d, t)
    assert set(rep) == {"a", "b", "none"} and rep["none"].tokens == 0 and rep["a"].max_repeats == 2 and rep["b"].max_repeats == 1
    assert 1 not in chosen and 2 not in chosen and 5 not in chosen and 7 not in chosen
    assert sum(r.target_share for r in rep.values()) == pytest.approx(1, abs=1e-5)
    chosen, rep = run(spark, [], t)
    assert not chosen and all(r.tokens == 0 for r in rep.values())
    chosen, rep = run(spark, d, [])
    assert not chosen and not rep


def test_ranges_follow_the_order_of_keys(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_IN_RANGE", 2)  # ranges of about two documents
    d = docs(spark, [(i, "w " * (i % 5 + 1), "hot") for i in range(2_000)])
    t = mixing.targets_of(targets(spark, [("hot", 1.0, 1)]))
    s = mixing.sized(d, t)
    total = s.agg(F.sum("tokens")).first()[0]
    b = mixing.budgets(s, t, total // 3)
    got = {r.doc_id for r in mixing.choose(s, b).collect()}
    rows = sorted(s.collect(), key=lambda r: (r.part, r.key, r.doc_id))
    want, run_ = set(), 0
    for r in rows:
        end = run_ + r.tokens
        if run_ < total // 3 and (end <= total // 3 or end - total // 3 < total // 3 - run_):
            want.add(r.doc_id)
        run_ = end
    assert got == want and len({r.part for r in rows}) > 500
