"""Change impact: what a change reaches, how risky that is, and which parts no test covers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scalar import has_test, risk_level
from codeloom.operators.graph import bfs, bucketed, existing_edges, pagerank, symmetrize
from codeloom.operators.resolve import diff_names
from codeloom.session import materialize


@dataclass
class Impact:
    """affected (id, name, file, line, type, hop, risk_score, has_test), high_risk (the untested among them with at least 0.3 of the greatest risk) and a one-row report."""

    affected: DataFrame
    high_risk: DataFrame
    report: DataFrame


def blast_radius(nodes: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int = 10, direction: str = "both", iterations: int | None = None, links: DataFrame | None = None) -> Impact:
    """What ``changed`` (id) reaches within ``max_depth`` hops over CALLS.

    direction ``both`` walks callers and callees, ``callers`` callers only.  If
    nothing is reached, the changed symbols themselves count as affected.  The
    risk of a symbol is its PageRank personalised to the change; the score is
    0.4 of the reach (50 at most) + 0.4 of the untested share + 0.2 of the mean
    degree of what changed (20 at most), in per cent, rounded half to even.
    Without changes the report has zeros; unknown ids count towards the radius
    but can't be annotated.  ``links`` is the symmetrised call graph, if the caller has it.
    """
    calls = edges.where("relation = 'CALLS'")
    both = bucketed(symmetrize(nodes, calls) if links is None else links)
    ways = both if direction == "both" else existing_edges(nodes, calls).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = materialize(changed.select("id").distinct(), "changed")
    reached = bfs(ways, start, max_depth).where("hop > 0")
    n = start.count()
    ids = reached if not reached.isEmpty() else start.withColumn("hop", F.lit(0))
    seeds = start.withColumn("p", F.lit(1.0 / max(n, 1)))
    risk = pagerank(nodes, both, seeds, iterations=iterations)
    short = nodes.select("id", "name", "file", F.col("line_start").alias("line"), "type")
    known = ids.join(short, "id").join(risk, "id", "left")
    affected = materialize(
        known.select("id", "name", "file", "line", "type", "hop", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("risk_score"), has_test("file", "name").alias("has_test")), "affected"
    )
    top = affected.agg(F.max("risk_score").alias("top"))
    high = affected.crossJoin(F.broadcast(top)).where(~F.col("has_test") & (F.col("risk_score") >= 0.3 * F.col("top"))).drop("top")
    degree = both.join(start.withColumnRenamed("id", "src"), "src", "left_semi").agg((2 * F.count(F.lit(1))).alias("degree"))
    sums = affected.agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("has_test")).cast("long")).alias("untested"))
    raw = (
        0.4 * F.least(F.col("n") / 50, F.lit(1.0))
        + 0.4 * F.col("untested") / F.col("n")
        + 0.2 * F.least(F.col("degree") / F.lit(max(n, 1)) / 20, F.lit(1.0))
    )
    score = F.when(F.col("n") == 0, F.lit(0)).otherwise(F.least(F.bround(F.round(raw * 100, 9), 0), F.lit(100)).cast("int"))
    radius = ids.agg(F.count(F.lit(1)).alias("blast_radius"))
    risky = high.agg(F.count(F.lit(1)).alias("high_risk"))
    report = (
        sums.crossJoin(degree).crossJoin(radius).crossJoin(risky)  # one row each
        .select(F.lit(n).cast("long").alias("changed"), "blast_radius", F.col("n").alias("affected"), F.coalesce("untested", F.lit(0)).alias("untested"), score.alias("risk_score"), "high_risk")
    )
    text = F.format_string("Risk: %s (%d/100). This change touches %d node(s), affecting %d downstream caller(s).", risk_level("risk_score"), "risk_score", "changed", "affected")
    return Impact(affected, high, report.withColumn("summary", text))


def impact_text(i: Impact) -> DataFrame:
    """(text): the report with its five riskiest untested and eight riskiest affected symbols.  Fixed values: its wording."""
    head = i.report.select(
        F.format_string("Impact Analysis\n  Changed nodes  : %d\n  Blast radius   : %d functions affected\n  Risk score     : %d/100", "changed", "blast_radius", "risk_score").alias("head")
    )

    def first(rows: DataFrame, n: int, line, name: str) -> DataFrame:
        top = rows.orderBy(F.desc("risk_score"), "id").limit(n).select(F.struct((-F.col("risk_score")).alias("s"), "id", line.alias("t")).alias("x"))
        return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias(name))

    risky = F.format_string("    - %s (%s:%d)", "name", "file", "line")
    mark = F.when(F.col("has_test"), "[x]").otherwise("[ ]")
    some = F.format_string("    %s %s risk=%.3f  %s", mark, F.rpad("name", 30, " "), "risk_score", "file")
    both = head.crossJoin(first(i.high_risk, 5, risky, "a")).crossJoin(first(i.affected, 8, some, "b"))
    part = lambda title, c: F.when(F.length(c) > 0, F.concat(F.lit(title), F.col(c)))
    return both.select(F.concat_ws("\n", "head", part("  Untested high-risk nodes:\n", "a"), part("\n  Top affected (by risk):\n", "b")).alias("text"))


def from_diff(nodes: DataFrame, edges: DataFrame, diffs: DataFrame, **kw) -> Impact:
    """Impact of the functions and classes that unified diffs (text) add, by name."""
    names = diff_names(diffs)
    return blast_radius(nodes, edges, nodes.join(names, "name", "left_semi").select("id"), **kw)
