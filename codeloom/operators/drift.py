"""Semantic drift: how far what a function declares lies from what it calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scalar import drift_severity
from codeloom.functions.vectors import dot, mean_vectors, norm, usable


def drift(nodes: DataFrame, edges: DataFrame, declared: str = "embedding", threshold: float = 0.35, least_callees: int = 2, dim: int = 64, fallback: str | None = None, exact: bool = False) -> DataFrame:
    """(node_id, name, file, line, callees, drift_score): functions and methods with at least ``least_callees`` callees and a drift of at least ``threshold``.

    Drift is 1 - cosine of the declared vector and the mean of the callees'
    vectors.  A callee without a usable vector has the one in the column ``fallback``,
    if given; callees or functions without any take no part.  The number of callees
    counts all that exist.  With ``exact``, a column ``score`` has the drift before it was rounded.
    """
    calls = edges.where("relation = 'CALLS'").select("src", "dst").distinct()
    callee = nodes.select(F.col("id").alias("dst"), (F.col("embedding") if fallback is None else F.when(usable("embedding", dim), F.col("embedding")).otherwise(F.col(fallback))).alias("v"))
    linked = calls.join(callee, "dst")
    n = linked.groupBy("src").agg(F.count(F.lit(1)).alias("callees")).where(F.col("callees") >= least_callees)
    mean = mean_vectors(linked.where(usable("v", dim)), "src", "v")
    own = nodes.where(F.col("type").isin("function", "method") & usable(declared, dim)).select(F.col("id").alias("src"), "name", "file", F.col("line_start").alias("line"), F.col(declared).alias("own"))
    both = own.join(n, "src").join(mean, "src").where(norm("mean") > 0)
    score = 1.0 - dot("own", "mean") / (norm("own") * norm("mean"))
    more = [score.alias("score")] if exact else []
    return both.select(F.col("src").alias("node_id"), "name", "file", "line", "callees", F.round(score, 4).alias("drift_score"), *more).where(F.col("drift_score") >= threshold)


def explain(name: Column, docstring: Column, callees: Column, score: Column) -> Column:
    """A sentence on a drift; ``callees`` is an array of names, of which five are shown.  Fixed values: its wording."""
    more = F.when(F.size(callees) > 5, F.concat(F.lit(" +"), (F.size(callees) - 5).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    doc = F.coalesce(docstring, F.lit(""))
    says = F.when(doc != "", F.concat(F.lit('"'), name, F.lit('" declares: "'), F.substring(doc, 1, 80), F.lit('"'))).otherwise(F.concat(F.lit('"'), name, F.lit('" has no docstring.')))
    head = F.format_string("Semantic drift (%s, score=%.2f).", drift_severity(score), score)
    return F.concat_ws(" ", head, says, F.concat(F.lit("But calls: "), F.array_join(F.slice(callees, 1, 5), ", "), more, F.lit(".")), F.lit("Name/docstring may not reflect actual responsibilities."))


def drift_report(nodes: DataFrame, edges: DataFrame, **kw) -> DataFrame:
    """Drifts with what was declared and an explanation that names up to five callees, the first by name."""
    d = drift(nodes, edges, exact=True, **kw)
    calls = edges.where("relation = 'CALLS'").select("src", "dst").distinct().join(d.select(F.col("node_id").alias("src")), "src", "left_semi")
    names = calls.join(nodes.select(F.col("id").alias("dst"), "name"), "dst").groupBy("src").agg(F.array_sort(F.collect_list("name")).alias("names"))  # one function's callees
    doc = nodes.select(F.col("id").alias("node_id"), "docstring")
    return d.join(names.withColumnRenamed("src", "node_id"), "node_id").join(doc, "node_id").select(
        "node_id", "name", "file", "line", "drift_score",
        F.concat_ws(" ", "name", "docstring").alias("declared_intent"),
        F.array_join("names", ", ").alias("actual_callees"),
        explain(F.col("name"), F.col("docstring"), F.col("names"), F.col("score")).alias("explanation"),
    )
