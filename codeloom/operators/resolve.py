"""Resolution of called names to symbols, inside files and across files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def called_names(nodes: DataFrame) -> DataFrame:
    """(id, name, file, callee): each distinct name a symbol calls; null names are dropped."""
    return nodes.select("id", "name", "file", F.explode(F.array_distinct("calls")).alias("callee")).where("callee is not null")


def resolve_intra(nodes: DataFrame) -> DataFrame:
    """(src, dst): calls to the last definition of that name in the same file; calls of one's own name are dropped."""
    last = nodes.where("type <> 'file' and name is not null").groupBy("file", F.col("name").alias("callee")).agg(F.max_by("id", F.struct(F.coalesce("ordinal", F.lit(-1)), "line_start", "id")).alias("dst"))
    calls = called_names(nodes).where("callee <> name")
    return calls.join(last, ["file", "callee"]).select(F.col("id").alias("src"), "dst").distinct()


def resolve_cross(nodes: DataFrame) -> DataFrame:
    """(src, dst): calls to every symbol of that name in any other file."""
    defs = nodes.where("type <> 'file' and name is not null").select(F.col("name").alias("callee"), F.col("id").alias("dst"), F.col("file").alias("f2"))
    return called_names(nodes).join(defs, "callee").where("file <> f2").select(F.col("id").alias("src"), "dst").distinct()


def resolve_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(attempts, fresh): cross-file links found, and those that weren't among the stored calls."""
    found = resolve_cross(nodes)
    known = edges.where("relation = 'CALLS'").select("src", "dst")
    return found.agg(F.count(F.lit(1)).alias("attempts")).crossJoin(found.join(known, ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("fresh")))


def diff_names(texts: DataFrame, text: Column | str = "text") -> DataFrame:
    """(name): functions and classes that a unified diff adds."""
    t = F.col(text) if isinstance(text, str) else text
    line = texts.select(F.explode(F.split(t, r"\r\n|\n|\r")).alias("line"))
    return line.select(F.regexp_extract("line", r"^\+\s*(?:def|class)\s+(\w+)", 1).alias("name")).where("name <> ''").distinct()
