"""Point and one-hop look-ups over the symbol store.

Nodes are (id, type, name, file, signature, docstring, line_start, line_end, ...),
edges (src, dst, relation).  Look-ups by name take the first candidate by (file,
line_start, id).  Unknown keys give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.scalar import map_line
from codeloom.operators.graph import existing_edges

SHORT = ("name", "type", "file", "line", "signature")


def _short(n: DataFrame, *more: str) -> DataFrame:
    return n.select(*more, "name", "type", "file", F.col("line_start").alias("line"), "signature")


def first_by_name(nodes: DataFrame, names: Column | None = None) -> DataFrame:
    """The first symbol of each name."""
    rank = F.row_number().over(W.partitionBy("name").orderBy(F.col("file").asc_nulls_last(), F.col("line_start").asc_nulls_last(), "id"))
    some = nodes if names is None else nodes.where(names)
    return some.where("name is not null").withColumn("_r", rank).where("_r = 1").drop("_r")


def callers(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id, name, type, file, line, signature): who calls each of ``targets`` (id)."""
    e = edges.where("relation = 'CALLS'").join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")
    return _short(e.select(F.col("dst").alias("target"), F.col("src").alias("id")).join(nodes, "id"), "target", "id")


def callees(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, name, type, file, line, signature): whom each of ``sources`` (id) calls."""
    e = edges.where("relation = 'CALLS'").join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    return _short(e.select(F.col("src").alias("source"), F.col("dst").alias("id")).join(nodes, "id"), "source", "id")


def callers_by_name(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Callers of the first symbol of each name, with that name as ``of``."""
    first = first_by_name(nodes).select("id", F.col("name").alias("of"))
    return callers(nodes, edges, first).join(first.withColumnRenamed("id", "target"), "target").select("of", *SHORT)


def callees_by_name(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    first = first_by_name(nodes).select("id", F.col("name").alias("of"))
    return callees(nodes, edges, first).join(first.withColumnRenamed("id", "source"), "source").select("of", *SHORT)


def file_maps(nodes: DataFrame) -> DataFrame:
    """(file, map): for each file its symbols in order of lines, signatures and the start of docstrings; file rows are left out."""
    lines = nodes.where("type <> 'file' and file is not null").select(
        "file", F.struct(F.coalesce("line_start", F.lit(0)).alias("l"), "id", map_line("type", "name", "line_start", "signature", "docstring").alias("t")).alias("s")
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "\n")  # one file
    return lines.groupBy("file").agg(F.concat(F.lit("# Symbol map: "), F.first("file"), F.lit("\n\n"), body).alias("map"))


def names_to_ids(nodes: DataFrame) -> DataFrame:
    """(name, symbols, first_id, files): how many symbols and files share a name; file rows are left out.

    Counts rather than lists: a name may belong to a third of all symbols.
    """
    n = nodes.where("type <> 'file' and name is not null")
    return n.groupBy("name").agg(F.count(F.lit(1)).alias("symbols"), F.min("id").alias("first_id"), F.countDistinct("file").alias("files"))


def ids_by_name(nodes: DataFrame) -> DataFrame:
    """(name, id, file): the symbols of each name, a row each; file rows are left out."""
    return nodes.where("type <> 'file' and name is not null").select("name", "id", "file")


def node_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, role, other, name, file): the callers and callees of each symbol, a row each."""
    e = existing_edges(nodes, edges.where("relation = 'CALLS'"))
    both = e.select(F.col("dst").alias("id"), F.lit("caller").alias("role"), F.col("src").alias("other")).union(e.select("src", F.lit("callee"), "dst"))
    return both.join(nodes.select(F.col("id").alias("other"), "name", "file"), "other").select("id", "role", "other", "name", "file")


def node_detail(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, type, file, n_callers, n_callees): each symbol with its degree in the call graph."""
    e = edges.where("relation = 'CALLS'")
    known = nodes.select("id")
    up = e.join(known.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_callers"))
    down = e.join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_callees"))
    out = nodes.select("id", "name", "type", "file").join(up, "id", "left").join(down, "id", "left")
    return out.na.fill(0, ["n_callers", "n_callees"])


def induced(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the subgraph on ``ids`` (id[, seed]); nodes have a seed flag."""
    i = ids.select("id", *([F.coalesce("seed", F.lit(False)).alias("seed")] if "seed" in ids.columns else [F.lit(False).alias("seed")])).groupBy("id").agg(F.max("seed").alias("seed"))
    v = i.select("id")
    e = edges.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.join(i, "id"), e


def file_like(nodes: DataFrame, part: str, limit: int | None = None) -> DataFrame:
    """Nodes whose file contains ``part`` regardless of case; with ``limit`` the first by id."""
    hit = nodes.where(F.lower("file").contains(part.lower()))
    return hit if limit is None else hit.orderBy("id").limit(limit)
