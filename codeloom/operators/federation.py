"""Links between repositories: boundary symbols, cross edges, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scalar import link_confidence, link_types
from codeloom.operators.graph import bfs, existing_edges


def boundary_nodes(nodes: DataFrame, mode: str = "last") -> DataFrame:
    """(node_id, repo_id, name, file, type, link_type, link_key) of functions, methods and classes.

    ``last`` keeps the weakest link of a symbol, the one that is stored last;
    ``all`` keeps every link.
    """
    n = nodes.where(F.col("type").isin("function", "method", "class") & F.col("file").isNotNull())
    links = n.withColumn("links", link_types("type", "name", "file", "signature")).where(F.size("links") > 0)
    cols = [F.col("id").alias("node_id"), "repo_id", "name", "file", "type"]
    if mode == "last":
        return links.select(*cols, F.element_at("links", -1).alias("x")).select("node_id", "repo_id", "name", "file", "type", "x.*")
    return links.select(*cols, F.inline("links"))


def cross_edges(boundary: DataFrame) -> DataFrame:
    """(src_repo, src_node, dst_repo, dst_node, link_type, confidence): symbols of different repositories with one key, both ways."""
    b = boundary.where("repo_id is not null")
    a = b.select(F.col("repo_id").alias("src_repo"), F.col("node_id").alias("src_node"), F.col("file").alias("fa"), "link_type", "link_key")
    o = b.select(F.col("repo_id").alias("dst_repo"), F.col("node_id").alias("dst_node"), F.col("file").alias("fb"), "link_key")
    hit = a.join(o, "link_key").where("src_repo <> dst_repo")
    conf = F.max(link_confidence("link_type", "fa", "fb"))
    return hit.groupBy("src_repo", "src_node", "dst_repo", "dst_node", "link_type").agg(conf.alias("confidence"))


def cross_counts(boundary: DataFrame) -> DataFrame:
    """(src_repo, dst_repo, links): the number of cross edges between repositories, without spelling them out.

    Symbols are counted by repository and key first, so a key that a third of all
    symbols share is as many rows as there are repositories.
    """
    n = boundary.where("repo_id is not null").groupBy("link_key", "link_type", "repo_id").agg(F.countDistinct("node_id").alias("n"))
    to = n.groupBy("link_key", F.col("repo_id").alias("dst_repo")).agg(F.sum("n").alias("m"))
    return n.withColumnRenamed("repo_id", "src_repo").join(to, "link_key").where("src_repo <> dst_repo").groupBy("src_repo", "dst_repo").agg(F.sum(F.col("n") * F.col("m")).alias("links"))


def federated_links(nodes: DataFrame, edges: DataFrame, cross: DataFrame) -> DataFrame:
    """(src, dst): directed calls inside repositories and cross edges, on keys ``repo:id``."""
    key = F.concat_ws(":", F.coalesce("repo_id", F.lit("")), "id")
    v = nodes.select("id", key.alias("key"))
    calls = existing_edges(nodes, edges.where("relation = 'CALLS'"))
    inside = calls.join(v.select(F.col("id").alias("src"), F.col("key").alias("ks")), "src").join(v.select(F.col("id").alias("dst"), F.col("key").alias("kd")), "dst").select(F.col("ks").alias("src"), F.col("kd").alias("dst"))
    return inside.union(cross.select(F.concat_ws(":", "src_repo", "src_node"), F.concat_ws(":", "dst_repo", "dst_node"))).distinct()


def trace(nodes: DataFrame, links: DataFrame, start: DataFrame, max_hops: int = 5) -> DataFrame:
    """(repo, node_id, name, file, hop): what ``start`` (id) reaches over federated links, with its least number of hops."""
    key = F.concat_ws(":", F.coalesce("repo_id", F.lit("")), "id")
    v = nodes.select(key.alias("id"), F.coalesce("repo_id", F.lit("")).alias("repo"), F.col("id").alias("node_id"), "name", "file")
    first = nodes.join(start.select("id"), "id", "left_semi").select(key.alias("id"))
    return bfs(links, first, max_hops).join(v, "id").select("repo", "node_id", "name", "file", "hop")
