"""References to records that do not exist.

Parent and child keys are brought into one long table of tagged rows and grouped
by key.  Child keys are reduced to the range of times at which they are used
before anything is shuffled, so a key that holds a third of all edges is one row
from each task.  Groups that lack a valid parent are the orphans; only edges
that name such a key are kept.

Defined results: an edge is a distinct (src, dst, relation), both ends neither
null nor blank, and lands with its first row; a node is known from its first
landing; a node without a time of landing is late for every edge that has one; an
edge without one is never early; null relations are kept as null; empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.normal import filled, norm_id, norm_upper

_FAR = "timestamp_ntz'9999-01-01 00:00:00'"


def distinct_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, relation, landed_at) of each distinct edge."""
    return (
        edges.where(filled("src") & filled("dst"))
        .groupBy(norm_id("src").alias("src"), norm_id("dst").alias("dst"), norm_upper("relation").alias("relation"))
        .agg(F.min("landed_at").alias("landed_at"))
    )


def orphan_references(edges: DataFrame, nodes: DataFrame, boundary: DataFrame) -> DataFrame:
    """(src, dst, relation, side, landed_at, reason): each edge and side that refers to nothing.

    reason is ``missing`` (in no table), ``removed`` (the node is not current) or
    ``late`` (the node landed after the edge).
    """
    used = edges.where(filled("src") & filled("dst"))
    far = F.expr(_FAR)
    # children, at most one row a key and task after the partial aggregation
    child = used.select(F.explode(F.array(norm_id("src"), norm_id("dst"))).alias("key"), F.lit(True).alias("child"), F.col("landed_at").alias("used_at"))
    none = F.lit(None)
    node = nodes.where(F.col("id").isNotNull()).select(
        norm_id("id").alias("key"),
        none.cast("boolean").alias("child"),
        F.lit(False).alias("fixed"),
        F.struct(F.col("indexed_at").alias("at"), F.col("landed_at").alias("landed")).alias("version"),
        F.col("removed_at").isNull().alias("alive"),
        F.coalesce("landed_at", far).alias("first"),
    )
    fixed = boundary.where(F.col("node_id").isNotNull()).select(norm_id("node_id").alias("key"), F.lit(True).alias("fixed"))
    tagged = node.unionByName(child, allowMissingColumns=True).unionByName(fixed, allowMissingColumns=True)
    suspects = (
        tagged.groupBy("key")
        .agg(
            F.max("child").alias("child"),
            F.max("fixed").alias("fixed"),
            F.max_by("alive", "version").alias("alive"),
            F.min("first").alias("first"),
            F.count("first").alias("rows"),
            F.min("used_at").alias("used_at"),
        )
        .where("child and not coalesce(fixed, false) and (rows = 0 or not alive or first > used_at)")
        .select(
            "key",
            F.when(F.col("rows") == 0, "missing").when(~F.col("alive"), "removed").otherwise("late").alias("reason"),
            "first",
        )
    )
    return _attach(used, suspects)


def _attach(used: DataFrame, suspects: DataFrame) -> DataFrame:
    ends = distinct_edges(used).select(
        "src", "dst", "relation", "landed_at",
        F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("key")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("key")))).alias("end"),
    ).select("src", "dst", "relation", "landed_at", "end.*")
    found = ends.join(suspects, "key").where((F.col("reason") != "late") | (F.col("first") > F.col("landed_at")))
    return found.select("src", "dst", "relation", "side", "landed_at", "reason")


def orphan_report(edges: DataFrame, nodes: DataFrame, boundary: DataFrame) -> DataFrame:
    """(relation, side, tbl, reason, month, orphans): counts by month in which the edge landed.

    ``tbl`` is the table that holds the parent, removed or late; ``none`` if no table does.
    """
    month = F.date_format("landed_at", "yyyy-MM")
    tbl = F.when(F.col("reason") == "missing", "none").otherwise("nodes")
    return (
        orphan_references(edges, nodes, boundary)
        .groupBy("relation", "side", tbl.alias("tbl"), "reason", month.alias("month"))
        .agg(F.count(F.lit(1)).alias("orphans"))
    )
