"""Snapshots of subgraphs as JSON, kept as a ring of the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.lookup import induced
from codeloom.session import drop_path


def save_snapshot(nodes: DataFrame, edges: DataFrame, ids: DataFrame, root: str, number: int, keep: int = 10) -> str:
    """Write the subgraph on ``ids`` (id[, seed]) as ``root/number=N/{nodes,edges}`` and drop all but the ``keep`` newest."""
    spark = nodes.sparkSession
    v, e = induced(nodes, edges, ids)
    where = f"{root.rstrip('/')}/number={number:012d}"
    cols = ["id", "name", "type", "file", F.coalesce("signature", F.lit("")).alias("signature"), F.col("line_start").alias("line"), "seed"]
    v.select(*cols).write.mode("overwrite").json(f"{where}/nodes")
    e.select("src", "dst", "relation").write.mode("overwrite").json(f"{where}/edges")
    for old in list_snapshots(spark, root)[keep:]:
        drop_path(spark, f"{root.rstrip('/')}/number={old:012d}")
    return where


def list_snapshots(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the snapshots that are kept, newest first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    return sorted((int(n.split("=")[1]) for n in names if n.startswith("number=")), reverse=True)


def read_snapshot(spark: SparkSession, root: str, number: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) of a snapshot, the newest by default; none if there is none."""
    known = list_snapshots(spark, root)
    if not known or (number is not None and number not in known):
        return None
    where = f"{root.rstrip('/')}/number={known[0] if number is None else number:012d}"
    node = "id string, name string, type string, file string, signature string, line int, seed boolean"
    return spark.read.schema(node).json(f"{where}/nodes"), spark.read.schema("src string, dst string, relation string").json(f"{where}/edges")
