"""The symbol store as append logs: latest rows, upserts, deletes, counts.

Tables are append-only; a later row of a key replaces an earlier one when they
are read or compacted.  Empty tables and null keys are allowed throughout:
rows without a key are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.normal import filled, latest, norm_id, norm_upper


def current_nodes(nodes: DataFrame, *columns: str) -> DataFrame:
    """(id, *columns): of each id the row with the greatest indexed_at, unless that row records a removal.

    Only ``columns`` are read; ``type`` comes trimmed and in lower case.  A null
    indexed_at comes before any other; of repeated deliveries the last counts.
    """
    cols = [norm_id(c).alias(c) if c == "type" else F.col(c) for c in columns]
    payload = [F.col("removed_at").isNull().alias("_alive"), *cols]
    live = latest(nodes.where(filled("id")), norm_id("id"), [F.col("indexed_at"), F.col("landed_at")], payload, "id")
    return live.where("_alive").select("id", *columns)


def current_edges(edges: DataFrame, relation: str | None = None) -> DataFrame:
    """(src, dst, relation): distinct edges with both ends neither null nor blank."""
    kept = edges.where(filled("src") & filled("dst"))
    if relation:
        kept = kept.where(norm_upper("relation") == relation.upper())
    return kept.select(norm_id("src").alias("src"), norm_id("dst").alias("dst"), norm_upper("relation").alias("relation")).distinct()


def current_hashes(file_hashes: DataFrame) -> DataFrame:
    """(file, hash): the last known hash of each file that is still there."""
    return latest(file_hashes.where(filled("file")), F.col("file"), [F.col("indexed_at"), F.col("landed_at")], [norm_id("hash").alias("hash")], "file").where("hash is not null")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both; of each key the one with the greatest ``order``, new before old on a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    cols = [F.col(c) for c in both.columns if c not in (key, "_new")]
    return latest(both, F.col(key), [F.col(order), F.col("_new")], cols, key)


def delete_files(nodes: DataFrame, edges: DataFrame, hashes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and hashes without the files named in ``files`` (file) and what hangs on them."""
    gone = nodes.join(files.select("file").distinct(), "file", "left_semi").select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    names = files.select("file").distinct()
    return nodes.join(names, "file", "left_anti"), kept.select(*edges.columns), hashes.join(names, "file", "left_anti")


def stats(nodes: DataFrame, edges: DataFrame, hashes: DataFrame) -> DataFrame:
    """(nodes, edges, files_indexed): one row."""
    one = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    return one.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(hashes.agg(F.count(F.lit(1)).alias("files_indexed")))


def unchanged(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files (file, hash) that are new or differ from the stored hash, and so need indexing."""
    return files.join(hashes.select("file", "hash"), ["file", "hash"], "left_anti")


def _moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, id, kind) of ids (file, id, state) in either: added, removed, changed - in both, with another state; nulls are equal - or null."""
    both = old.select("file", "id", F.struct(F.col("state")).alias("was")).join(new.select("file", "id", F.struct(F.col("state")).alias("now")), ["file", "id"], "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select("file", "id", kind.alias("kind"))


def delta_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, added, removed, changed): counts of ids (file, id, state) by file."""
    return _moved(old, new).groupBy("file").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("added", "removed", "changed")))


def delta_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, kind, id): the ids that were added, removed or changed, a row each."""
    return _moved(old, new).where("kind is not null").select("file", "kind", "id")
