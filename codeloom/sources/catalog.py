"""The engine's tables in a folder: written whole or by repository, read with a fixed schema.

Columns that an older table lacks are read as nulls; extra ones are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.session import drop_path

SCHEMAS = {
    "nodes": "file string, ordinal int, type string, name string, signature string, docstring string, line_start int, line_end int, calls array<string>, id string, embedding array<float>, indexed_at timestamp, repo_id string",
    "edges": "src string, dst string, relation string, repo_id string",
    "file_hashes": "file string, hash string, repo_id string",
    "temporal_nodes": "node_id string, name string, file string, type string, first_seen_ts timestamp, last_seen_ts timestamp, first_commit string, last_commit string, change_count long, volatility double, repo_id string",
    "temporal_edges": "src string, dst string, relation string, first_seen_ts timestamp, last_seen_ts timestamp, repo_id string",
    "boundary": "node_id string, name string, file string, type string, link_type string, link_key string, repo_id string",
    "cross_edges": "src_repo string, src_node string, dst_repo string, dst_node string, link_type string, confidence double",
    "fed_repos": "repo_id string, repo_path string, db_path string, indexed_at timestamp",
    "sessions": "id string, project string, summary string, tags array<string>, created_at timestamp, embedding array<float>",
}


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def read(self, name: str) -> DataFrame:
        """A table; empty if it hasn't been written."""
        if not self.has(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")

    def write(self, name: str, rows: DataFrame, repo: str | None = None) -> None:
        """Replace a table, or the part of it that belongs to ``repo``.

        The new files are written beside the old ones, which go when they are
        complete, so ``rows`` may come from the table itself.
        """
        part = f"/repo_id={repo}" if repo is not None else ""
        out = rows.drop("repo_id") if repo is not None else rows
        new, at = f"{self.root}/_new/{name}{part}", f"{self.root}/{name}{part}"
        out.write.mode("overwrite").parquet(new)
        drop_path(self.spark, at)
        self._fs.mkdirs(self._path(at).getParent())
        if not self._fs.rename(self._path(new), self._path(at)):
            raise OSError(f"{name} can't be replaced")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def size_kb(self) -> float:
        """Kilobytes of all tables, to one place."""
        return round(self._fs.getContentSummary(self._path(self.root)).getLength() / 1024, 1) if self._fs.exists(self._path(self.root)) else 0.0
