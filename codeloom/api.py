"""The engine's public surface: one method for each tool, each returning DataFrames.

An ``Engine`` holds the tables of an index.  Texts become vectors by a model that
maps a list of texts to an array; without one, by hashing (``hashed_vector``).
Names that aren't known give a row with ``error``, as do tools that lack a table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import context, drift, federation, graph, impact, lookup, memory, rollup, store
from codeloom.session import materialize
from codeloom.sources.ingest import Index, embed, hashed_vector, index_tree
from codeloom.sources.snapshots import save_snapshot


@dataclass
class Engine:
    """nodes, edges and hashes of an index; lifetimes from ``sources.commits.history``; sessions as in ``operators.memory``."""

    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    hashes: DataFrame
    lifetimes: DataFrame | None = None
    sessions: DataFrame | None = None
    dim: int = 384
    model: Callable[[list[str]], object] | None = None
    snapshots: str | None = None
    log: list[dict] = field(default_factory=list)
    _links: DataFrame | None = None

    @classmethod
    def from_tree(cls, spark: SparkSession, root: str, **kw) -> Engine:
        i = index_tree(spark, root, dim=kw.get("dim", 384))
        return cls(spark, i.nodes, i.edges, i.hashes, **kw)

    def index(self) -> Index:
        return Index(self.nodes, self.edges, self.hashes, self.index_status())

    def refresh(self, root: str) -> DataFrame:
        """Index what changed below ``root``; returns the report."""
        i = index_tree(self.spark, root, self.index(), dim=self.dim)
        self.nodes, self.edges, self.hashes, self._links = i.nodes, i.edges, i.hashes, None
        return i.report

    def links(self) -> DataFrame:
        """The symmetrised call graph, written once for each version of the index."""
        if self._links is None:
            self._links = graph.bucketed(graph.symmetrize(self.nodes, self.edges.where("relation = 'CALLS'")))
        return self._links

    def error(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "error string")

    def vector(self, text: str) -> list[float]:
        v = self.model([text])[0] if self.model else hashed_vector(text, self.dim)
        return [float(x) for x in v]

    def _query(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text, self.vector(text))], "id string, embedding array<float>")

    def _named(self, name: str, file: str | None) -> DataFrame:
        some = self.nodes.where(F.col("name") == name)
        return some.where(F.col("file").contains(file)) if file else some

    # tools

    def get_context(self, task: str, max_tokens: int = 4000, semantic_k: int = 5, pagerank_k: int = 25) -> DataFrame:
        """(context, tokens, nodes, included, naive_tokens, reduction_pct); an empty index gives an empty context."""
        rows, report = context.get_context(self.nodes, self.edges, self._query(task), max_tokens, semantic_k, pagerank_k, dim=self.dim, links=self.links())
        if self.snapshots:
            ids = rows.select("id", (F.col("place") <= semantic_k).alias("seed"))
            save_snapshot(self.nodes, self.edges, ids, self.snapshots, len(self.log) + 1)
        self.log.append({"task": task[:80]})
        return report

    def search(self, query: str, top_k: int = 10) -> DataFrame:
        return context.search_symbols(self.nodes, self._query(query), top_k, self.dim).orderBy("rank").select(*lookup.SHORT, "score")

    def get_callers(self, name: str, file: str | None = None) -> DataFrame:
        first = lookup.first_by_name(self._named(name, file))
        return self.error(f"no symbol {name}") if first.isEmpty() else lookup.callers(self.nodes, self.edges, first).select(*lookup.SHORT)

    def get_callees(self, name: str, file: str | None = None) -> DataFrame:
        first = lookup.first_by_name(self._named(name, file))
        return self.error(f"no symbol {name}") if first.isEmpty() else lookup.callees(self.nodes, self.edges, first).select(*lookup.SHORT)

    def get_file_map(self, file: str) -> DataFrame:
        some = self.nodes.where(F.col("file") == file)
        return self.error(f"no indexed symbols for {file}") if some.isEmpty() else lookup.file_maps(some).select("map")

    def session_memory(self, query: str, project: str, top_k: int = 3) -> DataFrame:
        """The recalled sessions as one text."""
        if self.sessions is None:
            return self.error("no sessions")
        q = self.spark.createDataFrame([(project, self.vector(query))], "project string, query array<float>")
        got = memory.recall(self.sessions, q, top_k, dim=self.dim)
        return memory.for_injection(got.join(self.sessions.select("project", "id", "summary", "created_at"), ["project", "id"]).withColumnRenamed("recall_rank", "age_rank"))

    def save_session(self, rows: DataFrame) -> None:
        self.sessions = materialize(rows if self.sessions is None else memory.save(self.sessions, rows), "sessions")

    def index_status(self) -> DataFrame:
        return store.stats(self.nodes, self.edges, self.hashes)

    def impact_analysis(self, names: list[str], file: str | None = None, direction: str = "both") -> impact.Impact | DataFrame:
        some = self.nodes.where(F.col("name").isin(*names))
        some = some.where(F.col("file").contains(file)) if file else some
        return self.error("no such functions") if some.isEmpty() else impact.blast_radius(self.nodes, self.edges, some.select("id"), direction=direction, links=self.links())

    def impact_of_diff(self, text: str) -> impact.Impact:
        return impact.from_diff(self.nodes, self.edges, self.spark.createDataFrame([(text,)], "text string"), links=self.links())

    def semantic_audit(self, file: str | None = None, threshold: float = 0.35) -> DataFrame:
        """Drift of what functions declare - name and docstring - against what they call; a callee without a vector has that of its name."""
        said = embed(self.nodes.withColumn("_said", F.concat_ws(" ", "name", "docstring")), "_said", self.dim, "declared", self.model)
        said = embed(said, "name", self.dim, "named", self.model)
        d = drift.drift_report(said, self.edges, declared="declared", threshold=threshold, dim=self.dim, fallback="named")
        return (d.where(F.col("file") == file) if file else d).orderBy(F.desc("drift_score"), "node_id")

    def get_volatility(self, name: str | None = None, top_k: int = 10) -> DataFrame:
        if self.lifetimes is None:
            return self.error("no history")
        if name is not None:
            return self.lifetimes.where(F.col("name") == name)
        return self.lifetimes.orderBy(F.desc("volatility"), "node_id").limit(top_k)

    def trace_cross_repo(self, name: str, max_hops: int = 5) -> DataFrame:
        """Needs nodes of several repositories (repo_id)."""
        first = lookup.first_by_name(self._named(name, None))
        if "repo_id" not in self.nodes.columns or first.isEmpty():
            return self.error(f"no symbol {name} in a federation")
        links = materialize(federation.federated_links(self.nodes, self.edges, federation.cross_edges(federation.boundary_nodes(self.nodes))), "fed")
        return federation.trace(self.nodes, links, first, max_hops).orderBy("hop", "repo", "node_id")

    def overview(self) -> dict[str, DataFrame]:
        """Folders, files and the edges between them."""
        return {
            "folders": rollup.folders(self.nodes),
            "files": rollup.files(self.nodes),
            "folder_edges": rollup.edge_weights(self.nodes, self.edges, "folder"),
            "file_edges": rollup.edge_weights(self.nodes, self.edges, "file"),
        }

    def ranks(self, personal: DataFrame | None = None, **kw) -> DataFrame:
        """PageRank of the whole graph, or personalised to ``personal`` (id, p)."""
        return graph.pagerank(self.nodes, self.links(), personal, **kw)
