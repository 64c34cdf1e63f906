"""Command line: ``python -m codeloom --store FOLDER COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from codeloom.api import Engine
from codeloom.operators import federation, memory
from codeloom.session import build_session
from codeloom.sources.catalog import Catalog
from codeloom.sources.commits import commit_log, history
from codeloom.sources.ingest import Index, index_tree


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("codeloom")
    p.add_argument("--store", required=True, help="folder of the tables")
    p.add_argument("--repo", default="main", help="name of the repository in the store")
    p.add_argument("--dim", type=int, default=384)
    p.add_argument("--json", action="store_true", help="print a JSON object for each row")
    sub = p.add_subparsers(dest="command", required=True)
    args = {
        "init": ["root"], "status": [], "query": ["task"], "search": ["text"], "callers": ["name"], "callees": ["name"], "map": ["file"], "impact": ["name"], "diff": ["file"],
        "audit": [], "timeline": ["root"], "volatility": [], "federate": [], "trace": ["name"], "recall": ["text"],
        "sessions": [], "session": ["prefix"], "remember": ["text"],
    }
    for name, positional in args.items():
        c = sub.add_parser(name)
        for a in positional:
            c.add_argument(a)
        c.add_argument("--limit", type=int, default=20)
    return p


def engine(spark, store: Catalog, args: argparse.Namespace) -> Engine:
    life = store.read("temporal_nodes").where(F.col("repo_id") == args.repo) if store.has("temporal_nodes") else None
    nodes = store.read("nodes")
    mine = nodes if args.command in ("trace", "federate") else nodes.where(F.col("repo_id") == args.repo)
    edges, hashes = store.read("edges"), store.read("file_hashes").where(F.col("repo_id") == args.repo)
    sessions = store.read("sessions") if store.has("sessions") else None
    return Engine(spark, mine, edges, hashes, life, sessions, args.dim)


def run(spark, args: argparse.Namespace):
    """The DataFrame that answers a command."""
    store = Catalog(spark, args.store)
    if args.command == "init":
        e = engine(spark, store, args)
        old = Index(e.nodes.drop("repo_id"), e.edges, e.hashes.drop("repo_id"), e.nodes) if store.has("nodes") else None
        i = index_tree(spark, args.root, old, dim=args.dim)
        for name, rows in (("nodes", i.nodes), ("edges", i.edges), ("file_hashes", i.hashes)):
            store.write(name, rows, args.repo)
        known = store.read("fed_repos").where(F.col("repo_id") != args.repo)
        me = spark.createDataFrame([(args.repo, args.root, args.store)], "repo_id string, repo_path string, db_path string").withColumn("indexed_at", F.current_timestamp())
        store.write("fed_repos", known.unionByName(me))
        return i.report
    if args.command == "timeline":
        life, edges, report = history(commit_log(spark, args.root))
        store.write("temporal_nodes", life, args.repo)
        store.write("temporal_edges", edges, args.repo)
        return report
    e = engine(spark, store, args)
    if args.command == "federate":
        b = federation.boundary_nodes(e.nodes)
        store.write("boundary", b)
        store.write("cross_edges", federation.cross_edges(store.read("boundary")))
        return store.read("cross_edges").groupBy("src_repo", "dst_repo").count()
    if args.command == "diff":
        text = sys.stdin.read() if args.file == "-" else Path(args.file).read_text(encoding="utf-8")
        return e.impact_of_diff(text).report
    if args.command == "status":
        return e.index_status().withColumn("db_size_kb", F.lit(store.size_kb()))
    if args.command == "remember":
        row = spark.createDataFrame([(uuid.uuid4().hex, args.repo, args.text, [], e.vector(args.text))], "id string, project string, summary string, tags array<string>, embedding array<float>")
        row = row.withColumn("created_at", F.current_timestamp())
        store.append("sessions", row.select("id", "project", "summary", "tags", "created_at", "embedding"))
        return row.select("id", "project", "created_at")
    if args.command in ("sessions", "session"):
        mine = store.read("sessions").where(F.col("project") == args.repo)
        some = memory.newest(mine, args.limit) if args.command == "sessions" else memory.by_prefix(mine, args.prefix)
        return some.select("id", "project", "summary", "created_at").orderBy(F.desc("created_at"), "id")
    if args.command == "impact":
        got = e.impact_analysis([args.name])
        return getattr(got, "report", got)
    plain = {
        "audit": e.semantic_audit, "volatility": lambda: e.get_volatility(top_k=args.limit), "query": lambda: e.get_context(args.task), "search": lambda: e.search(args.text, args.limit),
        "callers": lambda: e.get_callers(args.name), "callees": lambda: e.get_callees(args.name), "map": lambda: e.get_file_map(args.file), "trace": lambda: e.trace_cross_repo(args.name),
        "recall": lambda: e.session_memory(args.text, args.repo),
    }
    return plain[args.command]()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    rows = run(spark, args)
    if args.json:
        for text in rows.limit(args.limit).toJSON().collect():
            print(text)
    else:
        rows.show(args.limit, truncate=False)


if __name__ == "__main__":
    main()
