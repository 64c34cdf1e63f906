"""Commit logs: a batch data source over a git repository, and the history built from it.

The reader lists commits once and splits them into ranges; each task reads the
files of its range.  Merges are compared with their first parent only.  Rows:
(seq, sha, ts, file, content); null content marks a deleted file.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeloom.operators import temporal
from codeloom.operators.resolve import resolve_intra
from codeloom.session import ship
from codeloom.sources.ingest import parse_files
from codeloom.sources.scan import wanted

SCHEMA = "seq long, sha string, ts timestamp, file string, content binary"


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], check=True, capture_output=True).stdout


class Blobs:
    """Contents of files of commits, from one git process that answers as long as it is asked."""

    def __init__(self, repo: str):
        self._git = subprocess.Popen(["git", "-c", "safe.directory=*", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def get(self, sha: str, file: str) -> bytes | None:
        self._git.stdin.write(f"{sha}:{file}\n".encode("utf-8", "surrogateescape"))
        self._git.stdin.flush()
        head = self._git.stdout.readline().split()
        if len(head) < 3 or head[-2] != b"blob":
            if len(head) >= 3 and head[-1].isdigit():  # a submodule or a folder
                self._git.stdout.read(int(head[-1]) + 1)
            return None
        content = self._git.stdout.read(int(head[-1]))
        self._git.stdout.read(1)
        return content

    def close(self) -> None:
        self._git.stdin.close()
        self._git.wait()


class Range(InputPartition):
    def __init__(self, commits: list[tuple[int, str, int, str]]):
        super().__init__(None)
        self.commits = commits


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo = options["path"]
        self.branch = options.get("branch", "HEAD")
        self.most = int(options.get("maxcommits", "500"))
        self.size = int(options.get("commitspertask", "50"))

    def partitions(self) -> list[Range]:
        try:
            out = git(self.repo, "log", f"--max-count={self.most}", "--format=%H %ct %P", self.branch).decode()
        except (subprocess.CalledProcessError, OSError):
            return [Range([])]  # not a repository: no commits
        rows = [(p[0], int(p[1]), p[2] if len(p) > 2 else "") for p in (x.split() for x in reversed(out.splitlines()))]
        commits = [(i, sha, ts, parent) for i, (sha, ts, parent) in enumerate(rows)]
        return [Range(commits[i : i + self.size]) for i in range(0, len(commits), self.size)] or [Range([])]

    def read(self, partition: Range) -> Iterator[tuple]:
        import datetime

        blobs = Blobs(self.repo) if partition.commits else None
        for seq, sha, ts, parent in partition.commits:
            base = [parent, sha] if parent else ["--root", sha]
            changed = git(self.repo, "diff-tree", "-r", "--no-commit-id", "--name-only", "--no-renames", "-z", *base).decode("utf-8", "surrogateescape")
            when = datetime.datetime.fromtimestamp(ts, datetime.timezone.utc)
            for file in filter(None, changed.split("\0")):
                # a line end in a name would end the question
                content = blobs.get(sha, file) if "\n" not in file else self._alone(sha, file)
                yield seq, sha[:8], when, file.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), content
        if blobs:
            blobs.close()

    def _alone(self, sha: str, file: str) -> bytes | None:
        try:
            return git(self.repo, "show", f"{sha}:{file}")
        except subprocess.CalledProcessError:
            return None


class GitLog(DataSource):
    """``spark.read.format("git_log").option("path", repo)``; options branch, maxCommits, commitsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GitReader:
        return GitReader({k.lower(): v for k, v in self.options.items()})


def commit_log(spark: SparkSession, repo: str, max_commits: int = 500, branch: str = "HEAD") -> DataFrame:
    ship(spark)
    spark.dataSource.register(GitLog)
    return spark.read.format("git_log").option("path", repo).option("maxCommits", str(max_commits)).option("branch", branch).load()


def history(commits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lifetimes, edges, summary) of a commit log (seq, sha, ts, file, content).

    Each version of a file is parsed under its own path, so ids agree with an
    index of the same tree.  Calls are resolved inside each version of a file.
    """
    log = commits.where(wanted("file"))
    version = F.concat_ws("@", F.col("seq").cast("string"), "file")
    files = log.where("content is not null").select(version.alias("file"), "content")
    # parsing sees "seq@path"; the path is restored before ids are made
    parsed = parse_files(files).drop("id")
    path = F.regexp_replace("file", r"^\d+@", "")
    from codeloom.functions.scalar import symbol_id

    parsed = parsed.withColumn("seq", F.regexp_extract("file", r"^(\d+)@", 1).cast("long")).withColumn("version", F.col("file")).withColumn("file", path)
    parsed = parsed.withColumn("name", F.when(F.col("type") == "file", F.regexp_replace("name", r"^\d+@", "")).otherwise(F.col("name")))
    parsed = parsed.withColumn("id", symbol_id("file", "type", "name", "line_start"))
    when = commits.select("seq", "sha", "ts").distinct()
    seen = parsed.select(F.col("id").alias("node_id"), "name", "file", "type", "seq").join(when, "seq")
    touches = log.select("file", "seq", "ts", "sha")
    n = commits.select("seq").distinct().count()
    life = temporal.timeline(seen, touches, n)
    key = F.concat_ws("@", F.col("seq").cast("string"), "id")
    inner = resolve_intra(parsed.select(key.alias("id"), "type", "name", F.col("version").alias("file"), "calls", "ordinal", "line_start"))
    seq, bare = F.regexp_extract("src", r"^(\d+)@", 1).cast("long"), lambda c: F.regexp_replace(c, r"^\d+@", "")
    links = inner.select(seq.alias("seq"), bare("src").alias("src"), bare("dst").alias("dst"), F.lit("CALLS").alias("relation")).join(when, "seq")
    edges = temporal.edge_lifetimes(links)
    report = life.agg(F.count(F.lit(1)).alias("nodes_tracked")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges_tracked"))).withColumn("commits_processed", F.lit(n))
    return life, edges, report
