"""The live graph: file events in, deltas and fresh scores out.

Events are (file, content, ts); null content is a tombstone.  Each micro-batch
keeps the last event of each file, parses it, compares its symbols with the
stored ones, writes the symbols of the touched files and one delta row for each
file.  The state is the last version of each file over all batches, compacted
now and then, so a batch costs what it touches; scores are worked out on the
links around what changed, found by name, not on the whole graph.  A batch is
committed last, and one that is delivered again is skipped, so each event counts
once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.functions.normal import latest
from codeloom.operators.graph import local_pagerank, symmetrize
from codeloom.session import drop_path, materialize, passing
from codeloom.sources.ingest import call_edges, parse_files
from codeloom.sources.scan import wanted

EVENTS = "file string, content binary, ts timestamp"
DELTAS = "file string, added array<string>, removed array<string>, changed array<string>, ts timestamp, pagerank_updated long"
STATE = "file string, ordinal int, type string, name string, signature string, docstring string, line_start int, line_end int, calls array<string>, id string"


def around(symbols: DataFrame, ids: DataFrame, radius: int) -> DataFrame:
    """Symbols that hold all links which touch anything within ``radius`` calls of ``ids`` (id).

    Each step keeps whatever has a name that its symbols have or call, or calls
    such a name: joins with short lists of names instead of resolving all calls.
    """
    near = symbols.join(ids.select("id").distinct(), "id", "left_semi")
    for _ in range(radius + 1):
        near = materialize(near, "near")
        names = near.where("type <> 'file'").select("name")
        said = names.union(near.select(F.explode("calls"))).where("name is not null").distinct()
        callers = symbols.select("id", F.explode("calls").alias("name")).join(names.distinct(), "name", "left_semi").select("id")
        found = symbols.join(said, "name", "left_semi").select("id").union(callers).union(near.select("id")).distinct()
        near = symbols.join(found, "id", "left_semi")
    return near


class LiveGraph:
    """``root`` is a folder all executors share: state/batch=N and files/batch=N (what a batch touched), base/N, deltas/batch=N, scores/batch=N, done/N."""

    def __init__(self, spark: SparkSession, root: str, radius: int = 2, score: bool = True, rounds: int | None = None, compact_every: int = 32):
        self.spark, self.root, self.radius, self.score, self.rounds, self.compact_every = spark, root.rstrip("/"), radius, score, rounds, compact_every
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        where = self._path(f"{self.root}/{kind}")
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _done(self) -> list[int]:
        return self._numbers("done")

    def _mark(self, name: str) -> None:
        self._fs.create(self._path(f"{self.root}/{name}"), True).close()

    def _batches(self, kind: str, schema: str, numbers: list[int]) -> DataFrame:
        paths = [f"{self.root}/{kind}/batch={n}" for n in numbers]
        read = self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.root}/{kind}")
        return read.parquet(*paths) if paths else self.spark.createDataFrame([], f"{schema}, batch long")

    def symbols(self, files: DataFrame | None = None) -> DataFrame:
        """The symbols as of the last committed batch, or those of ``files`` (file)."""
        base = max(self._numbers("compacted"), default=-1)
        later = [n for n in self._done() if n > base]
        some = (lambda df: df.join(files.select("file"), "file", "left_semi")) if files is not None else lambda df: df
        last = some(self._batches("files", "file string", later)).groupBy("file").agg(F.max("batch").alias("batch"))
        new = self._batches("state", STATE, later).join(last, ["file", "batch"], "left_semi").drop("batch")
        if base < 0:
            return new
        old = some(self.spark.read.schema(STATE).parquet(f"{self.root}/base/{base}"))
        return old.join(last.select("file"), "file", "left_anti").unionByName(new)

    def deltas(self) -> DataFrame:
        return self._batches("deltas", DELTAS, self._done()).drop("batch")

    def stats(self) -> DataFrame:
        """(batches, files, symbols, added, removed, changed): one row, for periodic reports."""
        n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c)
        moved = self.deltas().agg(n("added"), n("removed"), n("changed"))
        held = self.symbols().agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("symbols"))
        return held.crossJoin(moved).select(F.lit(len(self._done())).cast("long").alias("batches"), "files", "symbols", "added", "removed", "changed")  # one row each

    def scores(self) -> DataFrame:
        """Local scores around what the last batch changed."""
        done = self._done()
        where = f"{self.root}/scores/batch={done[-1]}" if done else None
        empty = self.spark.createDataFrame([], "id string, score double")
        return self.spark.read.parquet(where) if where and self._fs.exists(self._path(where)) else empty

    def compact(self) -> None:
        """Write the state as one table; a reader of the older one isn't disturbed."""
        done, bases = self._done(), self._numbers("compacted")
        if done and done[-1] not in bases:
            self.symbols().write.mode("overwrite").parquet(f"{self.root}/base/{done[-1]}")
            self._mark(f"compacted/{done[-1]}")
            for n in bases[:-1]:  # the base before stays for a reader
                self._fs.delete(self._path(f"{self.root}/compacted/{n}"), False)
                drop_path(self.spark, f"{self.root}/base/{n}")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take over one micro-batch; a batch that is committed already is left alone."""
        if number in self._done():
            return
        with passing():
            events = materialize(latest(batch.where(wanted("file")), F.col("file"), [F.col("ts")], [F.col("content"), F.col("ts")], "file"), "events")
            old = self.symbols(events)
            parse_files(events).write.mode("overwrite").parquet(f"{self.root}/state/batch={number}")
            events.select("file").write.mode("overwrite").parquet(f"{self.root}/files/batch={number}")
            new = self.spark.read.schema(STATE).parquet(f"{self.root}/state/batch={number}")
            both = old.select("file", "id", F.lit(True).alias("was")).join(new.select("file", "id", F.lit(True).alias("now")), ["file", "id"], "full")
            ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("id"))))  # noqa: E731  # one file's symbols
            sets = both.groupBy("file").agg(
                ids(F.col("was").isNull()).alias("added"), ids(F.col("now").isNull()).alias("removed"), ids(F.col("was").isNotNull() & F.col("now").isNotNull()).alias("changed")
            )
            none = F.array().cast("array<string>")
            out = events.select("file", "ts").join(sets, "file", "left").select("file", *(F.coalesce(c, none).alias(c) for c in ("added", "removed", "changed")), "ts")
            out = materialize(out, "deltas")
            scored = self._score(out, new, events, number) if self.score else 0
            out.withColumn("pagerank_updated", F.lit(scored).cast("long")).write.mode("overwrite").parquet(f"{self.root}/deltas/batch={number}")
        self._mark(f"done/{number}")
        if len([n for n in self._done() if n > max(self._numbers("compacted"), default=-1)]) >= self.compact_every:
            self.compact()

    def _score(self, deltas: DataFrame, new: DataFrame, events: DataFrame, number: int) -> int:
        """Write the scores around what changed; how many there are."""
        now = self.symbols().join(events.select("file"), "file", "left_anti").unionByName(new)
        changed = deltas.select(F.explode(F.concat("added", "changed")).alias("id"))
        some = materialize(around(now, changed, self.radius), "around")
        ranks = local_pagerank(symmetrize(some, call_edges(some)), changed.join(now, "id", "left_semi"), self.radius, self.rounds)
        ranks.write.mode("overwrite").parquet(f"{self.root}/scores/batch={number}")
        return self.spark.read.parquet(f"{self.root}/scores/batch={number}").count()

    def start(self, events: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Run over a stream of events; ``once`` takes what is there and ends."""
        w = events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w).start()


def watch(spark: SparkSession, folder: str, files_at_once: int = 1_000) -> DataFrame:
    """File events from Parquet files that appear in ``folder``."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", str(files_at_once)).parquet(folder)
