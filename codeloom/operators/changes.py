"""Processing only new or changed records.

Change logs are read by offset, the time at which a row landed, within the
partition in which it came.  Before a batch is worked on, its plan - the offset
that each partition of each log has reached - is written ahead to the shared
folder; a batch that failed is replayed from its plan, never planned anew.  The
sink keeps one row for each key and batch, so whatever is replayed or delivered
again changes nothing, and hands on the keys whose state differs from the last.

``ChangeCapture`` is the operator.  Batches that are planned but not committed are
replayed together, in one pass over the rows between their offsets: one batch
behind the logs, or a whole history of runs (``changes_by_run``), is the same work.

Defined results: rows with a null or blank key or a null offset are never seen;
repeated rows are one; of rows with equal ``version`` the one that landed last
counts, then the greater state; rows that land after the last run wait; empty
logs or no successful run give an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.normal import filled, norm_id
from codeloom.session import scratch, ship, spread

_CHANGE = "batch long, tbl string, key string, version timestamp_ntz, state string, part string, offset long, changed boolean"


def successful_runs(runs: DataFrame) -> list[tuple[int, int]]:
    """(run_id, start in micros) of each successful run, in order.

    A run counts as successful if any of its rows says so.  What failed runs
    would have taken falls to the next successful one.  The log of runs is a
    control table: 16 bytes a successful run come to the driver.
    """
    good = (
        runs.where(F.col("run_id").isNotNull())
        .groupBy("run_id")
        .agg(F.min("started_at").alias("at"), F.max(norm_id("status") == "succeeded").alias("good"))
        .where("good and at is not null")
        .select("run_id", _micros("at").alias("at"))
    )
    return [(r.run_id, r.at) for r in good.orderBy("at", "run_id").collect()]


def _micros(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def compared(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, batch, now, was): the newest row (version, offset, state, part) of each key up to each of its batches and before it.

    Rows are reduced to one for each key and batch before the shuffle; what a
    window then sees of one key is bounded by the number of batches.
    """
    news = rows.groupBy(*keys, "batch").agg(F.max(F.struct("version", "offset", "state", "part")).alias("news"))
    w = W.partitionBy(*keys).orderBy("batch")
    return news.select(*keys, "batch", F.max("news").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("now"), F.max("news").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("was"))


def _with_part(log: DataFrame, table: DataFrame) -> DataFrame:
    return log if "repo_id" not in table.columns else log.withColumn("part", F.coalesce(norm_id("_part"), F.lit(""))).drop("_part")


def file_log(file_hashes: DataFrame) -> DataFrame:
    """The log of file states: the hash, null when the file was gone; a repository is a partition of it."""
    part = [F.col("repo_id").alias("_part")] if "repo_id" in file_hashes.columns else []
    rows = file_hashes.where(filled("file") & F.col("landed_at").isNotNull())
    return _with_part(rows.select(F.col("file").alias("key"), F.col("indexed_at").alias("version"), norm_id("hash").alias("state"), F.col("landed_at").alias("offset"), *part), file_hashes)


def node_log(nodes: DataFrame) -> DataFrame:
    """The log of node states: the time of indexing; a repository is a partition of it."""
    part = [F.col("repo_id").alias("_part")] if "repo_id" in nodes.columns else []
    rows = nodes.where(filled("id") & F.col("landed_at").isNotNull())
    return _with_part(rows.select(norm_id("id").alias("key"), F.col("indexed_at").alias("version"), F.col("indexed_at").cast("string").alias("state"), F.col("landed_at").alias("offset"), *part), nodes)


def changes_by_run(runs: DataFrame, logs: dict[str, DataFrame]) -> DataFrame:
    """(run_id, tbl, rec, state) for every successful run and each log by name.

    Each run's batch is planned, all plans are written ahead, and what they
    planned is replayed into the sink, from which the result is read.
    """
    spark = runs.sparkSession
    c = ChangeCapture(spark, scratch(spark, "capture"))
    c.plan_ahead(logs, successful_runs(runs))
    c.replay(logs)
    return c.taken().select(F.col("run").alias("run_id"), "tbl", F.col("key").alias("rec"), "state")


def _parted(log: DataFrame) -> DataFrame:
    """(part, key, version, state, offset in micros); one partition where nothing is known of it."""
    part = F.coalesce(F.col("part").cast("string"), F.lit("")) if "part" in log.columns else F.lit("")
    return log.where("offset is not null").select(part.alias("part"), "key", "version", "state", _micros("offset").alias("offset"))


def _step(ends: dict[str, Sequence[int]]) -> Callable[[Column, Column], Column]:
    """(part, offset) to the first of the part's ``ends`` (ascending) that isn't before the offset; binary search in Arrow batches."""
    held = {k: np.asarray(v, np.int64) for k, v in ends.items()}

    def find(part, offset):
        import pandas as pd

        out = np.zeros(len(offset), np.int64)
        names, at = np.unique(part.to_numpy().astype(str), return_inverse=True)
        for i, name in enumerate(names):
            mine = at == i
            out[mine] = np.searchsorted(held.get(name, held.get("*", np.zeros(0, np.int64))), offset.to_numpy()[mine], "left")
        return pd.Series(out)

    return F.pandas_udf(find, "long")


@dataclass(frozen=True)
class BatchPlan:
    """One line of the write-ahead log: the offsets (micros) of each part of each log, from low, which the batch before has seen too, to high."""

    batch: int
    low: dict[str, dict[str, int]]
    high: dict[str, dict[str, int]]
    run: int | None = field(default=None)


class ChangeCapture:
    """Durable batches over change logs.

    ``root`` (a folder all executors share) holds ``plans/N.json``, written before
    batch N is worked on, ``sink/from=N``, what batch N and those replayed with it
    brought, overwritten by each attempt, and ``done/N-M``, written last and at
    once for all of them.  A record is taken over once however often its batch
    fails.

    A log may have a column ``part``, the partition in which a row came; offsets
    are planned for each, so one that lags loses nothing.  Rows at the planned
    high itself are read again by the next batch, as more of them may land; rows
    that the sink knows change nothing.  A plan has an entry for each partition,
    so partitions should be shards or repositories, not files.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- the write-ahead log

    def _names(self, kind: str) -> list[str]:
        where = self._path(f"{self.root}/{kind}")
        if not self._fs.exists(where):
            return []
        return [n for x in self._fs.listStatus(where) if (n := x.getPath().getName())[0].isdigit() and not n.endswith(".tmp")]

    def _groups(self) -> list[tuple[int, int]]:
        """First and last batch of each committed group."""
        return sorted(tuple(map(int, n.split("-"))) for n in self._names("done"))

    def _put(self, name: str, text: str) -> None:
        """Write and rename, so that a plan or commit is there whole or not at all."""
        half, whole = self._path(f"{self.root}/{name}.tmp"), self._path(f"{self.root}/{name}")
        out = self._fs.create(half, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(half, whole):
            raise OSError(f"{name} exists already")

    def plans(self) -> list[BatchPlan]:
        """All plans, in order."""
        if not self._names("plans"):
            return []
        texts = self.spark.read.text(f"{self.root}/plans/*.json", wholetext=True).collect()
        return sorted((BatchPlan(**json.loads(t.value)) for t in texts), key=lambda p: p.batch)

    def pending(self) -> list[BatchPlan]:
        done = self._groups()
        return [p for p in self.plans() if not any(a <= p.batch <= b for a, b in done)]

    def plan_ahead(self, logs: dict[str, DataFrame], ends: Sequence[tuple[int | None, int | None]] = ((None, None),)) -> list[BatchPlan]:
        """Plan a batch for each of ``ends`` (run, micros, ascending): what has landed by then, or all without a time."""
        known = self.plans()
        last = known[-1] if known else BatchPlan(0, {}, {})
        far = np.iinfo(np.int64).max
        times = [far if at is None else at for _, at in ends]
        reached: dict[str, dict[str, list[int | None]]] = {}
        for name, log in logs.items():
            rows = spread(_parted(log).select("part", "offset"))
            step = _step({"*": times})(F.col("part"), F.col("offset")) if times != [far] else F.lit(0)
            # a row for each partition and end
            for r in rows.groupBy("part", step.alias("step")).agg(F.max("offset").alias("at")).collect():
                if r.step < len(times):
                    reached.setdefault(name, {}).setdefault(r.part, [None] * len(times))[r.step] = r.at
        new = []
        for i, (run, _) in enumerate(ends):
            low = last.high
            high = {name: dict(low.get(name, {})) for name in logs}
            for name, parts in reached.items():
                for part, at in parts.items():
                    if at[i] is not None:
                        high[name][part] = max(at[i], high[name].get(part, at[i]))
            last = BatchPlan(last.batch + 1, {name: low.get(name, {}) for name in logs}, high, run)
            self._put(f"plans/{last.batch}.json", json.dumps(asdict(last)))
            new.append(last)
        return new

    # ---- the sink

    def _sink(self, groups: Sequence[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.root}/sink/from={a}" for a, _ in groups]
        return self.spark.read.schema(_CHANGE).parquet(*paths) if paths else self.spark.createDataFrame([], _CHANGE)

    def _last(self) -> DataFrame:
        """The newest row of each key: the last compacted state and the groups since."""
        upto = max((int(n) for n in self._names("compacted")), default=0)
        rows = self._sink([g for g in self._groups() if g[0] > upto])
        if upto:
            rows = rows.unionByName(self.spark.read.schema(_CHANGE).parquet(f"{self.root}/state/upto={upto}"))
        return rows

    def compact(self) -> None:
        """Write the last state of each key, so that later batches needn't read the whole sink."""
        groups = self._groups()
        if groups:
            newest = F.max_by(F.struct("batch", "version", "state", "part", "offset", "changed"), F.struct("version", "offset", "state", "part"))
            rows = self._last().groupBy("tbl", "key").agg(newest.alias("x")).select("tbl", "key", "x.*")
            rows.write.mode("overwrite").parquet(f"{self.root}/state/upto={groups[-1][1]}")
            self._put(f"compacted/{groups[-1][1]}", "")

    def replay(self, logs: dict[str, DataFrame], work: Callable[[DataFrame], None] | None = None) -> list[BatchPlan]:
        """Work on all planned batches that aren't committed; ``work`` gets the rows (batch, tbl, key, version, state, part, offset) that change a key's state."""
        todo = self.pending()
        if not todo:
            return []
        ship(self.spark)
        first, last = todo[0].batch, todo[-1].batch
        out = None
        for name, log in logs.items():
            parts = sorted({p for plan in todo for p in plan.high.get(name, {})})
            ends = {p: [plan.high.get(name, {}).get(p, -(2**63)) for plan in todo] for p in parts}
            spans = [(p, todo[0].low.get(name, {}).get(p), ends[p][-1]) for p in parts]
            spans = F.broadcast(self.spark.createDataFrame(spans, "part string, lo long, hi long"))  # a row a partition
            rows = _parted(log).join(spans, "part").where((F.col("offset") <= F.col("hi")) & (F.col("lo").isNull() | (F.col("offset") >= F.col("lo"))))
            step = _step(ends)(F.col("part"), F.col("offset")) if len(todo) > 1 else F.lit(0)
            rows = rows.select(F.lit(name).alias("tbl"), "key", "version", "state", "part", "offset", (F.lit(first) + step).cast("long").alias("batch"))
            out = rows if out is None else out.unionByName(rows)
        rows = out
        if self._groups():
            touched = out.select("tbl", "key").distinct()
            known = self._last().join(touched, ["tbl", "key"], "left_semi").withColumn("batch", F.lit(first - 1).cast("long"))
            rows = out.unionByName(known.select(*out.columns))
        new = compared(rows, "tbl", "key").where((F.col("batch") >= first) & ~F.struct("now.version", "now.state", "now.offset").eqNullSafe(F.struct("was.version", "was.state", "was.offset")))
        # rows that are newer but change nothing stay too: what lands later is measured against them
        changed = ~F.col("now.state").eqNullSafe(F.col("was.state"))
        new.select("batch", "tbl", "key", "now.version", "now.state", "now.part", "now.offset", changed.alias("changed")).write.mode("overwrite").parquet(f"{self.root}/sink/from={first}")
        if work:
            work(self._sink([(first, last)]).where("changed").drop("changed"))
        self._put(f"done/{first}-{last}", "")
        return todo

    def run(self, logs: dict[str, DataFrame], work: Callable[[DataFrame], None] | None = None) -> BatchPlan:
        """Take over what failed before, or else one new batch."""
        if not self.pending():
            self.plan_ahead(logs)
        return self.replay(logs, work)[-1]

    def taken(self) -> DataFrame:
        """(batch, run, tbl, key, offset, version, state): the changes that the committed batches hold."""
        rows = self._sink(self._groups()).where("changed").select("batch", "tbl", "key", "offset", "version", "state")
        runs = self.spark.createDataFrame([(p.batch, p.run) for p in self.plans()], "batch long, run long")  # a row a batch
        return rows.join(F.broadcast(runs), "batch").select("batch", "run", "tbl", "key", "offset", "version", "state")
