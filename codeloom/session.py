"""Session set-up and the one way in which the library cuts lineage.

Intermediate results that are read more than once are written as Parquet below
the folder that the session names in ``spark.checkpoint.dir``.  All executors
share that folder, so a lost executor costs a re-read and no recomputation.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_WRITTEN: list[tuple[SparkSession, str, str | None]] = []  # session, folder, table in the session's catalog


def build_session(master: str = "local[*]", app: str = "codeloom", **conf: str) -> SparkSession:
    """A session with the settings this library expects (UTC, adaptive execution, Arrow)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode, where none is set, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    known = getattr(spark.sparkContext, "_codeloom_folder", None)
    if known is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext._codeloom_folder = known
    return known


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it on their path."""
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    on_path = {os.path.realpath(x) for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x}
    if str(root) in on_path or getattr(sc, "_codeloom_shipped", False):
        return
    where = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="codeloom-"), "codeloom"), "zip", root, "codeloom")
    sc.addPyFile(where)  # sent to the executors by the driver
    sc._codeloom_shipped = True


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, deleted by ``sweep`` and at the end."""
    path = new_path(spark, name)
    _WRITTEN.append((spark, path, None))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written table.

    With ``by`` the table is bucketed by that column in as many buckets as there
    are shuffle partitions: joins and groupings on it move no rows of it.
    """
    return observed(df, name, by)[0]


def observed(df: DataFrame, name: str, by: str | None = None, aligned: bool = False, **sums: Column) -> tuple[DataFrame, dict]:
    """``materialize`` and, of the rows written, the aggregates ``sums``, in one job.

    ``aligned`` says that the rows lie as their buckets do already, as after a
    join of bucketed tables.  The sums are taken in the last stage, so that rows of
    a stage that ran twice count once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    seen = Observation() if sums else None
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartition(buckets, by) if by and not aligned else df
    out = out.observe(seen, *(c.alias(k) for k, c in sums.items())) if seen else out
    table = None
    if by is None:
        out.write.parquet(path)
    else:
        table = "codeloom_" + os.path.basename(path).replace("-", "_")
        out.write.bucketBy(buckets, by).option("path", path).format("parquet").saveAsTable(table)
    _WRITTEN.append((spark, path, table))
    read = spark.table(table) if table else spark.read.schema(schema).parquet(path)
    read._codeloom_path = path
    return read, dict(seen.get) if seen else {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it is a written table already, else a written copy."""
    return df if getattr(df, "_codeloom_path", None) else materialize(df, name)


def spread(df: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as there are cores, for work that costs much CPU a row.

    Only small inputs are moved: a large one has more splits than cores already.
    ``df`` must be a scan with projections and filters.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    paths = {getattr(df, "_codeloom_path", None) for df in tables}
    for entry in [x for x in _WRITTEN if x[1] in paths]:
        _drop(*entry)
        _WRITTEN.remove(entry)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is written inside is deleted at the end, but for the tables handed to the function it gives."""
    before, kept = len(_WRITTEN), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(getattr(df, "_codeloom_path", None))
        return df

    try:
        yield keep
    finally:
        mine = [x for x in _WRITTEN[before:] if x[1] not in kept]
        for entry in mine:
            _drop(*entry)
            _WRITTEN.remove(entry)


def _drop(spark: SparkSession, path: str, table: str | None) -> None:
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    drop_path(spark, path)


def sweep() -> None:
    """Delete all tables that ``materialize`` wrote; DataFrames that read them are dead then."""
    for entry in _WRITTEN:
        _drop(*entry)
    _WRITTEN.clear()


@atexit.register
def _clean() -> None:
    for entry in _WRITTEN:
        try:
            _drop(*entry)
        except Exception:  # the session may be gone already
            return
