"""Event-time windows over the stream of events, and keyed latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.normal import filled, latest, norm_id
from codeloom.session import drop_path, scratch


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder as a stream, whether it is a file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): counts and sums by tumbling window.

    In append mode a window is final, and its state freed, once ``late`` has passed
    since its end; rows that come later still are dropped.
    """
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    g = e.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return its result as a written table.

    In complete mode the last batch holds the whole result, in append mode each
    batch a part of it; a batch that is written again overwrites itself.
    """
    spark = stream.sparkSession
    root = scratch(spark, "stream")
    state = {"last": -1}

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        state["last"] = max(state["last"], number)

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    read = spark.read.schema(stream.schema)
    return read.parquet(f"{root}/out/batch={state['last']}") if mode == "complete" else read.parquet(f"{root}/out").select(*stream.columns)


def file_states(hashes: DataFrame, root: str | None = None) -> DataFrame:
    """(file, hash): the last state of each file of a stream of hashes, run over what is there.

    ``root`` (else a folder of its own) holds the stream's checkpoint and the
    versions v=N of the state: batch N is merged into the newest version before
    it, so one that is delivered again overwrites itself, and a run that starts
    anew goes on where the last one ended.
    """
    spark = hashes.sparkSession
    root = root or scratch(spark, "states")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions() -> list[int]:
        where = path(f"{root}/states")
        return sorted(int(x.getPath().getName()[2:]) for x in fs.listStatus(where) if fs.exists(path(f"{root}/states/{x.getPath().getName()}/_SUCCESS"))) if fs.exists(where) else []

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.where(filled("file")).select("file", norm_id("hash").alias("hash"), "indexed_at", "landed_at")
        known = [n for n in versions() if n < number]
        both = new.unionByName(spark.read.schema(new.schema).parquet(f"{root}/states/v={known[-1]}")) if known else new
        last = latest(both, F.col("file"), [F.col("indexed_at"), F.col("landed_at")], [F.col("hash"), F.col("indexed_at"), F.col("landed_at")], "file")
        last.write.mode("overwrite").parquet(f"{root}/states/v={number}")
        for n in known[:-1]:  # the version before stays for a reader
            drop_path(spark, f"{root}/states/v={n}")

    q = hashes.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    done = versions()
    empty = spark.createDataFrame([], "file string, hash string")
    return spark.read.parquet(f"{root}/states/v={done[-1]}").select("file", "hash") if done else empty
