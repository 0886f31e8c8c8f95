"""Structured Streaming: append-only logs, late data, first-wins identity, incremental encoding, windows, monitors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def append_log(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files: int = 100) -> DataFrame:
    """A growing folder of immutable files as a stream; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def admitted(stream: DataFrame, created: str, cutoff: str) -> DataFrame:
    """Rows created by the cutoff, it included; rows without a time are left out."""
    return stream.where(F.col(created) <= F.to_timestamp(F.lit(cutoff)))


def first_wins(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """One row for each key among those that arrive within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, time: str, width: str, by: str, value: str, delay: str = "10 minutes") -> DataFrame:
    """(start, by, n, total) of fixed windows."""
    g = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, by: str, delay: str = "10 minutes") -> DataFrame:
    """(by, start, end, n): windows that end after a gap."""
    g = stream.withWatermark(time, delay).groupBy(F.col(by), F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Everything at hand in micro-batches, then stop; a later run goes on where this one ended."""
    q = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    q.awaitTermination()


def encode_new(cache_path: str, key: str, encode: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A micro-batch step that encodes only keys the cache lacks and appends them under the batch's number.

    Writing a batch again replaces its own files, so a repeated batch leaves the
    cache as it was.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        jvm = spark.sparkContext._jvm
        fs_path = jvm.org.apache.hadoop.fs.Path(cache_path)
        if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            old = spark.read.parquet(cache_path).where(F.col("batch") != number).select(key)
            new = new.join(old, key, "left_anti")
        encode(new).write.mode("overwrite").parquet(f"{cache_path}/batch={number}")

    return step


def heartbeat_monitor(stream: DataFrame, job: str, time: str, silent: int) -> DataFrame:
    """(job, status, at): 'up' at a job's first beat and after silence, 'silent' when ``silent`` seconds pass without one.

    The state of a job is its last beat and status.
    """
    out = T.StructType([T.StructField("job", T.StringType()), T.StructField("status", T.StringType()), T.StructField("at", T.TimestampType())])
    kept = T.StructType([T.StructField("last", T.LongType()), T.StructField("status", T.StringType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, _ = state.get
            state.update((last, "silent"))
            yield pd.DataFrame({"job": [key[0]], "status": ["silent"], "at": [pd.Timestamp(last + silent * 1_000_000, unit="us")]})
            return
        last, status = state.get if state.exists else (0, "new")
        rows = []
        for t in sorted(int(x.value // 1000) for b in batches for x in b["t"]):
            if status != "new" and t - last > silent * 1_000_000 and status != "silent":
                rows.append((key[0], "silent", pd.Timestamp(last + silent * 1_000_000, unit="us")))
                status = "silent"
            if status != "up":
                rows.append((key[0], "up", pd.Timestamp(t, unit="us")))
                status = "up"
            last = max(last, t)
        state.update((last, status))
        deadline = (last + silent * 1_000_000) // 1000
        if deadline > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(deadline)
        if rows:
            yield pd.DataFrame(rows, columns=["job", "status", "at"])

    x = stream.select(F.col(job).cast("string").alias("job"), F.col(time).cast("timestamp").alias("t")).withWatermark("t", "0 seconds")
    return x.groupBy("job").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
