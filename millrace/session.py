"""Session settings, staged tables and skew-safe joins shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import math
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes a side may have to be broadcast by ``bounded_broadcast``.
BROADCAST_BYTES = 32 << 20
#: Copies of the small side in a salted join, that is the pieces of a hot key.
SALTS = 8

_local_dirs: dict[str, str] = {}
_staged: list[tuple[SparkSession, str]] = []


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, skew joins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a folder of this machine; elsewhere a missing setting is an error,
    as the executors would not see the files of one another.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _local_dirs[app], True)
    return "file://" + _local_dirs[app]


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The written files survive the loss of executors, keep column pruning and
    carry the real size for the planner. They are removed by
    ``release_staged`` or when the driver ends.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str = "t") -> str:
    """A new path in the shared folder, not made yet, that goes with the staged tables: for runs, streams and archives that need a folder of their own."""
    path = f"{shared_dir(spark)}/millrace-{os.getpid()}/{name}-{uuid.uuid4().hex[:12]}"
    _staged.append((spark, path))
    return path


def release_staged() -> int:
    """Delete all staged tables of this process; DataFrames on them end there."""
    n = 0
    while _staged:
        spark, path = _staged.pop()
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            n += 1
    return n


atexit.register(release_staged)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df`` in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Nodes of a plan after which the planner's size is a guess that may be too low, and rows of the driver, which have none at all.
_GUESSED = ("Generate", "Join", "Expand", "MapInArrow", "MapInPandas", "FlatMapGroups", "CoGroup", "LogicalRDD")
#: Bytes in memory for one byte of a written table, at most.
UNPACKED = 8


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the size is at most ``limit`` bytes.

    The planner's estimate counts where it can't be too low. After rows are
    exploded or joined it is a guess; such a side is written first and its real
    size is taken, ``UNPACKED`` times as it is compressed. Rows made by the driver
    count as endless, so without a hint the planner would broadcast the other side.
    """
    estimate = plan_bytes(df)
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    if not any(n in tree for n in _GUESSED):
        return F.broadcast(df) if estimate <= limit else df
    written = stage(df, "side")
    return F.broadcast(written) if plan_bytes(written) * UNPACKED <= limit else written


def row_salt(salts: int, *cols: str | Column) -> Column:
    """A salt in [0, salts) that depends on the row's own values only."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join where one key of ``big`` may hold a third of all rows.

    ``small`` has few rows for a key and is copied ``salts`` times; ``big`` gets
    a salt from its ``spread`` columns, so the rows of a hot key go to as many
    tasks. ``how`` is inner, left, left_semi or left_anti. It is made of shuffles:
    the planner does not count the copies, and would broadcast them.
    """
    b = big.withColumn("__salt", row_salt(salts, *spread))
    s = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s.hint("merge"), [*on, "__salt"], how).drop("__salt")


def partitions_for(spark: SparkSession, total_bytes: float, each: int = 64 << 20) -> int:
    """Partitions so that each holds about ``each`` bytes, at least the default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_bytes / each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input has too few pieces for them, as one small file has; else unchanged.

    Large inputs have far more pieces than cores, so they are never shuffled for it.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if 2 * have > want else df.repartition(want)
