"""Writers, manifests and their verification."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import stage

from .readers import file_list, file_system, hadoop_settings, read_pieces


def save_run(run: DataFrame, path: str, system: str, dataset: str) -> DataFrame:
    """Write (qid, doc_id, score, rank) under system and dataset and return its manifest row.

    The partition is written once; writing it again is an error, as a result
    must never change under its name.
    """
    part = f"{path}/dataset={dataset}/system={system}"
    run.select("qid", "doc_id", "score", "rank").write.mode("errorifexists").parquet(part)
    return run_manifest(run.sparkSession, part)


def run_manifest(spark: SparkSession, part: str) -> DataFrame:
    """One row: (rows, queries, depth, digest); the digest does not depend on order or files."""
    x = spark.read.parquet(part)
    row = F.conv(F.substring(F.md5(F.to_json(F.struct("qid", "doc_id", "score", "rank"))), 1, 15), 16, 10).cast("decimal(38,0)")
    return x.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("qid").alias("queries"), F.max("rank").alias("depth"), F.sum(row).cast("string").alias("digest"))


def load_run(spark: SparkSession, part: str, digest: str | None = None, depth: int | None = None) -> DataFrame:
    """The run, if its digest and depth are as expected."""
    m = run_manifest(spark, part).first()
    if digest is not None and m.digest != digest:
        raise ValueError("the run is not the one that was saved")
    if depth is not None and (m.depth or 0) > depth:
        raise ValueError("the run is deeper than expected")
    return spark.read.parquet(part)


def write_once(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Write a table that must not exist yet; Spark's commit makes it appear whole or not at all."""
    df.write.mode("errorifexists").options(**options).format(fmt).save(path)


def write_jsonl(df: DataFrame, path: str, order: Sequence[str] = (), compressed: bool = False) -> None:
    """JSON lines with fields in the order of their names."""
    x = df.select(*sorted(df.columns))
    x = x.sort(*order) if order else x
    write_once(x, path, "json", **({"compression": "gzip"} if compressed else {}))


def write_tsv(df: DataFrame, path: str, compressed: bool = False) -> None:
    """Lines of the columns with tabs between them, as strings. A line break in a value is an error, as is a tab in any but the last; null is an empty value."""
    *lead, last = df.columns
    ok = ~F.coalesce(F.col(last).cast("string"), F.lit("")).rlike("[\n\r]")
    for c in lead:
        ok &= ~F.coalesce(F.col(c).cast("string"), F.lit("")).rlike("[\t\n\r]")
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    x = df.select(line.alias("value"), F.assert_true(ok, F.lit("a value can't be written in a line")).alias("ok")).where("ok is null").select("value")
    write_once(x, path, "text", **({"compression": "gzip"} if compressed else {}))


def write_files(files: DataFrame, path: str) -> int:
    """Write (name, content) as one file each, from the executors' rows through the driver's file system, some at a time; returns their number."""
    spark = files.sparkSession
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    where = at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 0
    for r in files.select("name", "content").toLocalIterator():  # a partition at a time
        out = where.create(at(r.name), True)
        out.write(bytearray(r.content))
        out.close()
        n += 1
    return n


def file_manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(name, bytes, sha256) of the files below a folder, hashed in pieces by the executors; bookkeeping files left out."""
    settings = hadoop_settings(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = []
            for path in pdf["path"]:
                h = hashlib.sha256()
                for piece in read_pieces(path, settings):
                    h.update(piece)
                sums.append(h.hexdigest())
            yield pdf.assign(sha256=sums)

    x = file_list(spark, root, pattern).mapInPandas(run, "path string, length long, sha256 string")
    name = F.regexp_replace(F.col("path"), r"^.*?" + _escaped(root), "")
    return x.select(F.regexp_replace(name, "^/+", "").alias("name"), F.col("length").alias("bytes"), "sha256").where(~F.col("name").rlike(r"(^|/)[._]"))


def _escaped(root: str) -> str:
    bare = root.split(":", 1)[1] if ":" in root.split("/")[0] else root
    return "".join("\\" + c if not c.isalnum() and c != "/" else c for c in "/" + bare.strip("/"))


def verify_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, problem): missing, extra or changed; empty if all is as written."""
    f = found.select("name", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    j = manifest.join(f, "name", "full")
    p = F.when(F.col("s").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when((F.col("s") != F.col("sha256")) | (F.col("b") != F.col("bytes")), "changed")
    return j.select("name", p.alias("problem")).where("problem is not null")


def archive_corpus(docs: DataFrame, path: str, each: int = 100_000) -> DataFrame:
    """Compressed JSON lines below ``path`` and their manifest (name, rows, bytes, sha256); equal corpora give equal files, byte by byte.

    Rows go to a file by a hash of doc_id and lie in it in the order of doc_id,
    then of the line itself; the number of files depends on the number of rows
    only, about ``each`` in one. Each task writes whole files under their final
    names, so a task that is run again writes the same.
    """
    spark = docs.sparkSession
    n = max(1, -(-docs.count() // each))
    settings = hadoop_settings(spark)
    line = F.to_json(F.struct(*sorted(docs.columns)))
    x = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(n)).alias("file"), "doc_id", line.alias("line"))
    x = x.repartition(min(n, 10_000), "file").sortWithinPartitions("file", "doc_id", "line").select("file", "line")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, out = None, 0, None
        done = []

        def close() -> None:
            if out is not None:
                done.append((f"part-{now:06d}.jsonl.gz", rows, *out.finish()))

        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["line"], strict=True):
                if file != now:
                    close()
                    now, rows, out = file, 0, _Packed(f"{path}/part-{file:06d}.jsonl.gz", settings)
                out.write(text.encode() + b"\n")
                rows += 1
        close()
        yield pd.DataFrame(done, columns=["name", "rows", "bytes", "sha256"])

    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if where.exists(made):
        raise FileExistsError(f"{path} already exists")
    where.mkdirs(made)
    return stage(x.mapInPandas(run, "name string, rows long, bytes long, sha256 string"), "archive")


class _Packed:
    """A gzip file without name and time, hashed while it is written; it appears under its name when it is whole."""

    def __init__(self, path: str, settings: dict[str, str]):
        where, name = file_system(path, settings)
        self.where, self.name, self.part = where, name, f"{name}.{uuid.uuid4().hex}.part"
        self.out = where.open_output_stream(self.part, compression=None)
        self.pack, self.sha, self.size = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha256(), 0

    def _put(self, data: bytes) -> None:
        if data:
            self.sha.update(data)
            self.size += len(data)
            self.out.write(data)

    def write(self, data: bytes) -> None:
        self._put(self.pack.compress(data))

    def finish(self) -> tuple[int, str]:
        self._put(self.pack.flush())
        self.out.close()
        self.where.move(self.part, self.name)
        return self.size, self.sha.hexdigest()


def table_identity(df: DataFrame) -> DataFrame:
    """One row: (rows, identity), a digest of the content that does not depend on order or layout."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(row).cast("string"), F.lit(",".join(sorted(df.columns)))), 256).alias("identity"))


def cached(spark: SparkSession, root: str, identity: str, build, name: str = "table") -> DataFrame:
    """The table kept under an identity, built once; another identity is another table."""
    path = f"{root}/{name}-{identity}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def encode_shards(rows: DataFrame, ident: str, root: str, shards: int, encode: Callable[[DataFrame, int], DataFrame]) -> list[int]:
    """Encode ``rows`` in shards by a hash of their id, each written once below ``root``; returns the shards that were written now.

    A shard is done when its table was committed, so a broken-off run goes on at
    the first one missing. The number of shards and the rows' identity are kept
    with them; other rows or another number are refused.
    """
    spark = rows.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    where = at("x").getFileSystem(conf)
    plan = f"plan-{shards}-{table_identity(rows).first().identity[:24]}"
    if where.exists(at("")) and not where.exists(at(plan)):
        raise ValueError("the shards below this folder are of other rows or of another number")
    where.mkdirs(at(plan))
    written = []
    part = F.pmod(F.xxhash64(F.col(ident).cast("string")), F.lit(shards))
    for i in range(shards):
        if not where.exists(at(f"shard={i}/_SUCCESS")):
            encode(rows.where(part == i), i).write.mode("overwrite").parquet(f"{root}/shard={i}")
            written.append(i)
    return written
