"""Readers: JSONL with aliases, TSV, judgement files, collections, archives, pages, git exports.

Every reader refuses what it cannot read exactly: a missing id, an unknown form
or a dangling reference raises when the rows are used, it is never skipped.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import urllib.parse
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.operators.ranking import distributed_row_number

#: Names that a reader must not open, by substring.
DENIED: tuple[str, ...] = ()


def admit(name: str, denied: Sequence[str] = DENIED) -> str:
    """The name, unless it holds a denied part."""
    hit = [d for d in denied if d.lower() in name.lower()]
    if hit:
        raise PermissionError(f"{name} is denied by {hit}")
    return name


def physical_split(split: str) -> str:
    """The stored name of a logical split."""
    return {"dev": "validation"}.get(split, split)


def parquet_table(spark: SparkSession, path: str, denied: Sequence[str] = DENIED) -> DataFrame:
    return spark.read.parquet(admit(path, denied))


def collection(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus (doc_id, text), queries with judgements, and judgements, all ids as strings; title and text are joined."""
    t = F.col("title") if "title" in corpus.columns else F.lit(None).cast("string")
    c = corpus.select(F.col("doc_id").cast("string").alias("doc_id"), F.trim(F.concat_ws(" ", F.nullif(F.trim(t), F.lit("")), "text")).alias("text"))
    r = qrels.select(F.col("qid").cast("string").alias("qid"), F.col("doc_id").cast("string").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
    q = queries.select(F.col("qid").cast("string").alias("qid"), "text").join(r.select("qid").distinct(), "qid", "left_semi")
    return c, q, r


def members(registry: DataFrame) -> DataFrame:
    """(dataset, member) of (dataset, members): one row for each member corpus."""
    return registry.select("dataset", F.explode("members").alias("member"))


def jsonl(spark: SparkSession, path: str, forms: Sequence[str] | None = None, require_id: bool = True) -> DataFrame:
    """(id, text, form): text from the field text, query or question, the first that is there.

    A row without text, without id (if required) or with a form outside
    ``forms`` raises, naming the file's row.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text", "query", "question", "form")])
    x = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    text = F.coalesce("text", "query", "question")
    ok = text.isNotNull()
    if require_id:
        ok &= F.col("id").isNotNull()
    if forms is not None:
        ok &= F.coalesce(F.col("form").isin(*forms), F.lit(False))
    bad = F.concat(F.lit("a row can't be read: "), F.to_json(F.struct("id", "text", "query", "question", "form")))
    return x.select("id", text.alias("text"), "form", F.assert_true(ok, bad).alias("ok")).where("ok is null").drop("ok")


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """(index, value) of a file that holds one array of strings."""
    x = spark.read.option("multiLine", True).option("wholetext", True).text(path)
    return x.select(F.posexplode(F.from_json("value", "array<string>")).alias("index", "value"))


def tsv(spark: SparkSession, path: str, names: tuple[str, str] = ("id", "text")) -> DataFrame:
    """Two columns, split at the first tab; a line without a tab raises. Compressed files are read as they are."""
    x = spark.read.text(path)
    p = F.split("value", "\t", 2)
    return x.select(p.alias("p"), F.assert_true(F.size(p) == 2, F.lit("a line has no tab")).alias("ok")).where("ok is null").select(F.col("p")[0].alias(names[0]), F.col("p")[1].alias(names[1]))


def question_answers(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, grade) of JSON lines with qid and answer_pids."""
    x = spark.read.schema("qid string, answer_pids array<string>").option("mode", "FAILFAST").json(path)
    return x.select("qid", F.explode("answer_pids").alias("doc_id"), F.lit(1).alias("grade"))


def zip_lines(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(member, line, value) of the members of zip files; each file is one task's, members are streamed.

    Only the names of the files are rows: a task opens its archive by path,
    copies it in pieces to a file of its own and reads members from there, so an
    archive may be larger than a row or than memory.
    """
    conf = hadoop_settings(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["path"]:
                with tempfile.TemporaryFile() as local:  # this task's only; gone with it
                    for piece in read_pieces(name, conf):
                        local.write(piece)
                    local.seek(0)
                    with zipfile.ZipFile(local) as z:
                        for member in sorted(z.namelist()):
                            if not member.endswith(suffix):
                                continue
                            with z.open(member) as f:
                                rows = []
                                for n, raw in enumerate(f):
                                    rows.append((member, n, raw.decode("utf-8").rstrip("\n")))
                                    if len(rows) == 10_000:
                                        yield pd.DataFrame(rows, columns=["member", "line", "value"])
                                        rows = []
                                yield pd.DataFrame(rows, columns=["member", "line", "value"])

    return file_list(spark, path).select("path").mapInPandas(run, "member string, line long, value string")


def hadoop_settings(spark: SparkSession) -> dict[str, str]:
    """What an executor needs to open a file of the cluster's file system."""
    return {"fs": str(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS"))}


def file_list(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a folder, one file a partition at most; contents are not read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    n = max(1, x.count())
    return x.repartition(min(n, 10_000), "path")


def file_system(path: str, settings: dict[str, str]):  # noqa: ANN201
    """(file system, name in it) of a path, as an executor opens it; a path without a scheme is of the default file system."""
    import pyarrow.fs as fs  # noqa: PLC0415

    name = path if "://" in path or path.startswith("file:") else settings["fs"].rstrip("/") + path
    if name.startswith("file:"):
        return fs.LocalFileSystem(), urllib.parse.unquote(re.sub(r"^file:/+", "/", name))
    return fs.FileSystem.from_uri(name)


def read_pieces(path: str, settings: dict[str, str], size: int = 8 << 20) -> Iterator[bytes]:
    """The bytes of a file in pieces."""
    where, name = file_system(path, settings)
    with where.open_input_stream(name, compression=None) as f:
        while piece := f.read(size):
            yield piece


def text_files(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame:
    """(path, suffix, text) of files with one of the suffixes, bad bytes replaced."""
    glob = "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}"
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)

    @F.pandas_udf(T.StringType())
    def decoded(b: pd.Series) -> pd.Series:
        return b.map(lambda v: bytes(v).decode("utf-8", "replace"))

    return x.select("path", F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1).alias("suffix"), decoded("content").alias("text"))


def judged_pages(pages: DataFrame, qrels: DataFrame) -> DataFrame:
    """The judgements; one that names a missing page raises."""
    j = qrels.join(pages.select("page_id", F.lit(1).alias("__h")), "page_id", "left")
    return j.withColumn("ok", F.assert_true(F.col("__h").isNotNull(), F.lit("a judgement names a missing page"))).where("ok is null").select(*qrels.columns)


def vectors(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, vector), of the given ids only if there are some: a semi join, not a gather by position."""
    v = spark.read.parquet(path).select("doc_id", "vector")
    return v if ids is None else v.join(ids.select("doc_id"), "doc_id", "left_semi")


def verified_vectors(spark: SparkSession, path: str, manifest: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``vectors`` of files that are exactly those of a manifest (name, bytes, sha256); any other file, size or hash is an error before a row is read."""
    from .sinks import file_manifest, verify_files  # noqa: PLC0415

    bad = verify_files(file_manifest(spark, path, "*.parquet"), manifest).limit(5).collect()
    if bad:
        raise ValueError(f"the files differ from their manifest: {[(r.name, r.problem) for r in bad]}")
    return vectors(spark, path, ids)


def row_index(stores: DataFrame) -> DataFrame:
    """(store, doc_id, row_id): position over all stores in the order of store, then id; stable whatever the layout.

    Offsets of the stores are added to numbers within them.
    """
    x = stores.select("store", F.col("doc_id").cast("string").alias("doc_id")).distinct().withColumn("h", F.md5("doc_id"))
    r = distributed_row_number(x, [], ["store"], "h", ["doc_id"])
    return r.select("store", "doc_id", (F.col("rn") - 1).alias("row_id"))


def fetch(spark: SparkSession, client: Callable[[str, str | None], tuple[list[dict], str | None]], endpoints: Sequence[str], root: str) -> int:
    """Fetch all pages of each endpoint into immutable files below ``root``; returns how many pages were fetched now.

    ``client(endpoint, cursor)`` gives the rows of a page and the cursor of the
    next one, None at the end; it may be a live client or stored answers. A page is
    a file of JSON rows, named with its number, and beside it a receipt with the
    hash of its bytes and the next cursor. A later call checks every page that is
    there, goes on at the first that is missing and asks finished endpoints nothing.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    files = at("x").getFileSystem(conf)

    def read(name: str) -> bytes | None:
        if not files.exists(at(name)):
            return None
        f = files.open(at(name))
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(f))
        finally:
            f.close()

    def write(name: str, data: bytes) -> None:
        part = at(f".{name.replace('/', '_')}.part")
        f = files.create(part, True)
        f.write(bytearray(data))
        f.close()
        files.mkdirs(at(name).getParent())
        if not files.rename(part, at(name)):
            raise OSError(f"{name} could not be written")

    fetched = 0
    for endpoint in endpoints:
        base = hashlib.sha256(endpoint.encode()).hexdigest()[:24]
        number, cursor = 1, None
        while True:
            page, slip = f"{base}-{number:06d}.json", f"_receipts/{base}-{number:06d}.json"
            receipt = read(slip)
            if receipt is not None:
                known = json.loads(receipt)
                data = read(page)
                if data is None or hashlib.sha256(data).hexdigest() != known["sha256"] or known["endpoint"] != endpoint:
                    raise ValueError(f"page {number} of {endpoint} is not what was fetched")
            else:
                rows, following = client(endpoint, cursor)
                data = ("[" + ",".join(dumps(r) for r in rows) + "]").encode()
                if read(page) is None:
                    write(page, data)
                known = {"endpoint": endpoint, "sha256": hashlib.sha256(data).hexdigest(), "next": following}
                if hashlib.sha256(read(page)).hexdigest() != known["sha256"]:
                    raise ValueError(f"page {number} of {endpoint} changed while it was fetched")
                write(slip, dumps(known).encode())
                fetched += 1
            if known["next"] is None:
                break
            number, cursor = number + 1, known["next"]
    return fetched


def api_pages(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """Rows of stored API pages: each file one JSON array, with ``page_file``."""
    inner = schema if isinstance(schema, str) else schema.simpleString()
    x = spark.read.option("wholetext", True).text(root).select(F.input_file_name().alias("page_file"), F.explode(F.from_json("value", f"array<{inner}>")).alias("r"))
    return x.select("page_file", "r.*")


def next_cursor(link: Column) -> Column:
    """The URL with rel="next" of a Link header, null if there is none."""
    return F.nullif(F.regexp_extract(link, r'<([^>]+)>\s*;\s*rel="next"', 1), F.lit(""))


def canonical_key(kind: Column, node_id: Column, ident: Column) -> Column:
    """Identity of an API row: node id, else fallback:kind:id."""
    return F.coalesce(F.nullif(node_id, F.lit("")), F.concat_ws(":", F.lit("fallback"), kind, ident.cast("string")))


def discussion_units(rows: DataFrame, min_comment_chars: int = 20) -> DataFrame:
    """Units of API rows (kind, source_id, artifact_id, title, body, author, created_at): openings, comments of ``min_comment_chars`` or more, and events that are not indexable."""
    bot = F.coalesce(F.col("author").endswith("[bot]"), F.lit(False))
    text = X.clean_body(F.coalesce("body", F.lit("")), bot)
    keep = ~F.col("kind").rlike("comment$") | (F.length(text) >= min_comment_chars)
    return rows.where(keep).select(X.stable_id(F.col("kind"), F.col("source_id").cast("string")).alias("doc_id"), "kind", "artifact_id", "title", text.alias("text"), X.urls(text).alias("outbound_links"), "created_at", (~F.col("kind").rlike("event$")).alias("indexable"))


def dumps(row: dict) -> str:
    """Canonical JSON: sorted keys, no blanks."""
    return json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
