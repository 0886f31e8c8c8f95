"""Queries through readers and sinks: tables written in the forms that the readers read, and read back.

Each writes its whole table to a folder of its own below the shared folder, so
what is compared is what came through the form, not the table itself.
"""

from __future__ import annotations

import io
import zipfile
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import harvest
from millrace.session import scratch, stage, table
from millrace.sources import readers, sinks
from millrace.streaming import ingest

from . import sql as S
from .registry import query
from .retrieval import _KNN, documents

_TEXTS = "(SELECT doc_id, text, kind FROM documents WHERE text IS NOT NULL)"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", "text", "kind")


@query(f"SELECT doc_id::VARCHAR AS id, md5(text) AS text, kind AS form FROM {_TEXTS}")
def jsonl_rows(spark: SparkSession, d: str) -> DataFrame:
    """Texts under one of three field names, by kind."""
    path = scratch(spark, "jsonl")
    x = _texts(spark, d)
    name = F.pmod("doc_id", F.lit(3))
    sinks.write_jsonl(x.select(F.col("doc_id").cast("string").alias("id"), F.col("kind").alias("form"), *[F.when(name == i, F.col("text")).alias(n) for i, n in enumerate(("text", "query", "question"))]), path)
    kinds = [r.kind for r in x.select("kind").distinct().collect()]  # a handful
    return readers.jsonl(spark, path, kinds).select("id", F.md5("text").alias("text"), "form")


@query("SELECT index::INT AS index, md5(value) AS value FROM (SELECT row_number() OVER (ORDER BY n_name) - 1 AS index, n_name AS value FROM nation)")
def json_array_rows(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "array")
    names = table(spark, d, "nation").agg(F.to_json(F.sort_array(F.collect_list("n_name"))).alias("value"))  # 25 rows
    names.coalesce(1).write.text(path)
    return readers.json_array(spark, path).select("index", F.md5("value").alias("value"))


_FLAT = "regexp_replace(text, '[\\t\\n\\r\\x0B\\f\\x00-\\x1f\\x85\\u2028\\u2029]', ' ', 'g')".replace("\\u2028\\u2029", "  ").replace("\\x85", "\x85")


def _flat(c: str):
    return F.regexp_replace(c, "[\\t\\n\\r\\x0B\\f\\x00-\\x1f\x85  ]", " ")


@query(f"SELECT doc_id::VARCHAR AS id, md5(kind || chr(9) || {_FLAT}) AS text FROM {_TEXTS}")
def tsv_rows(spark: SparkSession, d: str) -> DataFrame:
    """Compressed lines of two columns; the second may hold tabs itself."""
    path = scratch(spark, "tsv")
    sinks.write_tsv(_texts(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("\t", "kind", _flat("text")).alias("text")), path, compressed=True)
    return readers.tsv(spark, path).select("id", F.md5("text").alias("text"))


@query("SELECT DISTINCT qid, unnest(positive_ids) AS doc_id, 1 AS grade FROM query_spec WHERE qid IS NOT NULL AND len(list_filter(positive_ids, lambda x: x IS NULL)) = 0")
def answer_judgements(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "answers")
    q = table(spark, d, "query_spec").where("qid is not null and positive_ids is not null").where(F.forall("positive_ids", lambda x: x.isNotNull()))
    q.select("qid", F.col("positive_ids").alias("answer_pids")).write.json(path)
    return readers.question_answers(spark, path).distinct()


@query("SELECT (o_orderkey % 4)::VARCHAR || '.json' AS member, md5('{\"key\":' || o_orderkey || '}') AS value FROM orders")
def zip_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines of archive members, one archive for each part of the table."""
    path = scratch(spark, "zip")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for m, g in pdf.groupby("m"):
                z.writestr(f"{m}.json", "".join(f'{{"key":{k}}}\n' for k in sorted(g["k"])))
            z.writestr("notes.txt", "no rows\n")
        return pd.DataFrame({"name": [f"part-{pdf['p'].iloc[0]}.zip"], "content": [out.getvalue()]})

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 4).alias("m"), F.pmod(F.xxhash64("o_orderkey"), F.lit(8)).alias("p"))
    sinks.write_files(o.groupBy("p").applyInPandas(pack, "name string, content binary"), path)
    return readers.zip_lines(spark, path).select("member", F.md5("value").alias("value"))


@query("SELECT n_name || '.md' AS name, '.md' AS suffix, 'About ' || n_name AS text FROM nation WHERE n_nationkey % 2 = 0")
def text_file_rows(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "files")
    n = table(spark, d, "nation")
    name = F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, ".md").otherwise(".bin"))
    sinks.write_files(n.select(name.alias("name"), F.concat(F.lit("About "), "n_name").cast("binary").alias("content")), path)
    x = readers.text_files(spark, path, [".md", ".rst"])
    return x.select(F.element_at(F.split(F.url_decode("path"), "/"), -1).alias("name"), "suffix", "text")


@query("""WITH p AS (SELECT artifact_id, string_agg(coalesce(kind, ''), chr(12) ORDER BY doc_id) AS t FROM documents WHERE artifact_id IS NOT NULL GROUP BY 1), l AS (SELECT artifact_id, unnest(string_split(t, chr(12))) AS text, generate_subscripts(string_split(t, chr(12)), 1) AS i FROM p)
SELECT artifact_id || '/page_' || format('{:04d}', i) AS page_id, text FROM l""")
def report_pages(spark: SparkSession, d: str) -> DataFrame:
    x = documents(spark, d).where("artifact_id is not null")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", F.coalesce("kind", F.lit("")).alias("k")))), lambda e: e.k)  # one word a unit, as a report is one text
    return harvest.pages(x.groupBy("artifact_id").agg(F.array_join(parts, "\f").alias("t")), "artifact_id", "t")


@query("SELECT page_id, qid FROM (SELECT DISTINCT p AS page_id, qid FROM (SELECT qid, unnest(positive_ids) AS p FROM query_spec WHERE qid IS NOT NULL) WHERE p IN (SELECT unit_id FROM documents))")
def judgements_of_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = documents(spark, d).where("unit_id is not null").select(F.col("unit_id").alias("page_id")).distinct()
    q = table(spark, d, "query_spec").where("qid is not null").select("qid", F.explode("positive_ids").alias("page_id")).distinct()
    return readers.judged_pages(pages, q.join(pages, "page_id", "left_semi")).select("page_id", "qid")


@query("SELECT vec_id AS doc_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings WHERE label < 3")
def gathered_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of given ids, after the files are checked against their manifest."""
    path = scratch(spark, "vectors")
    e = table(spark, d, "embeddings")
    sinks.write_once(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), path)
    manifest = stage(sinks.file_manifest(spark, path, "*.parquet"), "manifest")
    v = readers.verified_vectors(spark, path, manifest, e.where("label < 3").select(F.col("vec_id").alias("doc_id")))
    return v.select("doc_id", F.size("vector").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query("SELECT 'part' AS name, 'changed' AS problem UNION ALL SELECT 'more', 'extra'")
def file_problems(spark: SparkSession, d: str) -> DataFrame:
    """What a check of files against their manifest finds after one was changed and one added."""
    path = scratch(spark, "checked")
    sinks.write_files(spark.createDataFrame([("part", bytearray(b"one")), ("other", bytearray(b"two"))], "name string, content binary"), path)
    manifest = stage(sinks.file_manifest(spark, path), "manifest")
    sinks.write_files(spark.createDataFrame([("part", bytearray(b"won")), ("more", bytearray(b"x"))], "name string, content binary"), path)
    return sinks.verify_files(sinks.file_manifest(spark, path), manifest)


@query("SELECT true AS same, count(*) AS rows FROM documents")
def archive_twice(spark: SparkSession, d: str) -> DataFrame:
    """Two archives of one corpus in other layouts: the same files, byte by byte."""
    docs = documents(spark, d).select("doc_id", "text", "kind")
    one = sinks.archive_corpus(docs, scratch(spark, "archive"))
    two = sinks.archive_corpus(docs.repartition(5, "kind"), scratch(spark, "archive"))
    j = one.join(two.select("name", F.col("sha256").alias("other"), F.lit(1).alias("h")), "name", "full")
    return j.agg(F.bool_and(F.coalesce(F.col("sha256") == F.col("other"), F.lit(False))).alias("same"), F.sum("rows").alias("rows"))


@query("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def fetched_pages(spark: SparkSession, d: str) -> DataFrame:
    """The nations of each region as an API would give them, two a page by cursor, fetched into files in two runs."""
    path = scratch(spark, "pages")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name").orderBy("r_name", "n_name").collect()  # 25 rows
    remote = {r: [x.n_name for x in n if x.r_name == r] for r in sorted({x.r_name for x in n})}

    def client(endpoint: str, cursor: str | None) -> tuple[list[dict], str | None]:
        at = int(cursor or 0)
        return [{"r_name": endpoint, "n_name": x} for x in remote[endpoint][at : at + 2]], str(at + 2) if at + 2 < len(remote[endpoint]) else None

    first = list(remote)[:2]
    readers.fetch(spark, client, first, path)
    asked: list[str] = []
    readers.fetch(spark, lambda e, c: (asked.append(e), client(e, c))[1], list(remote), path)
    if set(asked) & set(first):
        raise AssertionError("a finished endpoint was asked again")
    return readers.api_pages(spark, path, "struct<r_name:string,n_name:string>").select("n_name", "r_name")


@query("""SELECT doc_id::VARCHAR AS doc_id, trim(CASE WHEN trim(coalesce(title, '')) = '' THEN coalesce(text, '') WHEN text IS NULL THEN trim(title) ELSE trim(title) || ' ' || text END) AS text FROM documents""")
def collection_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    q = table(spark, d, "query_spec").where("qid is not null")
    rel = q.select("qid", F.explode("positive_ids").alias("doc_id"), F.lit(1).alias("grade"))
    return readers.collection(docs.select("doc_id", "title", "text"), q.select("qid", "text"), rel)[0]


@query("SELECT DISTINCT kind AS dataset, source AS member FROM documents WHERE kind IS NOT NULL AND source IS NOT NULL")
def registry_members(spark: SparkSession, d: str) -> DataFrame:
    return readers.members(documents(spark, d).where("kind is not null").groupBy(F.col("kind").alias("dataset")).agg(F.collect_set("source").alias("members")))


@query("SELECT r_regionkey, r_name FROM region")
def admitted_table(spark: SparkSession, d: str) -> DataFrame:
    """A table by its logical split, past the list of denied names."""
    try:
        readers.parquet_table(spark, f"{d}/customer.parquet", ("customer",))
    except PermissionError:
        return readers.parquet_table(spark, f"{d}/{readers.physical_split('region')}.parquet", ("customer",))
    raise AssertionError("a denied name was opened")


@query("SELECT DISTINCT unit_id, length(unit_id) AS n FROM documents WHERE unit_id IS NOT NULL")
def encoded_once(spark: SparkSession, d: str) -> DataFrame:
    """The units of a log encoded in two runs of a stream, each unit once."""
    log, cache, ck = (scratch(spark, n) for n in ("log", "cache", "ck"))
    x = documents(spark, d).select("doc_id", "unit_id")
    step = ingest.encode_new(cache, "unit_id", lambda new: new.select("unit_id", F.length("unit_id").alias("n")))
    for part in (0, 1):
        x.where(F.pmod("doc_id", F.lit(2)) == part).write.mode("append").parquet(log)
        ingest.run_available(ingest.append_log(spark, log, x.schema), ck, step)
    return spark.read.parquet(cache).select("unit_id", "n")


@query(f"WITH {_KNN} SELECT count(*) AS rows, count(DISTINCT qid) AS queries, max(rank) AS depth FROM r WHERE rank <= 10")
def run_manifests(spark: SparkSession, d: str) -> DataFrame:
    from .retrieval import _vector_run

    return sinks.save_run(_vector_run(spark, d, 10), scratch(spark, "runs"), "knn", "labels").select("rows", "queries", "depth")


@query(f"SELECT 'documents' AS \"table\", count(*) AS rows FROM documents WHERE doc_id IS NOT NULL AND {S.key60('doc_id::VARCHAR')} % 2 = 0")
def transaction(spark: SparkSession, d: str) -> DataFrame:
    """A table that is written once: a second attempt is refused and leaves it as it was."""
    path = scratch(spark, "once")
    from millrace.functions import hashing as H

    half = documents(spark, d).select("doc_id").where(F.pmod(H.key60(F.col("doc_id").cast("string")), F.lit(2)) == 0)
    sinks.write_once(half, path)
    try:
        sinks.write_once(half.limit(0), path)
    except Exception as e:  # noqa: BLE001
        if "already exists" not in str(e):
            raise
        return spark.read.parquet(path).agg(F.lit("documents").alias("table"), F.count(F.lit(1)).alias("rows"))
    raise AssertionError("a table was written twice")
