"""A vector index that is kept as a table, and searches of it.

The index is an inverted file: centres are fitted on a bounded sample, every row
of the collection belongs to the cell of its nearest centre, and a query looks
into the ``probes`` nearest cells. Rows of a cell are stored together, so a
search reads the row groups of the cells it needs. Within the cells inner
products are exact; with as many probes as cells the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import hashing as H
from millrace.session import bounded_broadcast, stage

from . import dense

#: Rows that centres are fitted on at most, those of the smallest hash; every row is indexed.
SAMPLE = 20_000
#: Rows of a cell that one task compares with the queries that look into it.
PIECE = 50_000


@dataclass
class Index:
    """Rows (doc_id, vector, cell) and the centres of the cells, one row of the matrix each."""

    rows: DataFrame
    centres: np.ndarray


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, which rows are in it): vectors of another length and with nulls are left out."""
    lists = column.to_pylist()
    ok = np.array([v is not None and len(v) == width and None not in v for v in lists], bool)
    return np.array([v for v, o in zip(lists, ok, strict=True) if o], np.float64).reshape(-1, width), ok


def fit_centres(docs: DataFrame, cells: int, seed: str = "ivf", sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means over at most ``sample`` rows of (doc_id, vector)."""
    head = docs.where("vector is not null").withColumn("__h", H.order_key(seed, F.col("doc_id"))).orderBy("__h", "doc_id").limit(sample).select("vector").collect()  # bounded
    width = max((len(r.vector) for r in head), default=1)
    x = np.array([r.vector for r in head if len(r.vector) == width and None not in r.vector], np.float64).reshape(-1, width)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    centres = x[:cells].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1) if len(centres) else np.zeros(0, int)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        centres = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centres)
    return centres


def _nearest_cells(centres, probes: int):
    """mapInArrow function over (id, vector): (id, vector, cell) for the ``probes`` nearest cells of each vector of the right length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        k = min(probes, len(c))
        for b in batches:
            m, ok = _matrix(b.column(1), c.shape[1])
            if not len(m) or not k:
                continue
            rows = np.flatnonzero(ok)
            s = m @ c.T
            near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(m), 1))
            at = pa.array(np.repeat(rows, near.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.reshape(-1).astype(np.int32))], ["id", "vector", "cell"])

    return run


def _in_cells(vectors: DataFrame, ident: str, centres: np.ndarray, probes: int) -> DataFrame:
    kind = vectors.schema[ident].dataType.simpleString()
    known = vectors.sparkSession.sparkContext.broadcast(centres)
    x = vectors.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    return x.mapInArrow(_nearest_cells(known, probes), f"id {kind}, vector array<float>, cell int").select(F.col("id").alias(ident), "vector", "cell")


def build(docs: DataFrame, path: str, cells: int, seed: str = "ivf") -> Index:
    """Index (doc_id, vector) below ``path``, which must not exist; rows are sorted by cell. Null vectors, null ids and vectors of another length are left out."""
    spark = docs.sparkSession
    centres = fit_centres(docs, cells, seed)
    x = _in_cells(docs, "doc_id", centres, 1).withColumn("__s", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 16)))  # a full cell may span several files
    x.repartitionByRange("cell", "__s").sortWithinPartitions("cell").drop("__s").write.parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that ``build`` wrote; the centres, of a number that is a parameter, come to the driver."""
    c = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return Index(spark.read.parquet(f"{path}/rows"), np.array([r.centre for r in c], np.float64).reshape(len(c), -1))


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 8, exclude_self: bool = True, digits: int = dense.SCORE_DIGITS, piece: int = PIECE) -> DataFrame:
    """(qid, doc_id, score, rank): the k documents of greatest inner product in the ``probes`` nearest cells of each query (qid, vector).

    Equal rounded scores go to the smaller id. A cell is cut into pieces of about
    ``piece`` rows and queries visit each of them, so no task holds a whole cell.
    """
    spark = index.rows.sparkSession
    kind, id_type = queries.schema["qid"].dataType.simpleString(), index.rows.schema["doc_id"].dataType.simpleString()
    sizes = index.rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("pieces"))
    asked = _in_cells(queries, "qid", index.centres, probes).join(bounded_broadcast(sizes), "cell")
    q = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(F.col("qid"), F.col("vector").alias("qv"), "cell", "piece")
    d = index.rows.join(bounded_broadcast(sizes), "cell").select("doc_id", "vector", "cell", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int").alias("piece"))
    most = k + int(exclude_self)

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qid", "doc_id", "score"]
        width = index_width
        (a, oka), (b, okb) = _matrix(left["qv"].combine_chunks(), width), _matrix(right["vector"].combine_chunks(), width)
        qid, doc = left["qid"].filter(pa.array(oka)), right["doc_id"].filter(pa.array(okb))
        at_q, at_d, score = [], [], []
        for i in range(0, len(a), 1024):
            s = np.round(a[i : i + 1024] @ b.T, digits)
            if s.shape[1] > most:  # everything at least as good as the last one wanted, so ties at the cut stay
                cut = -np.partition(-s, most - 1, axis=1)[:, most - 1 : most]
                x, y = np.nonzero(s >= cut)
            else:
                x, y = np.repeat(np.arange(len(s)), s.shape[1]), np.tile(np.arange(s.shape[1]), len(s))
            at_q.append(x + i)
            at_d.append(y)
            score.append(s[x, y])
        x, y, s = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (at_q, at_d, score))
        return pa.Table.from_arrays([qid.take(pa.array(x, pa.int64())), doc.take(pa.array(y, pa.int64())), pa.array(s, pa.float64())], names)

    index_width = index.centres.shape[1] if len(index.centres) else 1
    met = q.groupBy("cell", "piece").cogroup(d.groupBy("cell", "piece")).applyInArrow(meet, f"qid {kind}, doc_id {id_type}, score double")
    if exclude_self:
        met = met.where(F.col("qid").cast("string") != F.col("doc_id").cast("string"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall_sweep(index: Index, queries: DataFrame, probes: list[int], k: int = 10) -> DataFrame:
    """(probes, recall, candidates) for each number of probes: the share of the exact k that is found, and the rows compared for a query on average."""
    spark = index.rows.sparkSession
    exact = stage(dense.knn(queries, index.rows.select("doc_id", "vector"), k).select("qid", "doc_id"), "exact")
    n = exact.agg(F.count(F.lit(1)).alias("n"))
    sizes = index.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    out = None
    for p in probes:
        found = search(index, queries, k, p).select("qid", "doc_id")
        hit = found.join(exact, ["qid", "doc_id"]).agg(F.count(F.lit(1)).alias("hit"))
        seen = _in_cells(queries, "qid", index.centres, p).join(bounded_broadcast(sizes), "cell").groupBy("qid").agg(F.sum("size").alias("c")).agg(F.avg("c").alias("candidates"))
        one = hit.crossJoin(n).crossJoin(seen).select(F.lit(p).alias("probes"), F.round(F.try_divide("hit", "n"), 6).alias("recall"), F.round("candidates", 3).alias("candidates"))  # one row each
        out = one if out is None else out.union(one)
    return spark.createDataFrame([], "probes int, recall double, candidates double") if out is None else out
