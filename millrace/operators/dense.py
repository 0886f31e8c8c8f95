"""Exact vector search and query encoding.

Vectors are ``array<float>``. Exact search blocks the stated query set: every
task scans its documents once in Arrow batches, with a matrix product for each
block of queries, and keeps the best k of each query, ties closed by id, before
anything is shuffled. Several variants of the queries share that one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import arrays as A
from millrace.functions import text as X
from millrace.session import BROADCAST_BYTES, bounded_broadcast

#: Queries in one matrix product, and bytes of queries that one pass over the documents takes.
QUERY_BLOCK, PASS_BYTES = 8192, 256 << 20
SCORE_DIGITS = 9


def _blocks(spark: SparkSession, rows: Iterator, block: int, of) -> Iterator[tuple[list, list]]:
    """Passes (broadcast blocks, rows) over a stated set of rows with vectors ``of`` each: at most PASS_BYTES of vectors in one pass."""
    blocks: list = []
    now: list = []
    taken: list = []

    def close() -> None:
        if now:
            blocks.append(spark.sparkContext.broadcast(np.array([of(r) for r in now], np.float64)))
            taken.extend(now)
            now.clear()

    size = 0
    for r in rows:
        now.append(r)
        size += 8 * len(of(r))
        if len(now) >= block or size >= PASS_BYTES:
            close()
        if size >= PASS_BYTES:
            yield blocks, taken
            blocks, taken, size = [], [], 0
    close()
    if blocks:
        yield blocks, taken


def _best_of(blocks: list, k: int, digits: int):
    """mapInArrow function over (doc_id, vector): (q, doc_id, score) of the k best of the partition for each query; q counts through the blocks."""

    def keep(q: np.ndarray, d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        o = np.lexsort((d, -s, q))
        q, d, s = q[o], d[o], s[o]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        return q[place < k], d[place < k], s[place < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [b.value for b in blocks]
        first = np.cumsum([0, *[len(q) for q in queries]])
        have: list = [None] * len(queries)
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), dtype=object) if pa.types.is_string(b.column(0).type) else b.column(0).to_numpy(zero_copy_only=False)
            lists = b.column(1)
            width = queries[0].shape[1]
            ok = np.array([v is not None and len(v) == width for v in lists.to_pylist()]) if lists.null_count or len(lists.flatten()) != width * len(lists) else np.ones(len(lists), bool)
            m = lists.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            ids = ids[ok]
            for a in range(0, len(ids), 4096):
                part, names = m[a : a + 4096], ids[a : a + 4096]
                for i, some in enumerate(queries):
                    s = np.round(some @ part.T, digits)
                    n = s.shape[1]
                    if n > k:  # everything at least as good as the k-th, so ties at the cut stay
                        cut = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                        q, j = np.nonzero(s >= cut)
                    else:
                        q, j = np.repeat(np.arange(len(s)), n), np.tile(np.arange(n), len(s))
                    new = q, names[j], s[q, j]
                    have[i] = keep(*new) if have[i] is None else keep(*(np.concatenate([x, y]) for x, y in zip(have[i], new, strict=True)))
        for i, best in enumerate(have):
            for a in range(0, len(best[0]) if best is not None else 0, 50_000):
                q, d, s = (x[a : a + 50_000] for x in best)
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64) + first[i]), pa.array(d.tolist(), b.column(0).type), pa.array(s)], ["q", "doc_id", "score"])

    return run


def knn(queries: DataFrame, docs: DataFrame, k: int = 10, exclude_self: bool = True, digits: int = SCORE_DIGITS, block: int = QUERY_BLOCK, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(keys, doc_id, score, rank): the k documents of greatest inner product for each query.

    ``queries`` is (keys, vector), a stated set that is taken in blocks of
    ``block``; ``docs`` is (doc_id, vector) of any size, read once for each
    PASS_BYTES of queries. Equal rounded scores go to the smaller id. Null vectors
    and those of another length take no part.
    """
    spark = docs.sparkSession
    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in keys)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    stated = queries.where(F.col("vector").isNotNull()).select(*keys, F.col("vector").cast("array<double>").alias("vector"))
    out = None
    for blocks, rows in _blocks(spark, stated.toLocalIterator(), block, lambda r: r.vector):
        names = spark.createDataFrame([(i, *[r[c] for c in keys]) for i, r in enumerate(rows)], f"q long, {kinds}")
        best = docs.select("doc_id", "vector").mapInArrow(_best_of(blocks, k + int(exclude_self), digits), f"q long, doc_id {id_type}, score double")
        one = best.join(bounded_broadcast(names), "q").select(*keys, "doc_id", "score")
        out = one if out is None else out.union(one)
    if out is None:
        return spark.createDataFrame([], f"{kinds}, doc_id {id_type}, score double, rank int")
    if exclude_self:
        out = out.where(F.col("qid").cast("string") != F.col("doc_id").cast("string"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def variants(made: Mapping[str, DataFrame]) -> DataFrame:
    """(variant, qid, vector) of several encodings (qid, vector) of the queries."""
    out = None
    for name, df in made.items():
        x = df.select(F.lit(name).alias("variant"), "qid", F.col("vector").cast("array<double>").alias("vector"))
        out = x if out is None else out.unionByName(x)
    return out


def encoded(makers: Mapping[str, Callable[[DataFrame], DataFrame]], texts: DataFrame) -> DataFrame:
    """(variant, qid, vector): what each maker makes of the queries (qid, text); a maker that loses or repeats a query is an error."""
    n = texts.select("qid").distinct().agg(F.count(F.lit(1)).alias("__n"))
    x = variants({name: make(texts) for name, make in makers.items()})
    whole = x.groupBy("variant").agg(F.count(F.lit(1)).alias("__r"), F.count_distinct("qid").alias("__d")).crossJoin(F.broadcast(n))  # one row
    whole = whole.withColumn("ok", F.assert_true((F.col("__r") == F.col("__n")) & (F.col("__d") == F.col("__n")), F.lit("a maker does not give each query one vector"))).where("ok is null")
    return x.join(F.broadcast(whole.select("variant")), "variant")  # as many rows as makers


def knn_variants(queries: DataFrame, docs: DataFrame, k: int = 10, exclude_self: bool = True) -> DataFrame:
    """(variant, qid, doc_id, score, rank): exact search of every variant in one pass over the documents."""
    return knn(queries, docs, k, exclude_self, keys=("variant", "qid"))


def nn_cosine(queries: DataFrame, pool: DataFrame, ks: tuple[int, ...] = (1, 5), exclude_self: bool = True) -> DataFrame:
    """(k, mean_cosine): mean over queries of the mean cosine to the k nearest of the pool."""
    unit = lambda df, c: df.select(c, A.l2_normalized(F.col("vector")).alias("vector"))
    near = knn(unit(queries, "qid"), unit(pool, "doc_id"), max(ks), exclude_self)
    each = near.select("qid", "score", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "rank").where("rank <= k")
    return each.groupBy("k", "qid").agg(F.avg("score").alias("m")).groupBy("k").agg(F.round(F.avg("m"), 9).alias("mean_cosine"))


def mean_distance(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: the mean over pairs of sqrt(2 - 2 cos), ``x`` being a stated set against all of ``y``.

    ``y`` is read once for each PASS_BYTES of ``x``; only sums leave the tasks.
    """
    spark = y.sparkSession
    unit = lambda df: df.where("vector is not null").select(A.l2_normalized(F.col("vector")).alias("v"))
    total = None

    def part(blocks: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, n = 0.0, 0
            stated = [b.value for b in blocks]
            for b in batches:
                m = np.array(b.column(0).to_pylist(), np.float64).reshape(b.num_rows, -1)
                for q in stated if len(m) else []:
                    for i in range(0, len(m), 4096):
                        s += float(np.sqrt(np.maximum(0.0, 2 - 2 * (q @ m[i : i + 4096].T))).sum())
                    n += q.shape[0] * len(m)
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([n], pa.int64())], ["s", "n"])

        return run

    for blocks, _ in _blocks(spark, unit(x).toLocalIterator(), QUERY_BLOCK, lambda r: r.v):
        one = unit(y).mapInArrow(part(blocks), "s double, n long")
        total = one if total is None else total.union(one)
    if total is None:
        total = spark.createDataFrame([], "s double, n long")
    return total.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("d"))


def energy_distance(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: 2 E|X-Y| - E|X-X'| - E|Y-Y'| of unit vectors."""
    xy, xx, yy = mean_distance(x, y), mean_distance(x, x), mean_distance(y, y)
    j = xy.select(F.col("d").alias("xy")).crossJoin(xx.select(F.col("d").alias("xx"))).crossJoin(yy.select(F.col("d").alias("yy")))  # one row each
    return j.select(F.round(2 * F.col("xy") - F.col("xx") - F.col("yy"), 6).alias("energy"))


def weighted_mean(rows: DataFrame, key: str, weight: Column | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """(key, vector): the weighted mean of the vectors of each key, of unit length.

    Sums run per dimension, combined before the shuffle. A mean of length zero
    gives the fallback vector (one row, ``vector``) or null.
    """
    w = F.lit(1.0) if weight is None else weight
    x = rows.select(key, w.alias("w"), F.posexplode("vector").alias("i", "x"))
    s = x.groupBy(key, "i").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("x"))
    v = s.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e.x).alias("v"))  # one element a dimension
    unit = v.select(key, F.when(A.norm(F.col("v")) > 1e-12, A.l2_normalized(F.col("v"))).alias("vector"))
    if fallback is None:
        return unit
    return unit.crossJoin(F.broadcast(fallback.select(F.col("vector").alias("__f")).limit(1))).select(key, F.coalesce("vector", "__f").alias("vector"))


def _held_lookup(lookup: DataFrame) -> tuple[DataFrame, np.ndarray] | None:
    """((token, row), matrix) of a lookup table that a worker may hold; None if it is larger than ``BROADCAST_BYTES``, or of vectors of several lengths or with nulls."""
    rows = lookup.select("token", F.col("vector").cast("array<double>").alias("vector")).where("token is not null and vector is not null")
    nulls = F.exists("vector", lambda x: x.isNull())
    c = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.count_if(nulls).alias("nulls")).first()
    if not c.n or c.low != c.high or not c.low or c.nulls or c.n * c.low * 8 > BROADCAST_BYTES:
        return None
    held = rows.toArrow()  # bounded
    matrix = held["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, c.low)
    kind = T.StructType([T.StructField("token", lookup.schema["token"].dataType), T.StructField("row", T.IntegerType())])
    return lookup.sparkSession.createDataFrame(list(zip(held["token"].to_pylist(), range(held.num_rows), strict=True)), kind), matrix


def pooled(tokens: DataFrame, lookup: DataFrame, modes: list[str]) -> DataFrame:
    """(qid, mode, vector): ``lookup_encode`` by several modes in one pass over the tokens; vectors of no length are null.

    Of a lookup table that a worker may hold only the numbers of its rows travel with the tokens, which
    come sorted by query, and the vectors are added up in Arrow batches. A larger one is joined.
    """
    held = _held_lookup(lookup)
    if held is None:
        counted = tokens.groupBy("qid", "token").agg(F.count(F.lit(1)).alias("c"))
        out = None
        for mode in modes:
            hit = counted.join(lookup, "token").select("qid", "vector", A.pool_weight(F.col("c"), mode).alias("w"))
            one = weighted_mean(hit, "qid", F.col("w")).select("qid", F.lit(mode).alias("mode"), "vector")
            out = one if out is None else out.union(one)
        return out
    ids, matrix = held
    spark = tokens.sparkSession
    rows_of = spark.sparkContext.broadcast(matrix)
    counted = tokens.join(F.broadcast(ids), "token").groupBy("qid", "row").agg(F.count(F.lit(1)).alias("c"))  # as many as BROADCAST_BYTES have vectors
    counted = counted.select("qid", "row", *[A.pool_weight(F.col("c"), m).alias(f"w{i}") for i, m in enumerate(modes)])
    kind = tokens.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = rows_of.value

        def told(keys: pa.Array, sums: list[np.ndarray], weights: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for mode, s, w in zip(modes, sums, weights, strict=True):
                v = s / w[:, None]
                length = np.sqrt((v * v).sum(axis=1))
                none = length <= 1e-12
                v /= np.where(none, 1.0, length)[:, None]
                at = pa.array(np.arange(len(v) + 1, dtype=np.int32) * m.shape[1])
                yield pa.RecordBatch.from_arrays([keys, pa.array([mode] * len(v), pa.string()), pa.ListArray.from_arrays(at, pa.array(v.ravel()), mask=pa.array(none))], ["qid", "mode", "vector"])

        key = sums = weights = None  # of the query that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            runs = pc.run_end_encode(b.column(0))
            keys, ends = runs.values, runs.run_ends.to_numpy()
            starts = np.concatenate([[0], ends[:-1]])
            x = m[b.column(1).to_numpy()]
            w = [b.column(2 + i).to_numpy() for i in range(len(modes))]
            s, t = [np.add.reduceat(x * y[:, None], starts, axis=0) for y in w], [np.add.reduceat(y, starts) for y in w]
            if key is not None:
                if keys[0].as_py() == key[0].as_py():
                    for i in range(len(modes)):
                        s[i][0] += sums[i][0]
                        t[i][0] += weights[i][0]
                else:
                    yield from told(key, sums, weights)
            yield from told(keys[:-1], [y[:-1] for y in s], [y[:-1] for y in t])
            key, sums, weights = keys[-1:], [y[-1:] for y in s], [y[-1:] for y in t]
        if key is not None:
            yield from told(key, sums, weights)

    return counted.repartition("qid").sortWithinPartitions("qid").mapInArrow(run, f"qid {kind}, mode string, vector array<double>")


def lookup_encode(tokens: DataFrame, lookup: DataFrame, mode: str = "sqrt", fallback: DataFrame | None = None) -> DataFrame:
    """(qid, vector): pooled rows of a lookup table (token, vector) for (qid, token).

    A token that occurs c times weighs f(c) by ``mode``. Queries none of whose
    tokens has a row are absent unless ``fallback`` gives their vector. A table
    that no worker may hold is joined, as vocabularies may be large.
    """
    enc = pooled(tokens, lookup, [mode]).select("qid", "vector")
    if fallback is None:
        return enc
    one = F.broadcast(fallback.select(F.col("vector").alias("__f")).limit(1))
    enc = enc.crossJoin(one).select("qid", F.coalesce("vector", "__f").alias("vector"))
    lost = tokens.select("qid").distinct().join(enc.select("qid"), "qid", "left_anti")
    return enc.union(lost.crossJoin(F.broadcast(fallback.select("vector").limit(1))))


def gram_rows(tokens: DataFrame, grams: DataFrame) -> DataFrame:
    """(qid, token): the tokens of (qid, tokens) and, for every run of tokens that is in ``grams`` (gram, token), its row too, at each place it occurs.

    A gram is its tokens joined by blanks, of any length. Runs meet the grams by an equi-join; of lengths that no gram has there are none.
    """
    plain = tokens.select("qid", F.explode("tokens").alias("token"))
    lengths = [r[0] for r in grams.select(F.size(F.split("gram", " ")).alias("n")).distinct().collect()]  # a few lengths
    text = tokens.select("qid", F.transform("tokens", lambda t: t.cast("string")).alias("t"))
    found = None
    for n in sorted(lengths):
        x = text.select("qid", F.explode(A.kgrams(F.col("t"), n)).alias("gram"))
        found = x if found is None else found.union(x)
    if found is None:
        return plain
    return plain.union(found.join(bounded_broadcast(grams.select("gram", "token")), "gram").select("qid", "token"))


def character_rows(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """(qid, token) for every place where a character gram of ``grams`` (gram, token) occurs inside a word of (qid, text), in lower case. The grams are the side that is broadcast."""
    lengths = sorted(r[0] for r in grams.select(F.length("gram").alias("n")).distinct().collect())  # a few lengths
    w = texts.select("qid", F.explode(X.words(F.lower("text"))).alias("w"))
    found = None
    for n in lengths:
        at = F.when(F.length("w") >= n, F.sequence(F.lit(1), F.length("w") - n + 1))
        x = w.select("qid", "w", F.explode(at).alias("i")).select("qid", F.substr("w", F.col("i"), F.lit(n)).alias("gram"))
        found = x if found is None else found.union(x)
    if found is None:
        return texts.sparkSession.createDataFrame([], f"qid {texts.schema['qid'].dataType.simpleString()}, token {grams.schema['token'].dataType.simpleString()}")
    return found.join(bounded_broadcast(grams.select("gram", "token")), "gram").select("qid", "token")


def segment_rows(sequences: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """(qid, tokens): the sequences of ids (qid, tokens) after a fixed list of merges (left, right, new), in the order of the list.

    As in byte-pair encoding: the first merge of the list that applies somewhere is
    made first, from left to right. Null sequences are empty.
    """
    rank = {(a, b): (i, new) for i, (a, b, new) in enumerate(merges)}
    kind = sequences.schema["qid"].dataType.simpleString()

    def merged(ids: list[int]) -> list[int]:
        while len(ids) > 1:
            best = min((rank[p] for p in zip(ids, ids[1:]) if p in rank), default=None)
            if best is None:
                break
            a, b, new = merges[best[0]]
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([merged(x or []) for x in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["qid", "tokens"])

    return sequences.select("qid", F.col("tokens").cast("array<long>").alias("tokens")).mapInArrow(run, f"qid {kind}, tokens array<long>")


def unseen_policy(rows: DataFrame, policy: str, least: int = 1) -> DataFrame:
    """(token, vector) of (token, vector, start, updates): rows with fewer than ``least`` updates get by ``policy`` their 'start', the 'mean' of the others or 'zero'.

    The mean runs over elements of rows that were updated often enough; without any it is 0. Null updates are none.
    """
    seen = F.coalesce("updates", F.lit(0)) >= least
    if policy == "start":
        return rows.select("token", F.when(seen, F.col("vector")).otherwise(F.col("start")).cast("array<double>").alias("vector"))
    zero = F.transform("vector", lambda x: F.lit(0.0))
    if policy == "zero":
        return rows.select("token", F.when(seen, F.col("vector").cast("array<double>")).otherwise(zero).alias("vector"))
    if policy != "mean":
        raise ValueError(f"no policy {policy}")
    one = rows.where(seen).select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = one.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e.x).alias("__m"))  # one element a dimension
    x = rows.crossJoin(F.broadcast(mean))  # one row
    return x.select("token", F.when(seen, F.col("vector").cast("array<double>")).when(F.size("__m") > 0, F.col("__m")).otherwise(zero).alias("vector"))


def prf(queries: DataFrame, docs: DataFrame, k: int = 3, alpha: float = 0.4, beta: float = 0.6) -> DataFrame:
    """(qid, vector): alpha * query + beta * mean of its k best documents, of unit length."""
    near = knn(queries, docs, k).select("qid", "doc_id").join(docs, "doc_id").select("qid", F.posexplode("vector").alias("i", "x"))
    mean = near.groupBy("qid", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = mean.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e.x).alias("m"))
    mixed = F.zip_with(F.col("vector"), F.col("m"), lambda a, b: a.cast("double") * alpha + b * beta)
    return queries.join(mean, "qid").select("qid", A.l2_normalized(mixed).alias("vector"))


def centroid_targets(pairs: DataFrame, docs: DataFrame, queries: DataFrame, mix: float = 0.5) -> DataFrame:
    """(qid, vector): the unit mean of the positives mixed with the query, of unit length; unresolved positives are left out."""
    c = weighted_mean(pairs.join(docs, "doc_id"), "qid").withColumnRenamed("vector", "c")
    return queries.join(c, "qid").select("qid", A.l2_normalized(F.zip_with("vector", "c", lambda a, b: a.cast("double") * (1 - mix) + b * mix)).alias("vector"))


def gram_sums(rows: DataFrame, x: str, y: str | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(X'X, X'Y or column sums, rows): each task sends one matrix, of d * d numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = h = None
        n = 0
        for b in batches:
            m = np.array(b.column(0).to_pylist(), np.float64)
            if not len(m):
                continue
            o = np.array(b.column(1).to_pylist(), np.float64)
            g = m.T @ m if g is None else g + m.T @ m
            h = m.T @ o if h is None else h + m.T @ o
            n += len(m)
        if g is not None:
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()]), pa.array([h.tobytes()]), pa.array([n], pa.int64()), pa.array([g.shape[0]], pa.int64()), pa.array([h.shape[1]], pa.int64())], ["g", "h", "n", "d", "e"])

    right = F.array(F.lit(1.0)) if y is None else F.col(y)
    cols = rows.where(F.col(x).isNotNull()).select(F.col(x).cast("array<double>").alias("x"), right.cast("array<double>").alias("y"))
    parts = cols.mapInArrow(run, "g binary, h binary, n long, d long, e long").toLocalIterator()
    g = h = None
    n = 0
    for p in parts:
        pg, ph = np.frombuffer(p.g).reshape(p.d, p.d), np.frombuffer(p.h).reshape(p.d, p.e)
        g, h, n = (pg.copy(), ph.copy(), p.n) if g is None else (g + pg, h + ph, n + p.n)
    if g is None:
        raise ValueError("no rows")
    return g, h, n


def ridge(rows: DataFrame, x: str, y: str, lam: float = 1.0, prior: np.ndarray | None = None) -> np.ndarray:
    """W of (X'X + lam I) W = X'Y + lam W0."""
    g, h, _ = gram_sums(rows, x, y)
    w0 = np.zeros_like(h) if prior is None else prior
    return np.linalg.solve(g + lam * np.eye(len(g)), h + lam * w0)


def principal_axes(rows: DataFrame, x: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): the k directions of greatest variance, each with its largest component positive."""
    g, s, n = gram_sums(rows, x)
    mean = s[:, 0] / n
    _, vectors = np.linalg.eigh(g / n - np.outer(mean, mean))
    axes = vectors[:, ::-1][:, :k].T
    return mean, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]


def matrix_frame(spark: SparkSession, m: np.ndarray) -> DataFrame:
    """(row, col, value) of a matrix."""
    rows = [(i, j, float(v)) for i, r in enumerate(np.atleast_2d(m)) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("value", T.DoubleType())]))
