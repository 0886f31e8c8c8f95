"""The N best items of every group, by a mergeable bounded aggregation.

State of the aggregation: for every group the at most N best distinct items,
ordered by score descending, then item ascending. Two states merge by taking
both and cutting to N. Each map task folds its rows into such a state batch by
batch, so at most N rows of a group leave a task, however many rows a group
has; after the shuffle the same fold merges the states. A group that holds a
third of all rows therefore sends N rows from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import salted_join

N = 5


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Integers in the order of the strings, equal for equal ones."""
    enc = column.combine_chunks().dictionary_encode()
    if isinstance(enc, pa.ChunkedArray):
        enc = enc.combine_chunks()
    values = enc.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)  # bytes: the order of Spark's strings
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return rank[enc.indices.to_numpy(zero_copy_only=False)]


def cut(t: pa.Table, groups: int, n: int) -> pa.Table:
    """The state of the rows of ``t``: its first ``groups`` columns, then item, then score."""
    if not t.num_rows:
        return t
    score = t.column(groups + 1).to_numpy()
    item = _codes(t.column(groups))
    group = np.zeros(t.num_rows, np.int64)
    for i in range(groups):
        c = _codes(t.column(i))
        group = group * (int(c.max()) + 1) + c
        group = np.unique(group, return_inverse=True)[1]
    # an item counts once, with its highest score
    o = np.lexsort((-score, item, group))
    first = np.ones(len(o), bool)
    first[1:] = (group[o][1:] != group[o][:-1]) | (item[o][1:] != item[o][:-1])
    o = o[first]
    o = o[np.lexsort((item[o], -score[o], group[o]))]
    g = group[o]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return t.take(pa.array(o[place < n]))


def _fold(groups: int, n: int, hold: int = 200_000):
    """mapInArrow function: all rows of a partition into one state.

    Rows are folded whenever ``hold`` new ones or as many as the state has are
    at hand, so memory is the state and at most as much again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, new, rows = None, [], 0
        for b in batches:
            new.append(b)
            rows += b.num_rows
            if rows >= max(hold, state.num_rows if state is not None else 0):
                state = cut(pa.concat_tables([*([state] if state is not None else []), pa.Table.from_batches(new)]), groups, n)
                new, rows = [], 0
        if new or state is not None:
            state = cut(pa.concat_tables([*([state] if state is not None else []), *([pa.Table.from_batches(new)] if new else [])]), groups, n)
            yield from state.combine_chunks().to_batches(max_chunksize=20_000)

    return run


def top_items(rows: DataFrame, groups: list[str], item: str, score: str, n: int = N) -> DataFrame:
    """(groups, item, score): the ``n`` best distinct items of each group.

    An item that occurs several times in a group counts once, with its highest
    score; equal scores go to the smaller item; 0.0 and -0.0 are equal. Rows with a null in a
    group column or item, or with a null, NaN or infinite score, take no part.
    A group without any other row is absent. Further columns are dropped.
    """
    s = F.col(score).cast("double")
    ok = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    for c in (*groups, item):
        ok &= F.col(c).isNotNull()
    names = [*[F.col(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)], F.col(item).cast("string").alias("item"), (s + F.lit(0.0)).alias("score")]
    schema = ", ".join([*[f"g{i} string" for i in range(len(groups))], "item string", "score double"])
    x = rows.where(ok).select(*names)
    fold = _fold(len(groups), n)
    x = x.mapInArrow(fold, schema).repartition(*[f"g{i}" for i in range(len(groups))]).mapInArrow(fold, schema)
    return x.select(*[F.col(f"g{i}").alias(g) for i, g in enumerate(groups)], F.col("item").alias(item), F.col("score").alias(score))


def top_banked(points: DataFrame, bank: DataFrame, n: int = N) -> DataFrame:
    """(system, qid, doc_id, score): the best documents of the bank for each system and query.

    The bank's ids grow with the data, so the points meet them in a semi join on
    the id, salted by the query as one document may hold many points.
    """
    ids = bank.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    s = F.col("score")
    good = points.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))).select("system", "qid", "doc_id", "score")
    return top_items(salted_join(good, ids, ["doc_id"], ["qid", "system"], "left_semi"), ["system", "qid"], "doc_id", "score", n)
