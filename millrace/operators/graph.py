"""Connected components and families.

Components come from a distributed union-find: every partition builds a local
forest, ``fan_in`` whole forests are merged into one level by level, and only a
forest of at most ``merge_bound`` edges is merged in a single task. A larger one
is contracted by star rounds (each node to the smallest neighbour), also with
local forests in between, until every edge points at its root. Both ways give
the same roots. Edges are spread by both their ends and forests are merged
whole, so a node with very many edges is never one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import salted_join, stage

#: Edges that one task may merge: about 300 MB of Python dictionary.
MERGE_BOUND = 1_000_000
#: Forests merged into one at each level.
FAN_IN = 8


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition; one row (node, root) for each node that is no root."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x] = root
            x = p
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                if b < a:
                    a, b = b, a
                parent.setdefault(a, a)
                parent[b] = a
    rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
    for i in range(0, len(rows), 50_000):
        part = rows[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.string()), pa.array([r for _, r in part], pa.string())], ["a", "b"])


def _local_forests(edges: DataFrame) -> DataFrame:
    """(a, b, part): the forest of each partition and the partition's number."""
    return edges.select("a", "b").mapInArrow(_forest, "a string, b string").withColumn("part", F.spark_partition_id())


def _star_round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step over undirected edges (a, b)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = salted_join(both, low, ["a"], ["b"]).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = salted_join(down, least, ["a"], ["b"])
    small = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, merge_bound: int = MERGE_BOUND, fan_in: int = FAN_IN, partitions: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not the smallest of its component.

    Self edges and repeated edges are ignored, nulls are dropped, no edges give
    no rows. The root is the smallest node of the component.
    """
    spark = edges.sparkSession
    edges = stage(edges.where("a <> b").select("a", "b"), "edges")
    bound = max(1, merge_bound)
    # about a bound of edges for each task, at least a thousand
    width = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // max(1000, bound)))
    forest = stage(_local_forests(edges.repartition(width, "a", "b")), "forest")
    while True:
        n = forest.count()
        if n <= bound:
            # one task for at most merge_bound edges
            return stage(_local_forests(forest.repartition(1)), "roots").select(F.col("a").alias("node"), F.col("b").alias("root"))
        fewer = -(-width // fan_in)
        if fewer < width and n <= bound * fewer:
            width = fewer
            merged = stage(_local_forests(forest.repartition(width, F.floor(F.col("part") / fan_in))), "forest")
            if merged.count() < n:
                forest = merged
                continue
        stars = stage(_star_round(forest), "stars")
        # done when no root is itself below another node and each node has one root
        open_roots = stars.select(F.col("b").alias("a")).distinct().join(stars.select("a").distinct(), "a", "left_semi").limit(1).count()
        twice = stars.groupBy("a").count().where("count > 1").limit(1).count()
        if not open_roots and not twice:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        forest = stage(_local_forests(stars.repartition(width, "a", "b")), "forest")


def labelled(nodes: DataFrame, edges: DataFrame, merge_bound: int = MERGE_BOUND) -> DataFrame:
    """(node, root) for every row of ``nodes``; a node without edges is its own root."""
    roots = components(edges, merge_bound)
    n = nodes.where(F.col("node").isNotNull()).select("node").distinct()
    return n.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def star_edges(rows: DataFrame, node: str, key: str, hub: int | None = None) -> DataFrame:
    """Edges (a, b) that tie all nodes of a key through the smallest one: one row a node, never all pairs.

    Keys that tie more than ``hub`` nodes are left out where that is asked for.
    """
    x = rows.where(F.col(node).isNotNull() & F.col(key).isNotNull()).select(F.col(node).cast("string").alias("b"), F.col(key).alias("k")).distinct()
    first = x.groupBy("k").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    if hub is not None:
        first = first.where(F.col("n") <= hub)
    return salted_join(x, first.select("k", "a"), ["k"], ["b"]).where("a <> b").select("a", "b")


def families(rows: DataFrame, node: str, keys: list[str], hub: int | None = None, extra: DataFrame | None = None) -> DataFrame:
    """(node, root): nodes tied by equal values of any key column, or by further edges (a, b)."""
    edges = extra.select("a", "b") if extra is not None else None
    for k in keys:
        e = star_edges(rows, node, k, hub)
        edges = e if edges is None else edges.union(e)
    return labelled(rows.select(F.col(node).cast("string").alias("node")), edges)


def family_ids(labels: DataFrame, prefix: str = "fam:") -> DataFrame:
    """(node, root, family_id): the id is a hash of the root, the smallest member."""
    return labels.withColumn("family_id", F.concat(F.lit(prefix), F.substring(F.sha2("root", 256), 1, 20)))


def component_stats(labels: DataFrame, top: int = 10, large: int = 1000) -> DataFrame:
    """One row: components, nodes, largest, singletons, those above ``large``, and the ``top`` largest sizes in order."""
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    rank = sizes.orderBy(F.desc("n"), "root").limit(top).agg(F.array_join(F.transform(F.sort_array(F.collect_list("n"), asc=False), lambda x: x.cast("string")), ",").alias("top_sizes"))
    one = sizes.agg(F.count(F.lit(1)).alias("components"), F.sum("n").alias("nodes"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > large).alias("above"))
    return one.crossJoin(rank)  # one row each


def newest_of_family(rows: DataFrame, family: str, time: str, ident: str) -> DataFrame:
    """One row of each family: the latest, then the greatest id."""
    w = Window.partitionBy(family).orderBy(F.desc_nulls_last(time), F.desc(ident))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
