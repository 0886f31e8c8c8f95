"""Train, validation and test splits that keep related records together.

Records are tied by a shared source or family, directly or through further
records. The sets of tied records are the connected components of a graph whose
nodes are the normalised sources and families: a record with several of them is
an edge. Components come from a distributed union-find: every partition builds a
local forest, forests are merged level by level, and only a forest of at most
``merge_bound`` edges is merged in a single task. A larger one is contracted by
star rounds (each node to the smallest neighbour), also with local forests in
between, until every edge points at its root. Both ways give the same roots.

The split is greedy: largest component first, into the split furthest below its
target. Components of one size are exchangeable, so the greedy runs on the
histogram of sizes, which has at most sqrt(2 * records) rows, and the members
of a size class follow a distributed numbering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.graph import FAN_IN, MERGE_BOUND, components
from millrace.operators.ranking import distributed_row_number
from millrace.session import salted_join, stage

#: Characters that count as blanks around a value.
BLANKS = " \t\r\n"
#: Default proportions of the splits, in percent.
SPLITS = (("train", 80), ("validation", 10), ("test", 10))


def bare(c: Column) -> Column:
    """Lower case without outer blanks."""
    return F.lower(F.trim(c, F.lit(BLANKS)))


def record_keys(records: DataFrame) -> DataFrame:
    """Distinct (qid, key): the known sources and families of each record.

    A source of '', 'unknown' or null and a family of '' or null tie nothing.
    Rows with a null qid are no records.
    """
    s, f = bare(F.col("source")), bare(F.col("family"))
    keys = F.array(
        F.when(~f.isin(""), F.concat(F.lit("f:"), f)),
        F.when(~s.isin("", "unknown"), F.concat(F.lit("s:"), s)),
    )
    return (
        records.where(F.col("qid").isNotNull())
        .select("qid", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))
        .distinct()
    )


def tied_records(records: DataFrame, merge_bound: int = MERGE_BOUND, fan_in: int = FAN_IN) -> DataFrame:
    """(qid, comp) for every record with a key: ``comp`` is the smallest qid of its set of tied records.

    Repeated rows count once; a record with neither source nor family is
    absent here, as it is tied to none.
    """
    pairs = stage(record_keys(records), "keys")
    first = pairs.groupBy("qid").agg(F.min("key").alias("a"))
    edges = pairs.withColumnRenamed("key", "b").join(first, "qid").where("a <> b").select("a", "b").distinct()
    roots = components(edges, merge_bound, fan_in)
    per_key = pairs.groupBy("key").agg(F.min("qid").alias("q"))
    keyed = per_key.join(roots, per_key.key == roots.node, "left").select("key", "q", F.coalesce("root", "key").alias("root"))
    keyed = stage(keyed, "keyed")
    comp = keyed.groupBy("root").agg(F.min("q").alias("comp"))
    of_key = salted_join(keyed.select("key", "root"), comp, ["root"], ["key"]).select(F.col("key").alias("a"), "comp")
    return salted_join(first, of_key, ["a"], ["qid"]).select("qid", "comp")


def tied_pairs(records: DataFrame, merge_bound: int = MERGE_BOUND) -> DataFrame:
    """(qid_a, qid_b): of each set of tied records its smallest qid with each other one."""
    return tied_records(records, merge_bound).where("qid <> comp").select(F.col("comp").alias("qid_a"), F.col("qid").alias("qid_b"))


def greedy_counts(histogram: list[tuple[int, int]], weights: list[int]) -> list[tuple[int, int, int, int]]:
    """Largest-first greedy over a histogram of component sizes.

    ``histogram`` has (size, number of components), ``weights`` the proportions.
    Each component goes to the split whose size is furthest below its target,
    the first of equal ones. Returns (size, split, first, last): the components
    numbered first..last within their size go to that split. Equal to placing
    the components one by one, in O(sizes * log(records)).
    """
    total, w_all = sum(s * c for s, c in histogram), sum(weights)
    need = [total * w for w in weights]  # in units of 1 / w_all records
    out = []
    for size, count in sorted(histogram, reverse=True):
        step = size * w_all
        # split i is chosen at needs need[i], need[i] - step, ...; take the `count` largest
        lo, hi = min(need) - step * (count + 1), max(need)
        taken = lambda level: sum(max(0, (n - level) // step + 1) for n in need)  # noqa: B023, E731
        while lo < hi:  # the highest level at which at least `count` are taken
            mid = (lo + hi + 1) // 2
            if taken(mid) >= count:
                lo = mid
            else:
                hi = mid - 1
        above = [max(0, (n - lo - 1) // step + 1) for n in need]  # strictly above the level
        rest, start = count - sum(above), 1
        for i, n in enumerate(need):
            k = above[i]
            if rest and n - k * step == lo:
                k, rest = k + 1, rest - 1
            need[i] = n - k * step
            if k:
                out.append((size, i, start, start + k - 1))
                start += k
    return out


def split_records(records: DataFrame, splits: tuple[tuple[str, int], ...] = SPLITS, merge_bound: int = MERGE_BOUND) -> DataFrame:
    """(qid, comp, split) for every record.

    Tied records share a split, sizes come near the proportions. A record
    without source and family is a set of its own. A set that is larger than a
    split's target still stays whole, so proportions are met as nearly as the
    sets allow. Empty input gives no rows; rows with a null qid are no records.
    """
    spark = records.sparkSession
    tied = tied_records(records, merge_bound)
    qids = records.where(F.col("qid").isNotNull()).select("qid").distinct()
    recs = stage(qids.join(tied, "qid", "left").select("qid", F.coalesce("comp", "qid").alias("comp")), "recs")
    sizes = recs.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    sizes = stage(sizes.withColumn("h", F.md5("comp")), "sizes")
    # at most sqrt(2 * records) rows: distinct sizes of disjoint sets
    histogram = [(int(r.size_), int(r.n)) for r in sizes.groupBy(F.col("size").alias("size_")).agg(F.count(F.lit(1)).alias("n")).collect()]
    plan = greedy_counts(histogram, [w for _, w in splits])
    rows = [(s, splits[i][0], a, b) for s, i, a, b in plan]
    schema = T.StructType([T.StructField("p_size", T.LongType()), T.StructField("split", T.StringType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
    ranges = spark.createDataFrame(rows, schema)
    ranked = distributed_row_number(sizes, ["size"], [], "h", ["comp"])
    placed = ranked.join(F.broadcast(ranges), (F.col("size") == F.col("p_size")) & F.col("rn").between(F.col("lo"), F.col("hi"))).select("comp", "split")
    return salted_join(recs, placed, ["comp"], ["qid"]).select("qid", "comp", "split")
