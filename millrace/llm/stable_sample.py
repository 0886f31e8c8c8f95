"""A sample that is the same on every run and keeps its records as data grows.

Randomised block selection: the records of a stratum carry persistent sequence
numbers, cut into blocks of fixed size. A hash of stratum and block number
alone predetermines which positions of the block are chosen, also those not yet
filled, so a record that arrives later can never push out an earlier one.

The numbers are persistent because they are kept: ``numbered_records`` takes the
table of numbers given before and numbers only records that are not in it, after
the greatest number of their stratum. Without that table all records are
numbered by delivery, which gives the same numbers as long as new records come
in later deliveries only; anything that comes late, or without a delivery, needs
the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranking import distributed_row_number
from millrace.session import bounded_broadcast

from .related_splits import bare

BLOCK = 64
CHOSEN = 8
SEED = "millrace-sample-1"


def chosen_positions(seed: str, stratum: Column, block: Column, size: int, chosen: int) -> Column:
    """The first ``chosen`` positions of a block in its hashed order.

    Each position has a priority of 16 bits, four hex digits of an md5 of seed,
    stratum, block and position // 8; equal ones go by position.
    """
    hexes = F.concat(*[F.md5(F.concat_ws("|", F.lit(seed), stratum, block.cast("string"), F.lit(str(i)))) for i in range(-(-size // 8))])
    each = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.struct(F.substring(hexes, p * 4 + 1, F.lit(4)).alias("h"), p.alias("p")))
    return F.transform(F.slice(F.array_sort(each), 1, chosen), lambda e: e.p)


def numbered_records(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(source, qid, delivery, seq): each record of a source with its persistent sequence number from 0.

    A record is a qid within a source, compared without letter case and outer
    blanks; '', 'unknown' and null are one source, ''. ``known`` is an earlier
    result of this function: its rows stay as they are, also of records that are
    no longer delivered, and new records follow the greatest number of their
    source. New records are numbered by their first delivery, then md5(qid), then
    qid; a null delivery counts as 0. Rows with a null qid are no records.
    """
    s = bare(F.col("source"))
    x = records.where(F.col("qid").isNotNull()).select(F.when(s.isin("", "unknown") | s.isNull(), "").otherwise(s).alias("source"), "qid", F.coalesce("delivery", F.lit(0)).alias("delivery"))
    x = x.groupBy("source", "qid").agg(F.min("delivery").alias("delivery")).withColumn("h", F.md5("qid"))
    if known is None:
        return distributed_row_number(x, ["source"], ["delivery"], "h", ["qid"]).select("source", "qid", "delivery", (F.col("rn") - 1).alias("seq"))
    known = known.select("source", "qid", "delivery", "seq")
    new = distributed_row_number(x.join(known.select("source", "qid"), ["source", "qid"], "left_anti"), ["source"], ["delivery"], "h", ["qid"])
    ends = known.groupBy("source").agg((F.max("seq") + 1).alias("start"))
    new = new.join(bounded_broadcast(ends), "source", "left")
    return known.union(new.select("source", "qid", "delivery", (F.col("rn") - 1 + F.coalesce("start", F.lit(0))).alias("seq")))


def sample_numbered(numbered: DataFrame, chosen: int = CHOSEN, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """The rows of a table of numbers that are in the sample.

    The positions are computed once a block and joined to the numbers, each of
    which is in one row, so no key is hot.
    """
    blocks = numbered.groupBy("source").agg(F.max("seq").alias("last")).select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / block))).alias("b"))
    picked = blocks.select("source", "b", F.explode(chosen_positions(seed, F.col("source"), F.col("b"), block, chosen)).alias("p"))
    return numbered.join(picked.select("source", (F.col("b") * block + F.col("p")).alias("seq")), ["source", "seq"]).select("source", "qid", "delivery", "seq")


def stable_sample(records: DataFrame, known: DataFrame | None = None, chosen: int = CHOSEN, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """(source, qid, delivery, seq): ``chosen`` of each ``block`` consecutive records of every source.

    The same on every run and layout. With ``known``, the table that
    ``numbered_records`` gave before, all earlier choices stay, whatever comes
    later; without it they stay as long as new records are of later deliveries.
    A block that is not full yet yields the chosen ones of the positions it has.
    Empty input gives no rows.
    """
    return sample_numbered(numbered_records(records, known), chosen, block, seed)
