"""Row numbers over groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import plan_bytes, stage

#: Bytes of rows, by the planner's estimate, that one bucket of a numbering is to hold.
BUCKET_BYTES = 64 << 20


def bucket_digits_for(df: DataFrame) -> int:
    """Hex digits so that 16**digits buckets hold about BUCKET_BYTES each, even if all rows are in one group; 2 at least."""
    digits = 2
    while digits < 6 and plan_bytes(df) > BUCKET_BYTES * 16**digits:
        digits += 1
    return digits


def range_numbers(df: DataFrame, group: list[str], order: list[Column], out: str = "rn") -> DataFrame:
    """Number the rows of every group from 1 in an order of any columns, which begins with those of the group and is total.

    The rows are sorted by ranges; each range numbers its part of a group and gets
    the count of the ranges before as offset, so a group may be of any size.
    """
    ranges = stage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*(group or [F.lit(1)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*group, "__part").orderBy(*order)
    left = ranges.withColumn("__rn", F.row_number().over(inside))
    cond = [left[k].eqNullSafe(offsets[k]) for k in [*group, "__part"]]
    return left.join(offsets, cond, "inner").select(*[left[c] for c in df.columns], (left["__rn"] + offsets["__off"]).cast("long").alias(out))


def distributed_row_number(df: DataFrame, group: list[str], lead: list[str], order_key: str, tie: list[str], out: str = "rn", bucket_digits: int | None = None) -> DataFrame:
    """Number the rows of every group from 1 in the order (lead, order_key, tie).

    ``order_key`` is a column of hex digits spread evenly, such as an md5. Its
    first ``bucket_digits`` digits cut each (group, lead) into buckets that
    follow the same order, so no task ever sorts more than one bucket: the
    counts of the buckets give each bucket's offset. Without ``bucket_digits``
    there are as many as the size of the rows asks for. The numbers do not depend
    on it or on the layout.

    Cost: one shuffle of the rows, one small aggregation. A group has at most
    16**bucket_digits counts for each value of ``lead``.
    """
    bucket_digits = bucket_digits_for(df) if bucket_digits is None else bucket_digits
    keys = [*group, *lead, "__b"]
    x = df.withColumn("__b", F.substring(F.col(order_key), 1, bucket_digits))
    counts = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(*lead, "__b").rowsBetween(Window.unboundedPreceding, -1) if group else Window.partitionBy(F.lit(1)).orderBy(*lead, "__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys).orderBy(order_key, *tie)
    left = x.withColumn("__rn", F.row_number().over(inside))
    cond = [left[k].eqNullSafe(offsets[k]) for k in keys]
    j = left.join(offsets, cond, "inner").select(*[left[c] for c in df.columns], (left["__rn"] + offsets["__off"]).cast("long").alias(out))
    return j
