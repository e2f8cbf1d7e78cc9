"""Places in a total order over all rows, without a window that has no key."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows of a partition, in what monotonically_increasing_id gives.
_BITS = 33


def ranked(rows: DataFrame, order: list, place: str = "place") -> DataFrame:
    """rows with their place, from 1, in that order; order ends with a tie-breaker where places must be repeatable.

    A global sort deals rows by range to many tasks; each row keeps its place in its partition, to which the sizes of
    the partitions before are added. Only those sizes, one number a partition, come to the driver.
    """
    spark = rows.sparkSession
    dealt = cut(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", _BITS))
    sizes = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())
    before = accumulate((n for _, n in sizes), initial=0)
    offsets = spark.createDataFrame([(part, n) for (part, _), n in zip(sizes, before)], "__part long, __before long")
    inside = F.col("__at").bitwiseAND(F.lit((1 << _BITS) - 1))
    return dealt.join(F.broadcast(offsets), "__part").withColumn(place, F.col("__before") + inside + 1).drop("__part", "__at", "__before")


def hashed(rows: DataFrame, hash32: Column, key: str, group: str | None = None, place: str = "place", size: str = "group_size", bits: int = 10) -> DataFrame:
    """rows with their place, from 1, in order of an unsigned 32-bit hash, then key (of those of their group; null is a group too), and how many there are.

    The hash's leading bits are a block. Blocks are counted where rows are read, what comes before each is summed over
    (group, block) rows, and each task numbers single blocks: one shuffle of the rows, no sort of all, nothing written.
    """
    dealt = rows.withColumns({"__hash": hash32, "__group": F.xxhash64(group) if group else F.lit(0).cast("bigint")})
    dealt = dealt.withColumn("__block", F.coalesce(F.shiftright("__hash", 32 - bits), F.lit(-1)))
    counts = dealt.groupBy("__group", "__block").agg(F.count("*").alias("__held"))
    whole = Window.partitionBy("__group")
    before = F.coalesce(F.sum("__held").over(whole.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"__before": before, size: F.sum("__held").over(whole)}).drop("__held")
    inside = F.row_number().over(Window.partitionBy("__group", "__block").orderBy("__hash", key))
    return dealt.join(counts, ["__group", "__block"]).withColumn(place, F.col("__before") + inside).drop("__group", "__block", "__hash", "__before")


def ranked_within(rows: DataFrame, group: str, order: list, place: str = "place", size: str = "group_size") -> DataFrame:
    """rows with their place, from 1, among those of their group, and the group's size; null is a group too.

    As in ranked(), one global sort deals rows by range, so a group that holds most rows is spread over many tasks. What
    is counted of a group is one number for each partition it reaches into.
    """
    dealt = cut(rows.orderBy(group, *order).withColumn("__at", F.monotonically_increasing_id())).withColumns({"__part": F.shiftright("__at", _BITS), "__group": F.xxhash64(group)})
    inside = F.col("__at").bitwiseAND(F.lit((1 << _BITS) - 1))
    parts = dealt.groupBy("__group", "__part").agg(F.min(inside).alias("__first"), F.count("*").alias("__held"))
    whole = Window.partitionBy("__group")
    before = F.coalesce(F.sum("__held").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"__before": before, size: F.sum("__held").over(whole)}).drop("__held")
    return dealt.join(parts, ["__group", "__part"]).withColumn(place, F.col("__before") + inside - F.col("__first") + 1).drop("__group", "__part", "__at", "__first", "__before")
