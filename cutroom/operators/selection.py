"""Exact percentiles of columns of any size, by narrowing ranges of values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Ranges that a pass counts; a group of fewer values than SMALL is left to Spark's own percentile.
RANGES, SMALL = 512, 100_000


def percentiles(rows: DataFrame, column: str, shares: dict[str, float], keys: list[str] | None = None, small: int = SMALL) -> DataFrame:
    """keys, n, and for each name in shares the exact percentile, between neighbours by line; nulls are no values, and nan must not occur.

    A rank's value is looked for between a least and a most, at first those of the group. Each pass counts values in
    RANGES equal ranges between them, keeps the one that holds the rank, and goes on between the least and the most value
    in it, until these are one. Tasks hold counts of ranges only, however many values a group has and however often one of
    them comes. It takes a pass for each factor of RANGES between the spread of values and that of those near the rank:
    three to six, usually.
    """
    keys = keys or []
    held = rows.select(*keys, F.col(column).cast("double").alias("__x")).filter("__x IS NOT NULL")
    groups = cut(held.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))).filter("n > 0")
    few = groups.filter(F.col("n") <= small).select(*keys, "n")
    exact = {name: F.percentile("__x", F.lit(p)).alias(name) for name, p in shares.items()}
    out = _of(held, few, keys).groupBy(*keys, "n").agg(*exact.values()) if keys else held.groupBy(F.lit(1).alias("__one")).agg(F.count("*").alias("n"), *exact.values()).drop("__one")
    large = groups.filter(F.col("n") > small)
    if large.isEmpty():
        return out
    values = _ranked(held, large, keys, sorted({(name, p, up) for name, p in shares.items() for up in (0, 1)}))
    made = values.groupBy(*keys, "n").agg(*(_between(name, p).alias(name) for name, p in shares.items()))
    return out.unionByName(made) if keys else made


def _of(held: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """held with the columns of its group; null is a group too."""
    if not keys:
        return held.crossJoin(F.broadcast(groups))  # one row for each rank
    named = groups.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys))
    return held.join(named, same).drop(*(f"__of_{k}" for k in keys))


def _rank(p: float) -> Column:
    return (F.col("n") - 1).cast("double") * p


def _between(name: str, p: float) -> Column:
    at = lambda up: F.max(F.when((F.col("__name") == name) & (F.col("__up") == up), F.col("__value")))
    share = F.max(_rank(p) - F.floor(_rank(p)))
    return F.when((share == 0) | (at(0) == at(1)), at(0)).otherwise((1 - share) * at(0) + share * at(1))


def _ranked(held: DataFrame, groups: DataFrame, keys: list[str], wanted: list[tuple[str, float, int]]) -> DataFrame:
    """keys, n, __name, __up and __value: the value at the rank below (or above) each share."""
    asked = [groups.withColumns({"__name": F.lit(name), "__up": F.lit(up), "__rank": F.least(F.floor(_rank(p)) + up, F.col("n") - 1).cast("bigint")}) for name, p, up in wanted]
    state = asked[0]
    for more in asked[1:]:
        state = state.unionByName(more)
    ident = [*keys, "n", "__name", "__up"]
    state, done = cut(state.select(*ident, "__rank", "__lo", "__hi")), None
    while True:
        found = state.filter("__lo = __hi").select(*ident, F.col("__lo").alias("__value"))
        done = found if done is None else done.unionByName(found)
        open_ = state.filter("__lo < __hi")
        if open_.isEmpty():
            return done
        share = F.try_divide(F.col("__x") / 2 - F.col("__lo") / 2, F.col("__hi") / 2 - F.col("__lo") / 2)
        place = F.floor(F.when(F.isnan(share), 0.0).otherwise(F.coalesce(share, F.lit(0.0))) * (RANGES - 1)).cast("int")
        at = F.when(F.col("__x") == F.col("__lo"), 0).when(F.col("__x") == F.col("__hi"), RANGES).otherwise(place)  # ends lie apart: each pass narrows
        inside = _of(held, open_, keys).filter("__x BETWEEN __lo AND __hi").withColumn("__at", at)
        counts = inside.groupBy(*ident, "__rank", "__at").agg(F.count("*").alias("__n"), F.min("__x").alias("__least"), F.max("__x").alias("__most"))
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(*ident).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = counts.withColumn("__before", before).filter("__rank >= __before AND __rank < __before + __n")
        state = cut(hit.select(*ident, (F.col("__rank") - F.col("__before")).alias("__rank"), F.col("__least").alias("__lo"), F.col("__most").alias("__hi")))
