"""When a worker that meets errors waits, goes on, or stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Errors in a row after which a worker stops, seconds that it waits after one, and between other polls.
MOST_ERRORS, WAIT_S, POLL_S = 5, 30, 10


def decided(events: DataFrame, key: str, at: str, tie: str, span: int = 3_600_000) -> DataFrame:
    """events (key, at, tie, outcome) with consecutive_errors, action and wait_s.

    Outcome `error` adds one; `job` (one was worked on, well or not) begins anew; others leave the count. At MOST_ERRORS
    the worker stops: that event's action is `stop`, and later ones are not its own any more (`stopped`). Order is by at,
    then tie. A key's events are counted in spans of `at`, each a window of its own, and what a span carries into the
    next comes from one row a span: a key with very many events is many tasks' work.
    """
    rows = events.withColumns({"__span": F.floor(F.col(at) / span), "__error": (F.col("outcome") == "error").cast("bigint"), "__anew": (F.col("outcome") == "job").cast("bigint")})
    inside = Window.partitionBy(key, "__span").orderBy(at, tie)
    rows = rows.withColumn("__run", F.sum("__anew").over(inside))
    ends = rows.groupBy(key, "__span", "__run").agg(F.sum("__error").alias("n")).groupBy(key, "__span").agg(F.max_by("n", "__run").alias("tail"), F.max("__run").alias("runs"))
    spans = Window.partitionBy(key).orderBy("__span")
    ends = ends.withColumn("group", F.sum((F.col("runs") > 0).cast("int")).over(spans))
    carried = F.sum("tail").over(Window.partitionBy(key, "group").orderBy("__span"))
    ends = ends.withColumn("out", carried).select(key, "__span", F.coalesce(F.lag("out").over(spans), F.lit(0)).alias("__in"))
    own = F.sum("__error").over(Window.partitionBy(key, "__span", "__run").orderBy(at, tie))
    counted = rows.join(ends, [key, "__span"]).withColumn("consecutive_errors", own + F.when(F.col("__run") == 0, F.col("__in")).otherwise(0))
    stops = counted.filter(F.col("consecutive_errors") >= MOST_ERRORS).groupBy(key).agg(F.min(F.struct(at, tie)).alias("__stop"))
    here = F.struct(at, tie)
    error = F.col("outcome") == "error"
    action = F.when(here > F.col("__stop"), "stopped").when(here == F.col("__stop"), "stop").when(error, "wait").otherwise("go on")
    found = counted.join(stops, key, "left").withColumn("action", action)
    wait = F.when(F.col("action").isin("stop", "stopped"), 0).when(error, WAIT_S).otherwise(POLL_S)
    return found.withColumn("wait_s", wait).select(*events.columns, "consecutive_errors", "action", "wait_s")
