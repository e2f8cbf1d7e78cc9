"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Documents are shuffled within their source by a hash of doc_id and text. Each gets a virtual finish time:
the source's words up to and with it, divided by the source's target. All are sorted by range of finish
time and truncated at the total budget, so every source is served in proportion to its target at any
point. A source may be served again from its start (`most` times at most); then its words count on.

A null or empty text has size 0 and takes nothing. A null source is a source of its own, the last. Rows
that agree in all but their place are served one after the other, so how many of them are taken is the
same in every run; which ones cannot be told apart. A very long text is one document like any other, taken
whole or not at all. An empty table gives no rows. Extra columns are ignored by plan() and kept by mix(),
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, original

#: A source's running totals are made in blocks in hash order, of about so many rows of all sources; a task holds one block of one source.
BLOCK_ROWS = 16384
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """sources (source, source_size) with weight and target.

    Weights repeat in code point order, null last. The budget, `share` of all sizes, is dealt by weight;
    no target is above `most` times its source's size, and the excess goes to the others by weight.
    The level at which this ends comes from one pass in order of size over weight. One row a source.
    """
    everything = Window.partitionBy()
    rows = sources.withColumn("__i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    rows = rows.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), (F.col("__i") - 1) % len(cycle) + 1))
    rows = rows.withColumns({"__cap": F.col("source_size") * float(most), "__all": F.sum("source_size").over(everything) * float(share)})
    rows = rows.withColumn("__full_at", F.col("__cap") / F.col("weight"))
    rows = rows.withColumn("__rank", F.row_number().over(Window.orderBy("__full_at", "__i")))
    before = Window.orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("__rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("__level", (F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("__open", F.min(F.when(F.col("__full_at") > F.col("__level"), F.col("__rank"))).over(everything))
    rows = rows.withColumn("__level", F.max(F.when(F.col("__rank") == F.col("__open"), F.col("__level"))).over(everything))
    target = F.when(F.col("__open").isNull() | (F.col("__rank") < F.col("__open")), F.col("__cap")).otherwise(F.col("weight") * F.col("__level"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _sized(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def _placed(doc_id: Column, text: Column, seed: str) -> Column:
    """60 bits that shuffle documents within a source."""
    parts = (F.coalesce(x.cast("string"), F.lit("")) for x in (doc_id, F.xxhash64(text.cast("string"))))
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 15), 16, 10).cast("bigint")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _queued(docs: DataFrame, cycle: tuple[int, ...], share: float, most: int, seed: str) -> tuple[DataFrame, float]:
    """Each row with its place in its source's queue, upto (the source's words up to and with it), source_size and target; and the budget.

    Rows that agree in all columns used are counted, partition by partition, and come back as so many rows at
    the end: a large group of them is neither one row nor one task.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), _sized(F.col("text")).alias("size"), _placed(F.col("doc_id"), F.col("text"), seed).alias("place"))
    rows = rows.withColumns({"source_key": _source_key(F.col("source")), "part": F.spark_partition_id()})
    items = cut(rows.groupBy("doc_id", "source", "source_key", "size", "place", "part").agg(F.count("*").alias("n")))
    words = F.col("size") * F.col("n")
    n_rows, total = items.agg(F.sum("n"), F.sum(words)).first()
    bits = min(24, max(6, ((n_rows or 0) // BLOCK_ROWS).bit_length()))
    aimed = targets(items.groupBy("source").agg(F.sum(words).alias("source_size")), cycle, share, most)
    aimed = aimed.withColumn("source_key", _source_key(F.col("source"))).drop("source", "weight")

    # running totals in order of place: blocks of places are summed first, then each block is gone through
    dealt = items.withColumn("block", F.shiftright("place", 60 - bits).cast("int"))
    ahead = Window.partitionBy("source_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("source_key", "block").agg(F.sum(words).alias("block_size"))
    begins = sums.select("source_key", "block", F.coalesce(F.sum("block_size").over(ahead), F.lit(0)).alias("begin"))
    within = Window.partitionBy("source_key", "block").orderBy("place", "size", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = dealt.join(begins, ["source_key", "block"]).withColumn("upto", F.col("begin") + F.sum(words).over(within))
    each = lined.withColumn("after", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    each = each.withColumn("upto", F.col("upto") - F.col("after") * F.col("size")).join(aimed, "source_key")
    return cut(each.select("doc_id", "source", "source_key", "size", "place", "upto", "source_size", "target")), share * (total or 0)


def _finish(turn: Column | int) -> Column:
    """Virtual finish time of a document in a turn of its source."""
    return F.when(F.col("target") > 0, (F.col("upto") + turn * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))


def _served(docs: DataFrame, cycle: tuple[int, ...], share: float, most: int, seed: str) -> DataFrame:
    """_queued's rows with copies: in how many turns the document comes before the cut.

    All turns of all documents are sorted by range of finish time; each range's words are summed, and the one
    in which the budget ends is gone through. One number a range, and one row, come to the driver.
    """
    queued, budget = _queued(docs, cycle, share, most, seed)
    order = ["finish", "place", "turn", "size"]
    turns = queued.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).select(_finish(F.col("turn")).alias("finish"), "place", "turn", "size").filter("size > 0")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = cut(turns.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    end = None
    for row in sorted(sorted_.groupBy("range").agg(F.sum("size").alias("size")).collect()):
        if row["size"] > budget:
            upto = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            end = sorted_.filter(F.col("range") == row["range"]).withColumn("sum", upto).filter(F.col("sum") > budget).orderBy(*order).first()
            break
        budget -= row["size"]

    def taken(turn: int) -> Column:
        if end is None:
            return F.lit(1)
        mine = F.struct(_finish(turn).alias("a"), F.col("place").alias("b"), F.lit(turn).alias("c"), F.col("size").alias("d"))
        last = F.struct(F.lit(end["finish"]).alias("a"), F.lit(end["place"]).cast("bigint").alias("b"), F.lit(end["turn"]).alias("c"), F.lit(end["size"]).cast("bigint").alias("d"))
        return F.when(mine < last, 1).otherwise(0)

    copies = sum((taken(t) for t in range(1, most)), taken(0)).cast("int")
    return queued.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))


def plan(docs: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0 to most) and taken (size * copies).

    Whole documents are taken; a source's taken words miss its target by less than two documents, and the
    total by less than one.
    """
    rows = _served(docs, cycle, share, most, seed).withColumn("taken", F.col("size") * F.col("copies"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """docs as mixed: each row as often as the mix takes it, with all its columns.

    The mix is planned without texts, which are joined to it once. Rows that agree in doc_id, source, size and
    text share a plan of how many of them are taken in each turn; they are numbered by partition, and the
    first so many are taken.
    """
    key = ["source_key", "size", "place"]
    by_turn = F.array(*(F.count_if(F.col("copies") > t) for t in range(most)))
    planned = cut(_served(docs, cycle, share, most, seed).groupBy(*key).agg(F.count("*").alias("n"), by_turn.alias("by_turn")).filter(F.col("by_turn")[0] > 0))
    column = {name: F.col(f"__{i}") for i, name in enumerate(docs.columns)}
    named = docs.toDF(*(f"__{i}" for i in range(len(docs.columns))))
    named = named.withColumns({"source_key": _source_key(column["source"]), "size": _sized(column["text"]), "place": _placed(column["doc_id"], column["text"], seed)})
    copies = F.size(F.filter("by_turn", lambda t: t >= F.col("nth")))
    taken = lambda rows: original(rows.filter(copies > 0).withColumn("turn", F.explode(F.sequence(F.lit(0), copies - 1))), docs)
    once = taken(named.join(planned.filter("n = 1"), key).withColumn("nth", F.lit(1).cast("bigint")))
    several = planned.filter("n > 1")
    if several.isEmpty():
        return once
    repeated = cut(named.join(several, key).withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    counts = repeated.groupBy(*key, "part").agg(F.count("*").alias("in_part"))
    ahead = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("in_part").over(ahead), F.lit(0))).drop("in_part")
    nth = F.col("before") + F.row_number().over(Window.partitionBy(*key, "part").orderBy("at"))
    return once.union(taken(repeated.join(counts, [*key, "part"]).withColumn("nth", nth)))
