"""Shards by jump consistent hashing, with DataFrame functions only.

Law `key`: the key and the number of shards alone decide a row's shard; with one more shard, rows move
only into the new one, about one in (shards + 1). No ring table is kept.

Rows with equal keys share a shard; a null key is a key like any other. A null or empty text has size 1.
An empty table gives no rows; very long texts are measured whole. shard_documents() takes only doc_id and text, so other
columns may have any name; assign() and number() keep a caller's columns, whose names must not begin with two underscores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LCG = 2862933555777941757
_M16, _M32 = 0xFFFF, 0xFFFFFFFF
#: Blocks that a shard's rows are numbered in; a task holds one block of one shard.
BLOCKS = 256
#: Equal rows that are numbered as one.
RUN = 1 << 14


def key_bits(*columns: Column | str) -> tuple[Column, Column]:
    """Two unsigned 32-bit halves of the key's hash; null and '' differ."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string") if isinstance(c, str) else c.cast("string")), F.lit("-")) for c in columns]
    digest = F.md5(F.concat_ws("\x1f", *parts))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9))


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * _LCG + 1 modulo 2**64, in 32-bit halves and 16-bit limbs, so that nothing overflows."""
    ch, cl = _LCG >> 32, _LCG & _M32
    a0, a1 = lo.bitwiseAND(F.lit(_M16)), F.shiftright(lo, 16)
    b0, b1 = hi.bitwiseAND(F.lit(_M16)), F.shiftright(hi, 16)
    m16, m32 = (lambda c: c.bitwiseAND(F.lit(_M16))), (lambda c: c.bitwiseAND(F.lit(_M32)))
    p0, p1 = a0 * F.lit(cl), a1 * F.lit(cl)
    low = m32(p0) + F.shiftleft(m16(p1), 16) + F.lit(1)
    high = F.shiftright(p0, 32) + F.shiftright(p1, 16) + F.shiftright(low, 32)
    high = high + m32(a0 * F.lit(ch)) + F.shiftleft(m16(a1 * F.lit(ch)), 16)
    high = high + m32(b0 * F.lit(cl)) + F.shiftleft(m16(b1 * F.lit(cl)), 16)
    return m32(high), m32(low)


def jump(hi: Column, lo: Column, shards: int, steps: int | None = None) -> Column:
    """struct(shard, grown): the shard among `shards`, and among one more.

    Jumps from shard b to the next place where the key moves; that takes about ln(shards) steps, and shards + 1
    at most. A key that a usual number of steps is too few for (next to none is) goes on to that many.
    """
    steps = min(shards + 1, steps or 64 + 4 * math.ceil(math.log(shards + 1)))
    state = lambda h, l, shard, grown, j: F.struct(h.alias("hi"), l.alias("lo"), shard.alias("shard"), grown.alias("grown"), j.alias("j"))
    zero = F.lit(0).cast("bigint")

    def step(s: Column, _: Column) -> Column:
        h, l = _next(s["hi"], s["lo"])
        ahead = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(h, 1) + 1).cast("double"))).cast("bigint")
        moved = state(h, l, F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]), s["j"], ahead)
        return F.when(s["j"] <= shards, moved).otherwise(s)

    def shards_of(s: Column) -> Column:
        return F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown"))

    def finish(s: Column) -> Column:
        if steps > shards:
            return shards_of(s)
        return F.when(s["j"] > shards, shards_of(s)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), s, step, shards_of))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state(hi, lo, zero, zero, zero), step, finish)


def assign(df: DataFrame, shards: int, *keys: str, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """df with its shard, and the shard it would have with one more. A projection: no shuffle."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    placed = df.withColumn("__jump", jump(*key_bits(*keys), shards))
    return placed.withColumns({shard: F.col("__jump.shard"), grown: F.col("__jump.grown")}).drop("__jump")


def number(df: DataFrame, order: list[Column], shard: str = "shard", slot: str = "slot", blocks: int = BLOCKS, weight: Column | None = None) -> DataFrame:
    """df with a slot: 0, 1, 2 ... within each shard, by a hash of its order columns, then by order. A row of weight w takes w slots, of which it gets the first.

    A shard is numbered in blocks: their weights are summed over (shard, block) rows, of which there are
    shards * blocks, and each task numbers single blocks; no task holds a whole shard.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight
    dealt = df.withColumns({"__block": F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"), "__weight": weight})
    ahead = Window.partitionBy(shard).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(shard, "__block").agg(F.sum("__weight").alias("__n"))
    begins = sums.select(shard, "__block", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__begin"))
    within = Window.partitionBy(shard, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(begins, [shard, "__block"]).withColumn(slot, F.col("__begin") + F.sum("__weight").over(within) - F.col("__weight"))
    return placed.drop("__block", "__begin", "__weight")


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, run, held: rows equal in the first three, counted, in runs of RUN; held: how many rows the run from place `run` stands for."""
    text = F.col("text").cast("string")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    begun = equal.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(RUN).cast("bigint"))))
    return begun.withColumn("held", F.least(F.col("n") - F.col("run"), F.lit(RUN))).drop("n")


ORDER = ("doc_id", "text_crc32", "size", "run")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document.

    Equal rows are numbered in runs and come back from their count: neither a doc_id nor a text that very many rows have
    is one task's work.
    """
    numbered = number(assign(runs(docs), shards, "doc_id"), [F.col(c) for c in ORDER], weight=F.col("held"))
    each = numbered.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("held") - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col("at")).cast("bigint").alias("slot"), "grown_shard")
