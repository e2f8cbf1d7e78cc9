"""What the operators need from a session: tables in the shared folder and small helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, shared_folder
from .words import Text, pieces

__all__ = ["Shelf", "annotate", "apart", "bit_table", "cut", "looked_up", "original", "shared_folder", "spread", "table"]


class Shelf:
    """Tables written to the shared folder as Parquet and read again, so that lineage ends there; free() deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{uuid.uuid4()}.parquet"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def free(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[0])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def annotate(docs: DataFrame, fields: str, of_piece: Callable[[], Callable[[Text], list[pa.Array]]]) -> DataFrame:
    """docs with more columns, made from whole texts piece by piece; no shuffle.

    of_piece, called once a task, gives what makes the new columns' values of each piece. The columns of
    docs are kept as __0, __1 ... in order, so no name can clash; text is read as a string.
    """
    at = docs.columns.index("text")
    named = docs.toDF(*(f"__{i}" for i in range(len(docs.columns)))).withColumn(f"__{at}", F.col(f"__{at}").cast("string"))
    new = [f.name for f in T._parse_datatype_string(fields).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = of_piece()
        for batch in batches:
            for lo, hi, text in pieces(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(text)], names=[*part.schema.names, *new])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields)
    return named.mapInArrow(run, f"{kept}, {fields}")


def original(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, out of what annotate() made."""
    return rows.select(*(F.col(f"__{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(docs.schema.fields)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(column, n: int):
    """0 to n - 1 from a hash of the column: the salt that deals rows of a hot key to many tasks."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def looked_up(rows: DataFrame, by: str, values: DataFrame, salt: str = "key", salts: int = 32) -> DataFrame:
    """rows left-joined to values, whose `by` is unique; rows of a frequent `by` are dealt over `salts` tasks by another column, `salt`."""
    salted = rows.withColumn("__salt", spread(F.col(salt), salts))
    return salted.join(salted.select(by, "__salt").distinct().join(values, by), [by, "__salt"], "left").drop("__salt")


#: Log2 of the bits of a table by which rows are told from those that can't be wanted: 16 MB, whatever the number of keys.
SLOT_BITS = 27


def bit_table(keys: DataFrame, key: str) -> np.ndarray:
    """A table of 2**SLOT_BITS bits, in words of 64, that has a bit for each binary key, by its first four bytes. Distinct words reach the driver, 2**21 at most."""
    slot = F.shiftright(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("bigint"), 32 - SLOT_BITS)
    parts = keys.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63).cast("bigint")).cast("int").alias("bit"))
    words = parts.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    table = np.zeros(1 << (SLOT_BITS - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table


def in_table(table: np.ndarray, key: bytes) -> bool:
    """Whether bit_table() has the key's bit: always, if it was given the key."""
    slot = int.from_bytes(key[:4], "big") >> (32 - SLOT_BITS)
    return bool(int(table[slot >> 6]) >> (slot & 63) & 1)


def apart(rows: DataFrame, key: Column, keys: DataFrame, own: Column) -> tuple[DataFrame, DataFrame]:
    """rows whose key is certainly not in keys, and the others, among which few are not in keys either. No row is shuffled.

    A table of 2**SLOT_BITS bits, by a hash of the key, is broadcast in words of 64: its size is bounded whatever the
    number of keys. Names that begin with two underscores and a letter must be free in rows.
    """
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - SLOT_BITS)
    parts = lambda c: (F.shiftright(slot(c), 6).alias("__word"), slot(c).bitwiseAND(F.lit(63).cast("bigint")).cast("int").alias("__bit"))
    words = keys.select(*parts(own)).groupBy("__word").agg(F.expr("bit_or(shiftleft(1L, __bit))").alias("__bits"))
    marked = rows.select("*", *parts(key)).join(F.broadcast(words), "__word", "left").withColumn("__hit", F.expr("coalesce(shiftright(__bits, __bit) & 1, 0) = 1"))
    return tuple(marked.filter(test).select(*rows.columns) for test in ("NOT __hit", "__hit"))
